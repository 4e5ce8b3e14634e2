"""A keyed table in hash buckets whose versions share the files of untouched buckets.

Each version is a manifest: one small JSON file that names, for every bucket, the write whose files hold it. An upsert reads and writes
the buckets that its keys fall into and nothing else; a new manifest takes the next number by a rename that fails if the number is taken,
so a version is there as a whole or not at all. The file system has to have such a rename (HDFS, ABFS, local disks; object stores without
it don't).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType

from ..functions.text import hashed_bucket


class Conflict(RuntimeError):
    """Another writer brought out a version in which buckets that this one rewrote had changed."""


def merged(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """incoming in place of existing rows of the same key, all other rows as they are. Of incoming rows of one key one stays (the greatest)."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(last_of(incoming, key))


def last_of(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the greatest by the other columns (variants by their JSON), so that repeated keys have a defined result. Taken in each task before the shuffle."""
    others = [c for c in rows.columns if c != key]
    order = [F.to_json(c) if isinstance(rows.schema[c].dataType, VariantType) else F.col(c) for c in others]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(key, *(F.col(f"_row.`{c}`") for c in others)).select(*rows.columns)


class BucketTable:
    """Rows of `schema` (no column `bucket`), unique by `key`, in a fixed number of buckets by the key's hash.

    The number of buckets counts when the table is made: it bounds a manifest's length and what the driver holds, and the rows of a bucket
    are the least that an upsert rewrites. Older versions than the last and `keep` more lose their files as the next one comes out, except
    those that a reader has pinned. Two writers whose buckets differ both succeed; else the later one fails with Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = 64, keep: int = 1, pin_hours: float = 24):
        self.spark, self.at, self.key, self.buckets, self.keep, self.pin_hours = spark, path.rstrip("/"), key, buckets, keep, pin_hours
        self.schema = StructType.fromDDL(schema)
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.at).getFileSystem(self.conf)

    def bucket(self, buckets: int | None = None) -> Column:
        return hashed_bucket(F.col(self.key).cast("string"), buckets or self.manifest()["buckets"])

    def _names(self, folder: str) -> list[str]:
        at = self.path(f"{self.at}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        return sorted(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, and files: bucket -> the write that holds it. Before the first write: version 0 without files."""
        have = self.versions()
        if not have and version is None:
            return {"version": 0, "buckets": self.buckets, "files": {}}
        version = have[-1] if version is None else version
        stream = self.fs.open(self.path(f"{self.at}/versions/v{version:010}.json"))
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found | {"files": {int(b): w for b, w in found["files"].items()}}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets. The files are fixed by now: later writes don't show."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        files = manifest["files"]
        paths = [f"{self.at}/data/{files[b]}/bucket={b}" for b in sorted(files if buckets is None else set(buckets) & set(files))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame, manifest: dict | None = None) -> list[int]:
        """The buckets that rows (with the key) fall into: at most the number of buckets."""
        return [r[0] for r in rows.select(self.bucket((manifest or self.manifest())["buckets"]).alias("b")).distinct().collect()]

    def upsert(self, incoming: DataFrame) -> int:
        """Puts incoming rows in place of those of the same key, adds the others, and gives the new version. incoming is read twice: stage it where it is dear."""
        base = self.manifest()
        some = self.touched(incoming, base)
        return self._put(base, merged(self._rows(base, some), self.shaped(incoming), self.key), some) if some else base["version"]

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of these keys; buckets that hold none of them stay untouched."""
        base = self.manifest()
        some = self.touched(keys, base)
        return self._put(base, self._rows(base, some).join(keys.select(self.key).distinct(), self.key, "left_anti"), some) if some else base["version"]

    def reset_to(self, rows: DataFrame) -> int:
        """The table with these rows and no others, in as many buckets as were asked for now."""
        return self.write(lambda _: last_of(self.shaped(rows), self.key), self.buckets)

    def write(self, make: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> int:
        """A version of make(all rows): every bucket is written."""
        base = self.manifest()
        return self._put(base, make(self._rows(base)), None, buckets)

    def shaped(self, rows: DataFrame) -> DataFrame:
        """rows with the table's columns in their order; columns that are missing are null, others go."""
        return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema))

    def _put(self, base: dict, rows: DataFrame, some: list[int] | None, buckets: int | None = None) -> int:
        """Writes rows (of the buckets `some`; None: of all) and brings out the version in which they count."""
        write, buckets = uuid.uuid4().hex, buckets or base["buckets"]
        try:
            # large buckets are split over files, small ones share a task
            self.shaped(rows).withColumn("bucket", self.bucket(buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.at}/data/{write}")
            found = {int(n[7:]) for n in self._names(f"data/{write}") if n.startswith("bucket=")}
            if some is not None and not found <= set(some):
                raise ValueError("rows changed between two readings; stage them first")
            while True:
                now = self.manifest()
                if now["version"] != base["version"] and (some is None or now["buckets"] != buckets or any(now["files"].get(b) != base["files"].get(b) for b in some)):
                    raise Conflict(f"{self.at} was written to by another writer; run it again")
                others = {} if some is None else {b: w for b, w in now["files"].items() if b not in set(some)}
                version = now["version"] + 1
                if not found:
                    self._delete(f"data/{write}")
                if self._publish({"version": version, "buckets": buckets, "files": others | dict.fromkeys(sorted(found), write)}):
                    break
        except BaseException:
            self._delete(f"data/{write}")
            raise
        self._vacuum()
        return version

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest took its number; False if another one has it."""
        aside, number = self.path(f"{self.at}/versions/.{uuid.uuid4().hex}"), self.path(f"{self.at}/versions/v{manifest['version']:010}.json")
        out = self.fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(aside, number, options)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if not self.fs.exists(number):
                raise e
            return False
        return True

    def _delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.at}/{name}"), True)

    @contextmanager
    def pinned(self, version: int | None = None) -> Iterator[int]:
        """Gives a version's number; no writer deletes its files until the block ends, or pin_hours are over (a reader that was lost)."""
        version = self.manifest(version)["version"]
        name = f"pins/{version}-{uuid.uuid4().hex}"
        self.fs.create(self.path(f"{self.at}/{name}"), False).close()
        try:
            yield version
        finally:
            self._delete(name)

    def _vacuum(self) -> None:
        """Deletes manifests that no one needs, and files that only they name."""
        have, oldest = self.versions(), (time.time() - 3600 * self.pin_hours) * 1000
        pins = self.fs.listStatus(self.path(f"{self.at}/pins")) if self.fs.exists(self.path(f"{self.at}/pins")) else []
        held = {int(p.getPath().getName().split("-")[0]) for p in pins if p.getModificationTime() >= oldest}
        kept = [v for i, v in enumerate(have) if i >= len(have) - 1 - self.keep or v in held]
        live = {x for v in kept for x in self.manifest(v)["files"].items()}
        for v in set(have) - set(kept):
            for b, w in set(self.manifest(v)["files"].items()) - live:
                self._delete(f"data/{w}" if w not in {x[1] for x in live} else f"data/{w}/bucket={b}")
            self._delete(f"versions/v{v:010}.json")

    def changes(self, old: int, new: int) -> DataFrame:
        """Per bucket whose files differ between two versions: bucket, rows (in the new one), replaced (keys in both with other content), added, removed."""
        a, b = self.manifest(old), self.manifest(new)
        some = [k for k in set(a["files"]) | set(b["files"]) if a["files"].get(k) != b["files"].get(k)]
        content = lambda rows: F.xxhash64(*(F.to_json(f.name) if isinstance(f.dataType, VariantType) else F.col(f.name) for f in rows.schema if f.name != self.key))
        before, after = (rows.select(F.col(self.key), content(rows).alias(name)) for rows, name in ((self._rows(a, some), "_old"), (self._rows(b, some), "_new")))
        both = before.join(after, self.key, "full").withColumn("bucket", self.bucket(b["buckets"]))
        new_, old_ = F.col("_new").isNotNull(), F.col("_old").isNotNull()
        return both.groupBy("bucket").agg(
            F.count_if(new_).alias("rows"), F.count_if(new_ & old_ & (F.col("_new") != F.col("_old"))).alias("replaced"), F.count_if(new_ & ~old_).alias("added"), F.count_if(~new_ & old_).alias("removed")
        )
