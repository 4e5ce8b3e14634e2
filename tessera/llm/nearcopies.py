"""Near copies by what texts share: documents whose sets of word shingles have a Jaccard similarity of LEAST or more are linked, and links make groups.

All such pairs are found. Two alike sets of at most R shingles differ in at most D = 2R (1 - LEAST) / (1 + LEAST) of them. Dealt by their hashes over
D + 1 + z parts, they have more than z parts that are the same in both, so unless more than z parts of both are empty, a part that holds something
is the same: sets meet by the contents of their parts, which texts that merely share a passage hardly ever do. Sets with more than z empty parts also
meet by the shingles of a prefix: under any one order of all shingles, alike sets share one among the first n - ceil(LEAST * n) + 1 of each.
Shingles that a sample of documents shows to be common are left out of the parts, which keeps both bounds, and come last in the order; what the
sample misses costs time and changes no result. Alike sets have several parts in common, not just one, so each set leaves out as many of its keys less
one, those that the most sets have: pairs that share a passage and no more seldom meet. Each pair that meets is compared in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest
from xxhash import xxh64_digest as digest

from . import common, simhash
from .components import connected_components

#: Words of a shingle; the least similarity as a fraction.
WIDTH, SEED, LEAST = 5, 42, (4, 5)
ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c").__contains__
#: About so many documents show which shingles are common; so many documents of them have a common one; so many are put last.
SAMPLE, COMMON_DOCS, COMMON = 4_096, 3, 65_536
#: Sizes of sets that meet as one class go up to so many times those of the class before.
CLASS = 3 / 2
#: Bits of the sieve that keeps keys of one set alone from moving: a bound on what goes to every task (4 MB).
SIEVE = 1 << 25
#: Bits of a set's bitmap for each shingle, and the most there are (they travel with each key of a set); sets of a block.
BITS, MOST_BITS, BLOCK = 4, 512, 1_024
#: Sets of a bucket beyond which each is compared to one partner at a time, until a round joins few of them or there were so many rounds.
CROWD, ROUNDS = 16, 3
#: Sets that a task remembers while it compares pairs.
REMEMBERED = 64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of a whole text's word shingles: their 64-bit XXH64 hashes, sorted. A-Z count as a-z, words are what ASCII white space parts.

    Fewer words than `width` are one shingle; no word: none.
    """
    found, carry = [], []
    for block in common.blocks(text, space=ASCII_SPACE) if text else ():
        words = carry + block.encode("utf-8", "surrogatepass").lower().split()
        if len(words) >= width:
            parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found.append(np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in parts]), ">u8").astype(np.uint64)))
            words = words[len(words) - width + 1 :]
        carry = words
    if not found and carry:
        found.append(np.frombuffer(digest(b" ".join(carry), SEED), ">u8").astype(np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def alike(shared, a, b):
    """Whether sets of a and b members, of which `shared` are in both, have a similarity of LEAST: numbers or Columns."""
    return shared * (LEAST[0] + LEAST[1]) >= (a + b) * LEAST[0]


@lru_cache(1 << 10)
def turn(top: int) -> int:
    """0 or 1 by turns for the largest sizes of classes."""
    at, k = 1, 0
    while at < top:
        at, k = max(at + 1, int(at * CLASS)), k + 1
    return k % 2


@lru_cache(1 << 16)
def meetings(n: int) -> list[tuple[int, int, int]]:
    """The classes (top, parts, spare) in which a set of n shingles meets others: its own, and the next one if a set there can be alike.

    Of `parts` parts more than `spare` are the same in two alike sets of a class; top is the largest size in it.
    """
    top = 1
    while top < n:
        top = max(top + 1, int(top * CLASS))
    tops = [top] + [max(top + 1, int(top * CLASS))] * alike(n, n, top + 1)
    out = []
    for r in tops:
        differ = 2 * r * (LEAST[1] - LEAST[0]) // (LEAST[1] + LEAST[0])
        spare = 2 + differ // 9
        out.append((r, differ + 1 + spare, spare))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred so that each bit depends on all (the finalizer of splitmix64, whose constants are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def common_shingles(rows: DataFrame) -> np.ndarray:
    """The shingles that are in COMMON_DOCS or more documents of a sample, the most common last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(shingles(text.as_py()).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])

    sample = common.bounded_sample(rows, F.col("_row"), SAMPLE).select("text")
    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_DOCS)
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in reversed(found)], np.int64).view(np.uint64)


class Keys:
    """The numbers by which sets meet; `last` are the common shingles, the most common last."""

    def __init__(self, last: np.ndarray):
        self.rank = np.argsort(last)
        self.last = last[self.rank]

    def ranked(self, have: np.ndarray) -> np.ndarray:
        """0 for a shingle that isn't common, else its place from 1 on."""
        if not len(self.last):
            return np.zeros(len(have), np.int64)
        at = np.minimum(np.searchsorted(self.last, have), len(self.last) - 1)
        return np.where(self.last[at] == have, self.rank[at] + 1, 0)

    def of(self, have: np.ndarray) -> np.ndarray:
        return self.counted(have)[0]

    def counted(self, have: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The numbers, and for even and odd ones how many at least an alike set shares. A class has either, by turns, so a set's two classes differ."""
        rank, n, out, least = self.ranked(have), len(have), [], [1, 1]
        own = have[rank == 0]
        for top, parts, spare in meetings(n) if n else ():
            odd = turn(top)
            place = (own % np.uint64(parts)).astype(np.int64)
            held = np.flatnonzero(np.bincount(place, minlength=parts))
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, place, own)
            tag = np.uint64(top << 32)
            found = [mixed(mixed(tag + held.astype(np.uint64) + np.uint64(1)) ^ sums[held])]
            if parts - len(held) > spare:
                first = have[np.lexsort((have, rank))[: n - -(-LEAST[0] * n // LEAST[1]) + 1]]
                found.append(mixed(mixed(np.array([tag])) ^ first))
            # more than `spare` parts are the same; no more of them are empty in both than are empty here
            least[odd] = max(1, spare + 1 - (parts - len(held)))
            out += [x & ~np.uint64(1) | np.uint64(odd) for x in found]
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64), least


def bitmap(have: np.ndarray) -> np.ndarray:
    """A set as bits: whether the shingles whose hashes have this remainder are odd in number. How many there are is a power of two: the left half XOR the
    right is the bitmap of half the bits. A shingle that one of two sets lacks changes one bit, so they differ in at least as many shingles as bits."""
    n = min(MOST_BITS, max(64, 1 << (BITS * len(have)).bit_length()))
    bits = np.bincount((have % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps, folded to so many words each."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def matrix(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps, folded to the fewest bits among them."""
    least = min(map(len, bitmaps)) // 8
    return np.concatenate([folded(np.frombuffer(b, np.uint64)[None], least) for b in bitmaps])


def perhaps_alike(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Which of all pairs may be alike: each bit in which they differ is a shingle that they don't share."""
    words = min(bits_a.shape[1], bits_b.shape[1])
    a, b = folded(bits_a, words), folded(bits_b, words)
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 20) // max(1, len(b) * words))
    for at in range(0, len(a), step):
        own = n_a[at : at + step, None]
        differ = np.bitwise_count(a[at : at + step, None, :] ^ b).sum(axis=2, dtype=np.int64)
        out[at : at + step] = alike(np.minimum((own + n_b - differ) // 2, np.minimum(own, n_b)), own, n_b)
    return out


def key_sieve(keys: DataFrame) -> np.ndarray:
    """The classes, of SIEVE, that keys (their only column) are in, as bits; SIEVE / 64 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(SIEVE // 64, np.uint64)
        for batch in batches:
            kind = mixed(np.asarray(batch.column(0)).view(np.uint64)) % np.uint64(SIEVE)
            np.bitwise_or.at(words, (kind >> np.uint64(6)).astype(np.int64), np.uint64(1) << (kind & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at].view(np.int64))], ["at", "bits"])

    found = keys.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(SIEVE // 64, np.uint64)
    words[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(np.uint64)
    return words


def sieved(sets: DataFrame, words: np.ndarray) -> DataFrame:
    """The sets, keys last, with those keys that are in a class of the sieve; sets that keep none go. Nothing moves."""
    shared = sets.sparkSession.sparkContext.broadcast(words)
    others = [c for c in sets.columns if c != "keys"]
    rows = sets.select(*others, "keys")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            keys, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            kind = mixed(keys.view(np.uint64)) % np.uint64(SIEVE)
            held = (shared.value[(kind >> np.uint64(6)).astype(np.int64)] >> (kind & np.uint64(63))) & np.uint64(1) == 1
            left = np.concatenate([[0], np.cumsum(held)])[ends]
            out = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(keys[held]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*others, "keys"]).filter(pa.array(np.diff(left) > 0))

    return rows.mapInArrow(run, schema)


def rarest(met: DataFrame) -> DataFrame:
    """Of buckets' sets (key, even, odd, _row, n, need_even, need_odd; stored) those that two alike sets can't do without: (key, _row, n).

    even and odd: how many keys of either kind a bucket stands for; need_: how many a set shares with any alike one. Of one order of all buckets,
    the smallest first, take the first that two alike sets share: from there on each of them has as many keys as it shares, or more.
    """
    sized = met.join(met.groupBy("key").agg(F.count("*").alias("size")), "key")
    from_here = Window.partitionBy("_row").orderBy(F.desc("size"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sized.select("*", *(F.sum(c).over(from_here).alias(f"{c}_here") for c in ("even", "odd")))
    enough = [(F.col(c) > 0) & (F.col(f"{c}_here") >= F.col(f"need_{c}")) for c in ("even", "odd")]
    return sums.filter(enough[0] | enough[1]).select("key", "_row", "n")


def blocked(met: DataFrame) -> DataFrame:
    """(key, lane, _row, n, group, bits) in rows of arrays, one for each key and lane; sorted by both within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            edge = cuts(held)
            if len(edge) > 2:
                yield gathered(held.slice(0, edge[-2]), edge[:-1])
                held = held.slice(edge[-2])
        if held is not None and len(held):
            yield gathered(held, cuts(held))

    def cuts(t: pa.Table) -> np.ndarray:
        key, lane = np.asarray(t.column(0)), np.asarray(t.column(1))
        return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (lane[1:] != lane[:-1])) + 1, [len(key)]])

    def gathered(t: pa.Table, edge: np.ndarray) -> pa.RecordBatch:
        first, ends = pa.array(edge[:-1]), pa.array(edge, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(t.column(c).chunks)) for c in range(2, 6)]
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(first), t.column(1).combine_chunks().take(first), *lists], ["key", "lane", "rows", "ns", "groups", "bits"])

    rows = met.select("key", "lane", "_row", "n", "group", "bits").repartition("key", "lane").sortWithinPartitions("key", "lane")
    return rows.mapInArrow(run, "key long, lane int, rows array<long>, ns array<long>, groups array<long>, bits array<binary>")


def candidates(met: DataFrame, put: Callable[[DataFrame], DataFrame] = common.stored) -> DataFrame:
    """Pairs (a < b) of sets of one key that are not in one group and may be alike by their sizes and bitmaps."""
    return met_in_blocks(met, put, True)


def met_in_blocks(met: DataFrame, put: Callable[[DataFrame], DataFrame], every: bool) -> DataFrame:
    """The pairs of candidates(): every one, or of each set and block of others the first only.

    A key's sets are dealt into lanes of about BLOCK, and every lane meets every other one of the key as a whole: what is a row here is two
    blocks of sets, and pairs are rows only once their bitmaps leave them.
    """
    lanes = met.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lanes"))
    rows = met.join(lanes, "key").withColumn("lane", F.pmod(F.xxhash64("_row"), F.col("lanes")).cast("int"))
    blocks = put(blocked(rows))
    other = blocks.filter("lane > 0").select(F.col("key").alias("of"), F.col("lane").alias("lane_b"), *(F.col(c).alias(f"{c}_b") for c in ("rows", "ns", "groups", "bits")))
    own = blocks.select("rows", "ns", "groups", "bits", *(F.lit(None).cast(t).alias(f"{c}_b") for c, t in blocks.dtypes[2:]))
    across = blocks.join(other, (F.col("key") == F.col("of")) & (F.col("lane") < F.col("lane_b"))).select(*own.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = [batch.column(c)[i].values for c in range(4)]
                b = [batch.column(c)[i].values for c in range(4, 8)] if batch.column(4)[i].is_valid else a
                (id_a, n_a, group_a), (id_b, n_b, group_b) = ([np.asarray(x) for x in side[:3]] for side in (a, b))
                may = (group_a[:, None] != group_b[None]) & alike(np.minimum(n_a[:, None], n_b[None]), n_a[:, None], n_b[None])
                if a is b:
                    may &= id_a[:, None] < id_b[None]
                if may.any():
                    may &= perhaps_alike(n_a, matrix(a[3].to_pylist()), n_b, matrix(b[3].to_pylist()))
                if not every:
                    y = np.flatnonzero(may.any(axis=0))
                    x = may[:, y].argmax(axis=0)
                else:
                    x, y = np.nonzero(may)
                ends = np.minimum(id_a[x], id_b[y]), np.maximum(id_a[x], id_b[y])
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    return own.unionByName(across).mapInArrow(run, "a long, b long").distinct()


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (_row, text) as (_row, digest of the set, n, keys, bitmap, SimHash of the set, even and odd keys that an alike set shares at least)."""
    keys = Keys(common_shingles(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            found = [keys.counted(s) for s in sets]
            columns = [batch.column(0), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in found], pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())]
            columns.append(pa.array(np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)))
            columns += [pa.array([least[odd] for _, least in found], pa.int64()) for odd in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "digest", "n", "keys", "bits", "fp", "need_even", "need_odd"])

    return rows.select("_row", "text").mapInArrow(run, "_row long, digest binary, n long, keys array<long>, bits binary, fp long, need_even long, need_odd long")


def compared(pairs: DataFrame, texts: DataFrame, put: Callable[[DataFrame], DataFrame] = common.stored) -> DataFrame:
    """Of pairs (a, b) of rows (stored) those whose whole sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(shingles)
        for batch in batches:
            near = []
            for i in range(batch.num_rows):
                a, b = known(batch.column(2)[i].as_py()), known(batch.column(3)[i].as_py())
                near.append(alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    rows = put(pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct())
    texts = put(common.parted(texts, rows, "_row")[0])
    first = texts.select(F.col("_row").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("_row").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def fingerprint_pairs(sets: DataFrame, put: Callable[[DataFrame], DataFrame] = common.stored) -> DataFrame:
    """Pairs (a < b) of sets (_row, n, fp; stored) that SimHash links and whose sizes let them be alike: each set and the first of its fingerprint, and those
    firsts whose fingerprints a trie join finds within simhash.BUDGET bits (a spanning forest of them)."""
    prints = put(sets.groupBy("fp").agg(F.min(F.struct("_row", "n")).alias("first")).select("fp", "first.*"))
    own = sets.join(prints.select("fp", F.col("_row").alias("a"), F.col("n").alias("n_a")), "fp").filter("_row <> a").select("a", F.col("_row").alias("b"), "n_a", F.col("n").alias("n_b"))
    ends = [prints.select(F.col("fp").alias(of), F.col("_row").alias(row), F.col("n").alias(n)) for of, row, n in (("src", "a", "n_a"), ("dst", "b", "n_b"))]
    across = simhash.links(prints).join(ends[0], "src").join(ends[1], "dst").select("a", "b", "n_a", "n_b")
    near = own.unionByName(across).filter(alike(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(met: DataFrame, groups: DataFrame, over: int = 1) -> DataFrame:
    """The sets, each with its group, of the buckets (key, _row, ...) of more than `over` sets that aren't all in one group (node, component)."""
    met = met.join(groups.withColumnRenamed("node", "_row"), "_row", "left").select(*met.columns, F.coalesce("component", "_row").alias("group"))
    several = met.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("size")).filter(f"low < high AND size > {over}")
    return met.join(several.select("key"), "key", "left_semi")


def near_copies(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, a unique long, and component_id, the smallest id among the documents that links reach.

    Documents without a word (null, empty, blank) are one group. `rows` is read several times: settle or store it before.

    SimHash comes first: fingerprints of the sets, those within a few bits found by the trie join (simhash.links), each link checked by the whole
    sets. Its fingerprints of sets at LEAST are too far apart for any such join, so what it leaves apart is looked for exactly:

    Sets meet in buckets, one for each key that several sets have; of keys with the same sets one stands for all, and a set leaves those that the most
    sets have (rarest). At first every set is compared to one of its bucket only: a bucket of n near copies is about n comparisons. What this leaves
    apart meets in blocks: the bitmaps of two sets bound what they can share, and only pairs that the bound leaves are compared by their texts. In
    buckets of more than CROWD sets that is one partner for each set and block at first, while that joins them to groups, and all that are left then.
    Bitmaps are compared within a bucket pair by pair, which grows with the square of a bucket whose sets aren't alike (pages of one template),
    but no row is made, and no text moves, for a pair that they rule out. Sets of many more shingles than MOST_BITS differ in half their bits if they
    aren't alike, which then rules out less. Only keys that are in a class of one of the shared keys move to their buckets. What is stored on the way
    is deleted in the end.
    """
    with common.folder(rows.sparkSession) as put, ExitStack() as first:
        return common.stored(_near_copies(rows, id_col, text_col, put, first.enter_context(common.folder(rows.sparkSession)), first.close))


def _near_copies(rows: DataFrame, id_col: str, text_col: str, put: Callable[[DataFrame], DataFrame], early: Callable[[DataFrame], DataFrame], done: Callable[[], None]) -> DataFrame:
    texts = rows.select(F.col(id_col).cast("long").alias("_row"), F.col(text_col).cast("string").alias("text"))
    sets = put(keyed(texts))
    own = put(sets.groupBy("digest").agg(F.min("_row").alias("rep"), F.count("*").alias("copies")))
    members = put(common.join_with_hot_keys(sets.select("_row", "digest"), own, "digest", "copies").select("_row", "rep"))
    copies = members.filter("_row <> rep").select("_row")
    single = common.parted(sets.select("_row", "n", "need_even", "need_odd", "keys"), copies, "_row")[1]
    found = put(fingerprint_pairs(put(common.parted(sets.select("_row", "n", "fp"), copies, "_row")[1]), early))
    near = put(compared(found, texts, early))
    # as narrow as can be: a row for every entry is shuffled. The first set and the XOR of all sets' hashes tell which keys have the same sets
    entries = single.select(F.explode("keys").alias("key"), "_row").repartition("key")
    ends = F.min("_row").alias("lead"), F.bit_xor(F.xxhash64("_row")).alias("who")
    shared = entries.groupBy("key").agg(*ends).filter(F.col("who") != F.xxhash64("lead"))
    odd = F.sum(F.col("key").bitwiseAND(F.lit(1)))
    buckets = early(shared.groupBy("lead", "who").agg(F.min("key").alias("key"), (F.count("*") - odd).alias("even"), odd.alias("odd")).select("key", "even", "odd"))
    held = sieved(single, key_sieve(buckets.select("key"))).withColumn("key", F.explode("keys")).drop("keys")
    met = early(rarest(early(held.join(buckets, "key"))))
    leads = met.groupBy("key").agg(F.min(F.struct("_row", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("lead._row").alias("lead"), F.col("lead.n").alias("lead_n"))
    stars = met.join(leads, "key").filter(F.col("_row") != F.col("lead")).filter(alike(F.least("n", "lead_n"), F.col("n"), F.col("lead_n")))
    tried = put(stars.select(F.col("lead").alias("a"), F.col("_row").alias("b")).distinct().join(found, ["a", "b"], "left_anti"))
    links = put(compared(tried, texts, early)).unionByName(near)
    tried = tried.unionByName(found)
    groups = connected_components(links, "a", "b")
    met = put(apart(met, groups).drop("group"))
    done()  # what the first round needed
    bits = common.parted(sets.select("_row", "bits"), put(met.select("_row").distinct()), "_row")[0]
    met = put(met.join(bits, "_row"))
    for _ in range(ROUNDS):
        crowds = apart(met, groups, CROWD)
        pairs = put(met_in_blocks(crowds, put, False).join(tried, ["a", "b"], "left_anti"))
        tried, new = tried.unionByName(pairs), put(compared(pairs, texts, put))
        n, joined = pairs.count(), new.count()
        if joined:
            links = links.unionByName(new)
            groups = connected_components(links, "a", "b")
        if 4 * joined < n or not n:
            break
    # sets of a bucket that are not in one group yet
    pairs = put(candidates(apart(met, groups), put).join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(compared(pairs, texts, put))
    groups = connected_components(links, "a", "b")
    named = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select(F.col("_row").alias(id_col), F.coalesce("component", "rep").alias("component_id"))
