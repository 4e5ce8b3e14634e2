"""Near-duplicates by SimHash: fingerprints within a few bits of each other are linked, and links make groups.

All pairs within the bit budget are found by joining a binary trie of the distinct fingerprints with itself: two nodes are
traversed together, the bits in which their paths differ are added up, and a pair is dropped once they exceed the budget. The
upper levels are walked on the driver over counts of prefixes (few), which splits the join into tasks of about equal size; each
task walks the rest of its pairs of subtrees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest as digest

from . import common
from .components import connected_components

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 3
ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c").__contains__
#: Bits of a fingerprint by which the driver splits the trie at most; fingerprints that a subtree has at most then (least, most).
PREFIX_BITS, SUBTREE = 16, (16_384, 131_072)
#: Node pairs that a task holds in one array, and pairs of leaves that it compares outright instead of going on down.
FRONT, LEAVES = 1 << 18, 32


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a whole text over word shingles hashed by XXH64: a bit is 1 if it is in over half the hashes; no word: 0.

    A-Z count as a-z, words are what ASCII white space parts, fewer words than `width` are one shingle.
    """
    counts, total, carry = np.zeros(BITS, np.int64), 0, []
    parts = list(common.blocks(text, space=ASCII_SPACE)) if text else []
    for k, block in enumerate(parts):
        words = carry + block.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < width:
            if k + 1 < len(parts) or total or not words:
                carry = words
                continue
            shingles = [b" ".join(words)]
        else:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        bits = np.unpackbits(np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += len(bits)
        carry = words[-(width - 1) :] if width > 1 else []
    if not total and carry:  # few words in several blocks
        return int.from_bytes(digest(b" ".join(carry), SEED), "big")
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes: a bit is 1 if it is in over half of them; of none: 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col(text_col).cast("string").alias("_read_text"), F.col(id_col))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found)], [id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def split_nodes(counts: dict[int, int], bits: int = PREFIX_BITS, most: int = SUBTREE[1]) -> list[tuple[int, int, int]]:
    """The nodes (depth, prefix, leaves) at which the trie is cut: the highest with at most `most` leaves, or those `bits` down."""
    sums = {(bits, p): n for p, n in counts.items()}
    for depth in range(bits, 0, -1):
        for (d, p), n in list(sums.items()):
            if d == depth:
                sums[depth - 1, p >> 1] = sums.get((depth - 1, p >> 1), 0) + n
    out, stack = [], [(0, 0)] if sums else []
    while stack:
        d, p = stack.pop()
        if (d, p) in sums:
            if sums[d, p] <= most or d == bits:
                out.append((d, p, sums[d, p]))
            else:
                stack += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
    return sorted(out)


def node_pairs(nodes: list[tuple[int, int, int]], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Numbers (i <= j) of nodes whose paths differ in at most `budget` bits as far as both go: the top of the trie walked pairwise.

    A node of the cut stands still while the other goes deeper.
    """
    number = {(d, p): i for i, (d, p, _) in enumerate(nodes)}
    above = {(d - k, p >> k) for d, p, _ in nodes for k in range(d + 1)}

    def children(d: int, p: int) -> list[tuple[int, int]]:
        return [(d, p)] if (d, p) in number else [c for c in ((d + 1, 2 * p), (d + 1, 2 * p + 1)) if c in above]

    out, stack = [], [((0, 0), (0, 0))] if nodes else []
    while stack:
        a, b = stack.pop()
        if a in number and b in number:
            out.append((number[a], number[b]))
            continue
        for x in children(*a):
            for y in children(*b):
                if a == b and y < x:
                    continue
                k = min(x[0], y[0])
                if ((x[1] >> (x[0] - k)) ^ (y[1] >> (y[0] - k))).bit_count() <= budget:
                    stack.append((x, y))
    return sorted(set(tuple(sorted(p)) for p in out))


class Forest:
    """Groups of the leaves of one task, joined a whole array of links at a time."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in left, j in right) of fingerprints that differ in at most `budget` bits; right None: pairs i < j within left.

    Both are sorted and without repeats, so a trie node is a range of places. A front of node pairs with the bits they differ in
    so far goes down one bit at a time; small pairs are compared outright.
    """
    own = right is None
    b = left if own else right
    if not len(left) or not len(b):
        return
    one = np.array
    stack = [(0, one([0]), one([len(left)]), one([0]), one([len(b)]), one([0]))]
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > FRONT:
            for at in range(0, len(a0), FRONT):
                stack.append((depth, *(x[at : at + FRONT] for x in (a0, a1, b0, b1, d))))
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= LEAVES) if depth < BITS else np.ones(len(a0), bool)
        if small.any():
            yield from compared(left, b, a0[small], a1[small], b0[small], b1[small], budget, own)
            go = ~small
            a0, a1, b0, b1, d = a0[go], a1[go], b0[go], b1[go], d[go]
        if not len(a0):
            continue
        am, bm = halves(left, a0, a1, depth), halves(b, b0, b1, depth)
        next_ = []
        for lo, hi, lo2, hi2, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (lo < hi) & (lo2 < hi2) & (d + more <= budget)
            if own and more:  # of a node with itself, one of the two crossings is enough
                keep &= (a0 != b0) | (lo < lo2)
            next_.append((lo[keep], hi[keep], lo2[keep], hi2[keep], d[keep] + more))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*next_, strict=True))))


def halves(sorted_: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """For each range that shares its first `depth` bits: where the next bit turns to 1."""
    shift = np.uint64(BITS - 1 - depth)
    split = ((sorted_[low] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(sorted_, split), low, high)


def compared(a: np.ndarray, b: np.ndarray, a0, a1, b0, b1, budget: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves under small node pairs that keep the budget."""
    wide = b1 - b0
    size = (a1 - a0) * wide
    for low in range(0, len(size), max(1, FRONT // max(1, int(size.max(initial=1))))):
        s = slice(low, low + max(1, FRONT // max(1, int(size.max(initial=1)))))
        pair = np.repeat(np.arange(len(size[s])), size[s])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        i, j = a0[s][pair] + k // wide[s][pair], b0[s][pair] + k % wide[s][pair]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if own:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def links(distinct: DataFrame, budget: int = BUDGET, most: tuple[int, int] = SUBTREE) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints, column fp, that join all fingerprints within `budget` bits, directly or over others.

    Each task gives a spanning forest of the links it finds, so edges are at most its leaves and not their pairs. `distinct` is read
    twice: settle it before.
    """
    # driver: at most 2 ** PREFIX_BITS counts
    prefix = F.shiftrightunsigned("fp", BITS - PREFIX_BITS).cast("int")
    counts = {r[0]: r[1] for r in distinct.groupBy(prefix.alias("p")).count().collect()}
    most = min(most[1], max(most[0], -(-sum(counts.values()) // 4)))
    nodes = split_nodes(counts, most=most)
    pairs = node_pairs(nodes, budget)
    spark = distinct.sparkSession
    # prefix -> the pairs its leaves belong to, with the side; as few rows as pairs of nodes and prefixes
    member: dict[int, list[tuple[int, int]]] = {}
    load = [0] * len(pairs)
    for k, (i, j) in enumerate(pairs):
        member.setdefault(i, []).append((k, 0))
        load[k] += nodes[i][2]
        if i != j:
            member.setdefault(j, []).append((k, 1))
            load[k] += nodes[j][2]
    # tasks of about equal load, largest pairs first
    n_tasks = max(1, min(len(pairs), 2 * -(-sum(load) // (2 * most))))
    filled, task_of = np.zeros(n_tasks), [0] * len(pairs)
    for k in sorted(range(len(pairs)), key=lambda k: (-load[k], k)):
        task_of[k] = int(filled.argmin())
        filled[task_of[k]] += load[k]
    places = {(d, p): np.array([(task_of[k], k, s) for k, s in member[i]], np.int32).reshape(-1, 3) for i, (d, p, _) in enumerate(nodes)}
    depths = sorted({d for d, _, _ in nodes})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for d in depths:
                prefixes = (fp >> np.uint64(BITS - d)).astype(np.int64) if d else np.zeros(len(fp), np.int64)
                for p in np.unique(prefixes):
                    if (to := places.get((d, int(p)))) is not None:
                        leaves = [fp[prefixes == p].tobytes()] * len(to)
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in to.T), pa.array(leaves, pa.binary())], ["task", "pair", "side", "leaves"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in grouped(batches):
            both = left if right is None else np.concatenate([left, right])
            forest = Forest(len(both))
            shift = 0 if right is None else len(left)
            for i, j in trie_join(left, right, budget):
                forest.join(i, j + shift)
            root = forest.roots()
            own = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(both[own].view(np.int64)), pa.array(both[root[own]].view(np.int64))], ["src", "dst"])

    if not pairs:
        return spark.createDataFrame([], "src long, dst long")
    # leaves travel in blocks, a row for each block and pair that it takes part in
    dealt = distinct.select("fp").mapInArrow(deal, "task int, pair int, side int, leaves binary")
    dealt = dealt.repartitionById(n_tasks, F.col("task")).sortWithinPartitions("pair", "side")
    return dealt.select("pair", "side", "leaves").mapInArrow(walk, "src long, dst long")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Of rows (pair, side, leaves) sorted by pair: (left leaves, right leaves or None) of each, sorted and without repeats."""
    now, held = None, ([], [])

    def done():
        sides = [np.unique(np.concatenate([np.empty(0, np.uint64), *x])) for x in held]
        return sides[0], sides[1] if held[1] else None

    for batch in batches:
        for pair, side, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and pair != now:
                yield done()
                held = ([], [])
            now = pair
            held[side].append(np.frombuffer(leaves, np.uint64))
    if now is not None:
        yield done()


def near_duplicates(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, fingerprint (16 hex digits), component_id, the smallest id among the documents that links reach.

    Documents without a word (null, empty, blank) have fingerprint zero and link like any other. Repeated rows share their component;
    a null id keeps its row and never names a component unless all its ids are null. An empty table gives an empty result; other
    columns are not read.
    """
    prints = common.settled(fingerprints(docs, id_col, text_col))
    own = common.settled(prints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("copies")))
    groups = connected_components(links(own, budget))
    # fingerprints joined to another one: the smallest id of the whole group
    reach = own.join(groups, own["fp"] == groups["node"]).select("fp", "least_id", "component")
    best = reach.groupBy("component").agg(F.min("least_id").alias("group_id"))
    named = reach.join(best, "component").select(F.col("fp").alias("of"), "group_id")
    ids = own.join(named, own["fp"] == named["of"], "left").select("fp", "copies", F.coalesce("group_id", "least_id").alias("_component"))
    out = common.join_with_hot_keys(prints.withColumnRenamed(id_col, "_id"), common.settled(ids), "fp", "copies")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", named: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """One row of each group that `named` makes, the one with the smallest id; columns, whatever their names, as they were.

    Groups are of rows, not of ids: rows that share an id and have texts that aren't alike all stay, and of repeated rows one does. A null
    id comes after all others, and a group of nothing but null ids keeps one row. Null, empty and blank texts are alike. An empty table
    gives an empty result.
    """
    row = common.spare(docs, "_row")
    rows = common.stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = named(rows, id_col=row).select(F.col(row).alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")).join(groups, "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = ids.groupBy("component_id").agg(first.alias("first")).select("first.row")
    dropped = common.stored(ids.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", row))
    return common.parted(rows, dropped, row)[1].select(*docs.columns)


def op2_simhash_trie_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
