"""Best-fit packing of documents into sequences, by bin completion over the counts of lengths.

Lengths are integers from 1 to the capacity, so whatever the number of documents, the problem is a table of at most
`capacity` counts. The driver solves that; documents only learn which of the plan's places is theirs.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: Fillings that the search for a plan sets down after its first whole one before it keeps the best so far.
NODES = 1_000
#: Fillings that one search tests for dominance; past that it takes the first one at hand to its end.
TESTS = 20_000
#: Widths of the bands of waste by which the search is run: the least waste first, or longer documents first within a band.
SLACKS = (0, 64)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary is run by `tiktoken`, which takes a tenth of the time and gives the same ids: in such a file an id past
    the bytes' own is also the order of its merge, which is checked when it is loaded; any other file is run by `tokenizers`.
    The strings of the file's special tokens get those tokens' ids wherever they stand, as the library gives them by default.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None, special: dict[str, int] | None = None):
        self.path = path
        self.ranks, self.special = vocabulary_of(path) if ranks is None else (ranks, special or {})
        self.finds = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def full(self):
        return self._encoding(lambda pattern: pattern)

    @cached_property
    def quick(self):
        """For texts without two white spaces in a row, in which the look ahead never decides."""
        return self._encoding(lambda pattern: pattern.replace(r"\s+(?!\S)|", ""))

    def _encoding(self, change):
        import tiktoken
        from public_tokenizers import PATTERN

        return tiktoken.Encoding("own", pat_str=change(PATTERN), mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.part, cut(text)))

    def part(self, text: str) -> bytes:
        if not self.ranks:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids, at = [], 0
            for m in self.finds.finditer(text) if self.finds else ():
                ids += self.plain(text[at : m.start()])
                ids.append(self.special[m[0]])
                at = m.end()
            ids = ids + self.plain(text[at:]) if at else self.plain(text)
        return np.asarray(ids, "<u4").tobytes()

    def plain(self, text: str) -> list[int]:
        return (self.full if DOUBLE_SPACE.search(text) else self.quick).encode_ordinary(text)


DOUBLE_SPACE = re.compile(r"\s\s")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str, size: int = common.BLOCK_CHARS) -> Iterator[str]:
    """text in pieces of `size` characters or a little more, cut before a lone space, over which no token reaches."""
    at = 0
    while len(text) - at > size and (m := SAFE_CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def vocabulary_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes of each token to its id, and the special tokens' strings to theirs, if the file is a byte-level BPE whose ids are in the order of its merges; else nothing."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model["model"].get("type") != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model.get("normalizer"):
        return {}, {}
    # byte-level files write a byte as itself where it prints, else as a character from 256 on
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["model"]["vocab"]
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
    added = model.get("added_tokens", [])
    # tokens that reach over white space or stand only as whole words, and such as a text could be cut in, are left to the library
    if any(vocabulary[m] != 256 + i for i, m in enumerate(merges)) or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")) or any(re.search(r"\s", t["content"]) for t in added):
        return {}, {}
    special = {t["content"]: t["id"] for t in added}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}, special


_ids: dict[str, Ids] = {}


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that takes the rest."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """A row per piece of a document: its id, piece, start, length, ids_crc32. A null text counts as empty: one piece, `end_id` alone."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()
    words = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))  # of a vocabulary's size; a task then needs no more of the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids[path] if path in _ids else _ids.setdefault(path, Ids(path, *words.value))
        for batch in batches:
            out, at = [], []
            for i, text in enumerate(batch.column(1)):
                ids = ids_of.encode(text.as_py()) + end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    at.append(i)
                    out.append((k, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])))
            columns = np.asarray(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c) for c in columns)], [id_col, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long")


@dataclass
class Filling:
    """A way to fill a sequence, and of how many sequences it is the plan: lengths with how often each stands in it."""

    parts: list[tuple[int, int]]
    times: int


def sums_within(parts: list[tuple[int, int]], room: int) -> list[int]:
    """For each beginning of parts (length, how many): the sums up to `room` that it can make, as the bits of a number."""
    all_, out, now = (1 << room + 1) - 1, [], 1
    for length, n in parts:
        n, take = min(n, room // length), 1
        while n > 0:
            now |= now << length * min(take, n) & all_
            n, take = n - take, 2 * take
        out.append(now)
    return out


def spread(bits: int, by: int) -> int:
    """bits with each set bit's next `by` higher ones set too."""
    have = 0
    while have < by:
        step = min(have + 1, by - have)
        bits |= bits << step
        have += step
    return bits


def dominated(parts: list[tuple[int, int]], free: int, waste: int) -> bool:
    """Whether some of the parts, or none, can be swapped for one longer document at hand, or for one as long as several of them.

    What is swapped out fits where that document would have gone, so the filling needn't be looked at. free: the lengths at hand, as bits.
    """
    singles = several = 0
    for length, n in parts:
        for _ in range(n):
            several |= several << length | singles << length
            singles |= 1 << length
    more = (1 << waste + 1) - 2 | (spread(singles << 1, waste - 1) if waste else 0)  # in place of nothing, or of one
    return bool(free & (more | spread(several, waste)))


def fillings(left: np.ndarray, largest: int, capacity: int, slack: int = 0, tests: list[int] | None = None) -> Iterator[list[tuple[int, int]]]:
    """The undominated fillings around one document of length `largest`, in bands of waste `slack` wide, the least waste first, within a band those with
    longer documents first.

    The sums that shorter documents can still make bound the waste of every branch, so none is entered in vain. tests[0], where given, is how many
    may still be tested: without any left the first one comes untested, as the last.
    """
    room = capacity - largest
    have = [(int(x), int(left[x]) - int(x == largest)) for x in np.flatnonzero(left[: room + 1])]
    have = [(x, n) for x, n in have if n]
    reach = sums_within(have, room)
    sums, at_hand = reach[-1] if reach else 1, sum(1 << x for x, _ in have)
    counts, tests = dict(have), [1 << 62] if tests is None else tests
    while sums:
        high = sums.bit_length() - 1
        low = max(0, high - slack)
        sums &= (1 << low) - 1
        stack = [(len(have) - 1, high, ())]
        while stack:
            i, rest, chosen = stack.pop()
            if i < 0:
                parts = list(chosen)
                if tests[0] <= 0:
                    yield [(largest, 1), *parts]
                    return
                tests[0] -= 1
                free = at_hand ^ sum(1 << x for x, n in parts if n == counts[x])
                if not dominated(parts, free, room - high + rest):
                    yield [(largest, 1), *parts]
                continue
            while i and have[i][0] > rest:
                i -= 1
            length, n = have[i]
            below = reach[i - 1] if i else 1
            # the last pushed is looked at first: as many of the longest as fit, then fewer
            for k in range(min(n, rest // length) + 1):
                now = rest - k * length
                least = max(0, now - (high - low))
                if below >> least & (1 << now - least + 1) - 1:
                    stack.append((i - 1, now, chosen + (((length, k),) if k else ())))


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing over counts: each document, the longest first, goes where the least room is left that takes it."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            room = min((r for r in rooms if r >= length), default=0)
            if room:
                times, parts = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                room, times, parts = capacity, -(-n // (capacity // length)), ()
            each = room // length
            whole = min(times, n // each)
            rest = min(1, times - whole) * (n - whole * each if whole < times else 0)
            for t, k in ((whole, each), (1 if rest else 0, rest), (times - whole - (1 if rest else 0), 0)):
                if t:
                    rooms.setdefault(room - k * length, []).append((t, parts + (((length, k),) if k else ())))
            n -= whole * each + rest
    return [Filling(list(parts), times) for groups in rooms.values() for times, parts in groups]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A bound from waste: documents over half a sequence each need their own, and those of at least k fill no more than the room that is left beside
    documents of at most capacity - k; the greatest over all k."""
    lengths = np.arange(len(counts))
    n, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    half = capacity // 2
    k = np.arange(0, half + 1)
    top = capacity - k + 1  # lengths below this and over half leave room for k
    alone, beside = n[-1] - n[np.minimum(top, len(counts))], n[np.minimum(top, len(counts))] - n[half + 1]
    room = beside * capacity - (tokens[np.minimum(top, len(counts))] - tokens[half + 1])
    short = tokens[half + 1] - tokens[k]
    return int((alone + beside + np.maximum(0, -(-(short - room) // capacity))).max())


def best_plan(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Filling]:
    """The plan with fewest sequences that branch and bound finds; best fit is the first incumbent, so none is worse than that.

    The search is run once for each of SLACKS; after `nodes` fillings past the first whole plan, or TESTS tests, each keeps the incumbent; without
    these limits it is complete. Done at once when the bound is met.
    """
    counts = counts.astype(np.int64)
    best, bound = best_fit(counts, capacity), least_sequences(counts, capacity)
    for slack in SLACKS:
        if sum(f.times for f in best) > bound:
            best = searched(counts, capacity, best, bound, nodes, slack)
    return best


def searched(counts: np.ndarray, capacity: int, best: list[Filling], bound: int, nodes: int, slack: int) -> list[Filling]:
    """Depth first: a node takes the longest document left and one of its fillings, as often as the counts allow, then half as often and so on
    down to once, then the next filling. A branch ends when its sequences and the bound of what is left reach the incumbent's."""
    fewest, tests = sum(f.times for f in best), [TESTS]

    def choices(left: np.ndarray) -> Iterator[Filling]:
        left = left.copy()
        for parts in fillings(left, int(np.flatnonzero(left)[-1]), capacity, slack, tests):
            need: dict[int, int] = {}
            for length, n in parts:
                need[length] = need.get(length, 0) + n
            times = min(int(left[length]) // n for length, n in need.items())
            while times:
                yield Filling(sorted(need.items(), reverse=True), times)
                times //= 2

    # of a node on the way only its step and how many of its choices are done are kept; they are made again when the search comes back to it
    left, used, descending = counts.copy(), 0, True
    path: list[Filling] = []
    done, options = [0], choices(left)
    while descending or nodes > 0 < tests[0]:
        step = next(options, None)
        if step is None:
            done.pop()
            if not path:
                break
            used -= put(left, path.pop(), 1)
            options = islice(choices(left), done[-1], None)
            continue
        done[-1] += 1
        nodes -= not descending
        used += put(left, step, -1)
        if left.any() and (descending or used + least_sequences(left, capacity) < fewest):
            path.append(step)
            done.append(0)
            options = choices(left)
            continue
        if not left.any():
            descending = False
            if used < fewest:
                best, fewest = [*path, step], used
            if fewest <= bound:
                break
        used -= put(left, step, 1)
    return best


def put(left: np.ndarray, filling: Filling, sign: int) -> int:
    """Takes a filling's documents from what is left (sign -1) or puts them back; gives its sequences."""
    for length, n in filling.parts:
        left[length] += sign * n * filling.times
    return filling.times


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces (lengths from 1 to `capacity`) with sequence_id and offset: as few sequences as it can, places gapless from 0.

    Equal lengths are interchangeable, so each is numbered within its length and looks its place up in the plan; a plan has
    at most one filling per length and is small at any size. An empty table gives an empty result.
    """
    rows = common.settled(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy(length_col).count().collect():  # at most `capacity` rows
        counts[length] = n
    plan = best_plan(counts, capacity)
    # for each length: from which number on, which filling, how many a sequence, first sequence, offset
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for f in plan:
        offset = 0
        for length, n in f.parts:
            places.setdefault(length, []).append((int(used[length]), n, sequence, offset))
            used[length] += n * f.times
            offset += n * length
        sequence += f.times
    starts = {k: np.array(v, np.int64) for k, v in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (np.asarray(batch.column(c), np.int64) for c in (length_col, "_number"))
            ids, offsets = np.empty_like(lengths), np.empty_like(lengths)
            for length in np.unique(lengths):
                of = np.flatnonzero(lengths == length)
                table = starts[int(length)]
                place = table[np.searchsorted(table[:, 0], numbers[of], side="right") - 1]
                within = numbers[of] - place[:, 0]
                ids[of] = place[:, 2] + within // place[:, 1]
                offsets[of] = place[:, 3] + within % place[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_number"]).columns, pa.array(ids), pa.array(offsets)], [*batch.drop_columns(["_number"]).schema.names, "sequence_id", "offset"])

    own = common.numbered(rows, length_col, "_number")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return own.select(*rows.columns, "_number").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; only longer ones than `capacity` are cut. Null and empty texts are one piece of
    length 1. Repeated rows are packed each on their own; an empty table gives an empty result; other columns are not read.
    """
    return pack(tokenized(docs, path or tokenizer_path(), capacity, id_col, text_col), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
