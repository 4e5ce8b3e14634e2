"""SentencePiece encoding and decoding by a relational lattice.

Words are exploded into their substrings of bounded length, which an equi-join with the piece table turns into the edges of a
lattice; edges are grouped by word, and a higher-order fold over them finds the word's pieces: for unigram models the Viterbi path,
for BPE models the merges in the order of their scores (the best path by score sums isn't what such a model means).

Every distinct word of the documents takes that way. The ids of frequent words then go to every task, those of all others by a join to the texts
that have them; where a word's ids travel makes no difference to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
#: What stands for a space in pieces.
GAP = "\u2581"
#: Words whose ids go to every task, at most: the most frequent ones of about so many documents. Other words' ids are joined to their texts.
DICTIONARY, SAMPLE = 1 << 18, 1 << 14
#: Words are cut wherever no piece reaches over, which changes no id; a stretch without such a place that is longer than this (a fold's state is
#: the bits of a long) is folded where it occurs.
LONGEST = 62
#: Rows up to which the piece table counts as small enough to send to every task.
MOST_PIECES = 1 << 20
#: Words whose stretches a worker remembers, and rows that it gives back at once.
REMEMBERED, ROWS = 100_000, 256


@dataclass
class Pieces:
    """A model's pieces: text to (id, score), the ids of bytes, the unknown id, and whether it is `bpe` or `unigram`."""

    table: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    kind: str
    names: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Of a model file with the identity normaliser, a dummy prefix and kept white space, the only kind taken here."""
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kind = {1: "unigram", 2: "bpe"}.get(model.trainer_spec.model_type)
        if kind is None or rules.name != "identity" or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("a BPE or unigram model with the identity normaliser is needed")
        p = SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        names = [p.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        by = {names[i]: i for i in ids if p.is_byte(i)}
        return cls({names[i]: (i, p.get_score(i)) for i in plain}, [by[f"<0x{b:02X}>"] for b in range(256)] if by else [], p.unk_id(), kind, names)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.table), default=1)

    @cached_property
    def order(self) -> dict[str, int]:
        """Place of each piece's score among all scores, the highest first; -1 for what is only the beginning of a piece."""
        places = {s: k for k, s in enumerate(sorted({s for _, s in self.table.values()}, reverse=True))}
        out = {p[:k]: -1 for p in self.table for k in range(1, len(p))}
        return out | {p: places[s] for p, (_, s) in self.table.items()}

    @cached_property
    def pairs(self) -> set[str]:
        """Neighbouring characters of some piece: no piece, so no merge and no path, reaches over the place between any two others."""
        return {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}

    def stretches(self, word: str) -> list[str]:
        """word in parts whose ids, one after the other, are the word's: cut at every place that no piece reaches over."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @cached_property
    def unknown_score(self) -> float:
        """Of a character without a piece in a unigram lattice."""
        return min((s for _, s in self.table.values()), default=0.0) - 10.0

    def spelled(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def fold(self, word: str) -> list[int]:
        """The ids of one word, by the same fold over its edges as words_of() has in columns."""
        spans = self.merged(word) if self.kind == "bpe" else self.viterbi(word)
        ids: list[int] = []
        for s, e in spans:
            if (x := self.table.get(word[s:e])) is None:
                ids += self.spelled(word[s:e])
            else:
                ids.append(x[0])
        return ids

    def merged(self, word: str) -> list[tuple[int, int]]:
        n, get = len(word), self.order.get
        width = max(20, n.bit_length())
        mask = (1 << width) - 1
        edges = []  # each as one number that sorts by score and then from the left
        for s in range(n - 1):
            for e in range(s + 2, n + 1):
                if (o := get(word[s:e])) is None:
                    break
                if o >= 0:
                    edges.append(o << 2 * width | s << width | e)
        edges.sort()
        ends = list(range(1, n + 1))  # where the symbol that begins here ends; 0: none begins here
        for x in edges:
            s, e = x >> width & mask, x & mask
            m = ends[s]
            if 0 < m < e and ends[m] == e:
                ends[s], ends[m] = e, 0
        return [(s, e) for s, e in enumerate(ends) if e]

    def viterbi(self, word: str) -> list[tuple[int, int]]:
        best: list[tuple[float, int]] = [(0.0, -1)]
        for e in range(1, len(word) + 1):
            ways = [(best[s][0] + x[1], s) for s in range(max(0, e - self.longest), e) if (x := self.table.get(word[s:e]))]
            if word[e - 1 : e] not in self.table:
                ways.append((best[e - 1][0] + self.unknown_score, e - 1))
            best.append(max(ways))
        spans, at = [], len(word)
        while at > 0:
            spans.append((best[at][1], at))
            at = best[at][1]
        return spans[::-1]


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    rows = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double").withColumn("hash", F.xxhash64("piece"))
    return F.broadcast(rows) if len(pieces.table) <= MOST_PIECES else rows


def words_of(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Of distinct non-empty words (column word) of bounded length: word, its other columns, and ids, by the lattice.

    Nothing moves where the rows are dealt by their words already and the piece table is sent to every task.
    """
    spark, others = words.sparkSession, [c for c in words.columns if c != "word"]
    n = F.length("word")
    starts = words.select("word", *others, F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    subs = starts.select("word", *others, "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + pieces.longest))).alias("e"))
    subs = subs.withColumn("sub", F.expr("substring(word, s + 1, e - s)"))
    # by the pieces' hashes, whose joins are quick; a piece of the same hash that isn't the substring makes no edge
    edges = subs.join(piece_table(spark, pieces), F.xxhash64("sub") == F.col("hash"), "left").withColumn("id", F.when(F.col("sub") == F.col("piece"), F.col("id")))
    edges = edges.filter("id IS NOT NULL OR e = s + 1")  # single characters keep words without a piece
    one = F.lit(1).cast("long")
    ends, inner = F.expr("shiftleft(1L, s) | shiftleft(1L, e)"), F.expr("shiftleft(1L, e) - shiftleft(1L, s + 1)")
    edge = F.when(F.col("id").isNotNull(), F.struct((-F.col("score")).alias("cost"), "s", "e", "id", ends.alias("ends"), inner.alias("inner")))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"), *(F.min(c).alias(c) for c in others))
    if pieces.kind != "bpe":
        return lattice.withColumn("cuts", viterbi_cuts(pieces.unknown_score)).select("word", *others, ids_between(pieces).alias("ids"))
    lattice = lattice.withColumn("cut", merged_cuts())
    taken = F.filter("edges", lambda x: (F.col("cut").bitwiseAND(x["ends"]) == x["ends"]) & (F.col("cut").bitwiseAND(x["inner"]) == 0))
    lattice = lattice.withColumn("taken", F.array_sort(F.transform(taken, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))))
    lattice = lattice.withColumn("cuts", F.filter(F.sequence(F.lit(0), F.length("word")), lambda p: F.expr("cut").bitwiseAND(F.call_function("shiftleft", one, p)) != 0))
    whole = F.size("taken") == F.bit_count("cut") - 1
    return lattice.select("word", *others, F.when(whole, F.transform("taken", lambda x: x["id"])).otherwise(ids_between(pieces)).alias("ids"))


def merged_cuts() -> Column:
    """Where the symbols of a word begin, and its end, after all merges, as the bits of a long: edges in the order of their scores (then from the left), each taken if it is two neighbouring symbols by then."""

    def step(cut: Column, x: Column) -> Column:
        within = cut.bitwiseAND(x["inner"])
        fits = (cut.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(within) == 1)
        return F.when(fits, cut.bitwiseXOR(within)).otherwise(cut)

    return F.aggregate("edges", F.expr("shiftleft(1L, length(word) + 1) - 1"), step)


def viterbi_cuts(unknown: float) -> Column:
    """The same for the path of the greatest score sum; of equal sums the one whose last piece is shorter."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s")))

    def step(best: Column, e: Column) -> Column:
        into = F.filter("edges", lambda x: x["e"] == e)
        ways = F.transform(into, lambda x: F.struct((F.get(best, x["s"])["score"] - x["cost"]).alias("score"), x["s"].alias("s")))
        alone = F.array(F.struct((F.get(best, e - 1)["score"] + F.lit(float(unknown))).alias("score"), (e - 1).alias("s")))
        ways = F.when(F.exists(into, lambda x: x["s"] == e - 1), ways).otherwise(F.concat(ways, alone))
        return F.concat(best, F.array(F.array_max(ways)))

    best = F.aggregate(F.sequence(F.lit(1), F.length("word")), first, step)
    back = lambda cuts, e: F.when(F.element_at(cuts, 1) == e, F.concat(F.array(F.get(best, e)["s"]), cuts)).otherwise(cuts)
    return F.aggregate(F.reverse(F.sequence(F.lit(1), F.length("word"))), F.array(F.length("word")), back)


def ids_between(pieces: Pieces) -> Column:
    """The ids of the symbols between cuts: the piece's, or for a character without one those of its UTF-8 bytes (or the unknown id)."""
    places = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("s"), F.get("cuts", i + 1).alias("e")))

    def of(place: Column) -> Column:
        own = F.transform(F.filter("edges", lambda x: (x["s"] == place["s"]) & (x["e"] == place["e"])), lambda x: x["id"])
        code = F.hex(F.encode(F.substring("word", place["s"] + 1, place["e"] - place["s"]), "UTF-8"))
        if pieces.byte_ids:
            first = pieces.byte_ids[0]
            spelled = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda b: (F.conv(F.substring(code, 2 * b + 1, F.lit(2)), 16, 10).cast("int") + first).cast("int"))
        else:
            spelled = F.array(F.lit(pieces.unknown))
        return F.when(F.size(own) > 0, own).otherwise(spelled)

    return F.flatten(F.transform(places, of))


WORDS = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")


def words_in(text: str) -> Iterator[list[str]]:
    """The words of a text, block by block: a gap before the text, gaps for spaces; no piece reaches over the gap before a word."""
    carry = GAP
    for block in common.blocks(text, space=" ".__eq__) if text else ():
        yield WORDS.findall(carry + block.replace(" ", GAP))
        carry = ""


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """The most frequent words of a sample of about SAMPLE documents: at most `most`, cut at a whole count. Words that the sample has once are left out.

    Only what is sent to every task hangs on this, no result does. How many words have which count decides where to cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for words in words_in(text.as_py() or ""):
                    counts.update(words)
        found = {w: n for w, n in counts.items() if len(w) <= LONGEST}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    text = F.col(text_col).cast("string")
    sample = common.bounded_sample(docs.select(text.alias("text")), F.col("text"), SAMPLE)
    counts = common.settled(sample.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    held, cut = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += r["words"]
        if held > most:
            break
        cut = r["n"]
    return counts.filter(F.col("n") >= cut if cut is not None else F.lit(False)).select("word")


class Encoder(dict):
    """Texts to ids, given the ids of words and stretches of words as bytes: its own for all texts, `own` for the one at hand.

    A word that is in neither is put together of its stretches, of which those longer than LONGEST are folded.
    """

    def __init__(self, pieces: Pieces, known: dict[str, bytes]):
        super().__init__(known)
        self.pieces, self.cut, self.own = pieces, {}, {}

    @classmethod
    def of(cls, pieces: Pieces, words: list[str], stretches: dict[str, bytes]) -> Encoder:
        return cls(pieces, stretches | {w: b"".join(stretches[p] for p in pieces.stretches(w)) for w in words})

    def __reduce__(self):
        return Encoder, (self.pieces, dict(self))

    def stretches(self, word: str) -> list[str]:
        if (found := self.cut.get(word)) is None:
            if len(self.cut) >= REMEMBERED:
                self.cut.clear()
            found = self.pieces.stretches(word)
            if len(word) <= LONGEST:
                self.cut[word] = found
        return found

    def unseen(self, text: str) -> set[str]:
        """The stretches of the text's words that the lattice has yet to give ids to."""
        words = set().union(*words_in(text))
        return {p for w in words if w not in self for p in self.stretches(w) if len(p) <= LONGEST and p not in self}

    def encode(self, text: str, own: dict[str, bytes]) -> np.ndarray:
        self.own = own
        return np.frombuffer(b"".join([b"".join(map(self.__getitem__, words)) for words in words_in(text)]), "<i4")

    def __missing__(self, word: str) -> bytes:
        found = self.own.get(word)
        if found is None:
            found = self.own[word] = b"".join(map(self.stretch, self.stretches(word)))
        return found

    def stretch(self, part: str) -> bytes:
        if len(part) > LONGEST:
            return np.asarray(self.pieces.fold(part), "<i4").tobytes()
        return self[part] if part in self else self.own[part]


class Decoder:
    """Texts of ids: pieces joined, runs of byte pieces read as UTF-8 (what isn't UTF-8: U+FFFD), gaps to spaces, the first one dropped."""

    def __init__(self, pieces: Pieces):
        self.byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
        self.names = [chr(b) if (b := self.byte_of.get(i, 128)) < 128 else name for i, name in enumerate(pieces.names)]
        self.high = {i for i, b in self.byte_of.items() if b > 127}

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            return "".join(map(self.names.__getitem__, ids)).replace(GAP, " ")[1:]
        out: list[str] = []
        for of_bytes, run in groupby(ids, self.byte_of.__contains__):
            out.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace") if of_bytes else "".join(map(self.names.__getitem__, run)))
        return "".join(out).replace(GAP, " ")[1:]


def encode_documents(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", most: int = DICTIONARY, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """A row per document: its id (or the columns `keep`) and ids, the whole text's piece ids; with `check` also round_trip, whether they decode to the text.

    Null texts have null ids (and a round trip), empty ones none. Repeated rows are encoded alike; an empty table gives an empty result;
    other columns are not read. Words are cut where no piece reaches over, and all stretches of up to LONGEST characters get their ids from the
    lattice; longer ones (a run of letters without a space) are folded in the task, in time that grows as their length does, times its logarithm.

    Those that are not among the known ones travel with their text's hash: each distinct one once a text to the lattice, its ids back to the text.
    """
    keep = keep or [id_col]
    frequent = [r["word"] for r in frequent_words(docs, text_col, most).toLocalIterator()]
    deal = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work: not to be put together
    parts = docs.sparkSession.createDataFrame(pd.DataFrame({"word": sorted({p for w in frequent for p in pieces.stretches(w)})}, dtype="str"), "word string")
    known = words_of(parts.repartition(deal, "word"), pieces).toArrow().combine_chunks()  # the stretches of `most` words
    table = dict(zip(known["word"].to_pylist(), bytes_of(known["ids"].combine_chunks()), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.of(pieces, frequent, table))
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("_read_text"), F.xxhash64(text).alias("_key"), *keep)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = shared.value, set()  # copies in a task's own rows are asked for once
        for batch in batches:
            at, found = [], []
            for i, (t, key) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                t = t.as_py() or ""
                if (key, hash(t)) not in seen:
                    seen.add((key, hash(t)))
                    words = encoder.unseen(t)
                    at.extend([i] * len(words))
                    found.extend(words)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["_key", "word"])

    met = rows.select("_read_text", "_key").mapInArrow(others, "_key long not null, word string not null").repartition(deal, "word").distinct()
    # the least key of a word is below each of its keys; asking for it lets both sides of the join read one exchange
    lattice = words_of(met.groupBy("word").agg(F.min("_key").alias("_least")), pieces)
    given = met.join(lattice, "word").filter("_key >= _least").groupBy("_key").agg(F.collect_list(F.struct("word", "ids")).alias("_own"))
    copies = rows.groupBy("_key").agg(F.count("*").alias("_copies"))
    side = common.stored(copies.join(given, "_key", "left"))
    joined = common.join_with_hot_keys(rows, side, "_key", "_copies").select("_read_text", "_own", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value, Decoder(pieces)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(0).to_pylist()
                found = [None if t is None else encoder.encode(t, own) for t, own in zip(texts, owned(batch.column(1)), strict=True)]
                columns = [*batch.columns[2:], pa.array(found, pa.list_(pa.int32()))]
                if check:
                    columns.append(pa.array([t is None or decoder.decode(x.tolist()) == t.replace(GAP, " ") for t, x in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *["round_trip"] * check])

    schema = ", ".join(f"`{c}` {t}" for c, t in joined.dtypes[2:])
    return joined.mapInArrow(run, f"{schema}, ids array<int>" + ", round_trip boolean" * check)


def bytes_of(lists: pa.Array) -> Iterator[bytes]:
    """Each list of ids as bytes."""
    if isinstance(lists, pa.ChunkedArray):  # of no rows
        return
    values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    ends = 4 * np.cumsum([0, *lists.value_lengths().to_pylist()])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[a:b]


def owned(lists: pa.Array) -> Iterator[dict[str, bytes]]:
    """Of lists of (word, ids): word to ids as bytes."""
    entries = lists.flatten()
    pairs = zip(entries.field(0).to_pylist(), bytes_of(entries.field(1)), strict=True)
    for n in lists.value_lengths().fill_null(0).to_pylist():
        yield dict(islice(pairs, n))


def decode_documents(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all others by default) and decoded, the text of the ids: null for null, empty for none."""
    keep = keep or [c for c in encoded.columns if c != ids_col]
    rows = encoded.select(F.col(ids_col).alias("_read_ids"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                found = [None if x is None else decoder.decode(x) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], [*keep, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(run, f"{schema}, decoded string")


def op5_sentencepiece_lattice(spark, sf_dir: str) -> DataFrame:
    """Every whole text's ids, and whether they decode to the text again (a gap character in a text is a space)."""
    import public_tokenizers

    pieces = Pieces.load(public_tokenizers.path(MODEL))
    out = encode_documents(common.table(spark, sf_dir, "documents"), pieces, check=True)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), "ids", "round_trip")
