"""Fill-in-middle: texts cut between units and put in the order prefix, suffix, middle, so that a model learns to write what is missing."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A unit: a word with the ASCII white space before it, or the white space that ends a text.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 42, 50, 80
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points; four bytes a unit (a Spark string has fewer than 2 ** 31 characters)."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def seeds(key: str, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers that only the key and the seed decide."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def transformed(key: str, text: str, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    ends, (h1, h2, h3, h4) = unit_ends(text), seeds(key, seed)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, to = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if h4 % 100 < spm_percent:
        return n, "spm", at, to - at, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", at, to - at, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text again, from output and form alone. No part holds a mark, and no mark can begin inside a part, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return prefix + middle + suffix


def fim(key: Column, text: Column, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output) per text; key is text that names the document."""

    @F.pandas_udf(FIELDS)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(k, t, seed, percent, spm_percent) for k, t in zip(keys, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"], dtype=object)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key, text)


def digested(rows: Column) -> Column:
    """fim()'s struct with SHA-256 of the output and of the text that restored() makes of it, in place of the output.

    Spark runs it in the same pass of Python workers as fim(): outputs do not travel back in between.
    """

    @F.pandas_udf(DIGESTS)
    def run(made: pd.DataFrame) -> pd.DataFrame:
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        again = [sha(restored(o, f)) for o, f in zip(made["output"], made["form"], strict=True)]
        return made.drop(columns="output").assign(output_sha256=made["output"].map(sha).astype(object), restored_sha256=pd.Series(again, made.index, object))

    return run(rows)


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output.

    The id and the seed alone decide the cuts and the form: `percent` of the texts are transformed, `spm_percent` of those suffix first. A
    null text is an empty one, a null id the empty key; empty texts and those that hold a mark stay plain. Repeated rows give equal rows,
    an empty table an empty result; other columns are not read. No row moves.
    """
    made = fim(common.id_text(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")), seed, percent, spm_percent)
    return docs.select(F.col(id_col), made.alias("_made")).select(id_col, "_made.*")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    made = digested(fim(common.id_text("doc_id"), text))
    return common.table(spark, sf_dir, "documents").select("doc_id", made.alias("made")).select("doc_id", "made.*")


_H = ", ".join(f"CAST('0x' || substring(s, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_PART = "coalesce(list_aggregate(list_slice(u, {}, {}), 'string_agg', ''), '')"

OP11_SQL = f"""WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
    CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '{_UNIT}') END AS u FROM documents
), seeds AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_H} FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM seeds
), parts AS (SELECT *, {_PART.format(1, "low")} AS p, {_PART.format("low + 1", "high")} AS m, {_PART.format("high + 1", "n")} AS x FROM cuts),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m END AS output FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM made"""
