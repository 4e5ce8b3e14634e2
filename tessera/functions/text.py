"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .template import Template

#: White space that str.strip() takes off, fixed values; a character class that Java's and RE2's patterns read alike.
WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = rf"\A{WHITE}+|{WHITE}+\z"
THINK = r"(?s)<think>.*?</think>"


def strip(text: Column) -> Column:
    """Without white space (Unicode's, not only blanks) at both ends."""
    return F.regexp_replace(text, STRIP, "")


def strip_think(text: Column) -> Column:
    """Without closed think blocks (the first close ends a block, case counts, an unclosed one stays), then stripped."""
    return strip(F.regexp_replace(text, THINK, ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def words(text: Column) -> Column:
    """What white space parts; no empty words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def question(text: Column) -> Column:
    return strip(text)


#: Words that end a session, fixed values.
EXIT_WORDS = ("exit", "quit")


def is_exit(text: Column) -> Column:
    """Whether a stripped question is one of the words that end a session."""
    return F.lower(text).isin(*EXIT_WORDS)


def chunk_id(source_file: Column, page: Column, index: Column, text: Column) -> Column:
    """SHA-256 hex of file, page, file-wide index and text with bars between; missing metadata is an empty field."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source_file, page, index, text)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_key(model: str, text: Column) -> Column:
    """SHA-256 hex of a model's name and a text: what a vector depends on."""
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), F.coalesce(text, F.lit(""))), 256)


def label(source_file: Column, page: Column, text: Column) -> Column:
    """A chunk under the name of its source, for attribution."""
    return F.concat(F.lit("["), F.coalesce(source_file, F.lit("unknown")), F.lit(", page "), F.coalesce(page.cast("string"), F.lit("?")), F.lit("]\n"), text)


#: Our wording of the instruction: answer from the context alone, say when it isn't there, name the source of a fact.
PROMPT_HEAD = (
    "Answer the question about the documents below.\n\n"
    "Rely on the context and on nothing else. Where the context does not hold the answer, say that it does not. "
    "Name the document that each fact comes from.\n\nContext:\n"
)
PROMPT_QUESTION, PROMPT_END = "\n\nQuestion:\n", "\n\nAnswer:"
#: The default of the setting PROMPT_TEMPLATE.
PROMPT = f"{PROMPT_HEAD}{{context}}{PROMPT_QUESTION}{{question}}{PROMPT_END}"


def prompt(context: Column, question: Column, template: str = PROMPT) -> Column:
    """The prompt; what context and question hold stays as it is, whatever it looks like. A template needn't have both slots."""
    parsed = Template(template)
    return parsed.column(**{k: v for k, v in {"context": context, "question": question}.items() if k in parsed.slots})


def meta(metadata: Column, key: str, default: str) -> Column:
    """A field of a page's metadata (a variant) as text; `default` where it is missing or null."""
    return F.coalesce(F.try_variant_get(metadata, F.lit(f"$.{key}") if key.isidentifier() else F.lit(f'$["{key}"]'), "string"), F.lit(default))


def hashed_bucket(word: Column, dim: int) -> Column:
    """The first eight hex digits of a word's md5, modulo `dim`."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hashed_vector(text: Column, dim: int) -> Column:
    """How many words of the text fall into each of `dim` buckets, as doubles; for a few texts (a bulk goes through an Embedder)."""
    buckets = F.transform(words(text), lambda w: hashed_bucket(w, dim))
    # in an array of one, so that the words are hashed once and not once a bucket
    counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(own, lambda x: x == b)).cast("double"))
    return F.transform(F.array(buckets), counts)[0]
