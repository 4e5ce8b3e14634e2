import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in is that it was for on are with as his they be at one have this from by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde schon wenn ihre kann gegen vom können schön größe über straße jahr zwei haus stadt weg licht zeit welt".split()
#: Names that operators use for columns of their own, and that a table may bring along.
CLASHES = ["id", "key", "score", "held_out", "predicted", "lang_pred", "fp", "fingerprint", "component_id", "size", "shard", "slot", "law", "ids", "decoded", "digest", "canon", "label", "sequence_id", "offset", "length", "piece", "start", "_row", "_bucket", "_number", "word", "edges", "_text", "host", "at", "_id", "domain", "action", "_class", "_language", "_nearness", "_quality", "_read_text", "_scored_text", "row", "none", "first", "own", "lines", "line", "last", "gone", "mask", "part", "n"]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents in two languages, some copied, some junk, some toxic; and their labels."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        lang, words = ("en", EN) if i % 3 else ("de", DE)
        text = "\n".join(prose(rng, words, rng.randint(8, 40)) for _ in range(rng.randint(1, 4)))
        good = i % 4 != 0
        if not good:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        toxic = good and i % 6 == 1
        if toxic:
            text += " You utter nitwit" + rng.choice(["", "ted", "s", "ish"]) + " go. " + prose(rng, words, 6)
        rows.append((i, text, lang, f"s{min(i, 3)}", len(text)))
        labels.append((i, int(good), int(toxic)))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, rows[1][1] + " x", "en", "s0", 1), (302, "", None, None, None), (303, None, "en", "s1", None), (304, "12 34 !!", "de", "s1", 8), (None, "the of and to in is", "en", "s2", 3), (305, " \n\t", "en", "s", 3)]
    labels += [(None, 1, 0), (302, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing():
    """Adds columns with the names that operators use."""
    from pyspark.sql import functions as F

    return lambda df: df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
