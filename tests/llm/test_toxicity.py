import random
import string

from tessera.llm import toxicity

from .conftest import EN, prose


def test_rare_offending_words_are_rated_at_any_size(spark):
    """21,000 common words of toxic documents, all in clean ones too, come before a word of four toxic documents by frequency."""
    rng = random.Random(9)
    many = ["".join(rng.choices(string.ascii_lowercase, k=3)) + str(i) for i in range(21_000)]
    rows = [(i, f"{' '.join(many)}. {prose(rng, EN, 8)}" + (" You utter zzgit." if i < 4 else ""), 1) for i in range(8)]
    rows += [(100 + i, f"{' '.join(many)}. {prose(rng, EN, 8)}", 0) for i in range(60)]
    sample = spark.createDataFrame(rows, "id long, text string, label int").repartition(4)
    chosen = toxicity.chosen_features(sample, 8, 60)
    assert {"zzgit", "zzgi*"} <= set(chosen) and not set(many) & set(chosen)


def test_all_leaning_features_are_in_the_model(spark):
    words = [f"q{i}q" for i in range(2_500)]
    rows = [(i, " ".join(words), 1) for i in range(6)] + [(10 + i, "the of and to", 0) for i in range(60)]
    chosen = toxicity.chosen_features(spark.createDataFrame(rows, "id long, text string, label int"), 6, 60)
    assert set(words) <= set(chosen)
