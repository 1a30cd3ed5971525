"""Lemma tables: DataFrames of (word, lemma).  A word that is not listed is its own lemma."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import constants as C

SCHEMA = "word string, lemma string"

# English inflection endings and what replaces them.
SUFFIX_RULES = [
    ("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"),
    ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""),
    ("er", ""), ("est", ""), ("er", "e"), ("est", "e"),
]


def seed_lemmas(spark: SparkSession) -> DataFrame:
    """A small fixed table for the seed vocabulary."""
    return spark.createDataFrame(list(C.SEED_LEMMAS.items()), SCHEMA)


def suffix_lemmas(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lemma table by suffix rules: an ending is removed when what remains is a word of the lexicon.

    `words` and `lexicon` each have a `word` column.
    """
    rules = F.array(*[F.struct(F.lit(a).alias("ending"), F.lit(b).alias("base")) for a, b in SUFFIX_RULES])
    word = F.col("word")
    bases = F.transform(
        F.filter(rules, lambda r: F.endswith(word, r["ending"])),
        lambda r: F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(r["ending"])), r["base"]),
    )
    base_forms = words.select("word").distinct().select("word", F.explode(F.array_distinct(bases)).alias("lemma"))
    known = lexicon.select(F.col("word").alias("lemma")).distinct()
    return base_forms.filter("lemma <> word and lemma <> ''").join(known, "lemma", "left_semi").select("word", "lemma")
