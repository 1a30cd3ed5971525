"""Scored matching of link keywords against each team's tag vocabulary.

Per keyword occurrence and tag the first rule that applies gives points: equal (15), same lemma
(12), keyword inside tag (8), tag inside keyword (5).  A tag that has no points yet when a keyword
with similarity >= 80 comes by gets similarity / 10 once.  Points add up per (link, tag); the best
six tags stay.

How it runs: every rule is an equi-join between *distinct* (team, keyword) and (team, tag) pairs.
The pair table is joined back to the occurrences with hot keywords split, and one shuffle by link
adds up and ranks.  The order-dependent part of the rules has a closed form: the fuzzy score of a
tag counts exactly when the first similar keyword comes before the first keyword with points.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import similarity as S
from linkweave.functions.text import ASTRAL, blank_to_null, link_keywords, utf16_length
from linkweave.operators.skew import hot_keys, join_split_hot
from linkweave.session import written

# Longest substring used as a join key; beyond it the key is a prefix and the match is verified.
KEY_LENGTH = 50
# First similar position and its similarity travel as one number, so that the sum stays a hash aggregate.
_PACK = 128


def keyword_occurrences(links: DataFrame) -> DataFrame:
    """(link_id, team_id, pos, keyword) of every keyword, for links that have a team."""
    return links.filter(blank_to_null(F.col("team_id")).isNotNull()).select(
        "link_id", "team_id", F.posexplode(link_keywords(F.col("title"), F.col("description"))).alias("pos", "keyword")
    )


def _lengths(df: DataFrame, length: Column) -> Column:
    """The distinct lengths that occur, as one array.  There are few: words are short."""
    return df.agg(F.array_sort(F.collect_set(length)).alias("lengths")).scalar()


def _known_lengths(df: DataFrame, *lengths: Column) -> list[Column]:
    """The same for several lengths in one pass, found now: plans that use them hold the values and no subquery."""
    found = df.agg(*[F.array_sort(F.collect_set(n)).alias(f"n{i}") for i, n in enumerate(lengths)]).first()
    return [F.from_json(F.lit(json.dumps(ns)), "array<int>") for ns in found]


def _tasks(df: DataFrame) -> int:
    """Enough tasks for rows that are small but take long: many keys are made from each word."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _key_length(col: Column) -> Column:
    return F.least(F.length(col), F.lit(KEY_LENGTH))


def _substrings(df: DataFrame, text: str, lengths: Column) -> DataFrame:
    """`df` with `_key`: substrings of the given lengths, three UTF-16 units at least, one row each.

    Rows go by start first and then by length, so that no row ever holds all substrings of a long word.
    """
    shortest = F.when(F.col(text).rlike(ASTRAL), F.lit(2)).otherwise(F.lit(3))
    starts = df.withColumn("_least", shortest).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text))))
    room = F.length(text) - F.col("_at") + 1
    fitting = F.filter(F.col("_lengths"), lambda n: (n >= F.col("_least")) & (n <= room))
    sized = starts.withColumn("_lengths", lengths).withColumn("_size", F.explode(fitting))
    return sized.withColumn("_key", F.substring(F.col(text), F.col("_at"), F.col("_size"))).select(*df.columns, "_key")


def _pair(boost: Column, similarity: Column | None = None) -> list[Column]:
    return [
        F.col("team_id"),
        F.col("keyword"),
        F.col("tag"),
        F.col("tag_rank"),
        boost.cast("int").alias("boost"),
        (F.lit(None) if similarity is None else similarity).cast("int").alias("similarity"),
    ]


def _is_long(tag: Column) -> Column:
    return utf16_length(tag) > 2


def _tag_in_keyword(words: DataFrame, tags: DataFrame, lengths: Column) -> DataFrame:
    """Equal words, and tags that are part of a keyword.  lengths: those of the long tags' keys."""
    long_tags = tags.filter(_is_long(F.col("tag")))
    pieces = _substrings(words.select("team_id", "keyword").filter("keyword <> ''"), "keyword", lengths)
    keyed = long_tags.withColumn("_key", F.substring("tag", 1, KEY_LENGTH))
    return (
        pieces.join(keyed, ["team_id", "_key"])
        .filter((F.length("tag") <= KEY_LENGTH) | F.contains("keyword", "tag"))
        .select(
            *_pair(
                F.when(F.col("keyword") == F.col("tag"), C.SCORE_PERFECT).otherwise(C.SCORE_TAG_IN_KEYWORD)
            )
        )
    )


def _keyword_in_tag(words: DataFrame, tags: DataFrame, lengths: Column) -> DataFrame:
    """Keywords that are part of a tag.  lengths: those of the keywords' keys."""
    pieces = _substrings(tags.select("team_id", "tag", "tag_rank").filter("tag <> ''"), "tag", lengths)
    keyed = words.select("team_id", "keyword", F.substring("keyword", 1, KEY_LENGTH).alias("_key"))
    return (
        pieces.join(keyed, ["team_id", "_key"])
        .filter(F.col("keyword") != F.col("tag"))
        .filter((F.length("keyword") <= KEY_LENGTH) | F.contains("tag", "keyword"))
        .select(*_pair(F.lit(C.SCORE_KEYWORD_IN_TAG)))
    )


def _with_lemmas(df: DataFrame, word: Column, lemmas: DataFrame) -> DataFrame:
    """One row per lemma of the word; the word itself is always one of them."""
    forms = F.explode(F.array_distinct(F.array_compact(F.array(F.col("_word"), F.col("lemma")))))
    return (
        df.withColumn("_word", F.lower(word))
        .join(lemmas.select(F.col("word").alias("_word"), "lemma"), "_word", "left")
        .withColumn("_lemma", forms)
        .drop("_word", "lemma")
    )


def _grammatical(words: DataFrame, tags: DataFrame, lemmas: DataFrame) -> DataFrame:
    return (
        _with_lemmas(words.select("team_id", "keyword"), F.col("keyword"), lemmas)
        .join(_with_lemmas(tags, F.col("tag"), lemmas), ["team_id", "_lemma"])
        .filter(F.col("keyword") != F.col("tag"))
        .select(*_pair(F.lit(C.SCORE_GRAMMATICAL)))
    )


def _comparable_length(col: Column) -> Column:
    """Length of the form that the fuzzy rule compares; null where that is empty."""
    return F.nullif(F.length(S.comparable(col)), F.lit(0))


def _fuzzy(words: DataFrame, tags: DataFrame, word_lengths: Column, tag_lengths: Column) -> DataFrame:
    """Similar words.  word_lengths, tag_lengths: those of their comparable forms."""
    w = words.select("team_id", "keyword", S.comparable(F.col("keyword")).alias("_w")).filter("_w <> ''")
    t = tags.withColumn("_t", S.comparable(F.col("tag"))).filter("_t <> ''")
    # written, so that what decides about a broadcast is their size and not that of the lengths they are made from
    word_pieces = written(S.pieces_of_lengths(words.sparkSession, word_lengths, tag_lengths, S.segment_pieces), "word-pieces")
    tag_pieces = written(S.pieces_of_lengths(words.sparkSession, tag_lengths, word_lengths, S.probe_pieces), "tag-pieces")

    def keyed(df: DataFrame, text: str, pieces: DataFrame) -> DataFrame:
        col, size = F.col(text), F.length(text)
        df = df.select(*df.columns, size.alias(f"{text}_size"), S.letter_mask(col).alias(f"{text}_mask"))
        joined = df.join(pieces, F.col(f"{text}_size") == F.col("n"))
        return joined.withColumn("_key", S.hashed_key(col)).drop(*pieces.columns)

    passes = S.maybe_similar(
        F.col("_w"), F.col("_t"), F.col("_w_size"), F.col("_t_size"), F.col("_w_mask"), F.col("_t_mask")
    )
    return (
        keyed(w, "_w", word_pieces)
        .join(keyed(t, "_t", tag_pieces), ["team_id", "_key"])
        .filter(passes & (F.col("keyword") != F.col("tag")))
        .select("team_id", "keyword", "tag", "tag_rank", "_w", "_t")
        .distinct()
        .withColumn("similarity", S.similarity(F.col("_w"), F.col("_t")))
        .filter(S.similar_enough(F.col("similarity")))
        .select(*_pair(F.lit(0), F.col("similarity")))
    )


def word_pairs(words: DataFrame, tags: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(team_id, keyword, tag, tag_rank, boost, similarity) of every pair to which some rule applies.

    words: distinct (team_id, keyword).  tags: distinct (team_id, tag) with tag_rank.  Every rule
    reads both, so give tables that are cheap to read again.
    Points follow rule priority, so the highest points of a pair are those of its first rule.

    Each rule is a job of its own: the driver plans and keeps a few exchanges at a time, not all of them, and
    the plan that it describes anew after each one is that of one rule.
    """
    tag, keyword = F.col("tag"), F.col("keyword")
    tag_keys, tag_lengths = _known_lengths(tags, F.when(_is_long(tag), _key_length(tag)), _comparable_length(tag))
    word_keys, word_lengths = _known_lengths(words, _key_length(keyword), _comparable_length(keyword))
    hits = (
        written(_tag_in_keyword(words, tags, tag_keys), "rule-tag-in-keyword")
        .unionByName(written(_keyword_in_tag(words, tags, word_keys), "rule-keyword-in-tag"))
        .unionByName(written(_grammatical(words, tags, lemmas), "rule-grammatical"))
        .unionByName(written(_fuzzy(words, tags, word_lengths, tag_lengths), "rule-fuzzy"))
    )
    return hits.groupBy("team_id", "keyword", "tag").agg(
        F.min("tag_rank").alias("tag_rank"), F.max("boost").alias("boost"), F.max("similarity").alias("similarity")
    )


def match_tags(
    links: DataFrame, candidates: DataFrame, lemmas: DataFrame, limit: int | None = C.MAX_MATCHES, **hot_options
) -> DataFrame:
    """(link_id, match_rank, tag, score, match_types) of each link's best tags.

    links: link_id, team_id, title, description.  candidates: team_id, tag, tag_rank.
    """
    occurrences = written(keyword_occurrences(links), "occurrences")
    tasks = _tasks(links)
    words = written(
        occurrences.groupBy("team_id", "keyword").agg(F.count(F.lit(1)).alias("n")).repartition(tasks), "words"
    )
    candidates = written(candidates.select("team_id", "tag", "tag_rank").repartition(tasks), "candidates")
    pairs = written(word_pairs(words.select("team_id", "keyword"), candidates, lemmas), "pairs")
    keys = ["team_id", "keyword"]
    partners = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("tags"))
    made = words.join(partners, keys).select(*keys, (F.col("n") * F.col("tags")).alias("n"))  # rows the join makes of a keyword
    hot = written(hot_keys(written(made, "made"), keys, "n", **hot_options), "hot")
    hits = join_split_hot(occurrences, pairs, keys, hot, ["link_id"])
    return rank_matches(hits, limit)


def rank_matches(hits: DataFrame, limit: int | None) -> DataFrame:
    """Add up occurrence hits per (link, tag) and keep each link's best tags."""
    boosted = F.col("boost") > 0
    rule = (
        F.when(F.col("boost") == C.SCORE_PERFECT, C.MATCH_TYPES["perfect"])
        .when(F.col("boost") == C.SCORE_GRAMMATICAL, C.MATCH_TYPES["grammatical-variation"])
        .when(F.col("boost") == C.SCORE_KEYWORD_IN_TAG, C.MATCH_TYPES["keyword-in-tag"])
        .when(F.col("boost") == C.SCORE_TAG_IN_KEYWORD, C.MATCH_TYPES["tag-in-keyword"])
        .otherwise(0)
    )
    # One exchange by link serves both the sum and the ranking.  A link's hits are bounded by its own text.
    sums = (
        hits.repartition("link_id")
        .groupBy("link_id", "tag")
        .agg(
            F.sum("boost").alias("points"),
            F.min(F.when(boosted, F.col("pos"))).alias("first_boost"),
            F.min(F.when(~boosted, F.col("pos").cast("long") * _PACK + F.col("similarity"))).alias("first_fuzzy"),
            F.min("tag_rank").alias("tag_rank"),
            F.bit_or(rule).alias("rules"),
        )
    )
    fuzzy_pos = F.floor(F.col("first_fuzzy") / _PACK)
    use_fuzzy = F.col("first_fuzzy").isNotNull() & (
        F.col("first_boost").isNull() | (fuzzy_pos < F.col("first_boost"))
    )
    fuzzy_score = F.pmod(F.col("first_fuzzy"), F.lit(_PACK)).cast("double") / 10
    names = F.filter(
        F.array(*[F.when(F.col("rules").bitwiseAND(bit) != 0, name) for name, bit in C.MATCH_TYPES.items()]),
        lambda n: n.isNotNull(),
    )
    scored = sums.withColumn("use_fuzzy", use_fuzzy).select(
        "link_id",
        "tag",
        (F.col("points") + F.when(F.col("use_fuzzy"), fuzzy_score).otherwise(0.0)).alias("score"),
        F.when(F.col("use_fuzzy"), fuzzy_pos).otherwise(F.col("first_boost")).alias("first_pos"),
        F.col("use_fuzzy").cast("int").alias("phase"),
        "tag_rank",
        F.when(F.col("use_fuzzy"), F.col("rules").bitwiseOR(F.lit(C.MATCH_TYPES["fuzzy"])))
        .otherwise(F.col("rules"))
        .alias("rules"),
    )
    best_first = W.partitionBy("link_id").orderBy(F.desc("score"), "first_pos", "phase", "tag_rank")
    ranked = scored.withColumn("match_rank", F.row_number().over(best_first))
    if limit is not None:
        ranked = ranked.filter(F.col("match_rank") <= limit)
    return ranked.select("link_id", F.col("match_rank").cast("long").alias("match_rank"), "tag", "score", names.alias("match_types"))


def matches_per_link(matches: DataFrame) -> DataFrame:
    """(link_id, matches): each link's ranked matches as array<struct<tag, score>>."""
    entry = F.struct("match_rank", "tag", "score")
    return matches.groupBy("link_id").agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda m: F.struct(m["tag"].alias("tag"), m["score"].alias("score"))
        ).alias("matches")
    )
