"""Searches over a text index: by words and phrases, by substring, and by relevance."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.operators.postings import BLOCK_BITS, GRAM, words
from linkweave.operators.search import like_pattern, text_condition
from linkweave.session import written
from linkweave.sources.text_index import TextIndex

K1, B = 1.2, 0.75
SCORE_DECIMALS = 6
#: Ids of the rarest word or substring are sent to all tasks up to this many; beyond it they are joined by a shuffle.
MOST_SENT_IDS = 200_000


def parse_query(query: str) -> list[list[str]]:
    """What a query asks for: phrases, each a list of words.  A quoted part is one phrase, and so is each other part."""
    parts = [quoted or plain for quoted, plain in re.findall(r'"([^"]*)"?|([^"\s]+)', query)]
    return [found for found in map(words, parts) if found]


def _rarest(hits: DataFrame, key: str, wanted: list[list[str]]) -> DataFrame | None:
    """Ids of the rarest of the words that every match must hold, if they are few enough to be sent to all tasks."""
    if len(wanted) != 1 or len(set(wanted[0])) < 2:
        return None
    counts = {r[key]: r["n"] for r in hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = min(set(wanted[0]), key=lambda w: (counts.get(w, 0), w))
    return hits.where(F.col(key) == rare).select("id").distinct() if counts.get(rare, 0) <= MOST_SENT_IDS else None


def search_words(index: TextIndex, queries: Sequence[str]) -> DataFrame:
    """(query, id) of every link that holds all words of a query, and its phrases word for word.

    Only the buckets of the asked words are read, and their places only if there is a phrase.  A query without a word finds
    nothing.  Matches of a query and link come together in one group, which is as long as the query.
    """
    parsed = {q: parse_query(q) for q in dict.fromkeys(queries)}
    parsed = {q: groups for q, groups in parsed.items() if groups}
    spark = index.spark
    steps = [
        (q, g, off, term, len(group), len(groups))
        for q, groups in parsed.items()
        for g, group in enumerate(groups)
        for off, term in enumerate(group)
    ]
    table = spark.createDataFrame(steps, "query string, grp int, off int, term string, n_off int, n_grp int")
    if not steps:
        return table.select("query", F.lit(None).cast("long").alias("id")).where(F.lit(False))
    terms = sorted({s[3] for s in steps})
    phrases = any(len(group) > 1 for groups in parsed.values() for group in groups)
    rare = _rarest(index.postings(terms), "term", [[w for g in groups for w in g] for groups in parsed.values()])
    hits = index.postings(terms, positions=phrases)
    if not phrases:
        hits = hits.withColumn("positions", F.array(F.lit(1)))
    if rare is not None:
        hits = hits.join(F.broadcast(rare), "id", "left_semi")
    asked = hits.join(F.broadcast(table), "term")  # the queries came from the driver
    starts = F.when(F.col("n_off") > 1, F.transform("positions", lambda p: p - F.col("off"))).otherwise(F.array(F.lit(1)))
    found = asked.groupBy("query", "id").agg(
        F.any_value("n_grp").alias("n_grp"),
        F.collect_set(F.struct("grp", "off", "n_off", starts.alias("starts"))).alias("found"),
    )

    def holds(group: Column) -> Column:
        mine = F.filter("found", lambda f: f["grp"] == group)
        common = F.aggregate(mine, F.get(mine, F.lit(0))["starts"], lambda a, f: F.array_intersect(a, f["starts"]))
        return (F.size(mine) > 0) & (F.size(mine) == F.get(mine, F.lit(0))["n_off"]) & (F.size(common) > 0)

    every = F.forall(F.sequence(F.lit(0), F.col("n_grp") - 1), holds)
    return found.where(every).select("query", "id")


def literal_parts(query: str) -> list[str] | None:
    """The texts between the wildcards of a %query% search, in lower case; None where the pattern has no plain reading."""
    pattern, parts, part, i = like_pattern(query).lower(), [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            i += 1
            part += pattern[i]
        elif c in "%_":
            parts.append(part)
            part = ""
        else:
            part += c
        i += 1
    return [p for p in [*parts, part] if p]


def query_grams(query: str) -> list[str] | None:
    """Substrings of three characters that any match must hold; None if there are none to go by."""
    found = {p[i : i + GRAM] for p in literal_parts(query) or [] for i in range(len(p) - GRAM + 1)}
    return sorted(found) or None


def substring_candidates(index: TextIndex, queries: Sequence[str]) -> DataFrame:
    """(id, queries): links with a field that holds all substrings of a query, with the places of such queries in the list.

    Queries without substrings of three plain characters are left out.
    """
    wanted = {i: grams for i, query in enumerate(queries) if (grams := query_grams(query))}
    rows = [(i, gram, len(grams)) for i, grams in wanted.items() for gram in grams]
    table = index.spark.createDataFrame(rows, "query int, gram string, n int")
    hits = index.grams(sorted({gram for _, gram, _ in rows}))
    rare = _rarest(hits, "gram", list(wanted.values()))
    if rare is not None:
        hits = hits.join(F.broadcast(rare), "id", "left_semi")
    asked = hits.join(F.broadcast(table), "gram")  # the queries came from the driver
    held = asked.groupBy("id", "query").agg(F.count(F.lit(1)).alias("found"), F.any_value("n").alias("n"), F.bit_and("fields").alias("fields"))
    return held.where((F.col("found") == F.col("n")) & (F.col("fields") != 0)).groupBy("id").agg(F.collect_list("query").alias("queries"))


def search_substrings(index: TextIndex, links: DataFrame, queries: Sequence[str]) -> DataFrame:
    """The links whose title, description, URL or tags match %query%, with the `query`: the same rows as text_condition gives.

    Candidates come from the index and are verified, those of all queries in one pass over the links.  A query without three
    plain characters in a row is looked for in every link.
    """
    queries = list(dict.fromkeys(queries))
    short = [not query_grams(q) for q in queries]
    found = links.withColumn("_candidate", F.array().cast("array<int>"))
    if not all(short):
        candidates = substring_candidates(index, queries).withColumnRenamed("queries", "_candidate")
        found = links.join(candidates, "id", "left" if any(short) else "inner")
    held = [
        F.when(F.lit(short[i]) | F.array_contains(F.coalesce("_candidate", F.array().cast("array<int>")), i), F.when(text_condition(q), F.lit(q)))
        for i, q in enumerate(queries)
    ]
    return found.withColumn("query", F.explode(F.array_compact(F.array(*held)))).select("query", *links.columns)


def _impact(n: Column, length: Column, average: float) -> Column:
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / average))


def rank_words(index: TextIndex, query: str, k: int) -> DataFrame:
    """(user_id, rank, id, score): each user's k most relevant links for a query, by BM25; equal scores by id.

    A link counts if it holds any word of the query.  Numbers of links, of words and of links per word are those of all
    current links.  The highest count and least length in a block of ids bound its scores.  Of the blocks that hold links
    of a user the k with the highest bounds are scored first; of the others only those whose bound reaches the user's k-th
    score.  Scores have six decimals, and so blocks short of the k-th score by less than that are looked at.
    """
    spark, terms = index.spark, sorted({w for group in parse_query(query) for w in group})
    nothing = spark.createDataFrame([], "user_id string, rank int, id long, score double")
    totals = index.totals()
    if not terms or not totals["words"]:
        return nothing
    average = totals["words"] / totals["links"]
    held = {r["term"]: r["n"] for r in index.postings(terms).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held:
        return nothing
    weight = {t: math.log(1 + (totals["links"] - n + 0.5) / (n + 0.5)) for t, n in held.items()}
    weights = F.broadcast(spark.createDataFrame(sorted(weight.items()), "term string, weight double"))
    bound = F.sum(F.col("weight") * _impact(F.col("most"), F.col("shortest"), average)).alias("bound")
    bounds = index.blocks(terms).join(weights, "term").groupBy("block").agg(bound)
    links = index.versions().select("id", F.coalesce("user_id", F.lit("")).alias("user_id"), F.col("user_id").isNull().alias("_none"))
    links = written(links.withColumn("block", F.shiftright("id", BLOCK_BITS)), "ranked-links")
    user = ["user_id", "_none"]
    blocks = written(links.select(*user, "block").distinct().join(bounds, "block"), "ranked-blocks")
    best = W.partitionBy(*user).orderBy(F.desc("bound"), "block")
    top = written(blocks.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place"), "ranked-top")

    def scored(chosen: DataFrame) -> DataFrame:
        """Scores of the links of the chosen blocks that belong to a user who chose them."""
        hits = index.postings(list(weight), blocks=chosen.select("block").distinct()).join(weights, "term")
        score = F.round(F.sum(F.col("weight") * _impact(F.col("n"), F.col("length"), average)), SCORE_DECIMALS)
        mine = links.join(chosen.select(*user, "block"), [*user, "block"], "left_semi")
        return hits.groupBy("id").agg(score.alias("score")).join(mine.drop("block"), "id")

    first = written(scored(top), "ranked-first")
    order = W.partitionBy(*user).orderBy(F.desc("score"), "id")
    kth = first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k).select(*user, F.col("score").alias("kth"))
    rest = blocks.join(top.select(*user, "block"), [*user, "block"], "left_anti").join(kth, user, "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-SCORE_DECIMALS))
    ranked = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(F.when(~F.col("_none"), F.col("user_id")).alias("user_id"), "rank", "id", "score")
