"""Tag generation for a table of links: matching, prompts, replies, merging.

A model is either a table of stored replies (link_id, stage, reply) or a function that maps a
pandas frame with columns link_id, prompt, content to a sequence of reply texts.  Calls run inside
Spark partitions; a link is asked about once per stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import tagging as G
from linkweave.functions.webtags import include_existing_and_page_tags, scored_page_tags
from linkweave.operators.matching import match_tags, matches_per_link
from linkweave.session import written

STAGE_TAGS = "tags"
STAGE_SPECIFICITY = "specificity"

Model = Callable[[pd.DataFrame], "pd.Series"]


def ask(prompts: DataFrame, model: Model) -> DataFrame:
    """(link_id, reply): one reply per (link_id, prompt, content) row, asked in Arrow batches."""
    id_type = prompts.schema["link_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"link_id": batch["link_id"], "reply": pd.Series(model(batch), index=batch.index)})

    return prompts.select("link_id", "prompt", "content").mapInPandas(run, f"link_id {id_type}, reply string")


def _replies(prompts: DataFrame, stage: str, model: Model | DataFrame) -> DataFrame:
    if isinstance(model, DataFrame):  # of several stored replies to one prompt the greatest text counts
        return model.filter(F.col("stage") == stage).groupBy("link_id").agg(F.max("reply").alias("reply"))
    return written(ask(prompts, model), f"replies-{stage}")


def first_prompts(links: DataFrame, matches: DataFrame) -> DataFrame:
    """Links with their matches, the first prompt and its content."""
    none = F.array().cast("array<struct<tag:string,score:double>>")
    return (
        links.join(matches_per_link(matches), "link_id", "left")
        .withColumn("matches", F.coalesce("matches", none))
        .withColumn("matched", F.transform("matches", lambda m: m["tag"]))
        .withColumn("prompt", G.tag_prompt(F.col("url"), F.col("title"), F.col("description"), F.col("matched")))
        .withColumn("content", G.prompt_content(F.col("title"), F.col("description")))
    )


def second_prompts(asked: DataFrame) -> DataFrame:
    """Links whose first reply holds tags outside the vocabulary, with the second prompt."""
    candidates = G.candidate_tags(F.col("initial"), F.col("matched"))
    return (
        asked.withColumn("candidates", candidates)
        .filter(F.size("candidates") > 0)
        .withColumn(
            "prompt",
            G.specificity_prompt(F.col("url"), F.col("title"), F.col("description"), F.col("candidates")),
        )
        .withColumn("content", G.specificity_content(F.col("candidates")))
    )


def generate_tags(
    links: DataFrame, candidates: DataFrame, lemmas: DataFrame, model: Model | DataFrame
) -> DataFrame:
    """(link_id, generated): null where the first reply is missing, empty or not JSON.

    links: link_id, url, title, description, team_id, and page_tags if pages declare tags that are to be included.
    Manual tags join in later (manual_first).
    """
    base = first_prompts(links, written(match_tags(links, candidates, lemmas), "matches"))
    if not isinstance(model, DataFrame):
        base = written(base, "prompts")
    replied = base.join(_replies(base, STAGE_TAGS, model), "link_id", "left")
    asked = replied.withColumn("initial", G.reply_tags(F.col("reply"))).drop("reply", "prompt", "content")
    second = _replies(second_prompts(asked), STAGE_SPECIFICITY, model)
    kept = G.filtered_tags(F.col("initial"), F.col("matched"), F.col("reply"))
    if "page_tags" in links.columns:
        none = F.array().cast("array<string>")
        scored = scored_page_tags(F.coalesce("page_tags", none), F.col("title"), F.col("description"))
        generated = F.when(F.col("kept").isNotNull(), include_existing_and_page_tags(F.col("kept"), F.col("matches"), scored))
    else:
        generated = G.add_high_scorers(F.col("kept"), F.col("matches"))
    return asked.join(second, "link_id", "left").withColumn("kept", kept).select("link_id", generated.alias("generated"))
