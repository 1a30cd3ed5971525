"""Inputs of the registered queries, derived by Spark from the given tables (oracles.py has the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions.text import keywords, link_keywords
from linkweave.sources.pages import extract_metadata

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of files.

    A stream takes a plain path for a folder; a pattern, here one letter in brackets, may also name a file.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def documents_as_links(docs: DataFrame) -> DataFrame:
    """A stored collection: one link per document, its whole text as title and description."""
    title = F.substring_index("text", "\n", 1)
    seeds = F.array(*[F.lit(t) for t in C.SEED_TAGS])
    source_tag = F.get(seeds, F.pmod(F.regexp_extract("source", "([0-9]+)", 1).cast("int"), F.lit(len(C.SEED_TAGS))))
    tags = F.slice(F.array_distinct(F.concat(F.array(source_tag), keywords(title))), 1, C.MAX_TAGS)
    created = F.expr(f"{EPOCH} + make_dt_interval(0, 0, cast(doc_id as int), 0)")
    return docs.select(
        (F.col("doc_id") + 1).alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        title.alias("title"),
        F.nullif(F.substring("text", F.length(title) + 2, F.length("text")), F.lit("")).alias("description"),
        tags.alias("tags"),
        F.lit(None).cast("array<string>").alias("manual_tags"),
        F.expr("concat('U', doc_id % 50)").alias("user_id"),
        F.expr("concat('T', doc_id % 7)").alias("team_id"),
        F.expr("concat('C', doc_id % 20)").alias("channel_id"),
        F.lit(False).alias("is_private"),
        created.alias("created_at"),
        (created + F.expr("make_dt_interval(0, cast(doc_id % 5 as int), 0, 0)")).alias("updated_at"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return documents_as_links(table(spark, sf, "documents"))


HEADS = {
    0: "''",
    1: """concat('<meta name="description" content="D ', page_id, ' &amp; more">"""
    """<script type="application/ld+json">[{"keywords":"One, Two ,,page ', page_id, '"},{"tags":["x"]}]</script>')""",
    2: """concat('<meta property=\\'og:description\\' content=\\'O ', page_id, '\\'><script type="application/ld+json">{"tags": ["broken"</script>')""",
    3: """concat('<meta name="twitter:description" content="T ', page_id, '">')""",
    4: """concat('<title></title><meta property="og:title" content="OG ', page_id, '">')""",
    5: "'<title> </title>'",
    6: """concat('<meta property="og:image" content="https://img.example.com/', page_id, '.png">')""",
    7: """concat('<meta name="keywords" content="Alpha, beta;gamma"><meta name="article:tag" content="delta">"""
    """<meta name="tags" content="Beta,page ', page_id, '"><script type="application/ld+json">{"keywords":["K ', page_id,"""
    """ '", 5],"tags":["t"],"about":[{"name":"Topic"}]}</script><a class="tag" href="/x">Linked</a>')""",
}


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def pages_with_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with one of eight kinds of head elements put in front of its whole HTML."""
    cases = " ".join(f"when page_id % 8 = {k} then {v}" for k, v in HEADS.items())
    return pages(spark, sf).withColumn("html", F.concat(F.expr(f"case {cases} end"), "html"))


def fetched_pages(spark: SparkSession, sf: str, heads: bool = False) -> DataFrame:
    """Every page with a fetch result."""
    return (pages_with_heads if heads else pages)(spark, sf).selectExpr(
        "page_id", "url", "case when page_id % 11 = 3 then null else html end as html",
        "case when page_id % 5 = 0 then 404 when page_id % 5 = 1 then 301 else 200 end as status",
        "case when page_id % 3 = 0 then 'text/html; charset=utf-8' when page_id % 3 = 1 then 'text/html' "
        "when page_id % 2 = 0 then 'application/pdf' end as content_type",
        "if(page_id % 13 = 4, 2000000, octet_length(html)) as n_bytes",
    )


def _events_with_urls(spark: SparkSession, sf: str) -> DataFrame:
    all_pages = pages(spark, sf).select("page_id", "url")
    n = all_pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    events = table(spark, sf, "events").withColumn("page_id", F.pmod("event_id", n))
    return events.join(all_pages, "page_id")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One save request per event."""
    return _events_with_urls(spark, sf).selectExpr(
        "event_id as seq", "url", "if(event_id % 4 = 0, array(event_type), null) as manual_tags",
        "concat('U', user_id) as user_id", "concat('T', user_id % 7) as team_id",
        "concat('C', event_id % 20) as channel_id", "ts as requested_at",
    )


COMMAND_TEXT = """case event_type
  when 'click' then concat(url, ' ', event_type)
  when 'view' then concat('  ', url, '  ')
  when 'purchase' then concat(url, repeat(' Buy', cast(user_id % 13 as int)))
  when 'signup' then concat(url, ' ', repeat('x', cast(user_id % 60 as int)), ' tail')
  else case user_id % 3 when 0 then '' when 1 then replace(url, '://', '//') else upper(url) end end"""


def commands_from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "'process_bookmark' as type",
        f"""named_struct('text', {COMMAND_TEXT},
            'user_id', if(user_id % 50 = 7, ' ', concat('U', user_id)),
            'team_id', if(user_id % 50 = 8, '', concat('T', user_id % 7)),
            'channel_id', if(user_id % 50 = 9, '', concat('C', event_id % 20)),
            'response_url', cast(null as string)) as command""",
        "event_id as seq", "ts as sent_at",
    )


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """One command per event, some of them malformed."""
    return commands_from_events(_events_with_urls(spark, sf))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Stored links of the pages with a secure URL."""
    return pages(spark, sf).filter("url like 'https://%'").selectExpr(
        "page_id + 1 as id", "url", "concat('Stored ', page_id) as title",
        "cast(null as string) as description", "array('stored', concat('p', page_id % 9)) as tags",
        "cast(null as array<string>) as manual_tags", "concat('U', page_id % 150) as user_id",
        "concat('T', page_id % 7) as team_id", "concat('C', page_id % 20) as channel_id", "false as is_private",
        "timestamp_ntz'2023-06-01 00:00:00' as created_at", "timestamp_ntz'2023-06-01 00:00:00' as updated_at",
    )


def lemma_words(spark: SparkSession, sf: str, tags: DataFrame | None = None) -> DataFrame:
    """Every keyword of the titles and descriptions of all pages and documents, and every tag, as (word).  tags: tag_words, if at hand."""
    texts = extract_metadata(pages_with_heads(spark, sf)).select("title", "description").unionByName(
        links(spark, sf).select("title", "description")
    )
    found = texts.select(F.explode(link_keywords(F.col("title"), F.col("description"))).alias("word"))
    return found.unionByName(tag_words(spark, sf) if tags is None else tags).distinct()


def tag_words(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).select(F.explode("tags").alias("word")).distinct()


def first_reply(title: str = "title", url: str = "url") -> str:
    """SQL text, the same in both engines, of a reply that depends on the link."""
    return f"""case length({url}) % 7
      when 0 then concat('Sure: ["', replace({url}, 'https://', ''), '", "Alpha ", 1, null, "beta"] done')
      when 1 then 'no tags today'
      when 2 then '["open" "source"]'
      when 3 then ''
      when 4 then '["javascript", "TypeScript", "api", "docker", "{'x' * 51}", "", "one", "two", "three", "four", "five", "six", "seven"]'
      when 5 then '[["nested"], {{"a": "b"}}, true, "gamma", "gamma"]'
      else concat('["', 'n', length({title}), '"]', chr(10), 'text') end"""


def second_reply(url: str = "url") -> str:
    return f"""case length({url}) % 5 when 0 then '[]' when 1 then 'keep ["alpha", 7, "Kept"] please'
      when 2 then '["broken' when 3 then '["x"] ["y"]' else '["beta"]' end"""


# What the searches over indexes ask for.
TEXT_QUERIES = ["the thing", '"of the" in', 'renamed los', '"in the" "to the"', "Renamed 12", "que la", '"er die"', "on", ""]
SUBSTRINGS = ["tion_s", "nd the%on", "RENAMED 1", "x", '\\t%", "', "0.example.org/en", "heit%\\%", "qu_ l"]
RELEVANCE_QUERY = "the thing on der renamed que"
