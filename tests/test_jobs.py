import datetime as dt
import json
import os

import pandas as pd
from pyspark.sql import functions as F

from checks import inputs as I
from linkweave import constants as C
from linkweave import schemas
from linkweave.operators import generation, lemmas as L, matching
from linkweave.operators import tags as TG
from linkweave.plans import create
from linkweave.plans.create import create_links, link_key
from linkweave.sources.commands import read_commands, requests_from_commands, stream_commands
from linkweave.sources.links import LinkStore, read_links
from linkweave.sources.pages import read_pages
from linkweave.session import scratch, written
from linkweave.streaming.create import save_micro_batch, start_saving, usage_stream
from tests.test_tables import DAY, link, links_of

PAGES = [
    ("https://example.com", "<title>Example Tutorial</title><meta name='description' content='A great JavaScript tutorial'>", 200, "text/html"),
    ("https://other.org/doc.pdf", "%PDF", 200, "application/pdf"),
    ("https://gone.org", "<title>x</title>", 404, "text/html"),
]


def pages_of(spark):
    return spark.createDataFrame([(*p, None, None, None) for p in PAGES], schemas.PAGES)


def requests_frame(spark, rows):
    """rows: (seq, url, manual tags, user, team)"""
    full = [(s, u, m, user, team, "channel123", DAY + dt.timedelta(days=2, minutes=s)) for s, u, m, user, team in rows]
    return spark.createDataFrame(full, schemas.REQUESTS)


def model_of(tags):
    def model(batch: pd.DataFrame) -> pd.Series:
        return pd.Series([tags] * len(batch), index=batch.index)

    return model


def run(spark, rows, stored=(), model=None, **options):
    return create_links(
        requests_frame(spark, rows), links_of(spark, list(stored)), pages_of(spark), L.seed_lemmas(spark),
        model or model_of('["react", "frontend"]'), **options,
    )


def test_create_with_manual_tags(spark):
    result = run(spark, [(1, "https://example.com", ["javascript", "tutorial"], "user123", None)])
    row = result.changed.first()
    assert (row.title, row.description) == ("Example Tutorial", "A great JavaScript tutorial")
    assert row.tags[:4] == ["javascript", "tutorial", "react", "frontend"]
    assert (row.manual_tags, row.user_id, row.team_id, row.channel_id) == (["javascript", "tutorial"], "user123", "user123", "channel123")


def test_an_existing_link_is_returned_untouched(spark):
    stored = link(5, "https://example.com", "user123", title="kept")
    result = run(spark, [(1, "https://example.com", ["x"], "user123", None)], [stored])
    assert result.changed.count() == 0 and [r.id for r in result.returned.collect()] == [5]
    assert [r.title for r in result.links_after().collect()] == ["kept"]


def test_rejections(spark):
    result = run(spark, [(1, "", None, "u", "T"), (2, "https://gone.org", None, "u", "T"), (3, "https://example.com", ["x"] * 11, "u", "T")])
    got = {r.seq: (r.code, r.message, r.status) for r in result.rejected.collect()}
    assert got == {
        1: (C.CODE_VALIDATION, C.MSG_URL_REQUIRED, 400), 2: (C.CODE_EXTERNAL, "HTTP 404: ", 502),
        3: (C.CODE_VALIDATION, C.MSG_TOO_MANY_TAGS, 400)}
    assert result.changed.count() == 0
    light = run(spark, [(3, "https://example.com", ["x"] * 11, "u", "T")], validate=False)
    assert light.rejected.count() == 0 and light.changed.count() == 1


def test_repeated_tags_are_stored_once(spark):
    result = run(spark, [(1, "https://nowhere.org/a/b", ["javascript", "tutorial", "react"], "user123", None)])
    row = result.changed.first()
    assert row.tags == ["javascript", "tutorial", "react", "frontend"] and row.title == "b - nowhere.org"


def test_pages_that_are_not_html_get_their_url_as_title(spark):
    row = run(spark, [(1, "https://other.org/doc.pdf", None, "u", "T")]).changed.first()
    assert (row.title, row.description) == ("doc.pdf - other.org", "")


def test_failed_replies_leave_earlier_saves(spark):
    """Two teams save one page; the later team's reply cannot be read, so the first save stays."""
    replies = spark.createDataFrame(
        [("T1", '["one"]'), ("T2", '["broken" "]'), ("T3", '["three"]')], "team string, reply string"
    ).select(link_key(F.col("team"), F.lit("https://example.com")).alias("link_id"), F.lit("tags").alias("stage"), "reply")
    url = "https://example.com"
    result = run(spark, [(1, url, None, "a", "T1"), (2, url, None, "b", "T2")], model=replies)
    row = result.changed.first()
    assert row.user_id == "a" and row.tags[0] == "one"
    assert [(r.seq, r.code) for r in result.rejected.collect()] == [(2, C.CODE_EXTERNAL)]
    later = run(spark, [(1, url, None, "b", "T2"), (2, url, None, "a", "T1"), (3, url, None, "c", "T3")], model=replies)
    row = later.changed.first()
    assert row.user_id == "a" and row.tags[0] == "three" and row.team_id == "T1"


def test_the_model_is_asked_once_per_page_and_team(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def model(batch: pd.DataFrame) -> pd.Series:
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(batch["link_id"] + "|" + batch["content"].str.slice(0, 6)))
        return pd.Series(["[]"] * len(batch), index=batch.index)

    rows = [(i, "https://example.com", None, f"u{i}", f"T{i % 2}") for i in range(1, 9)]
    assert run(spark, rows, model=model).changed.count() == 1
    calls = [line for p in log.iterdir() for line in p.read_text().splitlines()]
    assert sorted(calls) == ["T0\x1fhttps://example.com|Exampl", "T1\x1fhttps://example.com|Exampl"]


def command(seq, text, user, team="T1"):
    at = (DAY + dt.timedelta(days=2, minutes=seq)).isoformat()
    return {"type": "process_bookmark", "seq": seq, "sent_at": at,
            "command": {"text": text, "user_id": user, "team_id": team, "channel_id": "C", "response_url": ""}}


def write_commands(folder, name, commands):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(c) for c in commands))


def requests_json(spark, path):
    return spark.read.schema(schemas.COMMANDS).json(str(path))


def test_a_page_listed_twice_counts_once(spark):
    twice = spark.createDataFrame(
        [(u, "<title>Old javascript javascript</title>", 200, "text/html", None, None, DAY) for u, *_ in PAGES]
        + [(*p, None, None, DAY + dt.timedelta(days=1)) for p in PAGES], schemas.PAGES)
    rows = [(1, "https://example.com", None, "a", "T1"), (2, "https://gone.org", None, "a", "T1"), (3, "https://example.com", None, "a", "T1")]
    replies = spark.createDataFrame([("T1", '["one"]'), ("T1", '["one"]')], "team string, reply string").select(
        link_key(F.col("team"), F.lit("https://example.com")).alias("link_id"), F.lit("tags").alias("stage"), "reply")
    args = (links_of(spark, []), twice, L.seed_lemmas(spark), replies)
    result = create_links(requests_frame(spark, rows), *args)
    assert [(r.title, r.user_id) for r in result.links_after().collect()] == [("Example Tutorial", "a")]
    assert [(r.seq, r.message) for r in result.rejected.collect()] == [(2, "HTTP 404: ")]
    saved = result.changed.first()
    assert [(r.seq, r.id, r.url) for r in result.repeated.collect()] == [(3, saved.id, saved.url)]


def test_a_store_per_user_keeps_every_users_link(spark, tmp_path):
    rows = [link(i, f"https://x.org/{i % 7}", user=f"U{i}", tags=[f"t{i % 3}"]) for i in range(1, 40)]
    store = LinkStore(spark, str(tmp_path / "store"), buckets=4, key=("url", "user_id"))
    store.create(links_of(spark, rows))
    assert store.links().count() == 39
    store.delete(spark.createDataFrame([(5, "U5"), (6, "U5")], "id long, user_id string"), 0)
    assert sorted(r.id for r in store.links().collect()) == [i for i in range(1, 40) if i != 5]
    recount = TG.team_tag_usage(store.links())
    assert sorted(map(str, store.usage().collect())) == sorted(map(str, recount.collect()))
    wanted = spark.createDataFrame([("https://x.org/3",)], "url string")
    assert {r.url for r in store.links(urls=wanted).collect()} == {"https://x.org/3"}


def test_scratch_tables_go_with_their_batch(spark):
    with scratch(spark):
        path = written(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    commands = [
        command(1, "https://example.com react", "a"), command(2, "https://other.org/doc.pdf", "b"),
        command(3, "nonsense", "a"), command(4, "https://example.com vue", "b"), command(5, " https://example.com x", "a"),
    ]
    inbox = tmp_path / "in"
    write_commands(inbox, "one", commands)
    stored = links_of(spark, [link(1, "https://old.org", "z", ["react", "go"])])
    batch = create_links(
        requests_from_commands(read_commands(spark, str(inbox))), stored, pages_of(spark), L.seed_lemmas(spark),
        model_of('["alpha"]'),
    )
    store = LinkStore(spark, str(tmp_path / "store"), buckets=4)
    store.create(stored)

    def stream(checkpoint):
        start_saving(
            stream_commands(spark, str(inbox), files_per_batch=1), store, pages_of(spark), L.seed_lemmas(spark),
            model_of('["alpha"]'), str(tmp_path / checkpoint),
        ).awaitTermination()
        return sorted(map(str, store.links().collect())), sorted(map(str, store.usage().collect()))

    once = stream("c1")
    assert once[0] == sorted(map(str, batch.links_after().collect()))
    assert once[1] == sorted(map(str, batch.usage_after().collect()))
    assert [r.seq for r in store.rejected().collect()] == [3]
    assert stream("c2") == once  # the same batch number again, as after a failure

    write_commands(inbox, "two", [command(6, "https://old.org golang", "q"), command(7, "https://example.com", "c")])
    twice = stream("c1")
    assert len(twice[0]) == 3 and twice != once
    recount = TG.team_tag_usage(store.links())
    assert twice[1] == sorted(map(str, recount.collect()))

    compact = store.compact(str(tmp_path / "compact"))
    assert sorted(map(str, compact.links().collect())) == twice[0]
    assert sorted(map(str, compact.usage().collect())) == twice[1]
    newest = store.links().orderBy(F.desc("id")).first()
    store.delete(spark.createDataFrame([(newest.id, newest.user_id), (newest.id, "nobody")], "id long, user_id string"), 9)
    assert store.links().count() == 2 and store.highest_id() == newest.id
    write_commands(inbox, "three", [command(8, "https://new.org", "a")])
    save_micro_batch(requests_json(spark, inbox / "three.json"), 10, store, pages_of(spark), L.seed_lemmas(spark), model_of("[]"))
    assert store.links().filter("url = 'https://new.org'").first().id > newest.id  # the deleted link's id is not given again
    assert sorted(map(str, store.usage().collect())) == sorted(map(str, TG.team_tag_usage(store.links()).collect()))


def test_usage_of_added_links_as_a_stream(spark, tmp_path):
    df = links_of(spark, [link(i, f"u{i}", tags=["a", "b"][: i % 3]) for i in range(9)])
    df.repartition(3).write.parquet(str(tmp_path / "links"))
    links = spark.readStream.schema(schemas.LINKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "links"))
    running = (
        usage_stream(links).writeStream.outputMode("complete").format("memory").queryName("usage_now")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert sorted(map(str, spark.table("usage_now").collect())) == sorted(map(str, TG.team_tag_usage(df).collect()))


def test_readers_use_fixed_schemas(spark, tmp_path):
    links_of(spark, [link(1, "u")]).write.parquet(str(tmp_path / "l"))
    pages_of(spark).write.parquet(str(tmp_path / "p"))
    assert read_links(spark, str(tmp_path / "l")).schema == schemas.LINKS
    assert read_pages(spark, str(tmp_path / "p")).count() == 3


def test_a_table_is_a_stream_as_a_file_and_as_a_folder(spark, tmp_path):
    rows = spark.range(20).withColumn("text", F.concat(F.lit("t"), "id"))
    rows.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "file/documents.parquet")
    for kind in ("folder", "file"):
        got = []
        stream = I.table_stream(spark, str(tmp_path / kind), "documents")
        running = stream.writeStream.foreachBatch(lambda batch, number: got.extend(r.id for r in batch.collect()))
        running.option("checkpointLocation", str(tmp_path / f"checkpoint-{kind}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(got) == list(range(20))


def exchanges(df):
    return sum(line.lstrip(" :+-").startswith(("Exchange", "BroadcastExchange")) for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_no_job_of_the_driver_holds_many_exchanges(spark, monkeypatch):
    """The driver describes a job's whole plan after each of its exchanges, so one large job costs it much memory."""
    found = {}

    def counted(df, name):
        found[name] = max(found.get(name, 0), exchanges(df))
        return written(df, name)

    for module in (create, generation, matching):
        monkeypatch.setattr(module, "written", counted)
    result = run(spark, [(1, "https://example.com", None, "u1", "T1"), (2, "https://other.org/doc.pdf", None, "u2", "T1")])
    assert result.changed.count() == 2 and max(found.values()) <= 8, found
