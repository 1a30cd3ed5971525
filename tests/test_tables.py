import datetime as dt
import random

from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave import schemas
from linkweave.operators import search as S
from linkweave.operators import store as ST
from linkweave.operators import tags as TG
from linkweave.plans import lookup as LK
from linkweave.sources.vocabulary import seed_tags
from tests import models

DAY = dt.datetime(2024, 1, 1)


def link(i, url, user="U1", tags=(), title="t", description=None, team="T1", minutes=0):
    at = DAY + dt.timedelta(minutes=minutes or i)
    return (i, url, title, description, list(tags), None, user, team, "C1", False, at, at)


def links_of(spark, rows):
    return spark.createDataFrame(rows, schemas.LINKS)


def requests_of(spark, rows):
    """rows: (seq, url, user, content title)"""
    full = [(seq, url, user, "T1", "C1", DAY + dt.timedelta(days=1, minutes=seq), title) for seq, url, user, title in rows]
    df = spark.createDataFrame(
        full, "seq long, url string, user_id string, team_id string, channel_id string, requested_at timestamp, title string"
    )
    content = F.struct("title", F.lit("").alias("description"), F.array("title").alias("tags"),
                       F.lit(None).cast("array<string>").alias("manual_tags"))
    return df.withColumn("content", content).drop("title")


def test_seed_tags(spark):
    assert [r.tag for r in seed_tags(spark).orderBy("tag_rank").collect()] == C.SEED_TAGS and len(C.SEED_TAGS) == 49


def test_usage_and_vocabulary(spark):
    rng = random.Random(5)
    rows = [
        link(i, f"u{i}", team=rng.choice(["A", "A", "A", "B"]), user=f"U{i % 3}",
             tags=[rng.choice(["go", "x", "yy", "yyy", "api", "zebra", f"t{i % 40}"]) for _ in range(rng.randint(0, 4))])
        for i in range(200)
    ]
    df = links_of(spark, rows)
    usage = TG.team_tag_usage(df)
    counts = {}
    for r in rows:
        for t in r[4]:
            n, last = counts.get((r[7], t), (0, DAY))
            counts[r[7], t] = (n + 1, max(last, r[11]))
    assert {(r.team_id, r.tag_name): (r.usage_count, r.last_used) for r in usage.collect()} == counts
    teams = spark.createDataFrame([("A",), ("B",), ("none",)], "team_id string")
    wanted = {}
    for team in ("A", "B", "none"):
        own = sorted((t for (tm, t) in counts if tm == team), key=lambda t: (-counts[team, t][0], t))
        wanted[team] = own + [s for s in C.SEED_TAGS if s not in own]

    def listed(frame):
        out = {}
        for r in frame.orderBy("team_id", "tag_rank").collect():
            out.setdefault(r.team_id, []).append((r.tag_rank, r.tag))
        return {k: [t for _, t in v] for k, v in out.items() if [n for n, _ in v] == list(range(1, len(v) + 1))}

    assert listed(TG.existing_tags(usage, teams)) == wanted
    assert listed(TG.team_seed_tags(usage, teams, 7)) == {k: v[:7] for k, v in wanted.items()}
    assert listed(TG.team_seed_tags(usage, teams, 60)) == {k: v[:60] for k, v in wanted.items()}
    top = TG.popular_tags(usage, 3).filter("team_id = 'A'").orderBy("position").collect()
    assert [r.tag_name for r in top] == [t for t in wanted["A"] if ("A", t) in counts][:3]
    listing = [(r.tag, r.total) for r in TG.tag_listing(TG.existing_tags(usage, teams)).filter("team_id = 'B'").collect()]
    assert listing == [(t, len(wanted["B"])) for t in sorted(wanted["B"])]


def test_lookups(spark):
    df = links_of(spark, [link(1, "a"), link(2, "b", "U2")])
    assert [r.url for r in S.find_by_id(df, 2).collect()] == ["b"] and S.find_by_id(df, 3).count() == 0
    assert S.find_by_url(df, "b", "U2").count() == 1 and S.find_by_url(df, "b", "U1").count() == 0
    wanted = spark.createDataFrame([(1,), (9,)], "id long")
    got = {r.id: (r.url, r.code, r.message, r.status) for r in LK.get_links(df, wanted).collect()}
    assert got == {1: ("a", None, None, 200), 9: (None, "NOT_FOUND", "Bookmark with ID 9 not found", 404)}


def test_delete_needs_the_owner(spark):
    df = links_of(spark, [link(1, "a"), link(2, "b", "U2")])
    wanted = spark.createDataFrame([(1, "U1"), (2, "U1"), (3, "U1")], "id long, user_id string")
    left, outcome = LK.delete_links(df, wanted)
    assert [r.id for r in left.collect()] == [2]
    assert {r.id: (r.deleted, r.status) for r in outcome.collect()} == {1: (True, 200), 2: (False, 404), 3: (False, 404)}


def test_search(spark):
    rows = [
        link(1, "https://x.org/Javascript", tags=["a", "b"]), link(2, "u2", title="JavaScript 100%", tags=["react"]),
        link(3, "u3", description="about javascript", tags=["React"]), link(4, "u4", user="U2", title="javascript"),
        link(5, "u5", tags=["javascript", "react"], minutes=3), link(6, "u6", title="x_y", description=""),
    ]
    df = links_of(spark, rows)

    def ids(**kw):
        found = S.search(df, "U1", **kw)
        return [r.id for r in found.links.collect()], found.total.first().total, found.query

    assert ids(query="javascript") == ([5, 3, 2, 1], 4, "javascript")
    assert ids(query="javascript", limit=2) == ([5, 3], 4, "javascript")
    assert ids(query="javascript", limit=2, offset=3) == ([1], 4, "javascript")
    assert ids(query="javascript", tags=["react"]) == ([5, 2], 4, "javascript")
    assert ids(query="javascript", tags=["react"], total_mode="filtered")[1] == 2
    assert ids(query='a", "b')[0] == [1] and ids(query="0\\%")[0] == [2] and ids(query="x\\_y")[0] == [6]
    assert ids(query="", tags=[], limit=0, offset=0) == ([6, 5, 3, 2, 1], 5, "")
    assert [r.id for r in S.recent(df, "U1", 2).collect()] == [6, 5]
    page = LK.search_links(df, "U1", " javascript ")
    assert [r.id for r in page.shown.collect()] == [5, 3, 2, 1] and page.found.first().found == 4


def test_a_page_shows_five_of_ten(spark):
    df = links_of(spark, [link(i, f"u{i}") for i in range(1, 15)])
    page = LK.search_links(df, "U1", None)
    assert page.shown.count() == 5 and page.found.first().found == 10 and page.total.first().total == 14
    rows = LK.search_links_all_users(df).collect()
    assert len(rows) == 5 and rows[0].found == 10 and rows[0].total == 14


def test_ordered_batches_equal_one_by_one(spark):
    for seed in range(3):
        rng = random.Random(seed)
        stored = {f"u{i}": f"U{rng.randrange(3)}" for i in range(6)}
        rows = [link(i + 1, u, user, title=f"old {u}") for i, (u, user) in enumerate(stored.items())]
        asked = [(s, f"u{rng.randrange(14)}", f"U{rng.randrange(4)}", f"new {s}") for s in range(10, 60)]
        start = {u: {"user": user, "content": f"old {u}"} for u, user in stored.items()}
        want = models.save_in_order(start, [(u, user, c, True) for _, u, user, c in asked])
        after = ST.save_batch(links_of(spark, rows), requests_of(spark, asked)).collect()
        assert {r.url: (r.user_id, r.title) for r in after} == {u: (r["user"], r["content"]) for u, r in want.items()}
        assert len({r.id for r in after}) == len(after)
        old_ids = {u: i + 1 for i, u in enumerate(stored)}
        assert all(r.id == old_ids[r.url] for r in after if r.url in old_ids)
        assert all(r.id > len(stored) for r in after if r.url not in old_ids)


def test_saving_again_changes_nothing(spark):
    before = links_of(spark, [link(1, "a", title="old")])
    asked = requests_of(spark, [(1, "a", "U2", "second"), (2, "b", "U1", "first"), (3, "b", "U1", "again")])
    once = ST.save_batch(before, asked)
    rows = links_of(spark, [tuple(r) for r in once.collect()])
    assert sorted(rows.collect()) == sorted(ST.save_batch(rows, asked).collect())
    assert {r.url: (r.user_id, r.title) for r in rows.collect()} == {"a": ("U1", "second"), "b": ("U1", "first")}


def test_links_per_user(spark):
    asked = requests_of(spark, [(1, "a", "U1", "x"), (2, "a", "U2", "y"), (3, "a", "U1", "z")])
    after = ST.save_batch(links_of(spark, [link(7, "a", "U1", title="old")]), asked, ("url", "user_id")).collect()
    assert sorted((r.id, r.user_id, r.title) for r in after) == [(7, "U1", "old"), (8, "U2", "y")]
