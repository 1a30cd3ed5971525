import datetime as dt
import math
import random

import pytest

from linkweave.operators import aliases as aliases_module
from linkweave.operators import similar
from linkweave.operators.aliases import close_aliases, rename_tags, renamed
from linkweave.operators.similar import similar_links
from linkweave.operators.tags import team_tag_usage
from linkweave.operators.trending import decayed_use, merged, trending
from linkweave.sources.links import LinkStore
from tests.test_tables import DAY, link, links_of


def tagged(seed, n=150, words=14):
    rng = random.Random(seed)
    pool = [f"t{i}" for i in range(words)]
    pick = lambda: rng.sample(pool[:4] if rng.random() < 0.5 else pool, rng.randint(0, 4))
    return [link(i, f"u{i}", team=rng.choice("AAB"), tags=pick(), minutes=rng.randint(1, 40_000)) for i in range(1, n + 1)]


def literal_pairs(rows, num, den):
    sets = [(r[7], r[0], frozenset(r[4])) for r in rows if r[4]]
    df = {t: sum(t in s for _, _, s in sets) for t in {t for _, _, s in sets for t in s}}
    weight = {t: round(1000 * math.log(1 + len(sets) / n)) for t, n in df.items()}
    first = {}
    for team, i, s in sets:
        first[team, s] = min(i, first.get((team, s), i))
    out = {}
    for (team, a), i in first.items():
        for (other, b), j in first.items():
            both, union = sum(weight[t] for t in a & b), sum(weight[t] for t in a | b)
            if team == other and i < j and both * den >= union * num:
                out[team, i, j] = round(both / union, 6)
    return out, {(team, first[team, s], i) for team, i, s in sets if first[team, s] != i}


@pytest.mark.parametrize("least", [(1, 2), (4, 5), (1, 10), (1, 1)])
def test_similar_links(spark, least, monkeypatch):
    monkeypatch.setattr(similar, "HOT_ROWS", 5)
    rows = tagged(sum(least))
    pairs, members = similar_links(links_of(spark, rows), least)
    want, same = literal_pairs(rows, *least)
    found = pairs.collect()
    assert len(found) == len(want) and {(r["team_id"], r["id"], r["other_id"]): r["similarity"] for r in found} == pytest.approx(want, abs=2e-6)
    assert {tuple(r) for r in members.collect()} == same


def test_similar_links_of_odd_rows(spark):
    rows = [link(1, "a", tags=["x", "x", None]), link(2, "b", tags=[]), (*link(3, "c")[:4], None, *link(3, "c")[5:]), link(4, "d", tags=["x"], team=None), link(5, "e", tags=["x"])]
    pairs, members = similar_links(links_of(spark, rows))
    assert pairs.collect() == [] and [tuple(r) for r in members.collect()] == [("T1", 1, 5)]
    pairs, members = similar_links(links_of(spark, []))
    assert pairs.collect() == [] and members.collect() == []


def test_trending(spark):
    rows = tagged(9)
    links = links_of(spark, rows)
    at, life = DAY + dt.timedelta(days=40), 5 * 86400
    want = {}
    for r in rows:
        for t in r[4]:
            key = (r[7], t)
            want[key] = want.get(key, 0) + 2 ** ((r[11] - at).total_seconds() / life)
    gone = links.where("id % 4 = 0")
    kept = {}
    for team in "AB":
        ranked = sorted(((-round(v, 6), t) for (tm, t), v in want.items() if tm == team))[:3]
        kept |= {(team, i): (t, -v) for i, (v, t) in enumerate(ranked, 1)}
    parts = merged(decayed_use(links.where("id <= 60"), life), decayed_use(links.where("id > 60"), life), decayed_use(gone, life), decayed_use(gone, life, -1))
    found = {(r["team_id"], r["position"]): (r["tag"], r["score"]) for r in trending(parts, at, 3, life).collect()}
    assert found.keys() == kept.keys() and all(found[k][0] == kept[k][0] and abs(found[k][1] - kept[k][1]) < 2e-6 for k in kept)
    assert trending(decayed_use(links_of(spark, [])), at, 3).count() == 0


def test_alias_chains_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(37)]
    rows = [*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("two", "b"), ("two", "a"), (None, "q"), ("q", None)]
    closed, rejected = close_aliases(spark.createDataFrame(rows, "tag string, target string"))
    assert {tuple(r) for r in closed.collect()} == {(f"c{i}", "c37") for i in range(37)} | {("two", "a")}
    assert {tuple(r) for r in rejected.collect()} == {("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")}
    closed, rejected = close_aliases(spark.createDataFrame([], "tag string, target string"))
    assert closed.collect() == [] and rejected.collect() == []


@pytest.mark.parametrize("mapped", [0, 1000])
def test_rename_in_a_store(spark, tmp_path, monkeypatch, mapped):
    monkeypatch.setattr(aliases_module, "MAPPED_ALIASES", mapped)
    rows = tagged(5)
    store = LinkStore(spark, str(tmp_path), buckets=4)
    store.create(links_of(spark, rows))
    aliases = spark.createDataFrame([("t1", "t2"), ("t2", "t0"), ("t13", "new")], "tag string, target string")
    for _ in range(2):
        assert rename_tags(store, aliases, 0).collect() == []
    to = {"t1": "t0", "t2": "t0", "t13": "new"}
    want = {r[0]: list(dict.fromkeys(to.get(t, t) for t in r[4])) for r in rows}
    assert {r["id"]: r["tags"] for r in store.links().collect()} == want
    key = lambda df: sorted(tuple(r) for r in df.select("team_id", "tag_name", "usage_count", "last_used").collect())
    assert key(store.usage()) == key(team_tag_usage(store.links()))
    once = renamed(links_of(spark, rows), spark.createDataFrame(list(to.items()), "tag string, target string"))
    assert {r["id"] for r in once.collect()} == {r[0] for r in rows if set(to) & set(r[4])}
    rename_tags(store, spark.createDataFrame([("new", "late"), ("absent", "t0")], "tag string, target string"), 1)
    assert {r["id"] for r in store.links().where("array_contains(tags, 'late')").collect()} == {r[0] for r in rows if "t13" in r[4]}
    assert key(store.usage()) == key(team_tag_usage(store.links()))
