import math
import random

import numpy as np
import pytest

from linkweave.operators import postings
from linkweave.operators import search as S
from linkweave.operators.text_search import literal_parts, parse_query, query_grams, rank_words, search_substrings, search_words
from linkweave.sources.text_index import TextIndex
from tests.test_tables import link, links_of


def some_links(seed, n=120):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(["go", "Rust", "the", "open-source", "Straße", "API_key", "x1", "über", "日本語", "😀", "end."]) for _ in range(k))
    return [
        link(i, f"https://E{rng.randint(1, 9)}.example/{i}", user=f"U{rng.choice([1, 1, 1, 2, 3])}", title=pick(rng.randint(0, 6)),
             description=rng.choice([None, "", pick(rng.randint(1, 30))]), tags=rng.sample(["go", "open source", "100%", "a_b", 'q"q'], rng.randint(0, 3)))
        for i in rng.sample(range(1, 20_000), n)
    ]


def text_words(row):
    return postings.words(f"{row[2]} {row[3] or ''}")


def holds(found, group):
    return any(found[i : i + len(group)] == group for i in range(len(found)))


def literal_search(rows, query):
    groups = parse_query(query)
    return {r[0] for r in rows if groups and all(holds(text_words(r), g) for g in groups)}


def literal_rank(rows, query, k):
    texts = {r[0]: text_words(r) for r in rows}
    terms, average = {w for g in parse_query(query) for w in g}, sum(map(len, texts.values())) / len(texts)
    out = {}
    for user in {r[6] for r in rows}:
        scores = []
        for r in rows:
            mine = texts[r[0]]
            score = 0.0
            for t in sorted(terms & set(mine)):
                df = sum(t in x for x in texts.values())
                n = mine.count(t)
                score += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(mine) / average))
            if terms & set(mine) and r[6] == user:
                scores.append((-round(score, 6), r[0]))
        out |= {(user, i): (link_id, -score) for i, (score, link_id) in enumerate(sorted(scores)[:k], 1)}
    return out


QUERIES = ["go", '"go rust"', "the open-source", '"the go" api', '"the the"', "key x1 go", "STRASSE", "straße 日本語", '""', "😀", "nothing", '"go']
PATTERNS = ["open", "Go%the", "e_t", "straße", "100\\%", "😀 g", "go", "", "a\\_b", 'q\\"q', '", "', "語 the%END", "x1\\", "example/1", "a_b_c", "\\%\\%\\%"]


def check(spark, index, rows, patterns=PATTERNS):
    links = links_of(spark, rows)
    found = {}
    for r in search_words(index, QUERIES).collect():
        assert r["id"] not in found.setdefault(r["query"], set())
        found[r["query"]].add(r["id"])
    assert found == {q: ids for q in QUERIES if (ids := literal_search(rows, q))}
    assert {r["id"] for r in search_words(index, [QUERIES[2]]).collect()} == literal_search(rows, QUERIES[2])
    for k in (1, 4) if patterns is PATTERNS else (2,):
        ranked = {(r["user_id"], r["rank"]): (r["id"], r["score"]) for r in rank_words(index, "go rust nothing end", k).collect()}
        want = literal_rank(rows, "go rust nothing end", k)
        assert ranked.keys() == want.keys()
        assert all(ranked[key][0] == want[key][0] and abs(ranked[key][1] - want[key][1]) < 2e-6 for key in want)
    assert rank_words(index, "", 3).count() == 0
    scan = sorted((p, r["id"]) for p in patterns for r in links.where(S.text_condition(p)).select("id").collect())
    assert sorted((r["query"], r["id"]) for r in search_substrings(index, links, patterns).collect()) == scan
    long = [p for p in patterns if query_grams(p)]
    assert sorted((r["query"], r["id"]) for r in search_substrings(index, links, long).collect()) == [x for x in scan if x[0] in long]
    assert sorted(r["id"] for r in search_substrings(index, links, long[:1]).collect()) == [i for p, i in scan if p == long[0]]


def test_searches_after_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK_LINKS", 50)
    monkeypatch.setattr(postings, "WORD_CHARS", 3000)
    monkeypatch.setattr(postings, "GRAM_CHARS", 3000)
    monkeypatch.setattr("linkweave.sources.text_index.BUCKET_CHARS", 2000)
    rows = some_links(1)
    index = TextIndex(spark, f"{tmp_path}/a")
    index.create(links_of(spark, rows))
    assert index.totals() == {"links": len(rows), "words": sum(len(text_words(r)) for r in rows)}
    check(spark, index, rows, PATTERNS[:3])
    other = some_links(2, 40)
    changed = [(a[0], *b[1:]) for a, b in zip(rows[:20], other, strict=False)] + [(30_000 + i, *b[1:]) for i, b in enumerate(other[20:])]
    gone = [r[0] for r in rows[20:35]]
    for _ in range(2):  # a batch that runs again leaves the same
        index.update(links_of(spark, changed), 0, spark.createDataFrame([(i,) for i in [*gone, 99_999]], "id long"))
    index.update(links_of(spark, [changed[0], rows[20]]), 1)
    current = [*changed, *rows[35:], rows[20]]
    assert index.totals() == {"links": len(current), "words": sum(len(text_words(r)) for r in current)}
    check(spark, index, current)
    small = index.compact(links_of(spark, current), f"{tmp_path}/b")
    assert small.totals() == index.totals()
    check(spark, small, current, PATTERNS[1:2])


def test_odd_links(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.create(links_of(spark, []))
    assert index.totals() == {"links": 0, "words": 0} and search_words(index, ["go"]).count() == 0 and rank_words(index, "go", 2).count() == 0
    long = " ".join(f"w{i} and" for i in range(30_000))
    rows = [link(1, None, title=None), (None, *link(2, "u", title="go go")[1:]), (3, "u3", "a", long, None, None, None, "T", "C", False, None, None), link(4, "u4", title="ab")]
    index.update(links_of(spark, rows), 0)
    assert [r["id"] for r in search_words(index, ["w29999 and"]).collect()] == [3] and search_words(index, ["go"]).count() == 0
    assert [(r["user_id"], r["id"]) for r in rank_words(index, "and", 2).collect()] == [(None, 3)]
    links = links_of(spark, [r for r in rows if r[0]])
    assert [r["id"] for r in search_substrings(index, links, ["w29999 AND"]).collect()] == [3]


def test_only_asked_buckets_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("linkweave.sources.text_index.BUCKET_CHARS", 100)
    index = TextIndex(spark, str(tmp_path))
    index.create(links_of(spark, some_links(3)))
    asked = index._asked("words", postings.WORD_SCHEMA, "term", ["rust", "über"])
    parts = {tuple(f.rsplit("/", 2)[-2].split("=")) for f in index._table("words", "term string").inputFiles()}
    assert len(parts) > 8
    plan = asked._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    read = scan.inputRDD()  # noqa: F841  listing happens here
    assert scan.metrics().apply("numPartitions").value() <= 2 and "PushedFilters: [In(term, [rust,über])]" in scan.toString()


def test_parsing():
    assert parse_query('Open-Source "The go" x "') == [["open", "source"], ["the", "go"], ["x"]]
    assert literal_parts("a\\%b%c_d\\\\") == ["a%b", "c", "d\\"] and literal_parts("a\\") == ["a%"]
    assert query_grams("ab%cd") is None and query_grams("ABCD") == ["abc", "bcd"] and query_grams("") is None


@pytest.mark.parametrize("texts", [["abcabc", "", "ab", "xabc"], ["日本語", "\U0001f600a\U0001f600"]])
def test_gram_rows(texts):
    ids = np.arange(10, 10 + len(texts))
    found = {}
    for batch in postings._gram_rows(ids, [texts, texts[::-1]]):
        values, sizes = postings.numbers(batch.column(2))
        places = postings.sums(values >> 4, sizes) + np.repeat(np.asarray(batch.column(1)), sizes)
        for gram, i, f in zip(np.repeat(batch.column(0).to_pylist(), sizes), places, values & 15, strict=True):
            found[str(gram), int(i)] = int(f)
    want = {}
    for field, column in enumerate((texts, texts[::-1])):
        for i, t in zip(ids, column, strict=True):
            for j in range(len(t) - 2):
                want[t[j : j + 3], i] = want.get((t[j : j + 3], i), 0) | 1 << field
    assert found == want


def test_coded_numbers():
    rng = random.Random(1)
    groups = [[rng.choice([0, 1, 127, 128, 300, 2**14, 2**21, 2**40, 2**62]) for _ in range(rng.randint(1, 5))] for _ in range(50)]
    flat = np.array([v for g in groups for v in g])
    sizes = np.array([len(g) for g in groups])
    starts = np.cumsum(sizes) - sizes
    values, counted = postings.numbers(postings.varints(flat, starts))
    assert values.tolist() == flat.tolist() and counted.tolist() == sizes.tolist()
    rising = np.concatenate([np.sort(np.array(g) % 1000) for g in groups])
    assert postings.sums(postings.differences(rising, starts), sizes).tolist() == rising.tolist()
    empty = postings.varints(np.zeros(0), np.zeros(0, np.int64))
    assert len(empty) == 0 and postings.numbers(empty)[0].tolist() == []
