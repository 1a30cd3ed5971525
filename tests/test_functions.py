import re

import pytest
from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import html as H
from linkweave.functions import json_text as J
from linkweave.functions import tagging as G
from linkweave.functions import text as X
from linkweave.functions import urls as U
from linkweave.functions import validation as V
from linkweave.functions import webtags as WT
from linkweave.operators import search as S
from tests import models


def apply(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_keywords(spark):
    cases = {
        "vue3": ["vue"], "ES2022": [], "open-source": ["open-source"], "C++": ["c++"], "a_b": [], "2024": [],
        "react x react": ["react", "react"], "the": [], "a\u00a0long\u3000word": ["long", "word"], "😀a": ["😀a"],
        "it's one": ["it's"], "": [],
    }
    assert apply(spark, cases, X.keywords) == list(cases.values())


def test_urls(spark):
    cases = {
        "https://a.b": True, "HTTP://a.b": False, "ftp://a.b": False, "http://": False, "http://foo_bar.com": True,
        "notaurl": False, "https://a.b:65535/x": True, "https://a.b:65536": False, "http://a b.com": False,
        "http://1.2.3.4": True, "http://1.2.3.999": False, "http://1.2.3": False, "https://[::1]:80/": True,
        "https://u:p@h.org?x": True, "https://a.b:/x y": True, "": False, None: False, "https:///a.b": True,
        "http://a%zz.com": False, "http://x.9y": True,
    }
    assert apply(spark, cases, U.is_valid_url) == list(cases.values())


def test_titles_from_urls(spark):
    cases = {
        "https://www.a.com/": "a.com", "https://a.com/b/c/": "c - a.com", "http://WWW.A.com:80/x?q=1#f": "x - a.com",
        "bad": "Untitled Bookmark", "https://a.com/f\u00fcr e": "f%C3%BCr%20e - a.com", "https://a.com/a/../b": "b - a.com",
        "https://a.com/..": "a.com", "https://a.com/x/.": "x - a.com", "https://a.com#f/g": "a.com",
    }
    assert apply(spark, cases, U.title_from_url) == list(cases.values())


def test_entities(spark):
    cases = {"&amp;lt;": "&lt;", "a&nbsp;b": "a b", "&#8217;": "'", "&#x27;": "&#x27;", "&AMP;": "&AMP;", "&#8220;x&#8221;": '"x"'}
    assert apply(spark, cases, X.decode_entities) == list(cases.values())


def test_page_titles_and_descriptions(spark):
    heads = [
        "<TITLE lang='x'> A &amp; B </TITLE>",
        "<title></title><meta property='og:title' content=\"OG\">",
        "<title> </title>",
        "<title>" + "x" * 600 + "</title>",
        "<meta name=\"description\" content=\"it's\">",
        "<meta content='x' name='description'><meta\nname='twitter:description' content='tw'>",
        "<meta name='description' content=' '><meta property='og:description' content='og'>",
    ]
    title = apply(spark, heads, lambda h: H.page_title(h, F.lit("https://a.com/b")))
    assert title == ["A & B", "OG", "b - a.com", "x" * 500, "b - a.com", "b - a.com", "b - a.com"]
    assert apply(spark, heads, H.page_description) == ["", "", "", "", "it", "tw", "og"]


def test_fetch_outcomes(spark):
    rows = [
        ("x", 404, "text/html", 1, "error"), ("x", 200, "application/pdf", 1, "fallback"), ("x", 200, None, 1, "fallback"),
        (None, 200, "text/html", None, "fallback"), ("x", 204, "text/html; charset=x", 1, "ok"),
        ("x", 200, "TEXT/HTML", 1, "fallback"), ("x", 200, "text/html", 1048577, "fallback"), ("x", 200, "text/html", 1048576, "ok"),
    ]
    df = spark.createDataFrame(rows, "html string, status int, type string, n int, want string")
    got = df.select("want", H.fetch_outcome(F.col("html"), F.col("status"), F.col("type"), F.col("n")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_validation_first_rule_wins(spark):
    ok = "https://a.b"
    rows = [
        (ok, "u", "c", ["x"], None), ("", "", "", None, C.MSG_URL_REQUIRED), (None, "u", "c", None, C.MSG_URL_REQUIRED),
        ("x", "", "", None, C.MSG_URL_INVALID), (ok, " \u00a0", "c", None, C.MSG_USER_REQUIRED),
        (ok, "u", None, None, C.MSG_CHANNEL_REQUIRED), (ok, "u", "c", ["x"] * 10, None),
        (ok, "u", "c", [" "] * 11, C.MSG_TOO_MANY_TAGS), (ok, "u", "c", ["x", " ", "y" * 51], C.MSG_EMPTY_TAG),
        (ok, "u", "c", ["x", "y" * 51, ""], C.MSG_LONG_TAG), (ok, "u", "c", ["y" * 50], None),
    ]
    df = spark.createDataFrame(rows, "url string, u string, c string, tags array<string>, want string")
    error = V.validation_error(F.col("url"), F.col("u"), F.col("c"), F.col("tags"))
    assert [(r.want, r.got) for r in df.select("want", error["message"].alias("got")).collect()] == [(r[4], r[4]) for r in rows]


def test_commands(spark):
    texts = ["https://a.b", "  https://a.b  x\tY ", "", None, "\u00a0https://a.b one"]
    assert apply(spark, texts, V.command_url) == ["https://a.b", "https://a.b", "", None, "https://a.b"]
    assert apply(spark, texts, V.command_tags) == [None, ["x", "Y"], None, None, ["one"]]


def test_cleaning(spark):
    assert apply(spark, [["  React ", "", " "], None, ["A", "a"]], V.clean_tags, "array<string>") == [["react"], None, ["a", "a"]]
    titles = apply(spark, ["", " ", None, "\tx\u00a0"], lambda t: X.trim_ws(V.default_title(t)))
    assert titles == ["Untitled", "", "Untitled", "x"]


def test_strict_json(spark):
    cases = {
        '["a"] ["b"]': False, '["a"]]': False, '["a"], ["b"]': False, '["a"], "x": 1': False, '["a",]': False,
        '["a"': False, '["a"]}, ["b"]': False, '["a"]], [["b"]': False, ' ["a", {"x": [1]}] ': True, '[]': True, '{"a": 1}': True,
    }
    assert apply(spark, cases, lambda t: J.parse_strict(t).isNotNull()) == list(cases.values())


def test_replies(spark):
    replies = [
        'Sure: ["A ", 1, null, "b"]', "none", '["a" "b"]', "", None, "[" + ",".join(f'"t{i}"' for i in range(12)) + "]",
        '["' + "x" * 51 + '", "ok"]', '[\n"a",\n"b"\n]', '[["n"], {"k": "v"}, "z"]',
    ]
    assert apply(spark, replies, G.reply_tags) == [
        ["a", "b"], [], None, None, None, [f"t{i}" for i in range(10)], ["ok"], ["a", "b"], ["z"]]


def test_filtered_tags(spark):
    rows = [
        (["a", "b"], ["a"], '["B", 1]', ["a", "B"]), (["b"], [], "[]", ["b"]), (["a", "b"], ["a"], "[]", ["a"]),
        (["a", "b"], ["a"], '["x', ["a", "b"]), (["a", "b"], ["a"], None, ["a", "b"]), (["a"], ["a"], '["x"]', ["a"]),
        ([], ["a"], '["x"]', []), (["a", "b"], ["a"], '["x"] ["y"]', ["a", "b"]),
    ]
    df = spark.createDataFrame(rows, "initial array<string>, matched array<string>, reply string, want array<string>")
    got = df.select("want", G.filtered_tags(F.col("initial"), F.col("matched"), F.col("reply")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_high_scorers_and_their_slice(spark):
    matches = [("m1", 15.0), ("low", 14.9), ("m2", 30.0), ("m3", 15.0)]
    rows = [([f"c{i}" for i in range(n)], matches) for n in (0, 4, 6, 7, 8, 9, 12)]
    df = spark.createDataFrame(rows, "current array<string>, matches array<struct<tag:string,score:double>>")
    for r in df.select("current", G.add_high_scorers(F.col("current"), F.col("matches")).alias("got")).collect():
        strong = ["m2", "m1", "m3"]
        assert r.got == r.current + models.slice_js(strong, 6 - len(r.current))


def test_manual_tags_come_first(spark):
    rows = [
        ([f"m{i}" for i in range(9)], ["g"], [f"m{i}" for i in range(9)]), (["React"], ["react"], ["react", "react"]),
        (None, ["b", "b", "A"], ["b", "a"]), (["javascript", "tutorial", "react"], ["react", "frontend"],
                                             ["javascript", "tutorial", "react", "frontend"]), ([], ["x"], ["x"]),
    ]
    df = spark.createDataFrame(rows, "manual array<string>, generated array<string>, want array<string>")
    got = df.select("want", G.final_tags(F.col("manual"), F.col("generated")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_prompts(spark):
    row = spark.range(1).select(
        G.tag_prompt(F.lit("u"), F.lit("@description@"), F.lit(""), F.array(F.lit("a"), F.lit("b"))).alias("p"),
        G.tag_prompt(F.lit(None), F.lit(""), F.lit("d"), F.array().cast("array<string>")).alias("n"),
    ).first()
    assert "URL: u\nTitle: @description@\nDescription: No description available\n\nPREFER" in row.p
    assert "if appropriate: a, b\n" in row.p and "for this bookmark.\n" in row.p
    assert "URL: Unknown\nTitle: Unknown\nDescription: d\n\nAVOID" in row.n and "for this bookmark:\n" in row.n


def test_page_tags(spark):
    html = (
        '<script type="application/ld+json">{"keywords":["A","b",1],"tags":["t1"],"about":[{"name":"N1"},{"x":1}]}</script>'
        '<meta name="keywords" content="Alpha, beta;gamma"><meta name="article:tag" content="delta">'
        '<script type="application/ld+json">[{"keywords":"k1, k2,,"},5]</script>'
        '<script type="application/ld+json">{"keywords":["no"]} {}</script>'
        '<a class="tag x" href="/q">foo</a><a href="/category/1">b r</a>'
    )
    assert apply(spark, [html], WT.json_ld_tags) == [["a", "b", "t1", "n1", "k1", "k2"]]
    assert apply(spark, [html], WT.taxonomy_links) == [["foo"]]
    assert apply(spark, [html, ""], WT.page_tags) == [
        ["alpha", "beta", "gamma", "delta", "a", "b", "t1", "n1", "k1", "k2"], []]


def test_page_tag_scores(spark):
    rows = [
        ("React Hooks Tutorial", "react", 16), ("Machine Learning with Python", "machine learning", 17),
        ("React Tutorial", "web development 2024 best practices", 0), ("JavaScript Tips", "programming", 6),
    ]
    df = spark.createDataFrame(rows, "title string, tag string, want int")
    got = df.select("want", "tag", WT.page_tag_score(F.col("tag"), F.col("title"), F.lit(None)).alias("got"),
                    WT.scored_page_tags(F.array("tag"), F.col("title"), F.lit("")).alias("kept")).collect()
    assert all(r.want == r.got and len(r.kept) == (r.want >= 4) for r in got)


@pytest.mark.parametrize("query", ["abc", "a%c", "a_c", r"\%", r"\_", r"100%", r"a\bc", "\\", 'a", "b', "%", "A.C", "%%", "c\\"])
def test_text_queries_equal_like(spark, query):
    texts = ["abc", "aXc", "a\nc", "%", "_", "100%", "100 %", 'x a", "b', "A.C", "a.c", "", "ends with %", "c%", "\\", None]

    def like(text):
        if text is None:
            return None
        pattern, out, i = f"%{query}%", "", 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\":
                i += 1
                out += re.escape(pattern[i])
            else:
                out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
            i += 1
        return re.fullmatch(out, text, re.S | re.I) is not None

    assert apply(spark, texts, S.like_matcher(query)) == [like(t) for t in texts]


def test_tags_as_text(spark):
    assert apply(spark, [["a", 'q"t', "\u00e9"], []], X.tags_text, "array<string>") == ['["a", "q\\"t", "\u00e9"]', "[]"]
