import random

from pyspark.sql import functions as F

from linkweave import constants as C
from linkweave.functions import similarity as S
from linkweave.operators import lemmas as L
from linkweave.operators import matching as M
from linkweave.operators import skew
from tests import models


def run(spark, links, vocab, lemma_rows=(), **options):
    link_df = spark.createDataFrame(links, "link_id long, team_id string, title string, description string")
    tags = [(team, t, i + 1) for team, ts in vocab.items() for i, t in enumerate(ts)]
    tag_df = spark.createDataFrame(tags, "team_id string, tag string, tag_rank long")
    lemma_df = spark.createDataFrame(list(lemma_rows), L.SCHEMA)
    out = {}
    for r in M.match_tags(link_df, tag_df, lemma_df, **options).orderBy("link_id", "match_rank").collect():
        out.setdefault(r["link_id"], []).append((r["tag"], r["score"], set(r["match_types"])))
    return out


def expected(links, vocab, lemma_rows=(), limit=6):
    table = {}
    for w, l in lemma_rows:
        table.setdefault(w, set()).add(l)
    out = {}
    for link_id, team, title, description in links:
        got = models.best_matches(f"{title or ''} {description or ''}", vocab.get(team, []), table, limit)
        if team and got:
            out[link_id] = got
    return out


def test_single_rules(spark):
    cases = [
        ("react", "react", 15.0), ("tutorials", "tutorial", 12.0), ("script", "typescript", 8.0),
        ("dockerfile", "docker", 5.0), ("kubernets", "kubernetes", 9.5), ("goo", "go", 8.0), ("aui", "ai", 8.0),
    ]
    links = [(i, f"T{i}", w, None) for i, (w, _, _) in enumerate(cases)]
    vocab = {f"T{i}": [t] for i, (_, t, _) in enumerate(cases)}
    got = run(spark, links, vocab, [("tutorials", "tutorial")])
    assert {i: (m[0][0], m[0][1]) for i, m in got.items()} == {i: (t, s) for i, (_, t, s) in enumerate(cases)}


def test_fuzzy_counts_only_before_other_points(spark):
    links = [(1, "T", "kubernets kubernetes", ""), (2, "T", "kubernetes kubernets", ""), (3, "", "kubernetes", ""),
             (4, None, "kubernetes", "")]
    got = run(spark, links, {"T": ["kubernetes"], "": ["kubernetes"]})
    assert got[1][0][:2] == ("kubernetes", 9.5 + 15) and got[2][0][:2] == ("kubernetes", 15.0)
    assert set(got) == {1, 2}


def random_case(seed):
    rnd = random.Random(seed)
    syllables = ["re", "act", "do", "ck", "er", "ty", "pe", "a", "i", "ing", "s", "c++", "😀", "é", "X", "-"]

    def word():
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))

    pool = [word() for _ in range(60)]
    vocab = {f"T{k}": list(dict.fromkeys(rnd.choice(pool) if rnd.random() < 0.7 else word() for _ in range(25)))
             for k in range(3)}
    links = [
        (i, f"T{rnd.randrange(4)}" if rnd.random() < 0.9 else None,
         " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))),
         None if rnd.random() < 0.3 else " ".join(word() for _ in range(6)))
        for i in range(60)
    ]
    lemma_rows = [(rnd.choice(pool).lower(), rnd.choice(pool).lower()) for _ in range(15)]
    return links, vocab, lemma_rows


def test_random_inputs_equal_the_literal_loop(spark):
    for seed in range(2):
        links, vocab, lemma_rows = random_case(seed)
        assert run(spark, links, vocab, lemma_rows) == expected(links, vocab, lemma_rows)


def test_splitting_hot_keywords_changes_nothing(spark):
    links, vocab, lemma_rows = random_case(7)
    assert run(spark, links, vocab, lemma_rows, min_rows=2) == expected(links, vocab, lemma_rows)


def test_number_of_hot_keys_is_bounded(spark):
    counts = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 50 + 1).alias("n"))
    hot = skew.hot_keys(counts, ["k"], "n", max_keys=100, min_rows=1).collect()
    assert len(hot) < 100
    spike = counts.withColumn("n", F.when(F.col("k") == 5, 10**6).otherwise(F.col("n")))
    assert [r["_splits"] for r in skew.hot_keys(spike, ["k"], "n", 100, 1).collect()] == [98]


def test_segment_join_finds_every_similar_pair(spark):
    rnd = random.Random(3)

    def word():
        return "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 20])))

    left = sorted({word() for _ in range(300)})
    right = sorted({word() for _ in range(150)} | {w[:-1] + "d" + w[-1] for w in left[::3]})
    wanted = {(a, b): models.ratio(a, b) for a in left for b in right if models.ratio(a, b) >= 80}
    a = spark.createDataFrame([(w,) for w in left], "a string")
    b = spark.createDataFrame([(w,) for w in right], "b string")
    a_lengths, b_lengths = M._lengths(a, F.length("a")), M._lengths(b, F.length("b"))
    a_pieces = S.piece_table(a, "a", b_lengths, S.segment_pieces)
    b_pieces = S.piece_table(b, "b", a_lengths, S.probe_pieces)
    a = a.join(a_pieces, F.length("a") == F.col("n")).select("a", S.hashed_key(F.col("a")).alias("k"))
    b = b.join(b_pieces, F.length("b") == F.col("n")).select("b", S.hashed_key(F.col("b")).alias("k"))
    pairs = a.join(b, "k").filter(
        S.maybe_similar(F.col("a"), F.col("b"), F.length("a"), F.length("b"), S.letter_mask(F.col("a")), S.letter_mask(F.col("b")))).select("a", "b").distinct()
    got = pairs.withColumn("s", S.similarity(F.col("a"), F.col("b"))).filter(S.similar_enough(F.col("s"))).collect()
    assert {(r.a, r.b): r.s for r in got} == wanted


def test_long_words_and_long_tags(spark):
    long_word = "ab" * 70 + "react" + "cd" * 70
    vocab = {"T": ["react", "ab" * 40 + "x", "ab" * 60, "x" * 10 + long_word + "y"]}
    links = [(1, "T", long_word, "z" * 2000)]
    assert run(spark, links, vocab) == expected(links, vocab)


def test_suffix_lemmas(spark):
    words = spark.createDataFrame([("libraries",), ("coding",), ("boxes",), ("this",)], "word string")
    lexicon = spark.createDataFrame([("library",), ("code",), ("box",)], "word string")
    got = {tuple(r) for r in L.suffix_lemmas(words, lexicon).collect()}
    assert got == {("libraries", "library"), ("coding", "code"), ("boxes", "box")}


def test_seed_lemmas_are_a_table(spark):
    assert L.seed_lemmas(spark).count() == len(C.SEED_LEMMAS)


def test_very_long_words_and_hot_keywords(spark):
    """Words without an end, and a keyword in most links that matches many tags."""
    rnd = random.Random(12)
    long_word = "".join(rnd.choices("abcdefgh", k=20_000)) + "docker" + "x" * 50
    links = [(1, "T", long_word, ""), (2, "T", f"{long_word[:300]} react", "")]
    links += [(i, "T", "react dockering", None) for i in range(10, 70)]
    vocab = {"T": ["react", "docker", "typescript", long_word[:60]] + [f"react{i}" for i in range(30)]}
    assert run(spark, links, vocab, max_keys=4, min_rows=10) == expected(links, vocab)
