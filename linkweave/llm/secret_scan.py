"""Secret scans: three fixed kinds by pattern, others by character Markov models.  DataFrame functions only.

Two first-order models over the characters of a run, one of random strings and one of ordinary identifiers, are learned
from labelled samples; by default from the corpus itself, where values that the patterns find are labelled random and short
runs outside of them ordinary.  Any longer run is then scored by its log-likelihood ratio, in whole thousandths, and is a
secret where the ratio passes the prior odds of the samples times a margin.

A run is as long as its characters last.  Base spans stay whatever the models say; a run that holds or touches one is
not scored, and neither is one without a letter: a number alone is no secret.  A character U+0001 counts as one of a run,
and such a run is not scored either.  A null text is empty and has no
spans.  Rows are answered one by one, so repeated rows, ties and other columns do not matter; without rows the
models are uniform and there is no answer.  Arrays are handled in time n log n, however many spans a text has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import bind

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MASK = "\x01"
LETTER = "[A-Za-z]"
RUN = r"[A-Za-z0-9+/_=\x01-]"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_CHARS = 8
#: Runs of at least this many characters are scored; shorter ones of at least ORDINARY_CHARS are samples of identifiers.
SCORED_CHARS = 16
ORDINARY_CHARS = 4
#: Characters that can follow each other lie between + and z; ^ stands for the start of a run.
FIRST, SYMBOLS, START = ord("+"), ord("z") - ord("+") + 1, "^"
#: Strings of a sample are made of so many characters (letters, digits, + / _ = - .).
ALPHABET = 68
#: A run counts as random when that is so many times likelier than that it is not.
ODDS = 1000
MILLI = 1000


@dataclass
class MarkovModels:
    """`ratios[(a - FIRST) * SYMBOLS + b - FIRST]`: log of P(b | a) if random over P(b | a) if ordinary, in thousandths."""

    ratios: list[int]
    threshold: int


def running_totals(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... items, by doubling: each round adds the total that lies as far back as is summed."""
    def added(back: int) -> Callable[[Column], Column]:
        further = lambda a: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - back), F.lit(0).cast("long")))
        return lambda a: F.when(F.size(a) > back, further(a)).otherwise(a)

    totals = lengths
    for k in range(31):
        totals = bind(totals, added(1 << k))
    return totals


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches of a pattern in order: structs of start, end, the match and, if asked, a group of it."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    pair = lambda m, v: F.struct(m.alias("match"), v.alias("value"))
    matches = F.zip_with(
        F.zip_with(every(0), every(group or 0), pair),
        F.split(text, pattern, -1),
        lambda m, before: F.struct(before.alias("before"), m["match"].alias("match"), m["value"].alias("value")),
    )
    kept = F.filter(matches, lambda m: m["match"].isNotNull())

    def placed(m: Column) -> Column:
        ends = running_totals(F.transform(m, lambda x: (F.length(x["before"]) + F.length(x["match"])).cast("long")))
        return F.zip_with(m, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match"), x["value"].alias("value")))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), bind(kept, placed)).otherwise(empty)


def _masked(text: Column) -> Column:
    """The text with every character of a passing `assign` match as U+0001."""
    blank = lambda m, value: F.when(F.length(value) >= ASSIGN_CHARS, F.repeat(F.lit(MASK), F.length(m))).otherwise(m)
    every = lambda g: F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(g))
    hidden = F.zip_with(every(0), every(2), blank)
    whole = F.array_join(F.zip_with(F.split(text, ASSIGN, -1), hidden, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit("")))), "")
    return F.when(F.regexp_like(text, F.lit(ASSIGN)), whole).otherwise(text)


def _characters(value: Column) -> Column:
    """Codes of the characters, the start first."""
    return F.transform(F.split(F.concat(F.lit(START), value), ""), lambda c: F.ascii(c) - FIRST)


def _pairs(codes: Column, body: Callable[[Column, Column], Column]) -> Column:
    rest = F.size(codes) - 1
    return F.zip_with(F.slice(codes, F.lit(1), rest), F.slice(codes, F.lit(2), rest), body)


def labelled_samples(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(value, random), each once: values the patterns find that hold a digit, and runs of 4 to 15 characters outside them."""
    text = docs.select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    every = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    digit = lambda values: F.filter(values, lambda v: v.rlike("[0-9]"))
    given = F.filter(every(ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_CHARS)
    none = F.array().cast("array<string>")
    random = F.when(F.regexp_like("text", F.lit(ASSIGN)), digit(given)).otherwise(none)
    random = F.concat(random, F.when(F.contains(F.col("text"), F.lit("AKIA")), digit(every(ACCESS))).otherwise(none), digit(every(HEX)))
    runs = F.regexp_extract_all(F.col("masked"), F.lit(f"{RUN}{{{ORDINARY_CHARS},}}"), F.lit(0))
    plain = F.filter(runs, lambda r: (F.length(r) < SCORED_CHARS) & ~F.contains(r, F.lit(MASK)))
    both = text.select(random.alias("random"), _masked(F.col("text")).alias("masked")).select("random", plain.alias("plain"))
    labelled = F.concat(
        F.transform("random", lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))),
        F.transform("plain", lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))),
    )
    return both.select(F.inline(labelled)).distinct()


def train(samples: DataFrame) -> MarkovModels:
    """Transition models of labelled samples (value, random) with one added to every count.

    Counts cover all samples; at most 2 x 80 x 80 of them come to the driver.
    """
    follow = _pairs(F.col("codes"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = samples.select("random", _characters(F.col("value")).alias("codes")).select("random", F.explode(follow).alias("s"))
    steps = steps.where(F.col("s.a").between(0, SYMBOLS - 1) & F.col("s.b").between(0, SYMBOLS - 1))
    counted = steps.groupBy("random", "s.a", "s.b").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in counted}
    totals: dict[tuple[bool, int], int] = {}
    for (random, a, _), n in counts.items():
        totals[random, a] = totals.get((random, a), 0) + n

    def ratio(a: int, b: int) -> int:
        share = lambda random: (counts.get((random, a, b), 0) + 1) / (totals.get((random, a), 0) + ALPHABET)
        return round(MILLI * math.log(share(True) / share(False)))

    strings = lambda random: totals.get((random, ord(START) - FIRST), 0)
    prior = (strings(False) + 1) / (strings(True) + 1)
    return MarkovModels([ratio(a, b) for a in range(SYMBOLS) for b in range(SYMBOLS)], round(MILLI * math.log(prior * ODDS)))


def log_ratio(value: Column, models: MarkovModels) -> Column:
    """Log-likelihood ratio of a run in thousandths."""
    ratios = F.split(F.lit(" ".join(map(str, models.ratios))), " ").cast("array<int>")
    step = lambda a, b: F.get(ratios, a * SYMBOLS + b).cast("long")
    return bind(_characters(value), lambda codes: F.aggregate(_pairs(codes, step), F.lit(0).cast("long"), lambda x, y: x + y))


def find_secrets(docs: DataFrame, models: MarkovModels, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id and `secrets`, an array of (start, rank, end, kind, value, score) by start, then kind as in KINDS.

    Places are code points from 0, `end` exclusive.  `value` is the match (of `assign` what is assigned), `score` the
    log-likelihood ratio in thousandths of a `markov` span, else null.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))

    def of_kind(kind: str, found: Column, score: Column | None = None) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                m["value"].alias("value"), (F.lit(None).cast("long") if score is None else m["score"]).alias("score"),
            ),
        )

    given = F.filter(_found(F.col("_text"), ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_CHARS)
    runs = F.filter(
        _found(F.col("_masked"), f"{RUN}{{{SCORED_CHARS},}}"),
        lambda m: ~F.contains(m["value"], F.lit(MASK)) & m["value"].rlike(LETTER) & ~m["value"].rlike(f"{HEX}|{ACCESS}"),
    )
    scored = F.filter(
        F.transform(runs, lambda m: F.struct(m["start"], m["end"], m["value"], log_ratio(m["value"], models).alias("score"))),
        lambda m: m["score"] > models.threshold,
    )
    read = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"))
    read = read.select("_id", "_text", _masked(F.col("_text")).alias("_masked"))
    kinds = read.select(
        "_id",
        of_kind("assign", given).alias("_assign"),
        of_kind("access", _found(F.col("_text"), ACCESS)).alias("_access"),
        of_kind("hex", _found(F.col("_text"), HEX)).alias("_hex"),
        of_kind("markov", scored, F.lit(0)).alias("_markov"),
    )
    return kinds.select(F.col("_id").alias(id_column), F.sort_array(F.concat("_assign", "_access", "_hex", "_markov")).alias("secrets"))
