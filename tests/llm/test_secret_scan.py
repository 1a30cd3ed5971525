import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from linkweave.llm import secret_scan as S
from linkweave.llm.queries import secrets_of_documents

SCHEMA = "doc_id long, text string, secrets string, value int, random boolean"
BASE = {"assign": S.ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def base_spans(text):
    """Leftmost matches of the plain patterns, failing ones dropped."""
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def masked(text):
    for start, _, end, kind in base_spans(text):
        if kind == "assign":
            text = text[:start] + "\x01" * (end - start) + text[end:]
    return text


def samples(texts):
    out = set()
    for text in texts:
        for start, _, end, kind in base_spans(text):
            value = re.match(S.ASSIGN, text[start:end]).group(2) if kind == "assign" else text[start:end]
            if re.search("[0-9]", value):
                out.add((value, True))
        out |= {(r, False) for r in re.findall(S.RUN + "{4,}", masked(text)) if len(r) < 16 and "\x01" not in r}
    return out


def literal(texts):
    """All spans of each text."""
    pairs = {True: {}, False: {}}
    for value, label in samples(texts):
        for a, b in zip("^" + value, value):
            row = pairs[label].setdefault(a, {})
            row[b] = row.get(b, 0) + 1
    share = lambda label, a, b: (pairs[label].get(a, {}).get(b, 0) + 1) / (sum(pairs[label].get(a, {}).values()) + 68)
    n = {label: sum(pairs[label].get("^", {}).values()) for label in pairs}
    least = round(1000 * math.log((n[False] + 1) / (n[True] + 1) * 1000))
    out = []
    for text in texts:
        spans = base_spans(text)
        for m in re.finditer(S.RUN + "{16,}", masked(text)):
            run = m.group()
            if "\x01" in run or not re.search("[A-Za-z]", run) or re.search(f"{S.HEX}|{S.ACCESS}", run):
                continue
            if sum(round(1000 * math.log(share(True, a, b) / share(False, a, b))) for a, b in zip("^" + run, run)) > least:
                spans.append((m.start(), 3, m.end(), "markov"))
        out.append(sorted(spans))
    return out


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", 1, True) for i, t in enumerate(texts)], SCHEMA)
    found = S.find_secrets(docs, S.train(S.labelled_samples(docs)))
    return [[(x["start"], x["rank"], x["end"], x["kind"]) for x in r["secrets"]] for r in found.orderBy("doc_id").collect()]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "ter", "li", "on", "get_", "User", "ing", "ed"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    parts = [
        lambda: " ".join(rng.choice(words) for _ in range(12)), lambda: f"token = \"{token(20)}\"", lambda: f"API_KEY:'{token(12)}'",
        lambda: f"password={token(7)}", lambda: "AKIA" + token(rng.randint(10, 16), letters[:26] + "0123456789"), lambda: token(rng.randint(30, 34), "0123456789abcdef"),
        lambda: token(rng.randint(14, 40)), lambda: f"deadbeefdeadbeefdeadbeefdeadbeea pi_key={token(9)}", lambda: "été 😀 " + token(24), lambda: "secret:token=secret=abcdefgh12",
        lambda: f"{token(18)}\x01{token(18)}", lambda: "0" * 31 + "api_key=" + token(9), lambda: f"{token(17)}-token={token(9)}", lambda: "token  ='=a.b-c_d/e+f==",
    ]
    return [rng.choice(["", "\n", " "]).join(rng.choice(parts)() for _ in range(rng.randint(0, 25))) for _ in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_loops(spark, seed):
    texts = corpus(seed)
    want = literal(texts)
    assert run(spark, texts) == want
    assert {k for spans in want for *_, k in spans} == set(S.KINDS)


def test_odd_rows(spark):
    long = " ".join(f"token={i:08d}x 0123456789abcdef0123456789abcdef" for i in range(20_000))
    assert run(spark, [None, "", "no secret", "no secret", long]) == [[], [], [], [], base_spans(long)]
    assert run(spark, []) == []


def test_labelled_samples_decide(spark):
    rng = random.Random(7)
    labelled = [("".join(rng.choice(["iden", "ti", "fier", "coun", "ter", "run", "ning"]) for _ in range(3)), False) for _ in range(200)]
    labelled += [("".join(rng.choice("qwxzQWXZ0123456789KLpV") for _ in range(20)), True) for _ in range(200)] + [("%%odd%%", True)]
    models = S.train(spark.createDataFrame(labelled, "value string, random boolean"))
    docs = spark.createDataFrame([(1, "identifiercounterrunning z9Kq4Zx8Kp2Lw7Zx9Vp8 1234567890123456789")], "doc_id long, text string")
    found = S.find_secrets(docs, models).first()["secrets"]
    assert [x["value"] for x in found] == ["z9Kq4Zx8Kp2Lw7Zx9Vp8"] and found[0]["score"] > models.threshold


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "my token: abcdefgh1"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in secrets_of_documents(spark, str(tmp_path)).collect()}
    assert found[1]["spans"] == "assign:3:19" and found[1]["base_sha256"] == hashlib.sha256(b"assign:3:19").hexdigest()
    assert (found[2]["n_assign"], found[2]["spans"], found[2]["base_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
