import random
import re

import pytest

from linkweave.llm import decontaminate
from linkweave.llm.decontaminate import BlockMaxIndex, find_leaks
from tests.llm.samples import edge_documents

ITEMS = "item_id long, text string"


def cases(seed=8):
    chosen = random.Random(seed)
    words = lambda n: [f"w{int(chosen.paretovariate(0.6)) % 3000}" for _ in range(n)]
    items = [(i, " ".join(words(chosen.randrange(12, 60))) + ". " + " ".join(words(chosen.choice([6, 20]))) + ".") for i in range(60)]
    texts = []
    for _ in range(300):
        base = words(chosen.randrange(0, 250))
        if chosen.random() < 0.6:
            part = chosen.choice(chosen.choice(items)[1].split(". ") + [chosen.choice(items)[1]] * 2).split()
            for _ in range(chosen.randrange(4)):
                part[chosen.randrange(len(part))] = "edited"
            at = chosen.randrange(len(base) + 1)
            base[at:at] = part
        texts.append(" ".join(base).upper() if chosen.random() < 0.2 else " ".join(base))
    return items, texts


def literal(items, text):
    """Items of which a passage (two strides from a multiple of the longest item's length) has 0.8 of the shingles of the whole, of a
    question of 8 words or of an answer of 13."""
    split = lambda t: re.findall(r"\w+", t.lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    stride = max(len(split(t)) for _, t in items)
    words = split(text)
    found = set()
    for item_id, item in items:
        sentences = re.split(r"(?<=[.?!])\s+", item.strip())
        answer = split(sentences[-1]) if len(sentences) > 1 else []
        question = split(" ".join(sentences[:-1] if len(sentences) > 1 else sentences))
        parts = [question + answer]
        parts += [question] if answer and len(question) >= 8 else []
        parts += [answer] if question and len(answer) >= 13 else []
        for part in parts:
            n = min(5, len(part))
            for start in range(0, len(words), stride):
                held = runs(words[start : start + 2 * stride], n)
                if part and len(runs(part, n) & held) >= 0.8 * len(runs(part, n)) - 1e-9:
                    found.add(item_id)
    return found


@pytest.mark.parametrize("gathered", [1, 2_000_000])
def test_pruning_loses_nothing(monkeypatch, gathered):
    monkeypatch.setattr(decontaminate, "GATHERED", gathered)
    items, texts = cases()
    found = BlockMaxIndex(items).leaks(texts)
    want = [literal(items, text) for text in texts]
    assert [{leak["item_id"] for leak in leaks} for leaks in found] == want
    assert 60 < sum(map(bool, want)) < 290


def test_questions_and_answers():
    item = "What is the name of the highest hill in the whole wide county here? It is called the Green Hill by all who ever walked up there in spring."
    question, answer = item.split("? ")
    index = BlockMaxIndex([(1, item), (2, "one two three"), (3, "Is this a short one? Yes it is.")])
    got = index.leaks([f"so {item} and on", question + "?", "ONE, two three!", answer, "Is this a short one? No", "is this a short one yes IT is"])
    shares = [[(x["item_id"], x["question_overlap"], x["answer_overlap"]) for x in leaks] for leaks in got]
    assert shares == [[(1, 1.0, 1.0)], [(1, 1.0, 0.0)], [(2, 1.0, 1.0)], [(1, 0.0, 1.0)], [], [(3, 1.0, 1.0)]]


def test_indexes_share_their_statistics(spark, monkeypatch):
    items, texts = cases(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r["doc_id"]: r["leaks"] for r in find_leaks(docs, spark.createDataFrame(items, ITEMS)).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 7)
    many = find_leaks(docs, spark.createDataFrame([(str(i), t) for i, t in items] + [("x", "no number")], "item_id string, text string"))
    for row in many.collect():
        assert [x["item_id"] for x in row["leaks"]] == [x["item_id"] for x in one[row["doc_id"]]]
        assert all(abs(x["score"] - y["score"]) < 1e-9 for x, y in zip(row["leaks"], one[row["doc_id"]], strict=True))
    assert {i: {x["item_id"] for x in leaks} for i, leaks in one.items()} == {i: literal(items, text) for i, text in enumerate(texts)}


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 2)
    docs = edge_documents(spark).withColumnRenamed("n_chars", "leaks").withColumnRenamed("lang", "item_id")
    items = [(1, "The same first line here"), (1, "The same first line here"), (None, "something else that is long"), (2, None), (3, ""), (4, "!!"), (5, "short")]
    items += [(6, "something else that is long"), (7, "word5 and more word6 and more word7 and more")]
    found = find_leaks(docs, spark.createDataFrame(items, ITEMS))
    rows = found.collect()
    assert len(rows) == docs.count() and found.columns == ["doc_id", "text", "item_id", "source", "leaks"]
    got = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"]) for r in rows}
    assert got == {1: [1, 5], 2: [1, 6], 3: [], 4: [], None: [1], 5: [], 6: [7], 7: [], 8: []}
    assert all(r["leaks"] == [] for r in find_leaks(docs, spark.createDataFrame([], ITEMS)).collect())
    assert find_leaks(docs.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0
