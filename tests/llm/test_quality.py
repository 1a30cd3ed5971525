import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm.quality import Evidence, features, judge, site_posteriors
from tests.llm.samples import DOCUMENTS, edge_documents


@pytest.fixture(scope="module")
def tables(spark):
    chosen = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        words = ["".join(chosen.choices("abcdefgh", k=chosen.randrange(2, 9))) for _ in range(chosen.randrange(20, 80))]
        bad = chosen.random() < 0.2
        if bad:
            words = [w + "***" for w in words] if i % 2 else words[:2] * 20
        rows.append((i, " ".join(words) + ".", "en", f"src{i % 5}" if i % 4 else "hot", 0))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_unlabelled_texts(tables):
    docs, labels, rows = tables
    found = {r["doc_id"]: r for r in judge(docs, labels).collect()}
    bad = {i: "***" in text or len(set(text.split())) < 5 for i, text, *_ in rows}
    unseen = [i for i in found if i % 3 == 0]
    assert sum(found[i]["good"] != bad[i] for i in unseen) >= 0.97 * len(unseen)
    assert all(found[i]["good"] for i in found if not bad[i])
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "evidence", "host_posterior", "path_posterior", "quality", "good"}


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "big/en", 0.9)] * 300 + [("bad", "bad/en", 0.1)] * 300 + [("one", "one/en", 0.1)] + [("big", "big/few", 0.1)]
    found = {(r["host"], r["path"]): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    prior = found["one", "one/en"]["prior"]
    assert abs(prior - 0.5) < 0.02
    assert found["bad", "bad/en"]["path_posterior"] < 0.15 and found["big", "big/en"]["path_posterior"] > 0.85
    assert found["bad", "bad/en"]["host_posterior"] < found["one", "one/en"]["host_posterior"] < prior
    assert found["big", "big/few"]["path_posterior"] > 0.3  # one text says little against its host


def test_evidence_without_both_classes():
    assert np.allclose(Evidence(np.zeros((0, 1)), np.zeros(0)).chances(np.zeros((3, 1))), 0.5)
    assert (Evidence(np.array([features("a b")] * 4), np.ones(4)).chances(np.array([features(None)])) > 0.8).all()


def test_edge_rows(spark):
    docs = edge_documents(spark).withColumn("quality", F.lit("old")).withColumn("host", F.lit("old"))
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (7, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = judge(docs, given).collect()
        assert len(rows) == docs.count() and all(0 < r["quality"] < 1 and r["host"] == "old" for r in rows)
    assert judge(docs.limit(0), labels).count() == 0
    assert features(None) == features("")
