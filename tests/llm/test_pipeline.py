import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linkweave.llm import queries
from tests.llm.samples import edge_documents
from tests.llm.test_line_dedup import literal as literal_lines
from tests.llm.test_simhash import literal_fingerprint, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes in and comes out of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.toPandas().set_index("doc_id")}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.toPandas().set_index("doc_id")
    return out


def test_quality_keeps_what_is_labelled_good(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    left = set(steps["quality"].index)
    good, bad = set(labels[labels == 1].index), set(labels[labels == 0].index)
    assert len(good & left) >= 0.99 * len(good) and len(bad & left) <= 0.2 * len(bad) and left <= set(steps["documents"].index)


def test_lines(steps):
    before, after = steps["quality"], steps["line_dedup"]
    want = {doc_id: kept for doc_id, _, _, kept in literal_lines(list(zip(before.index, before.text, strict=True)))}
    assert after.text.to_dict() == want and (after.n_chars == after.text.str.len()).all()
    assert after.source.to_dict() == before.source.to_dict()


def test_near_duplicates(steps):
    before, after = steps["line_dedup"].sort_index(), steps["near_dedup"]
    ids = before.index.tolist()
    root = roots([literal_fingerprint(text) for text in before.text])
    assert set(after.index) == {ids[r] for r in root}


def test_leaks_and_tokens(spark, steps):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = steps["near_dedup"], steps["decontaminate"]
    whole = {i for i, text in before.text.items() if any(item in " ".join(text.split()) for item in items)}
    assert whole and not whole & set(after.index)
    clean = {i for i, text in before.text.items() if not any(" ".join(item.split()[k : k + 5]) in " ".join(text.split()) for item in items for k in range(len(item.split()) - 4))}
    assert clean <= set(after.index)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = steps["encode"].n_tokens.to_dict()
    assert tokens == {i: len(library.encode(text, add_special_tokens=False).ids) for i, text in after.text.items()}


def test_edge_rows_in_each_stage(spark):
    docs = edge_documents(spark).withColumn("marks", F.lit(1)).withColumn("good", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        left, nothing = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0
        rows = left.collect()
        if name != "encode":
            assert left.columns == docs.columns
        if name in ("line_dedup", "encode"):
            assert len(rows) == docs.count()
        if name == "near_dedup":  # null, empty and blank texts are one group; rows of one id stay together, rows without an id stay
            assert None in [r["doc_id"] for r in rows] and {4, 5}.isdisjoint(r["doc_id"] for r in rows) and [r["doc_id"] for r in rows].count(2) == 2


def test_every_operator_is_registered():
    numbers = {name.split("_")[0] for name in queries.QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)} and set(queries.ORACLES) <= set(queries.QUERIES)
