import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkweave.llm.bpe import ForcedBoundaryCoder, encode
from tests.llm.samples import edge_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return ForcedBoundaryCoder(file.read())


def test_ids_and_texts_are_the_librarys(coder, library):
    chosen = random.Random(1)
    letters = [chr(c) for c in [*range(0x250), 0x558, 0x2009, 0x200D, 0x4E2D, 0xAC00, 0x1F600, 0x3000, 0x10FFFF, 0x85, 0x2028]]
    letters += ["<|endoftext|>", "<|endof", "'s", "'ll", "  ", "\n\n", " the", "tion"]
    for _ in range(3000):
        text = "".join(chosen.choice(letters) for _ in range(chosen.randrange(40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_forced(coder):
    letters = "".join(coder.fragments("zqüxjj学"))
    assert len(coder.fragments("zqüxjj学")) > 1
    assert letters.translate({ord(v): k for k, v in coder._letters.items()}).encode("latin-1").decode() == "zqüxjj学"
    assert coder.fragments(" the") == ["Ġthe"]


def test_edge_rows(spark, library):
    docs = edge_documents(spark).withColumnRenamed("n_chars", "ids")
    rows = encode(docs, PATH).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "ids", "decoded"}
    want = sorted((repr(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["decoded"]) for r in rows) == want
    for row in rows:
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode(row["decoded"], add_special_tokens=False).ids
    assert encode(docs.limit(0), PATH).count() == 0
