import random
import re

import numpy as np
import xxhash

from linkweave.llm.graph import components
from linkweave.llm.simhash import Golay, classes, fingerprint, join_keys, near_duplicates
from tests.llm.samples import edge_documents


def literal_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for piece in pieces:
        h = xxhash.xxh64_intdigest(piece.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(pieces))


def roots(values):
    """Smallest index reachable over differences of three bits or fewer."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))
    for _ in range(len(values)):
        before = list(root)
        for i in range(len(values)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
            low = min(root[j] for j in near)
            for j in near:
                root[j] = low
        if before == root:
            return root
    return root


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "A b c", "Ünï Ä é " * 70, "x " * 70_000, "a b c d a b c d e", "\x1fa\x85b c d"):
        assert fingerprint(text) == literal_fingerprint(text)


def test_keys_meet_within_three_bits():
    golay, rng = Golay(), np.random.default_rng(2)
    assert len(np.unique(golay.index(np.arange(1 << 23)))) == 4096
    a = rng.integers(-(2**63), 2**63 - 1, 2000)
    for bits in (1, 2, 3):
        masks = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in a]
        b = (a.view(np.uint64) ^ np.array(masks, np.uint64)).view(np.int64)
        (rows, keys), _ = join_keys(a, golay)
        _, (other_rows, other_keys) = join_keys(b, golay)
        left = set(zip(rows.tolist(), keys.tolist(), strict=True))
        assert {r for r, k in zip(other_rows.tolist(), other_keys.tolist(), strict=True) if (r, k) in left} == set(range(len(a)))


def test_clouds_of_near_fingerprints(spark):
    chosen = random.Random(3)
    values = set()
    for _ in range(4):
        centre = chosen.getrandbits(64)
        for _ in range(120):
            values.add(centre ^ sum(1 << b for b in chosen.sample(range(64), chosen.randrange(6))))
    values |= {chosen.getrandbits(64) for _ in range(100)} | {0, 7, 2**64 - 1}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = {r["bits"]: r["root"] for r in classes(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()}
    want = roots(values)
    groups = {}
    for i, value in enumerate(signed):
        groups.setdefault(want[i], []).append(value)
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(v, v) for v in signed}) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(41)}) == 1 and len({found[i] for i in range(100, 140)}) == 1 and found[200] == found[201]
    assert len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    docs = edge_documents(spark).withColumnRenamed("n_chars", "bits")
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    given = {(r["doc_id"], literal_fingerprint(r["text"])) for r in docs.collect()}
    assert {(r["doc_id"], r["bits"] % 2**64) for r in rows} == given
    components_of = {r["doc_id"]: r["component_id"] for r in rows}
    assert components_of[3] == components_of[4] == components_of[5] == 3 and components_of[2] == 2
    assert near_duplicates(docs.limit(0)).count() == 0
