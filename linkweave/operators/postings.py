"""Postings of words and of substrings of three characters, made in the tasks that read the links."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import tags_text

WORD = re.compile(r"[^\W_]+")
GRAM = 3
#: Links whose ids agree but for so many bits share a block; a word's postings in a block have bounds of their own.
BLOCK_BITS = 12
#: A task handles so many links, and for words and for substrings so many characters, at a time.
CHUNK_LINKS = 4096
WORD_CHARS, GRAM_CHARS = 8_000_000, 3_000_000
#: The places that a text search looks at.
FIELDS = ("title", "description", "url", "tags")

WORD_SCHEMA = "term string, block long, links binary, places binary, most int, shortest int"
GRAM_SCHEMA = "gram string, first long, links binary"


def varints(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Whole numbers from 0 as bytes of seven bits, low ones first, the last byte of a number below 128; one item per start."""
    values = np.asarray(values, np.int64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[(ends - size)[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    offsets = np.append((ends - size)[starts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all items one after the other, and how many each item has."""
    blobs = column.to_pylist()
    data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    values = np.add.reduceat((data & 127) << 7 * place, starts) if len(ends) else np.zeros(0, np.int64)
    upto = np.searchsorted(ends, np.cumsum([len(b) for b in blobs]))
    return values, np.diff(np.append(0, upto))


def differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each number less the one before; the first of a group as it is."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums inside groups of the given sizes."""
    total = np.cumsum(values)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat((total - values)[starts], sizes[sizes > 0])


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, lower case."""
    return WORD.findall(text.lower())


def _chunks(batches: Iterator[pa.RecordBatch], texts: int, most: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Parts of batches with their ids in order, of limited size; `texts` is the number of text columns after id."""
    for batch in batches:
        ids = np.asarray(batch.column(0), np.int64)
        order = np.argsort(ids, kind="stable")
        size = np.zeros(len(ids), np.int64)
        for c in range(1, texts + 1):
            size += np.asarray(pc.fill_null(pc.utf8_length(batch.column(c)), 0), np.int64)
        total = np.cumsum(size[order])
        start = 0
        while start < len(ids):
            before = total[start - 1] if start else 0
            end = int(np.searchsorted(total, before + most, side="right"))
            end = min(max(end, start + 1), start + CHUNK_LINKS, len(ids))
            yield ids[order[start:end]], batch.take(pa.array(order[start:end]))
            start = end


def _word_rows(ids: np.ndarray, texts: list[str]) -> pa.RecordBatch | None:
    vocabulary: dict[str, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t)), np.int64) for t in texts]
    length = np.array([len(c) for c in coded], np.int64)
    if not vocabulary:
        return None
    code = np.concatenate(coded)
    doc = np.repeat(np.arange(len(ids)), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length) + 1
    blocks, block_of = np.unique(ids >> BLOCK_BITS, return_inverse=True)
    key = code * len(blocks) + block_of[doc]
    order = np.argsort(key, kind="stable")  # inside a key links and places stay in order
    key, doc, place = key[order], doc[order], place[order]
    new_row = np.r_[True, key[1:] != key[:-1]]
    rows, postings = np.flatnonzero(new_row), np.flatnonzero(new_row | np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.append(postings, len(doc)))
    owner = doc[postings]
    first = np.searchsorted(postings, rows)  # each row's first posting
    block = blocks[key[rows] % len(blocks)]
    far = differences(ids[owner], first)
    far[first] -= block << BLOCK_BITS
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(vocabulary), pa.string()).take(pa.array(key[rows] // len(blocks))),
            pa.array(block, pa.int64()),
            varints(np.stack([far, counts, length[owner]], axis=1).ravel(), 3 * first),
            varints(differences(place, postings), rows),
            pa.array(np.maximum.reduceat(counts, first), pa.int32()),
            pa.array(np.minimum.reduceat(length[owner], first), pa.int32()),
        ],
        names=["term", "block", "links", "places", "most", "shortest"],
    )


def indexed_text(links: DataFrame) -> DataFrame:
    """(id, text, user_id): title and description in lower case, the text whose words are indexed."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    return links.select("id", text.alias("text"), "user_id")


def word_postings(links: DataFrame) -> DataFrame:
    """Per word and block of ids: the links that hold the word, how often, their lengths in words, and the places.

    `links` codes for each link the distance of its id from the one before (from the block's start), the count and the
    length; `places` the distances of places from one to the next, from 0 for each link.  `most` is the highest count
    and `shortest` the least length, which bound any score in the block.  A block can come in several rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches, 1, WORD_CHARS):
            rows = _word_rows(ids, chunk.column(1).to_pylist())
            if rows is not None:
                yield rows

    return indexed_text(links).where("id is not null").select("id", "text").mapInArrow(make, WORD_SCHEMA)


def read_words(postings: DataFrame, positions: bool) -> DataFrame:
    """(term, id, n, length, batch, and positions if asked) of coded rows (term, block, links, places, batch), one row per link."""
    schema = "term string, id long, n int, length int, batch long" + (", positions array<int>" if positions else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = numbers(batch.column(2))
            far, n, length = values.reshape(-1, 3).T
            sizes //= 3
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids = sums(far, sizes) + (np.asarray(batch.column(1), np.int64) << BLOCK_BITS)[row]
            row = pa.array(row)
            columns = [batch.column(0).take(row), pa.array(ids), pa.array(n, pa.int32()), pa.array(length, pa.int32()), batch.column(3).take(row)]
            if positions:
                ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(sums(numbers(batch.column(4))[0], n), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "n", "length", "batch", "positions"][: len(columns)])

    return postings.select("term", "block", "links", "batch", *(["places"] if positions else [])).mapInArrow(read, schema)


def _gram_keys(texts: list[str], index: Callable[[np.ndarray], np.ndarray], letters: int, docs: int) -> np.ndarray:
    """Sorted distinct (gram, text) pairs as one number each."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(p) for p in points])
    doc = np.repeat(np.arange(len(texts)), size)
    code = index(np.concatenate(points)) if len(doc) else np.zeros(0, np.int64)
    if len(code) < GRAM:
        return np.zeros(0, np.int64)
    whole = doc[2:] == doc[:-2]
    return np.unique((((code[:-2] * letters + code[1:-1]) * letters + code[2:]) * docs + doc[:-2])[whole])


def _gram_rows(ids: np.ndarray, columns: list[list[str]]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0x110000, bool)
    for texts in columns:
        for t in texts:
            seen[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) ** GRAM * len(ids) >= 2**62 and len(ids) > 1:
        half = len(ids) // 2
        yield from _gram_rows(ids[:half], [c[:half] for c in columns])
        yield from _gram_rows(ids[half:], [c[half:] for c in columns])
        return
    place = np.cumsum(seen) - 1
    found = [_gram_keys(texts, lambda points: place[points], len(alphabet), len(ids)) for texts in columns]
    key = np.concatenate(found)
    if not len(key):
        return
    bits = np.repeat(1 << np.arange(len(columns)), [len(f) for f in found])
    order = np.argsort(key, kind="stable")
    key, bits = key[order], bits[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    fields, key = np.bitwise_or.reduceat(bits, starts), key[starts]
    gram, owner = key // len(ids), key % len(ids)
    rows = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    n = len(alphabet)
    letters = [alphabet[g].tolist() for g in (gram[rows] // (n * n), gram[rows] // n % n, gram[rows] % n)]
    names = ["".join(map(chr, g)) for g in zip(*letters, strict=True)]
    far = differences(ids[owner], rows)
    far[rows] = 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(ids[owner[rows]]), varints(far << len(FIELDS) | fields, rows)], names=["gram", "first", "links"]
    )


def searched_fields(links: DataFrame) -> DataFrame:
    """(id, and the four texts that a text search looks at, in lower case)."""
    texts = [F.col("title"), F.col("description"), F.col("url"), tags_text(F.col("tags"))]
    return links.select("id", *[F.lower(F.coalesce(t, F.lit(""))).alias(name) for t, name in zip(texts, FIELDS, strict=True)])


def gram_postings(links: DataFrame) -> DataFrame:
    """Per substring of three characters: the links that hold it, and in which of the four fields.

    `links` codes for each link the distance of its id from the one before (the first is `first`), then four bits for the fields.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in _chunks(batches, len(FIELDS), GRAM_CHARS):
            yield from _gram_rows(ids, [chunk.column(c + 1).to_pylist() for c in range(len(FIELDS))])

    return searched_fields(links).where("id is not null").mapInArrow(make, GRAM_SCHEMA)


def read_grams(postings: DataFrame) -> DataFrame:
    """(gram, id, fields, batch) of coded rows (gram, first, links, batch), one row per link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = numbers(batch.column(2))
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids = sums(values >> len(FIELDS), sizes) + np.asarray(batch.column(1), np.int64)[row]
            fields = pa.array(values & (1 << len(FIELDS)) - 1, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(ids), fields, batch.column(3).take(pa.array(row))], names=["gram", "id", "fields", "batch"])

    return postings.select("gram", "first", "links", "batch").mapInArrow(read, "gram string, id long, fields int, batch long")
