"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged, so a piece of text may be
cut between them. What lies between two cuts is encoded by itself; the ids are then put together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: How the byte-level pre-tokenizer splits text (fixed value of the public vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose Unicode class is old enough to be the same in each library; others are split by the tokenizer itself.
SETTLED = r"[^\u0000-՗‐-⁞₠-₿℀-⅏ぁ-ゖァ-ヺ一-龥가-힣]"
#: Pieces whose ids a task remembers before it starts afresh.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryCoder:
    """Encodes and decodes one text at a time; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        described = json.loads(definition)
        before = described["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or described["normalizer"] or described["model"]["ignore_merges"]:
            raise ValueError("a byte-level vocabulary without prefix space, normalizer or ignored merges is needed")
        self._tokenizer = Tokenizer.from_str(definition)
        self._merge = self._tokenizer.model.tokenize
        self._letters = byte_letters()
        bytes_of = {letter: byte for byte, letter in self._letters.items()}
        vocabulary = described["model"]["vocab"]
        self._inside = {a + b for token in vocabulary for a, b in zip(token, token[1:], strict=False)}
        self._bytes = {i: bytes(bytes_of[letter] for letter in token) for token, i in vocabulary.items()}
        self._special = {x["content"]: x["id"] for x in described["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in described["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self._bytes |= {i: content.encode() for content, i in self._special.items()}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self._pieces = regex.compile(PIECES).findall
        self._unsettled = regex.compile(SETTLED).search
        self._known: dict[str, bytes] = {}
        self._fragments: dict[str, bytes] = {}

    def fragments(self, piece: str) -> list[str]:
        """The piece in byte letters, cut wherever two neighbours stand together in no token."""
        letters = piece.encode().decode("latin-1").translate(self._letters)
        cuts = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in self._inside]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def _piece(self, piece: str) -> bytes:
        packed = []
        for fragment in self.fragments(piece):
            ids = self._fragments.get(fragment)
            if ids is None:
                ids = b"".join(token.id.to_bytes(4, "little") for token in self._merge(fragment))
                if len(self._fragments) >= REMEMBERED:
                    self._fragments.clear()
                self._fragments[fragment] = ids
            packed.append(ids)
        return b"".join(packed)

    def _split(self, text: str) -> list[str]:
        if self._unsettled(text):
            return [text[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._pieces(text)

    def encode(self, text: str) -> bytes:
        packed = []
        parts = self._specials.split(text) if self._specials else [text]
        for i, part in enumerate(parts):
            if i % 2:
                packed.append(self._special[part].to_bytes(4, "little"))
                continue
            pieces = self._split(part)
            known = self._known
            for piece in set(pieces).difference(known):
                if len(piece) > 200:  # rare and long: not worth remembering
                    continue
                known[piece] = self._piece(piece)
            packed += [known.get(piece) or self._piece(piece) for piece in pieces]
            if len(known) > REMEMBERED:
                known.clear()
        return b"".join(packed)

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again: the id, `ids` (packed 32-bit little-endian) and `decoded`.

    Null texts count as empty and give no ids. Rows with equal or null ids are each kept. Other columns are not read, so their names
    cannot clash. The strings of special tokens in a text become their ids, as the public library has it by default.
    `tokenizer_path` is read by the driver and sent to the tasks: its size is that of one vocabulary file.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(id_column, text_column)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ForcedBoundaryCoder(definition.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [coder.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())],
                    [id_column, "ids", "decoded"],
                )

    schema = T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(coded, schema)
