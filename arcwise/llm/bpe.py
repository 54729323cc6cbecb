"""Byte-level BPE through a sentencepiece model made from the vocabulary alone.

The ranks of the vocabulary become a serialised sentencepiece model of type BPE: every token's bytes are mapped to
characters one by one, the piece's score is its negative rank, and normalisation is the identity. The pattern's
matches are encoded one by one, a match that is itself a token as that token. Decoding maps ids to bytes by the table.
Ids, not text, are what a decode sees. Pre-tokens seen before are kept in a table of bounded size.

Nulls: a null text counts as empty and has no tokens. Lone surrogates can't come from Spark's UTF-8. Empty tables give
an empty result; other columns are ignored. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

CACHE = 200_000
_OFFSET = 0x100  # byte b is the character U+0100 + b


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes, an int or a float."""
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mapped(data: bytes) -> str:
    return "".join(chr(_OFFSET + b) for b in data)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown one, piece r + 1 the token of the r-th rank in order.

    Field numbers of the public format: pieces 1 (piece 1, score 2, type 3), trainer_spec 2 (model_type 3: BPE is 2;
    byte_fallback 35; ids of unk, bos, eos, pad 40 to 43), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    none = (1 << 64) - 1  # -1: no such piece
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, mapped(token).encode()) + _field(2, float(-rank))))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, none) + _field(42, none) + _field(43, none)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """encode and decode texts by a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        order = sorted(ranks.items(), key=lambda x: x[1])
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.rank_of = [-1, *(r for _, r in order)]
        self.whole = ranks
        self.bytes_of = {r: t for t, r in order}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        hard = []
        for w in words:
            data = w.encode("utf-8", "surrogatepass")
            if data in self.whole:
                self.known[w] = (self.whole[data],)
            else:
                hard.append((w, mapped(data)))
        for (w, _), ids in zip(hard, self.model.encode([m for _, m in hard], num_threads=1), strict=True):
            self.known[w] = tuple(self.rank_of[i] for i in ids)

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        known = self.known
        missing = list({w for w in words if w not in known})
        if missing:
            self._learn(missing)
            known = self.known
            if not all(w in known for w in words):  # the table was emptied: take this text's words anew
                self._learn(list(set(words)))
        return [i for w in words for i in known[w]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array of int) of every row; path is read by each worker."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        own = codec(path, pattern)
        digits: dict[int, str] = {r: str(r) for r in own.bytes_of}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                out = [[] for _ in range(4)]
                for text in texts[at : at + 256]:
                    ids = own.encode(text)
                    row = (len(ids), hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), ids if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                columns = [batch.column(0).slice(at, 256), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out[3], pa.list_(pa.int32()))] * with_ids, names=names)

    bound_batches(docs.sparkSession)
    rows = text_of(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of what encode returned; bytes that aren't UTF-8 become the replacement character."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    bound_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_public(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """encode by the installed multilingual vocabulary."""
    return encode(docs, *_vocabulary(), with_ids=with_ids).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *([F.col("ids")] if with_ids else []))
