"""Byte-level BPE encoding and decoding through a sentencepiece model.

The model is serialised from the vocabulary alone: each token becomes a piece in the letters
that stand for its bytes, scored by its negative rank, under identity normalisation. The
pre-tokens of a text are encoded by it; decoding maps ids to pieces and letters back to bytes.
A pre-token that is itself a token is that token, as in the rank files' own library.

Null and empty texts have no tokens. Repeated rows are encoded each. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.best_fit_packing import byte_letters
from tunelake.llm.common import CACHE_WORDS, documents, id_and_text, slices_by_bytes, text_bytes

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BATCH_BYTES = 4 << 20
UNKNOWN = "\ufffe?"  # no letter of a byte, so no text reaches it

# A word with the space before it, or white space: no pre-token goes over these borders.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks have to be 0, 1, 2, ...")
    pieces = [("".join(letters[b] for b in t), -float(i), 1) for i, t in enumerate(tokens)] + [(UNKNOWN, 0.0, 2)]
    model = [_field(1, _field(1, p.encode()) + _field(2, score) + _field(3, kind)) for p, score, kind in pieces]
    absent = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(model) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe(dict):
    """Ids of chunks of text, as packed little-endian 32-bit numbers."""

    def __init__(self, path: str = VOCABULARY):
        super().__init__()
        self.ranks = read_ranks(path)
        self.letters = {b: letter for b, letter in byte_letters().items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))
        byte = {letter: b for b, letter in self.letters.items()}
        self.bytes_of = [bytes(byte[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def pre_tokens(self, chunk: str) -> list[bytes]:
        return [t.encode() for t in self.pattern.findall(chunk)]

    def learn(self, chunks: set[str]) -> None:
        """Encodes new chunks, all their pre-tokens in one call."""
        tokens = {c: self.pre_tokens(c) for c in chunks}
        new = list({t for ts in tokens.values() for t in ts if t not in self.ranks})
        coded = self.model.encode([t.decode("latin-1").translate(self.letters) for t in new], num_threads=1) if new else []
        ids = dict(zip(new, coded, strict=True))
        for chunk, ts in tokens.items():
            flat = [i for t in ts for i in (ids[t] if t in ids else (self.ranks[t],))]
            self[chunk] = struct.pack(f"<{len(flat)}I", *flat)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text."""
        chunked = [_CHUNK.findall(t) for t in texts]
        new = {c for chunks in chunked for c in chunks if c not in self}
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = {c for chunks in chunked for c in chunks}
        self.learn(new)
        return [b"".join(map(self.__getitem__, chunks)) for chunks in chunked]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[str, ByteBpe] = {}


def codec(path: str = VOCABULARY) -> ByteBpe:
    """One codec per worker process."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, the ids as packed little-endian 32-bit numbers, the decoded bytes."""

    def run(batches):
        bpe = codec(path)
        for batch in slices_by_bytes(batches, BATCH_BYTES):
            ids = bpe.encode([t.decode() for t in text_bytes(batch)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(documents(spark, sf_dir))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op8_byte_bpe": op8_byte_bpe}


def oracle_sql() -> dict[str, str]:
    return {}
