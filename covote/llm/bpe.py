"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

Each byte string of the vocabulary becomes a piece of letters that stand for its bytes, scored by its
negative rank, so that the best merge is the one of lowest rank; text is not normalised. A text is
split by the vocabulary's pattern, every match is encoded by itself, and ids are decoded by mapping
the letters of their pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covote.llm.common import byte_letters

CACHE = 300_000  # matches of the pattern that a worker remembers


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """A field of a protocol buffer: bytes and messages, whole numbers, or 32-bit floats."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model in which the id of a piece is its rank.

    Ranks must run from 0 without a gap; the unknown piece, which no text reaches since every byte
    has a piece, comes last.
    """
    letters = byte_letters()
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without a gap")
    normal, unknown = 1, 2
    pieces = [
        _field(1, _field(1, "".join(letters[b] for b in piece)) + _field(2, -float(rank)) + _field(3, normal))
        for piece, rank in ordered
    ]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ordered))
    plain = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, plain)


class Codec(dict):
    """Remembers what each match encodes to: how many ids, the ids as text, and the bytes they decode to."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        letters = byte_letters()
        self.letters = [letters[b] for b in range(256)]
        as_byte = {c: b for b, c in letters.items()}
        self.pieces = [
            bytes(as_byte[c] for c in self.model.id_to_piece(k)) for k in range(self.model.get_piece_size() - 1)
        ]

    def ids(self, match: str) -> list[int]:
        return self.model.encode("".join([self.letters[b] for b in match.encode()]))

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[k] for k in ids])

    def __missing__(self, match: str) -> tuple[int, str, bytes]:
        if len(self) >= CACHE:
            self.clear()
        ids = self.ids(match)
        found = self[match] = (len(ids), " ".join(map(str, ids)), self.decoded(ids))
        return found

    def encode(self, text: str) -> list[int]:
        return [k for match in self.split(text) for k in self.ids(match)]

    def digest(self, text: str) -> tuple[int, str, str]:
        found = list(map(self.__getitem__, self.split(text)))
        counts, ids, raw = zip(*found, strict=True) if found else ((), (), ())
        return sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, null texts like empty ones without any."""
    proto = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))

    @F.pandas_udf("array<int>")
    def encoding(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(proto.value, pattern)
        for texts in batches:
            yield pd.Series([codec.encode(t or "") for t in texts], dtype=object)

    return docs.select("doc_id", encoding("text").alias("ids"))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row.

    The first digest is of the decimal ids joined by blanks, the second of the bytes that the ids
    decode to, which are those of the text. A null text is like an empty one: no ids, digests of
    nothing. A text is encoded whole however long it is; other columns are not read.
    """
    proto = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digesting(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(proto.value, pattern)
        for texts in batches:
            yield pd.DataFrame([codec.digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digesting("text").alias("d")).select("doc_id", "d.*")
