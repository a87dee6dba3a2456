"""Byte-level BPE: encoding through a sentencepiece model made from a rank file, and decoding.

The vocabulary file lists byte strings with ranks. From it a sentencepiece BPE
model is serialised directly: each byte becomes one printable character, each
entry a piece whose score is its negative rank, and normalisation is the
identity, so sentencepiece merges exactly the pair of lowest rank first. A text
is split into pre-tokens by the tokenizer's pattern; each pre-token is encoded
by itself. A pre-token that is a vocabulary entry is that entry. Decoding maps
ids back to their bytes.

A worker keeps the ids of pre-tokens it has met in a table of at most
``CACHE`` short entries; it only saves time.

Defined results: null and empty texts have no ids; an unknown id fails; rows
repeat as given; no row depends on another.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.common import documents

CACHE, CACHED_LENGTH = 400_000, 64
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_characters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a message or string, a varint, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one more id is the unknown piece."""
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in p).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, p in enumerate(by_rank)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(by_rank))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Splitter:
    """Cuts a text into pre-tokens by the byte-level pattern.

    Texts whose characters all lie below U+0250 go through the standard ``re``
    engine with the pattern's classes written out, which gives the same matches
    in less than half the time; all others, and other patterns, through ``regex``.
    """

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.full = regex.compile(pattern).findall
        letters, numbers, blanks = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
        self.latin = re.compile(
            f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"
        ).findall
        self.beyond = re.compile("[^\x00-ɏ]").search if pattern == public_tokenizers.PATTERN else lambda text: True

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.beyond(text) else self.latin(text)


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.split = Splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.pieces = sorted(self.ranks, key=self.ranks.__getitem__)
        chars = byte_characters()
        self.table = [chars[b] for b in range(256)]
        self.cache: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8")
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.model.encode("".join(self.table[b] for b in raw))
        out = np.array(ids, "<u4").tobytes()
        if len(raw) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        known, other = self.cache.get, self.encode_piece
        return b"".join([known(p) or other(p) for p in self.split(text or "")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(text: Column, path: str = RANKS) -> Column:
    """``array<int>`` of ids."""

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for part in parts:
            found = [codec.encode(t) for t in part.to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))

    return ids(text)


def decode(ids: Column, path: str = RANKS) -> Column:
    """The bytes that an ``array<int>`` of ids stands for; null gives null."""

    @F.arrow_udf("binary")
    def raw(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        for part in parts:
            yield pa.array([None if x is None else codec.decode(np.array(x, "<u4").tobytes()) for x in part.to_pylist()], pa.binary())

    return raw(ids)


def round_trip(text: Column, path: str = RANKS, keep_ids: bool = False) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if asked for."""
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>>" if keep_ids else ">")

    @F.arrow_udf(kind)
    def digest(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in parts:
            ids = [codec.encode(t) for t in part.to_pylist()]
            cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(codec.decode(x)) for x in ids], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                names.append("ids")
            yield pa.StructArray.from_arrays(cols, names)

    return digest(text)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the ids of each document with the digests of a checked round trip."""
    return docs.select("doc_id", round_trip(F.col("text"), keep_ids=True).alias("r")).select("doc_id", "r.*")
