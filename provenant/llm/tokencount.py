"""Token counts without token ids.

A part is a few million characters of texts. Its pre-tokens are dictionary
encoded, which leaves the part's distinct pre-tokens and, for each document, the
codes that occur in it with their frequencies. The distinct pre-tokens of all
parts meet by a shuffle, so each is given to the tokenizer's merge model once in
the whole job; only the number of its pieces is kept. These numbers go back to
the parts that hold the pre-token and are joined there to the documents, whose
counts are the sums of frequency times pieces. No ids are made, and a very common
pre-token travels once a part, not once an occurrence.

Special tokens written in a text count as one token, as the library has it by
default. Null and empty texts have 0 tokens and 0 bytes; rows repeat as given,
null ids included; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenant.llm.bpe import Splitter, byte_characters
from provenant.llm.common import documents, materialise

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PART = 1 << 22  # characters of texts whose pre-tokens are held at once
BUCKETS = 4096  # of pre-tokens; a task holds the distinct ones of a bucket


class PieceCounter:
    """Cuts texts into pre-tokens, and counts the pieces of a pre-token, for a byte-level BPE file."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        whole = Tokenizer.from_file(path)
        self.model, self.split = whole.model, Splitter(pattern)
        special = sorted((t.content for t in whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.table = byte_characters()

    def pieces(self, pretoken: bytes) -> int:
        return len(self.model.tokenize(pretoken.decode("latin-1").translate(self.table)))

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special tokens in it."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1


@lru_cache(2)
def counter_of(path: str) -> PieceCounter:
    """One for each worker process."""
    return PieceCounter(path)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, least first, all but the last with a high bit; and the bytes each takes."""
    values = values.astype(np.int64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 5):
        n += values >= 1 << (7 * k)
    starts = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        some = n > k
        out[starts[some] + k] = (values[some] >> (7 * k)) & 127 | np.where(n[some] > k + 1, 128, 0)
    return out, n


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(last) else np.empty(0, np.int64)


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rising numbers as steps, anew from each start."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def unstepped(out: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(out)
    return total - np.repeat(np.concatenate(([0], total))[starts], np.diff(np.append(starts, len(out))))


def _unpacked_rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's end."""
    rows = column.to_pylist()
    data = np.frombuffer(b"".join(rows), np.uint8)
    # as many numbers as bytes without a high bit
    return unpacked(data), np.concatenate(([0], np.cumsum(data < 128)))[np.cumsum([0, *map(len, rows)])]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


_FREQUENCIES = "part bigint, bucket int, doc_id bigint, n_bytes bigint, extra bigint, codes binary, freqs binary, entries binary"
_KNOWN = "part bigint, codes binary, pieces binary"
_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _frequencies(path: str):
    """(doc_id, text) to a row for each document, with its frequencies, and rows with its part's distinct pre-tokens, by bucket.

    Codes number a part's pre-tokens by falling frequency. A document has its
    codes in order, each as twice the step from the one before, plus one if it
    occurs more than once; ``freqs`` has how often these do. A bucket has its
    pre-tokens' bytes one after another in ``entries``, their lengths in ``freqs``.
    """

    def part_of(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        counter = counter_of(path)
        found, extra = zip(*map(counter.pretokens, texts), strict=True)
        coded = pc.dictionary_encode(pa.array(list(chain.from_iterable(found)), pa.large_string()))
        size, n, at = max(1, len(coded.dictionary)), len(texts), coded.indices.to_numpy()
        order = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, freq = np.unique(np.repeat(np.arange(n), [len(p) for p in found]) * size + place[at], return_counts=True)
        row, several = pairs // size, freq > 1
        step = steps(pairs % size, np.flatnonzero(np.diff(row, prepend=-1)))
        names = coded.dictionary.take(pa.array(order))
        bucket = np.fromiter((crc32(p) % BUCKETS for p in names.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), np.int64, len(order))
        dealt = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[dealt], prepend=-1))
        m = len(first)

        def binary(values: np.ndarray, rows: np.ndarray, count: int) -> pa.Array:
            data, width = packed(values)
            return _binary(np.concatenate(([0], np.cumsum(np.bincount(rows, width, minlength=count)))), data)

        of_bucket = np.cumsum(np.diff(bucket[dealt], prepend=-1) != 0) - 1
        names = names.take(pa.array(dealt)).cast(pa.binary())
        _, edges, held = names.buffers()
        edges = np.frombuffer(edges, np.int32)[names.offset : names.offset + len(names) + 1]
        codes = pa.concat_arrays([binary(2 * step + several, row, n), binary(steps(dealt, first), of_bucket, m)])
        freqs = pa.concat_arrays([binary(freq[several], row[several], n), binary(np.diff(edges), of_bucket, m)])
        entries = _binary(np.concatenate((np.zeros(n), edges[first], edges[-1:])), np.frombuffer(held or b"", np.uint8))
        none = [None] * m
        columns = [
            pa.array(np.full(n + m, uuid.uuid4().int >> 65, np.int64)), pa.array([*[None] * n, *bucket[dealt][first].tolist()], pa.int32()), pa.concat_arrays([ids, pa.nulls(m, pa.int64())]),
            pa.array([*(len(t.encode("utf-8")) for t in texts), *none], pa.int64()), pa.array([*extra, *none], pa.int64()), codes, freqs, entries,
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FREQUENCIES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_numpy(zero_copy_only=False).tolist()]
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= PART):
                    held += len(texts[j])
                    j += 1
                yield part_of(batch.column(0).slice(i, j - i), texts[i:j])
                i = j

    return run


def _pieces(path: str):
    """(bucket, part, codes, freqs, entries), equal buckets together, to (part, codes, pieces): each pre-token is given to the model once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, known = counter_of(path).pieces, None, {}
        for batch in batches:
            out = []
            for bucket, lengths, held in zip(*(batch.column(c).to_pylist() for c in ("bucket", "freqs", "entries")), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                ends = np.cumsum(unpacked(np.frombuffer(lengths, np.uint8))).tolist()
                names = [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                for p in names:
                    if p not in known:
                        known[p] = count(p)
                out.append(packed(np.array([known[p] for p in names], np.int64))[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("codes"), pa.array(out, pa.binary())], ["part", "codes", "pieces"])

    return run


def _sum_part(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one part, and the pieces of its codes, to their counts."""
    step, ends = _unpacked_rows(known["codes"])
    pieces = np.zeros(len(step) + 1, np.int64)
    pieces[unstepped(step, ends[:-1])] = _unpacked_rows(known["pieces"])[0]
    step, ends = _unpacked_rows(docs["codes"])
    times = np.ones(len(step), np.int64)
    times[step % 2 == 1] = _unpacked_rows(docs["freqs"])[0]
    code = unstepped(step // 2, ends[:-1][ends[1:] > ends[:-1]])
    sums = np.concatenate(([0], np.cumsum(pieces[code] * times)))
    counts = sums[ends[1:]] - sums[ends[:-1]] + docs["extra"].to_numpy()
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(counts)})


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_frequencies(path), _FREQUENCIES)
    parts = materialise(rows, "token-frequencies", compression="zstd")
    entries = parts.where("bucket IS NOT NULL").select("bucket", "part", "codes", "freqs", "entries")
    known = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pieces(path), _KNOWN)
    each = parts.where("bucket IS NULL").select("part", "doc_id", "n_bytes", "extra", "codes", "freqs")
    return each.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_sum_part, _COUNTS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 512)
