"""A content-addressed store of token ids.

Format, all Parquet under one folder of shared storage:

``chunks``     ``hash binary, payload binary``: each distinct chunk of ids once,
               under its BLAKE2b-128 hash; ids little-endian, 2 bytes each where
               the vocabulary fits, else 4.
``recipes``    one row a document in ascending ``doc_id`` order: ``part``, ``seq``
               (its place), ``doc_id``, ``n_tokens``, ``local_start`` (ids before it
               in its part), ``hashes`` (its chunks in order), ``root`` (Merkle root
               over them).
``manifests``  one row a part: ``part``, ``n_docs``, ``n_tokens``, ``root`` (Merkle
               root over the part's document roots in order).

A rolling (gear) hash over the ids decides where a chunk ends, so equal runs of
ids give equal chunks wherever they stand and are stored once. Reading checks
every chunk's hash, every document's Merkle root and length and every part's
manifest; a lost, altered or misplaced piece is an error, never a gap.

Defined results: null and empty texts hold the end id alone; repeated rows are
documents of their own; null ids sort first; ties are ordered by their
content; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain, compress, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenant.llm.bpe import Splitter, byte_characters
from provenant.llm.common import documents, shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
PART = 1 << 22  # characters of texts encoded at once
KNOWN = 640_000  # pre-tokens a worker remembers, about 150 bytes each
KNOWN_CHARACTERS = 16 * KNOWN
_BLANK = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"  # all that any engine takes for one
_ROUGH = rf"[{_BLANK}] (?:[{_BLANK}]|\z)"
_WHOLE = rf"^ [^{_BLANK}](?:(?s:.)*[^{_BLANK}])?$"
_LATIN = r"^ [!-~\x{a1}-\x{24f}](?:[\t-\r!-~\x{a0}-\x{24f}]*[!-~\x{a1}-\x{24f}])?$"
_GAP = re.compile(r"(?<=\S) (?=\S)")
WINDOW, MASK, LEAST, MOST = 16, 255, 64, 2048  # ids: hashed together, cut on average at 1 in 256, least and most in a chunk
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, np.uint64)  # any fixed table does


class Known:
    """Pre-tokens met before and the ids of each."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.held = 0  # characters
        self.starts, self.counts, self.met, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def trim(self) -> None:
        """Once full, only what was met in two parts of the texts or more stays, or nothing if that is over half."""
        if len(self.slots) <= KNOWN and self.held <= KNOWN_CHARACTERS:
            return
        stays = np.flatnonzero(self.met > 1)
        # slots stand in the order of their numbers
        names = list(compress(self.slots, (self.met > 1).tolist()))
        held = sum(map(len, names))
        if 2 * len(names) > KNOWN or 2 * held > KNOWN_CHARACTERS:
            self.__init__()
            return
        self.ids, counts = self.of(stays)
        self.slots, self.held = dict(zip(names, range(len(names)), strict=True)), held
        self.starts, self.counts, self.met = np.cumsum(counts) - counts, counts, np.ones(len(names), np.int64)

    def find(self, names: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where each of these distinct strings is held; ``learn`` gives the ids of all new ones, and how many each has."""
        slot = np.array(list(map(self.slots.get, names, repeat(-1))), np.int64)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            new = [names[i] for i in fresh.tolist()]
            ids, counts = learn(new)
            slot[fresh] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.slots.update(zip(new, slot[fresh].tolist(), strict=True))
            self.held += sum(map(len, new))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        self.met[slot] += 1
        return slot

    def of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids held at these places, one after another, and how many each has."""
        counts = self.counts[slot]
        return gather(self.ids, self.starts[slot], counts), counts


class Encoder:
    """Ids by the tokenizers library's merge model, many texts at once.

    Texts are cut at single spaces and the words between them dictionary-encoded,
    without a Python object for each. Each different word is cut into pre-tokens;
    the model is called once for each of these that is not known yet, and the ids
    of the texts are gathered.

    A cut before a space changes no match of the pattern unless the space stands
    within blanks or ends them: every other match begins at that space or ends
    before it. Texts with such a space are cut by the pattern alone.
    """

    def __init__(self, path: str = VOCABULARY):
        whole = Tokenizer.from_file(path)
        self.model, self.split = whole.model, Splitter()
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        self.size = whole.get_vocab_size(with_added_tokens=True)
        self.table = dict(byte_characters())
        self.known = Known()

    def _merged(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by the model."""
        pretokens = pa.array(names, pa.large_string())
        shown = pc.replace_substring(pretokens, " ", self.table[32])
        # all but the space and printable ASCII go byte by byte
        other = pc.match_substring_regex(pretokens, r"[^ -~]")
        rest = pretokens.filter(other)
        raw, ends = "".join(strings(rest)).encode().decode("latin-1").translate(self.table), np.cumsum(pc.binary_length(rest).to_numpy()).tolist()
        shown = strings(pc.replace_with_mask(shown, other, pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.large_string())))
        merge, flat, ends = self.model.tokenize, [], []
        for p in shown:
            flat += [t.id for t in merge(p)]
            ends.append(len(flat))
        return np.array(flat, np.uint32), np.diff(ends, prepend=0)

    def _of_pretokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens in their order, and how many each has."""
        coded = pc.dictionary_encode(pa.array(found, pa.large_string()))
        slot = self.known.find(strings(coded.dictionary), self._merged)
        return self.known.of(slot[coded.indices.to_numpy()])

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of text, each cut by the pattern alone, and how many each has."""
        found: list[str] = []
        edges = [0]
        for piece in pieces:
            found += self.split(piece)
            edges.append(len(found))
        ids, counts = self._of_pretokens(found)
        return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[edges])

    def _of_words(self, words: pa.Array, spaced: int) -> pa.Array:
        """The ids of each word, as lists; the first ``spaced`` begin with a space.

        Words that neither begin nor end with a blank after it are joined and cut as one text.
        """
        names, place = strings(words), pa.array(np.arange(len(words)) < spaced)
        kinds = np.where(pc.and_(place, pc.match_substring_regex(words, _LATIN)).to_numpy(zero_copy_only=False), 0, 2)
        other = np.flatnonzero(kinds)
        whole = pc.and_(place.take(pa.array(other)), pc.match_substring_regex(words.take(pa.array(other)), _WHOLE))
        kinds[other[whole.to_numpy(zero_copy_only=False)]] = 1
        found: list[str] = []
        begins = []
        for kind, cut in ((0, self.split.latin), (1, self.split.full)):
            got = cut("".join(compress(names, (kinds == kind).tolist())))
            # a pre-token with a space begins a word
            begins.append(len(found) + np.flatnonzero(pc.starts_with(pa.array(got, pa.large_string()), " ").to_numpy(zero_copy_only=False)))
            found += got
        own = []
        for name in compress(names, (kinds == 2).tolist()):
            own.append(len(found))
            found += self.split(name)
        ids, counts = self._of_pretokens(found)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate((*begins, np.array(own, np.int64), [len(found)]))]
        held = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))
        back = np.empty(len(names), np.int64)
        back[np.argsort(kinds, kind="stable")] = np.arange(len(names))
        return held.take(pa.array(back))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        if not texts:
            return []
        self.known.trim()
        whole = pa.array(texts, pa.large_string())
        rough = pc.match_substring_regex(whole, _ROUGH)
        if pc.any(rough).as_py():
            at = rough.to_numpy(zero_copy_only=False)
            ids, counts = self._of_pieces(strings(whole.filter(rough)))
            ends = np.cumsum(counts)
            pieces = iter([ids[a:b] for a, b in zip(ends - counts, ends, strict=True)])
            others = iter(self.plain(strings(whole.filter(pc.invert(rough)))))
            return [next(pieces if r else others) for r in at.tolist()]
        cut = pc.split_pattern(whole, " ")
        edges = cut.offsets.to_numpy()
        coded = pc.dictionary_encode(cut.values)
        # the first word of a text has no space before it
        first = pc.dictionary_encode(cut.values.take(pa.array(edges[:-1])))
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string()))
        at = coded.indices.to_numpy().copy()
        at[edges[:-1]] = len(spaced) + first.indices.to_numpy()
        del cut, coded
        got = self._of_words(pa.concat_arrays([spaced, first.dictionary]), len(spaced)).take(pa.array(at))
        ids, ends = got.values.to_numpy(), got.offsets.to_numpy()[edges]
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _segments(self, text: str) -> list[str | int]:
        """A text without its special tokens, cut where it is long, and the ids of these in between."""
        if self.specials is None or not self.specials.search(text):
            return slices(text)
        plain, marks = self.specials.split(text), self.specials.findall(text)
        out: list[str | int] = slices(plain[0])
        for mark, rest in zip(marks, plain[1:], strict=True):
            out += [self.special[mark], *slices(rest)]
        return out

    def streams(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; special tokens written in it become their ids, as the library does by default.

        Texts of ``PART`` characters are held at once, or one text's slice.
        """
        segments = [self._segments(t or "") for t in texts]
        plain = [s for each in segments for s in each if isinstance(s, str)]
        encoded = chain.from_iterable(self.plain(plain[a:b]) for a, b in parts_of([len(s) for s in plain], PART))
        for each in segments:
            got = [next(encoded) if isinstance(s, str) else np.array([s], np.uint32) for s in each]
            yield got[0] if len(got) == 1 else np.concatenate(got)


def slices(text: str, most: int = PART) -> list[str]:
    """A text cut after about ``most`` characters, where a lone space parts two characters that are not blank."""
    out, start = [], 0
    while len(text) - start > most and (m := _GAP.search(text, start + most)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, in a tenth of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for each worker process, whose tasks share what it knows."""
    return Encoder(path)


def parts_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes sum to ``most`` at most; a larger item is a run of its own."""
    i, total = 0, np.concatenate(([0], np.cumsum(sizes)))
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``values`` one after another."""
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def cut_points(streams: list[np.ndarray]) -> Iterator[list[int]]:
    """Ends of the chunks of each id stream; a stream's cuts depend on its own ids alone."""
    i = 0
    while i < len(streams):
        j, held = i, 0
        while j < len(streams) and (j == i or held + len(streams[j]) <= 1 << 18):
            held += len(streams[j]) + WINDOW
            j += 1
        # streams lie one after another, a window of nothing between them
        starts = np.concatenate(([0], np.cumsum([len(x) + WINDOW for x in streams[i:j]])))
        h = np.zeros(starts[-1], np.uint64)
        for at, x in zip(starts, streams[i:j], strict=False):
            h[at : at + len(x)] = _GEAR[x & 0xFFFF]
        # the sum over the window of each id's value, shifted by its distance: doubled from 1 to WINDOW
        d = 1
        while d < WINDOW:
            wider = h.copy()
            wider[d:] += h[:-d] << np.uint64(d)
            h, d = wider, 2 * d
        marks = np.flatnonzero((h >> np.uint64(24)) & np.uint64(MASK) == 0) + 1
        edges = np.searchsorted(marks, starts, "right")
        for k in range(i, j):
            own = (marks[edges[k - i] : edges[k - i + 1]] - starts[k - i]).tolist()
            yield _spaced(own, len(streams[k]))
        i = j


def _spaced(marks: list[int], n: int) -> list[int]:
    """Marks thinned to the least size and filled up to the most."""
    ends, last = [], 0
    for mark in [*(m for m in marks if m < n), n]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or (mark == n and mark > last):
            last = mark
            ends.append(last)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is; no leaves hash the empty string."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root from leaves that arrive one by one, holding one node a level."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        self.nodes.append((0, leaf))
        while len(self.nodes) > 1 and self.nodes[-1][0] == self.nodes[-2][0]:
            (height, left), (_, right) = self.nodes[-2:]
            self.nodes[-2:] = [(height + 1, digest(left + right))]

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        out = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            out = digest(left + out)
        return out


# --- writing --------------------------------------------------------------------------------------------------------


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, set[bytes]]]:
    """Slices of ``PART`` bytes of texts, so that little more is held at once, and what a whole batch has seen."""
    for batch in batches:
        seen: set[bytes] = set()
        for a, b in parts_of(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), PART):
            yield batch.slice(a, b - a), seen


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        tail, kind = np.array([end], np.uint32), "<u2" if encoder.size <= 1 << 16 else "<u4"
        item = int(kind[-1])
        for batch, seen in _texts_of(batches):
            kept, roots, sizes, counts, fresh_counts, payloads, fresh = [], [], [], [], [], [], []
            streams = [np.concatenate((ids, tail)) for ids in encoder.streams(strings(batch.column(1)))]
            for ids, cuts in zip(streams, cut_points(streams), strict=True):
                body, start, hashes, before = ids.astype(kind).tobytes(), 0, [], len(fresh)
                for stop in cuts:
                    payload = body[start * item : stop * item]
                    address = digest(payload)
                    hashes.append(address)
                    if address not in seen:
                        seen.add(address)
                        fresh.append(address)
                        payloads.append(payload)
                    start = stop
                kept += hashes
                roots.append(merkle_root(hashes))
                sizes.append(len(ids))
                counts.append(len(hashes))
                fresh_counts.append(len(fresh) - before)
            ends = lambda n: pa.array(np.cumsum([0, *n]).astype(np.int32))
            chunks = pa.StructArray.from_arrays([pa.array(fresh, pa.binary()), pa.array(payloads, pa.binary())], ["hash", "payload"])
            columns = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends(counts), pa.array(kept, pa.binary())),
                pa.array(roots, pa.binary()), pa.ListArray.from_arrays(ends(fresh_counts), chunks),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "hashes", "root", "fresh"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted part get their place and the ids before them."""
    seq = start = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = start + np.cumsum(n)
        cols = [pa.array(np.arange(seq, seq + len(n))), batch.column("doc_id"), batch.column("n_tokens"), pa.array(ends - n), batch.column("hashes"), batch.column("root")]
        seq, start = seq + len(n), int(ends[-1]) if len(n) else start
        yield pa.RecordBatch.from_arrays(cols, ["seq", "doc_id", "n_tokens", "local_start", "hashes", "root"])


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, seq) to one row a part."""
    part, tree, docs, tokens, out = None, MerkleStream(), 0, 0, []
    for batch in batches:
        for p, root, n in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("part", "root", "n_tokens")), strict=True):
            if p != part:
                out += [(part, docs, tokens, tree.root())] * (part is not None)
                part, tree, docs, tokens = p, MerkleStream(), 0, 0
            tree.add(root)
            docs, tokens = docs + 1, tokens + n
    out += [(part, docs, tokens, tree.root())] * (part is not None)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["part", "n_docs", "n_tokens", "root"])


_MANIFEST = "part int, n_docs bigint, n_tokens bigint, root binary"


def manifest_of(recipes: DataFrame) -> DataFrame:
    return recipes.select("part", "seq", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "seq").mapInArrow(_manifest, _MANIFEST)


#: Chunks are all different: no dictionary of them is tried.
_PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def write_store(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode all documents, append ``end`` to each, and write the store's three tables under ``path``."""
    schema = "doc_id bigint, n_tokens bigint, hashes array<binary>, root binary, fresh array<struct<hash:binary,payload:binary>>"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(vocabulary, end), schema)
    staged = shared_dir(docs.sparkSession, "tokenstore-staged")
    rows.write.options(**_PACKED).parquet(staged)
    staged = docs.sparkSession.read.schema(rows.schema).parquet(staged)
    # a batch names a chunk once, so little meets before the shuffle: one sort after it, and the first of each hash stays
    again = F.lag(F.lit(True)).over(Window.partitionBy("hash").orderBy("hash"))
    chunks = staged.select(F.inline("fresh")).withColumn("again", again).where("again IS NULL").drop("again")
    chunks.write.options(**_PACKED).parquet(f"{path}/chunks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged.drop("fresh").repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = ordered.mapInArrow(_number, "seq bigint, doc_id bigint, n_tokens bigint, local_start bigint, hashes array<binary>, root binary")
    numbered.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    manifest_of(docs.sparkSession.read.parquet(f"{path}/recipes")).coalesce(1).write.parquet(f"{path}/manifests")


# --- reading --------------------------------------------------------------------------------------------------------


def _check_chunks(item: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, payloads = strings(batch.column(0)), strings(batch.column(1))
            if any(digest(p) != h for h, p in zip(hashes, payloads, strict=True)):
                raise ValueError("a chunk does not match its address")
            crc = [zlib.crc32(np.frombuffer(p, f"<u{item}").astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // item for p in payloads], pa.int64()), pa.array(crc, pa.int64())], ["hash", "n", "crc"])

    return run


_ZEROS = bytes(4 * MOST)


def join_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two runs of bytes from those of each; ``length``: bytes of the second."""
    while length > len(_ZEROS):
        first, length = zlib.crc32(_ZEROS, first) ^ zlib.crc32(_ZEROS), length - len(_ZEROS)
    zeros = _ZEROS[:length]
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column("pieces")
        edges, each = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
        pos, lost = each.field("pos").to_numpy(), each.field("crc").null_count
        rows = np.repeat(np.arange(len(held)), np.diff(edges))
        order = pa.array(np.lexsort((pos, rows)))
        hashes = strings(each.field("hash").take(order))
        n, crc = (each.field(c).take(order).fill_null(0).to_numpy() for c in ("n", "crc"))
        right = np.add.reduceat(n, edges[:-1]) == batch.column("n_tokens").to_numpy() if len(held) else np.empty(0, bool)
        if lost or not right.all():
            raise ValueError(f"a document cannot be rebuilt from its recipe: {lost} pieces lost, {int((~right).sum())} lengths wrong")
        n, crc, roots, crcs = (4 * n).tolist(), crc.tolist(), strings(batch.column("root")), []
        for i, (start, stop) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
            if merkle_root(hashes[start:stop]) != roots[i]:
                raise ValueError(f"document {batch.column('doc_id')[i]} cannot be rebuilt from its recipe")
            crcs.append(reduce(lambda done, j: join_crc(done, crc[j], n[j]), range(start + 1, stop), crc[start]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")] + [pa.array(crcs, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str, item: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, rebuilt and checked from the store's files.

    ``item`` is the payload's bytes an id. Chunk payloads are read, checked and
    summed where they lie; only their checksums travel to the recipes.
    """
    recipes, manifests = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifests")
    # one row a part, however many documents
    sums, made = (t.toArrow().sort_by("part") for t in (manifests.select("part", "n_docs", "n_tokens", "root"), manifest_of(recipes)))
    if sums.to_pylist() != made.to_pylist():
        raise ValueError("recipes do not match their manifests")
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_check_chunks(item), "hash binary, n bigint, crc bigint")
    steps = recipes.select("part", "seq", F.posexplode("hashes").alias("pos", "hash")).join(chunks, "hash", "left")
    pieces = steps.groupBy("part", "seq").agg(F.collect_list(F.struct("pos", "hash", "n", "crc")).alias("pieces"))
    whole = recipes.select("part", "seq", "doc_id", "n_tokens", "local_start", "root").join(pieces, ["part", "seq"])
    rebuilt = whole.mapInArrow(_assemble, "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    before = dict(zip(sums.column("part").to_pylist(), np.concatenate(([0], np.cumsum(sums.column("n_tokens").to_numpy())))[:-1].tolist(), strict=True))
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, offset bigint")
    return rebuilt.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, item: int = 2) -> DataFrame:
    """(doc_id, ids array<int>) of each document, put together again from its chunks."""
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")

    @F.arrow_udf("array<int>")
    def joined(parts: pa.Array) -> pa.Array:
        rows = [np.frombuffer(b"".join(p["payload"] for p in sorted(x, key=lambda p: p["pos"])), f"<u{item}").astype(np.int32) for x in parts.to_pylist()]
        return pa.array(rows, pa.list_(pa.int32()))

    steps = recipes.select("part", "seq", "doc_id", F.posexplode("hashes").alias("pos", "hash")).join(chunks, "hash")
    return steps.groupBy("part", "seq", "doc_id").agg(F.collect_list(F.struct("pos", "payload")).alias("p")).select("doc_id", joined("p").alias("ids"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokenstore")
    write_store(documents(spark, sf_dir), path)
    return read_store(spark, path)
