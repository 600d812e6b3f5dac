"""Token ids in Simple-8b shard files.

Each 64-bit word has a 4-bit selector in its top bits and 60 bits of payload that hold as many of the next ids as fit at one
width; ids of more than 20 bits are escaped, one raw id a word. Ids are cut into blocks of ``BLOCK``, no word crosses a block,
and a shard keeps the word offset of every block, so blocks are encoded and decoded side by side with numpy and any
of them can be read alone.

Shard layout, little-endian: magic ``QS8B``, version, block size; numbers of documents, ids, blocks and words; doc_ids, null flags,
id offsets of documents (n + 1), word offsets of blocks (n + 1), words.

Documents go to shards in ascending order of doc_id (nulls first, ties by text) by a range partitioning; a task writes shards of
about ``SHARD_IDS`` ids, whatever the size of its partition. A shard's name is unique to the task attempt and only shards of finished
tasks are in the manifest, so a lost executor leaves an unlisted file at worst. Shards are in the shared folder, through the
file system that its address names.

Encoding: the text is cut where the tokenizer's own pre-tokenisation always cuts (before a space that follows a non-space,
around single newlines, between ASCII letters and punctuation), each different piece is encoded once by the library, and its ids
are gathered. Texts with non-ASCII white space or with ``<|`` go to the library whole.

Pieces are looked up by hash, and their bytes are compared with the text's. Should they differ, the library gets the whole texts.

Defined results: null text counts as empty; an empty text has the end id only. Null doc_ids sort first and stay null; rows that repeat a doc_id are
written each, in order of text. An empty table makes no shard and an empty result. A text of any length is one document of one shard. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import textcore as T
from .base import Scratch, new_path, slices, text_column

BLOCK, PART, SHARD_IDS = 1024, 256 << 10, 4 << 20
#: Tasks that read shards back, one a shard below that.
READERS = 10_000
#: Pieces that a worker keeps, their bytes, and those pieces that the library encodes at once.
MOST_PIECES, MOST_LETTERS, AT_ONCE = 600_000, 32 << 20, 8192
#: Ids in a word by selector; selector 13 is one id of up to 60 bits, the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = len(COUNTS) - 1
HEAD = "<4sIIQQQQ"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` and the word offsets of its blocks (n + 1), some blocks at a time."""
    words, blocks, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for at in range(0, len(ids), PART):
        w, o = _pack(ids[at : at + PART])
        words.append(w)
        blocks.append(o[1:] + base)
        base += len(w)
    return np.concatenate(words), np.concatenate(blocks)


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    bits = np.zeros(blocks * BLOCK, np.uint8)
    bits[:n] = np.frexp(np.maximum(ids, 1).astype(np.float64))[1]
    left = np.full(blocks, BLOCK)
    left[-1] = n - (blocks - 1) * BLOCK
    room = np.repeat(left, BLOCK) - np.tile(np.arange(BLOCK), blocks)  # ids from here to the end of the block
    best = np.full(len(bits), ESCAPE, np.uint8)
    widest, span = bits.copy(), 1  # widest[i] = most bits of ids i .. i + span - 1
    for s in range(ESCAPE - 1, -1, -1):
        count = int(COUNTS[s])
        while span * 2 <= count:
            widest[:-span] = np.maximum(widest[:-span], widest[span:])
            span *= 2
        most = widest.copy()
        if count > span:
            most[: -(count - span)] = np.maximum(most[: -(count - span)], widest[count - span :])
        best[(room >= count) & (most <= WIDTHS[s])] = s
    at, base, chosen = np.zeros(blocks, np.int64), np.arange(blocks) * BLOCK, []
    live = np.arange(blocks)
    while len(live):
        here = base[live] + at[live]
        chosen.append(here)
        at[live] += COUNTS[best[here]]
        live = live[at[live] < left[live]]
    begin = np.sort(np.concatenate(chosen))
    sel = best[begin]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        for j in range(COUNTS[s]):
            words[rows] |= ids[begin[rows] + j].astype(np.uint64) << np.uint64(j * WIDTHS[s])
    return words, np.searchsorted(begin, np.arange(blocks + 1) * BLOCK)


def unpack(words: np.ndarray) -> np.ndarray:
    """Ids of whole Simple-8b words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        begin, mask = ends[rows] - COUNTS[s], np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(COUNTS[s]):
            out[begin + j] = (words[rows] >> np.uint64(j * WIDTHS[s])) & mask
    return out.astype(np.uint32)


def shard_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks = pack(ids)
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = struct.pack(HEAD, b"QS8B", 1, BLOCK, len(doc_ids), len(ids), len(blocks) - 1, len(words))
    return b"".join([head, known.tobytes(), nulls.tobytes(), offs.tobytes(), blocks.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, id offsets of documents, ids) of a shard."""
    magic, version, _, docs, n, blocks, words = struct.unpack_from(HEAD, data)
    if magic != b"QS8B" or version != 1:
        raise ValueError("not a token shard of version 1")
    at = struct.calcsize(HEAD)
    known = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    offs = np.frombuffer(data, "<u8", docs + 1, at := at + docs).astype(np.int64)
    at += 8 * (docs + 1) + 8 * (blocks + 1)
    ids = unpack(np.frombuffer(data, "<u8", words, at))
    if len(ids) != n:
        raise ValueError("token shard is damaged")
    return [None if z else int(x) for x, z in zip(known.tolist(), nulls.tolist())], offs, ids


WS, LETTER, PUNCT = T.SPACE, np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
PUNCT[33:48] = PUNCT[58:65] = PUNCT[91:97] = PUNCT[123:127] = True
PUNCT[ord("'")] = False
ODD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"<|")


class Encoder:
    """Ids of texts by the ``tokenizers`` library, which sees each different piece once; kept per worker process."""

    _made: dict[str, Encoder] = {}
    #: Bytes in a text that send it to ``whole_ids``.
    ODD = ODD

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs tasks side by side; the library's own threads cost more time than they save
        self.library = Tokenizer.from_file(path)
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pieces_ids(self, pieces: list[bytes]) -> list:
        return [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def whole_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def borders(data: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Between ASCII letters and punctuation."""
        return (PUNCT[data] & LETTER[before]) | (LETTER[data] & PUNCT[before])

    def cuts(self, data: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Bytes before which texts are cut into pieces that are encoded alone."""
        line = (data == 10) & ~WS[before] & ~WS[after]
        cut = ((data == 32) & ~WS[before]) | line | self.borders(data, before)
        cut[1:] |= line[:-1]
        return cut

    def _reset(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted keys of pieces, and their places in start and size
        self.start, self.size, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self.begin, self.length, self.text, self.letters = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint8), 0  # the pieces' own bytes

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds pieces of ascending new keys."""
        n = len(self.keys)
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces[at : at + AT_ONCE]
            got = self.pieces_ids(part)
            first, stop = n + at, n + at + len(part)
            self.start, self.size, self.begin, self.length = (self._grown(a, stop) for a in (self.start, self.size, self.begin, self.length))
            for lists, begin, length, held, used, flat in (
                (got, self.start, self.size, "ids", "used", np.fromiter(itertools.chain.from_iterable(got), np.uint32)),
                (part, self.begin, self.length, "text", "letters", np.frombuffer(b"".join(part), np.uint8)),
            ):
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                base = getattr(self, used)
                setattr(self, held, self._grown(getattr(self, held), base + len(flat)))
                getattr(self, held)[base : base + len(flat)] = flat
                begin[first:stop], length[first:stop] = base + np.cumsum(size) - size, size
                setattr(self, used, base + len(flat))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, where, keys), np.insert(self.place, where, np.arange(n, n + len(keys)))

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> bool:
        """Whether the spans, which cover ``data``, have the bytes of the pieces that their hashes name."""
        size = self.length[piece]
        return bool((size == ends - starts).all()) and bool((self.text[np.repeat(self.begin[piece] - starts, size) + np.arange(len(data))] == data).all())

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each key among the known ones, and whether it is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _pieces(self, col: pa.Array, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], bytes]:
        """Starts of the pieces of all rows, their places in start and size, the rows that the library must encode whole, and the bytes."""
        raw = data.tobytes()
        before = np.concatenate([data[:1], data[:-1]])
        after = np.concatenate([data[1:], data[-1:]])
        cut = self.cuts(data, before, after)
        cut[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = T.span_hash(data, starts, ends)
        if len(self.keys) > MOST_PIECES or self.letters > MOST_LETTERS:
            self._reset()
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(~self._known(distinct)[1])
        if len(fresh):
            spans = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())
            self._learn(distinct[fresh], [raw[a:b] for a, b in spans])
        piece = self.place[self._known(distinct)[0]][inverse]
        odd = [i for i in range(len(col)) if any(x in raw[offs[i] : offs[i + 1]] for x in self.ODD)] if any(x in raw for x in self.ODD) else []
        if not self._same(data, starts, ends, piece):  # two pieces share a hash: the library encodes the whole texts
            odd = list(range(len(col)))
        return starts, piece, odd, raw

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a large_string column without nulls, and the number of each row's."""
        data, offs = T.flat(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        starts, piece, odd, raw = self._pieces(col, data, offs)
        size = self.size[piece]
        stops = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[piece] - (stops - size), size) + np.arange(stops[-1])]
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, offs)]
        if not odd:
            return ids, np.diff(bounds)
        rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in odd:
            rows[i] = self.whole_ids(raw[offs[i] : offs[i + 1]].decode())
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def sizes(self, col: pa.Array) -> np.ndarray:
        """The number of ids of each row, as ``encode`` gives it; the ids themselves are not put together."""
        data, offs = T.flat(col)
        if not len(data):
            return np.zeros(len(col), np.int64)
        starts, piece, odd, raw = self._pieces(col, data, offs)
        out = np.diff(np.concatenate([[0], np.cumsum(self.size[piece])])[np.searchsorted(starts, offs)])
        for i in odd:
            out[i] = len(self.whole_ids(raw[offs[i] : offs[i + 1]].decode()))
        return out


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs(doc_id, text)`` to shards in ``folder``: manifest (part, k, path, n_docs, n_ids) in order of (part, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, held = Encoder.of(tokenizer), TaskContext.get().partitionId(), []

        def flush(k: int) -> pa.RecordBatch:
            doc_ids = [x for d, _, _ in held for x in d]
            sizes, ids = np.concatenate([s for _, s, _ in held]), np.concatenate([i for _, _, i in held])
            held.clear()
            path = f"{folder}/part-{part:06d}-{k:04d}-{uuid.uuid4().hex}.qs8b"
            fs, name = _file_system(path)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(shard_bytes(doc_ids, sizes, ids))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([path]), pa.array([len(doc_ids)]), pa.array([len(ids)])], names=["part", "k", "path", "n_docs", "n_ids"])

        k = n = 0
        for whole in batches:
            for b in slices(whole, "text"):
                ids, size = encoder.encode(text_column(b, "text"))
                at = np.cumsum(size)
                held.append((b.column(0).to_pylist(), size + 1, np.insert(ids, at, end_id).astype(np.uint32)))
                n += len(ids)
                if n >= SHARD_IDS:
                    yield flush(k)
                    k, n = k + 1, 0
        if held:
            yield flush(k)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part long, k long, path string, n_docs long, n_ids long")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = _file_system(path)
                with fs.open_input_stream(name) as f:
                    doc_ids, offs, ids = read_shard(f.read())
                ids, bounds = ids.astype("<u4"), offs.tolist()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(offs[:-1] + before), pa.array(np.diff(offs)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A running sum over one row a shard of some four million ids.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.count()
    spread = manifest.select("path", before.alias("before")).repartition(max(1, min(shards, READERS)))  # round robin, a fixed number that AQE keeps
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_count(tokenizer: str, text: str = "text"):
    """Column: the number of ids of a text, the end id not among them."""

    @F.arrow_udf(LongType())
    def run(texts: pa.Array) -> pa.Array:
        encoder, batch = Encoder.of(tokenizer), pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(encoder.sizes(text_column(b, "text")) for b in slices(batch, "text"))]).astype(np.int64))

    return run(text)


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as byte-level BPE ids in shards, read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = Scratch(spark, "tokens").table(write_shards(docs, tokenizer, new_path(spark, "shards")), "manifest")
    return read_documents(manifest)
