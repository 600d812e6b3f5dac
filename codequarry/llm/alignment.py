"""Alignment of the tokens of two tokenizers over the bytes of each text.

Both tokenizers see a text with a space before it: a byte-level BPE (A) and a SentencePiece model (B, which adds the space itself). For each batch of texts,
``merge_asof``, keyed by document, finds for every token start the token of the other side that covers it; the union of both directions is all overlapping pairs, since of
two overlapping tokens the later start lies in the other. Overlapping tokens that end together are *linked*, and their ends cut the tokens into *groups*.

Corpus-wide counts of linked id pairs: texts are gathered in blocks of ``BLOCK`` bytes (a longer text is one alone). A block names its different pairs once, with
their numbers, and its documents name pairs by their place in that list. So counting, ranking and the way back move one row per block and different pair
through the shuffles, not one per link; counts come back to their blocks in a join on the block. What is broadcast has one row per id of B at most.

Each different piece of text goes to the libraries once per worker; pieces are cut where they always cut.

Defined results: texts that are null or empty, or whose joined token bytes on either side differ from the text with its space, have no tokens (all numbers 0, groups '').
Null doc_ids and repeated rows are aligned each, and each counts. An empty table gives an empty result. Only the columns named by ``keep`` are returned; others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .base import Scratch, fresh_names, slices, text_column
from .bpe import Decoder
from .token_files import ODD, Encoder

#: Bytes of the texts of a block and of those that are aligned at once; shift of A's id in the code of a pair.
BLOCK, SLICE, SHIFT = 8 << 20, 1 << 19, 32
SPACE = "▁"


class ByteSide(Encoder):
    """A: ids of a byte-level BPE, strings of special tokens as plain text."""

    _made: dict[str, ByteSide] = {}
    ODD = tuple(x for x in ODD if x != b"<|")

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        flat, offs, spaced = Decoder._table(path)
        if spaced:
            raise ValueError("not a byte-level tokenizer")
        self.bytes = flat, offs


class PieceSide(Encoder):
    """B: ids of a SentencePiece model that puts a space before the text; a piece holds spaces at its begin only."""

    _made: dict[str, PieceSide] = {}
    ODD = (SPACE.encode(),)

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self._reset()
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces go over word ends")
        shown = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def pieces_ids(self, pieces: list[bytes]) -> list:
        found = self.library.encode([p[1:].decode() for p in pieces], num_threads=1)
        return [x if p != b" " else [self.library.piece_to_id(SPACE)] for x, p in zip(found, pieces)]  # of an empty text the library makes nothing

    def whole_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text[1:]), np.uint32)

    def cuts(self, data: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return (data == 32) & (before != 32)


@dataclass
class Aligned:
    """Tokens of consecutive rows on both sides. Rows have ``count_a`` and ``count_b`` tokens; ``pairs_a`` and ``pairs_b`` are the overlapping ones and ``linked`` tells whether
    they end together; group k of all ends before token ``group_a[k]`` of A and ``group_b[k]`` of B, and ``groups`` counts those of each row."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    count_a: np.ndarray
    count_b: np.ndarray
    pairs_a: np.ndarray
    pairs_b: np.ndarray
    linked: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: np.ndarray


def _sizes(side: Encoder, ids: np.ndarray) -> np.ndarray:
    offs = side.bytes[1]
    return offs[ids + 1] - offs[ids]


def _true_rows(side: Encoder, ids: np.ndarray, count: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of each row's tokens are those of the text."""
    flat, begin = side.bytes
    size = _sizes(side, ids)
    stops = np.cumsum(size)
    ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(count)])]
    good = np.diff(ends) == np.diff(offs)
    if not good.all():  # compare the rows of right length alone
        keep = np.repeat(good, count)
        ids, size = ids[keep], size[keep]
        stops = np.cumsum(size)
        data = data[np.repeat(good, np.diff(offs))]
    shown = flat[np.repeat(begin[ids] - (stops - size), size) + np.arange(len(data))]
    if not (shown == data).all():
        at = np.flatnonzero(good)
        n = np.diff(offs)[at]
        wrong = np.add.reduceat(np.append(shown != data, False), np.cumsum(n) - n) > 0
        good[at[wrong]] = False
    return good


def _covering(starts: np.ndarray, rows: np.ndarray, other: np.ndarray, other_rows: np.ndarray) -> np.ndarray:
    """For every token start the token of the other side, of the same row, that covers it."""
    left = pd.DataFrame({"at": starts, "row": rows})
    right = pd.DataFrame({"at": other, "row": other_rows, "token": np.arange(len(other))})
    return pd.merge_asof(left, right, on="at", by="row", direction="backward")["token"].to_numpy(np.int64)


def align_texts(a: ByteSide, b: PieceSide, texts: pa.Array) -> Aligned:
    """The tokens of all rows of a large_string column without nulls, aligned."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    data, offs = T.flat(spaced)
    (ids_a, count_a), (ids_b, count_b) = a.encode(spaced), b.encode(spaced)
    ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
    good = (np.diff(offs) > 1) & _true_rows(a, ids_a, count_a, data, offs) & _true_rows(b, ids_b, count_b, data, offs)
    ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
    count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
    rows = np.arange(len(good))
    row_a, row_b = np.repeat(rows, count_a), np.repeat(rows, count_b)
    end_a, end_b = np.cumsum(_sizes(a, ids_a)), np.cumsum(_sizes(b, ids_b))
    start_a, start_b = end_a - _sizes(a, ids_a), end_b - _sizes(b, ids_b)
    in_b, in_a = _covering(start_a, row_a, start_b, row_b), _covering(start_b, row_b, start_a, row_a)
    fresh = np.flatnonzero(start_a[in_a] != start_b)  # pairs that start together came from the other direction
    pairs_a, pairs_b = np.concatenate([np.arange(len(ids_a)), in_a[fresh]]), np.concatenate([in_b, fresh])
    order = np.argsort(pairs_a + pairs_b, kind="stable")  # a later overlap has a later token on one side at least
    pairs_a, pairs_b = pairs_a[order], pairs_b[order]
    linked = end_a[pairs_a] == end_b[pairs_b]
    group_a, group_b = pairs_a[linked] + 1, pairs_b[linked] + 1
    return Aligned(ids_a, ids_b, count_a, count_b, pairs_a, pairs_b, linked, group_a, group_b, np.bincount(row_a[group_a - 1], minlength=len(good)))


_DIGITS: list[tuple[np.ndarray, np.ndarray]] = []


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n at least, and their offsets."""
    if not _DIGITS or len(_DIGITS[0][1]) <= n:
        shown = [str(i).encode() for i in range(max(n, 1 << 16))]
        _DIGITS[:] = [(np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])]))]
    return _DIGITS[0]


def listed(x: Aligned) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for every row: ids of A and B, group by group."""
    n = len(x.ids_a) + len(x.ids_b)
    size_a, size_b = np.diff(x.group_a, prepend=0), np.diff(x.group_b, prepend=0)
    ids, mark, row = np.empty(n, np.int64), np.full(n, ord(","), np.uint8), np.empty(n, np.int64)
    at_a = np.arange(len(x.ids_a)) + np.repeat(x.group_b - size_b, size_a)
    at_b = np.arange(len(x.ids_b)) + np.repeat(x.group_a, size_b)
    ids[at_a], ids[at_b] = x.ids_a, x.ids_b
    mark[x.group_a - 1 + x.group_b - size_b] = ord("|")
    mark[x.group_b - 1 + x.group_a] = ord(";")
    flat, offs = _digits(int(ids.max(initial=0)) + 1)
    size = offs[ids + 1] - offs[ids] + 1
    stops = np.cumsum(size)
    out = np.empty(stops[-1] if n else 0, np.uint8)
    text = np.ones(len(out), bool)
    text[stops - 1] = False
    out[stops - 1] = mark
    size = size - 1
    text_stops = np.cumsum(size)
    out[text] = flat[np.repeat(offs[ids] - (text_stops - size), size) + np.arange(text_stops[-1] if n else 0)]
    per = x.count_a + x.count_b
    ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(per)])]
    last = np.ones(len(out), bool)
    last[ends[1:][per > 0] - 1] = False  # no mark after the last token of a row
    bounds = ends - np.concatenate([[0], np.cumsum(per > 0)])
    return pa.LargeStringArray.from_buffers(len(per), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[last]))


def _list(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), values)


def align(docs: DataFrame, byte_bpe: str, pieces: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with a_ids, b_ids, overlaps (places of an A and a B token that share bytes, and whether they end together) and groups of each text."""
    rows = docs.select(*keep, F.col(text).alias("\0text"))
    fresh_names(rows, "a_ids", "b_ids", "overlaps", "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteSide.of(byte_bpe), PieceSide.of(pieces)
        for whole in batches:
            for part in slices(whole, "\0text"):
                x = align_texts(a, b, text_column(part, "\0text"))
                first_a, first_b = np.cumsum(x.count_a) - x.count_a, np.cumsum(x.count_b) - x.count_b
                row = np.repeat(np.arange(part.num_rows), x.count_a)[x.pairs_a]
                pairs = pa.StructArray.from_arrays([pa.array((x.pairs_a - first_a[row]).astype(np.int32)), pa.array((x.pairs_b - first_b[row]).astype(np.int32)), pa.array(x.linked)], names=["a", "b", "linked"])
                more = [_list(pa.array(x.ids_a.astype(np.int32)), x.count_a), _list(pa.array(x.ids_b.astype(np.int32)), x.count_b), _list(pairs, np.bincount(row, minlength=part.num_rows)), listed(x).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], "a_ids", "b_ids", "overlaps", "groups"])

    made = ", ".join(["a_ids array<int>", "b_ids array<int>", "overlaps array<struct<a:int,b:int,linked:boolean>>", "groups string"])
    schema = rows.drop("\0text").schema
    for f in docs.sparkSession.createDataFrame([], made).schema:
        schema.add(f)
    return rows.mapInArrow(run, schema)


class _Pairs:
    """The different pairs of a block, in order of arrival, with their numbers."""

    def __init__(self):
        self.pairs = self.place = self.counts = np.zeros(0, np.int64)  # sorted pairs, the place of each, and the number of each place

    def places(self, pairs: np.ndarray) -> np.ndarray:
        distinct, inverse, n = np.unique(pairs, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.pairs, distinct)
        there = at < len(self.pairs)
        there[there] = self.pairs[at[there]] == distinct[there]
        place = np.empty(len(distinct), np.int64)
        place[there] = self.place[at[there]]
        place[~there] = len(self.pairs) + np.arange(len(distinct) - there.sum())
        self.pairs, self.place = np.insert(self.pairs, at[~there], distinct[~there]), np.insert(self.place, at[~there], place[~there])
        self.counts = np.concatenate([self.counts, np.zeros(len(self.pairs) - len(self.counts), np.int64)])
        self.counts[place] += n
        return place[inverse]

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(self.pairs), np.int64)
        out[self.place] = self.pairs
        return out, self.counts


def _blocks(docs: DataFrame, byte_bpe: str, pieces: str) -> DataFrame:
    """A row per document, with its links as places in the list of pairs of its block, and one per block that holds the list and the pairs' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteSide.of(byte_bpe), PieceSide.of(pieces)
        names = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "pairs", "counts"]
        longs, block, size, known = pa.list_(pa.int64()), TaskContext.get().partitionId() << 32, 0, _Pairs()

        def ends() -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            pairs, counts = known.listed()
            return pa.RecordBatch.from_arrays([pa.array([block]), *none, pa.array([pairs], longs), pa.array([counts], longs)], names=names)

        for whole in batches:
            for part in slices(whole, "text", SLICE):
                texts, n = text_column(part, "text"), part.num_rows
                x = align_texts(a, b, texts)
                at = np.flatnonzero(x.linked)
                places = known.places((x.ids_a[x.pairs_a[at]] << SHIFT) | x.ids_b[x.pairs_b[at]]).astype("<i4")
                offs = pa.py_buffer(np.concatenate([[0], np.cumsum(x.groups * 4)]).astype(np.int32))
                links = pa.Array.from_buffers(pa.binary(), n, [None, offs, pa.py_buffer(places.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), part.column(0), pa.array(x.count_a), pa.array(x.count_b), pa.array(x.groups), listed(x).cast(pa.string()), links, pa.nulls(n, longs), pa.nulls(n, longs)], names=names)
                size += len(T.flat(texts)[0])
                if size >= BLOCK:
                    yield ends()
                    block, size, known = block + 1, 0, _Pairs()
        if size or len(known.pairs):
            yield ends()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = rows.mapInArrow(run, "block long, doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, pairs array<long>, counts array<long>")
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return found.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256")


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links, given the counts of its pairs."""
    place = right["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
    links = [np.frombuffer(x, "<i4") for x in left["links"].to_pylist()]
    out = left.drop_columns(["block", "links"])
    out = out.append_column("n_best", pa.array([int(best[x].sum()) for x in links], pa.int64()))
    return out.append_column("count_sum", pa.array([int(count[x].sum()) for x in links], pa.int64()))


def link_counts(docs: DataFrame, byte_bpe: str, pieces: str) -> tuple[DataFrame, DataFrame]:
    """(documents, counts): n_a, n_b, n_groups, groups_sha256, n_best and count_sum of every row of ``docs(doc_id, text)``; and (a, b, count, best) of every linked
    id pair, with whether no other pair of its B id has a higher count. Written tables, which stay until ``base.clear``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    table = scratch.table(_blocks(docs, byte_bpe, pieces), "blocks")
    pairs = table.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counts = scratch.table(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # a row per id of B at most: bounded by the vocabulary
    ranked = counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.join(ranked, "pair").select(F.col("block").alias("of"), "place", "count", F.col("best").cast("long").alias("best"))
    done = table.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    done = done.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    return done, ranked.select(F.shiftrightunsigned("pair", SHIFT).alias("a"), "b", "count", "best")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, byte_bpe: str | None = None, pieces: str | None = None) -> DataFrame:
    """Every document under byte-level BPE and SentencePiece, aligned. Linked tokens end a group, so a document has as many links as groups."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done, _ = link_counts(docs, byte_bpe or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
