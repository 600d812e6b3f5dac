"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Text is escaped as the model file says (a space becomes U+2581, one is put before the text) and cut before each run of U+2581
that follows another character; no piece of a vocabulary crosses such a cut (checked when the model is read). Different words
are segmented once a worker: words of equal length advance together, the hashes of all their substrings ending at a position probe the
sorted hashes of the pieces, and vectorised maxima keep the best score and a backpointer. On equal scores the longer last piece wins.
A character that no piece covers costs ten less than the lowest score and becomes its UTF-8 byte pieces.

The segmentation is the one of the highest summed score (tested against a plain dynamic program). The shipped file is of type BPE: its scores
are merge ranks and the library merges pairs instead of maximising a sum, so its ids differ for many words (see the README).

Defined results: null text counts as empty and has no ids; decoding gives back every text exactly. Rows that repeat, and those with a null
doc_id, are encoded each; an empty table gives an empty result. A word of n letters (a text without spaces is one) takes n steps one after
the other, some 0.2 milliseconds each when it is alone of its length. ``encode`` adds the column ``ids`` and refuses input that has it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .base import fresh_names, slices, text_column

SPACE = "▁"
FIRST = np.uint64(0xD6E8FEB86659FD93)
MOST_WORDS = 1_000_000
#: Code points of words of one length that are segmented side by side.
AT_ONCE = 1 << 20


class Pieces:
    """Vocabulary of a SentencePiece model file: sorted piece keys with scores, byte pieces, and a store of segmented words."""

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces or model.normalizer_spec.name != "identity":
            raise ValueError("only models with the identity normaliser and a dummy prefix")
        self._load([(p.piece, p.score, p.type) for p in model.pieces])

    def _load(self, pieces: list[tuple[str, float, int]]) -> None:
        usable = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (1, 4)]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in usable):
            raise ValueError("a piece crosses a word boundary")
        size = np.array([len(p) for _, p, _ in usable])
        points = np.zeros((int(size.max()), len(usable)), np.uint64)
        for k, (_, p, _) in enumerate(usable):
            points[: len(p), k] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        keys = np.zeros(len(usable), np.uint64)
        for j in range(len(points)):
            keys = np.where(size > j, self._longer(keys, points[j]), keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _, _ in usable])[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.scores = np.array([s for _, _, s in usable], np.float32)[order]
        self.longest, self.unknown = int(size.max()), np.float32(self.scores.min() - 10)
        self.bytes = np.zeros(256, np.int64)
        shown = [b""] * len(pieces)
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                self.bytes[int(p[3:5], 16)], shown[i] = i, bytes([int(p[3:5], 16)])
            elif t in (1, 4):
                shown[i] = p.replace(SPACE, " ").encode()
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.known: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _longer(key: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Hash of a string from that of all but its last code point."""
        with np.errstate(over="ignore"):
            return T.mix(key * np.uint64(0x9E3779B97F4A7C15) + point)

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, escaped: those of equal length side by side, ``AT_ONCE`` code points at most together.

        From each place of a word the substrings that begin there are probed, shortest first, and improve the places where they end.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        size = np.array([len(w) for w in words])
        for n in np.unique(size).tolist():
            if n == 0:
                continue
            rows = np.flatnonzero(size == n)
            per = max(1, AT_ONCE // n)
            for at in range(0, len(rows), per):
                some = rows[at : at + per]
                for i, ids in zip(some.tolist(), self._together([words[i] for i in some], n)):
                    out[i] = ids
        return out

    def _together(self, words: list[str], n: int) -> list[np.ndarray]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
        best = np.full((n + 1, len(words)), -np.inf, np.float32)
        back, piece = np.zeros((n + 1, len(words)), np.int8), np.full((n + 1, len(words)), -1, np.int32)
        best[0] = 0
        for start in range(n):
            key = np.zeros(len(words), np.uint64)
            for length in range(1, min(self.longest, n - start) + 1):
                key, end = self._longer(key, points[start + length - 1]), start + length
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                score = np.where(hit, self.scores[at], self.unknown if length == 1 else np.float32(-np.inf)) + best[start]
                better = score > best[end]  # longer last pieces came first
                best[end] = np.where(better, score, best[end])
                back[end] = np.where(better, length, back[end])
                piece[end] = np.where(better, np.where(hit, self.ids[at], -1), piece[end])
        out = []
        for k, word in enumerate(words):
            ids, end = [], n
            while end > 0:
                length = int(back[end, k])
                if piece[end, k] >= 0:
                    ids.append(int(piece[end, k]))
                else:
                    ids.extend(reversed([int(self.bytes[b]) for b in word[end - length : end].encode()]))
                end -= length
            out.append(np.array(ids[::-1], np.int64))
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a large_string column without nulls, and the number of each row's.

        Words are looked up by hash, so the ids are decoded and compared with the text; rows that differ are segmented word by word without the store.
        """
        ids, size = self._encode(col)
        data, offs = T.flat(col)
        shown, bounds = self._bytes(ids, size)
        begin, end = bounds[:-1], bounds[1:]
        begin = np.minimum(begin + 1, end)  # the space put before the text
        if len(shown) - int((begin - bounds[:-1]).sum()) == len(data) and (end - begin == np.diff(offs)).all():
            keep = np.ones(len(shown), bool)
            keep[bounds[:-1][end > bounds[:-1]]] = False
            if (shown[keep] == data).all():
                return ids, size
        rows = [ids[a:b] for a, b in zip(np.cumsum(size) - size, np.cumsum(size))]
        for i, text in enumerate(col.to_pylist()):
            if shown[begin[i] : end[i]].tobytes() != text.encode():
                rows[i] = np.concatenate(self.segment([w.replace(" ", SPACE) for w in re.findall(" +[^ ]*|[^ ]+", " " + text)]))
        return np.concatenate(rows), np.array([len(r) for r in rows])

    def _encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = T.flat(col)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(col), np.int64)
        cut = data == 32
        cut[1:] &= data[:-1] != 32
        first = offs[:-1][np.diff(offs) > 0]
        cut[first] = True
        starts = np.flatnonzero(cut)
        keys = T.span_hash(data, starts, np.append(starts[1:], len(data)))
        head = np.searchsorted(starts, first)
        keys[head] ^= FIRST
        raw, ends = data.tobytes(), np.append(starts[1:], len(data))
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        listed, heads = distinct.tolist(), set(head.tolist())
        fresh = [i for i, k in enumerate(listed) if k not in self.known]
        if fresh:
            words = [(" " if at[i] in heads else "") + raw[starts[at[i]] : ends[at[i]]].decode() for i in fresh]
            self.known.update(zip((listed[i] for i in fresh), self.segment([w.replace(" ", SPACE) for w in words])))
        lists = [self.known[k] for k in listed]
        size = np.array([len(x) for x in lists])
        store, begin = np.concatenate(lists), np.cumsum(size) - size
        n = size[inverse]
        stops = np.cumsum(n)
        ids = store[np.repeat(begin[inverse] - (stops - n), n) + np.arange(stops[-1])]
        return ids, np.diff(np.concatenate([[0], stops])[np.searchsorted(starts, offs)])

    def _bytes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive rows of ``ids`` and the n + 1 row offsets into them."""
        n = self.offs[ids + 1] - self.offs[ids]
        stops = np.cumsum(n)
        flat = self.flat[np.repeat(self.offs[ids] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]
        return flat, np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive rows of ``ids``."""
        flat, bounds = self._bytes(ids, sizes)
        flat = flat.tobytes()
        return [flat[a + 1 : b].decode() if b > a else "" for a, b in itertools.pairwise(bounds.tolist())]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``ids``, the pieces of ``text``; all other columns pass through."""
    from pyspark.sql.types import StructType

    fresh_names(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for whole in batches:
            for b in slices(whole, "text"):
                ids, size = pieces.encode(text_column(b, "text"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("ids array<int>").fields]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """All documents encoded and decoded: number and crc32 of the ids, and whether decoding gave the text back."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for whole in batches:
            for b in slices(whole, "text"):
                col = text_column(b, "text")
                ids, size = pieces.encode(col)
                same = [x == y for x, y in zip(pieces.decode(ids, size), col.to_pylist())]
                flat, bounds = ids.astype("<u4"), np.concatenate([[0], np.cumsum(size)]).tolist()
                crc = [zlib.crc32(flat[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
