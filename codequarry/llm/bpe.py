"""BPE ids by a bounded-lookahead streaming transducer, and text from ids by an incremental machine.

The merges of a word go by rank. A merge (x, y) at a place can be forestalled from its right only by an earlier merge that takes a right end of y; that one
again only by a still earlier one, and so on. The ranks of such a chain fall, so its length in symbols is bounded; the longest one, found by one pass over the merge list, is
the list's sufficient lookahead: whether a token ends at a place depends on what lies to the left, and on that many symbols to the right. The transducer
merges a window of symbols, emits the tokens whose ends have their lookahead inside it, and goes on behind the last of them; it holds one window, however long the
word is. Words that fit into a window at once are merged side by side with numpy, the least rank of every word in each step.

This holds for merge lists in which parts are made before wholes, which ``Merges`` checks.

Normalisation and the cut into words are those that the tokenizer's file names, applied by its library to each different chunk of text once; chunks are
cut where these always cut: before a run of ASCII white space, and between ASCII letters and punctuation. Strings of special tokens in a text
are these tokens, as in the library. ``Decoder`` keeps the bytes of a character that isn't whole yet, so ids can be given in any portions.

Defined results: null text counts as empty and has no ids; ids outside the vocabulary are left out by ``decode``. Null doc_ids and repeated rows are encoded
each; an empty table gives an empty result. Only the columns named by ``keep`` are returned, so other columns can have any name.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .base import fresh_names, slices, text_column
from .token_files import Encoder

#: Symbols up to which words are merged side by side; symbols of a window of the transducer, at least; ids that are decoded at once.
SHORT, WINDOW, PORTION = 48, 4096, 1 << 16
#: Ids of a returned batch.
BATCH_IDS = 1 << 20
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = itertools.count(0x100)
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class Merges:
    """A merge list with its sufficient ``lookahead`` and ``longest`` token, both in symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        self.suffix = suffix or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        made, ends, reach = {}, {}, {}  # rank that makes a token; tokens that can stand at its right end; farthest chain that begins with it on the left
        plain = lambda t: t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
        self.lookahead, self.longest = 0, max(len(plain(t)) for t in vocabulary)
        for rank, (x, y) in enumerate(merges):
            if any(len(plain(t)) > 1 and t not in made for t in (x, y)) or x + y in made:
                raise ValueError(f"merge {rank} uses a token before it is made, or makes one again")
            made[x + y] = rank
            tail = ends.get(y, (y,))
            ends[x + y] = (x + y, *tail)
            far = len(plain(y)) + max(reach.get(t, 0) for t in tail)
            reach[x] = max(reach.get(x, 0), far)
            self.lookahead = max(self.lookahead, far)
            self.pairs[vocabulary[x], vocabulary[y]] = rank, vocabulary[x + y]
        self.width = max(vocabulary.values()) + 1
        keys = np.array([x * self.width + y for x, y in self.pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.pairs.values()] or [0], np.int64)[order]
        self.made = np.array([t for _, t in self.pairs.values()] or [0], np.int64)  # by rank

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.width + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of one window and the symbols of each, by a heap of (rank, place)."""
        token, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        pairs, n = self.pairs, len(symbols)
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (token[i], token[j]) != pair:
                continue
            token[i], token[j] = pairs[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (token[i], token[k])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (token[h], token[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], h, p))
        live = [i for i in range(n) if token[i] >= 0]
        return [token[i] for i in live], [after[i] - i for i in live]

    def stream(self, portions: Iterable[list[int]], window: int = 0) -> Iterator[int]:
        """Tokens of a word whose symbols come in portions, each as soon as it is stable."""
        window = max(window or WINDOW, self.lookahead + self.longest)
        held: list[int] = []
        for portion in portions:
            for at in range(0, len(portion), window):
                held += portion[at : at + window]
                if len(held) < window:
                    continue
                done = 0
                for token, size in zip(*self.merge(held)):
                    if done + size + self.lookahead > len(held):
                        break
                    yield token
                    done += size
                held = held[done:]
        yield from self.merge(held)[0]

    def side_by_side(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many short words, and the number of each word's."""
        out, place = np.array(symbols, np.int64), np.arange(len(symbols))
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_tokens, done_words, done_places = [], [], []
        rank = np.full(len(out), NONE)
        if len(out):
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(out[:-1], out[1:]), NONE)
        while len(out):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(out)))
            if (least == NONE).any():
                rest = np.repeat(least == NONE, size)
                done_tokens.append(out[rest]), done_words.append(word[rest]), done_places.append(place[rest])
                out, word, place, rank = out[~rest], word[~rest], place[~rest], rank[~rest]
                least, size = least[least != NONE], size[least != NONE]
                if not len(out):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)  # in a run of equal pairs, the first, third, ...
            hit = hit[(hit - np.repeat(hit[run], np.diff(np.append(run, len(hit))))) % 2 == 0]
            out[hit] = self.made[rank[hit]]
            keep = np.ones(len(out), bool)
            keep[hit + 1] = False
            out, word, place, rank = out[keep], word[keep], place[keep], rank[keep]
            at = np.cumsum(keep)[hit] - 1
            for i in (at, at[at > 0] - 1):
                j = np.minimum(i + 1, len(out) - 1)
                rank[i] = np.where((word[i] == word[j]) & (i < j), self.rank(out[i], out[j]), NONE)
        tokens, place = np.concatenate([np.zeros(0, np.int64), *done_tokens]), np.concatenate([np.zeros(0, np.int64), *done_places])
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *done_words]), minlength=len(sizes))
        return tokens[np.argsort(place)], count

    def tokens(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and the number of each word's: short words side by side, others by the transducer."""
        long = np.flatnonzero(sizes > SHORT)
        if not len(long):
            return self.side_by_side(symbols, sizes)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        short = np.repeat(sizes <= SHORT, sizes)
        tokens, count = self.side_by_side(symbols[short], np.where(sizes <= SHORT, sizes, 0))
        rows = dict(zip(long.tolist(), (np.fromiter(self.stream([symbols[offs[i] : offs[i + 1]].tolist()]), np.int64) for i in long.tolist())))
        ends = np.cumsum(count)
        parts, at = [], 0
        for i, row in rows.items():
            parts += [tokens[at : ends[i]], row]
            at = ends[i]
            count[i] = len(row)
        return np.concatenate([*parts, tokens[at:]]), count


class StreamEncoder(Encoder):
    """Ids of texts; each different chunk is normalised, cut into words and merged once."""

    _made: dict[str, StreamEncoder] = {}
    ODD = (b"<|",)

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE model of plain merges")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix"))
        self.first, self.last = (np.full(0x200, -1, np.int64) for _ in range(2))
        for c in byte_letters():
            self.first[ord(c)], self.last[ord(c)] = model["vocab"][c], model["vocab"][c + self.merges.suffix]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(not c.startswith("<|") or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for c, t in zip(special, spec["added_tokens"])):
            raise ValueError("special tokens of another form")
        self.special = special
        self.parts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, in letters that stand for bytes."""
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols, ends = self.first[letters], np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[letters[ends]]
        return self.merges.tokens(symbols, sizes)

    def pieces_ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        words = [self.words(p.decode()) for p in pieces]
        tokens, count = self.merged(list(itertools.chain.from_iterable(words)))
        at = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum([len(w) for w in words])])].tolist()
        return [tokens[a:b] for a, b in zip(at[:-1], at[1:])]

    def whole_ids(self, text: str) -> np.ndarray:
        """Ids of a text that may hold special tokens."""
        parts = self.parts.split(text) if self.parts else [text]
        return np.concatenate([np.array([self.special[p]]) if p in self.special else self.merged(self.words(p))[0] for p in parts]).astype(np.uint32)

    def cuts(self, data: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        space = T.SPACE
        return (space[data] & ~space[before]) | self.borders(data, before)


class Decoder:
    """Text of ids that come in portions; bytes of a character that isn't whole yet wait for the next portion.

    With a byte-level decoder in the tokenizer's file a token stands for its bytes, and bytes that are no text give U+FFFD; without a decoder tokens are
    joined by spaces, as the library does.
    """

    _tables: dict[str, tuple[np.ndarray, np.ndarray, bool]] = {}

    def __init__(self, path: str):
        if path not in self._tables:
            self._tables[path] = self._table(path)
        self.flat, self.offs, self.spaced = self._tables[path]
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    @staticmethod
    def _table(path: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Bytes of all tokens and their offsets (a space before each, if they are joined by spaces)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not known")
        known = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_letters())}
        of = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            raw = bytes(byte[c] for c in token) if kind and all(c in byte for c in token) else token.encode()
            of[i] = raw if kind else b" " + raw
        return np.frombuffer(b"".join(of), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in of])]), kind is None

    def push(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.offs) - 1)].astype(np.int64)
        size = self.offs[ids + 1] - self.offs[ids]
        stops = np.cumsum(size)
        raw = self.flat[np.repeat(self.offs[ids] - (stops - size), size) + np.arange(stops[-1] if len(ids) else 0)].tobytes()
        if self.spaced and not self.begun and raw:
            raw, self.begun = raw[1:], True
        return self.machine.decode(raw)

    def finish(self) -> str:
        """What is left, and a fresh start."""
        out, self.begun = self.machine.decode(b"", True), False
        self.machine.reset()
        return out

    def text(self, ids: np.ndarray) -> str:
        return "".join([*(self.push(ids[at : at + PORTION]) for at in range(0, len(ids), PORTION)), self.finish()])


def encode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "ids") -> DataFrame:
    """``keep`` and the ids of ``text`` as an array of integers named ``out``."""
    rows = docs.select(*keep, F.col(text).alias("\0text"))
    fresh_names(rows, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = StreamEncoder.of(tokenizer)
        for whole in batches:
            for b in slices(whole, "\0text"):
                ids, size = encoder.encode(text_column(b, "\0text"))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], out])

    return rows.mapInArrow(run, rows.drop("\0text").withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id", "ids"), ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``keep`` and the text of ``ids``, an array of integers, as ``out``; null ids give an empty text, null entries are left out."""
    rows = rows.select(*keep, F.coalesce(F.array_compact(ids), F.array().cast("array<int>")).alias("\0ids"))
    fresh_names(rows, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        for whole in batches:
            ends = np.cumsum(whole.column(whole.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_IDS, "right")))
                b = whole.slice(at, to - at)
                col = b.column(b.num_columns - 1)
                flat, offs = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))])
                texts = [decoder.text(flat[x:y]) for x, y in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], out])
                at = to

    return rows.mapInArrow(run, rows.drop("\0ids").withColumn(out, F.lit(None).cast("string")).schema)


def op13_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document as word-end BPE ids, and their text."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, tokenizer), tokenizer)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
