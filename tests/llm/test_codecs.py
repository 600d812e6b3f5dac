"""Operators 11 to 13 against plain re-computation, the tokenizers' libraries and numpy, and on odd tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH, ODD, SCHEMA

from codequarry.llm import alignment, bpe, queries, whitening

P = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
MIXED = ["a", "b", "an", "ing", "kno", " ", "  ", "\n", "\t ", ".", ",", "!'", "'t", "é", "Σ", "İ", "ß", "的", "中文", "😀", "́", "≠", "<|endoftext|>", "<|startoftext|>", "<s>", "<|", "▁", "|>", "1", "23", "\x1c", "\x85", "A", "THE", "ﬁ", "x" * 60, "　", "\x00", "<0x41>"]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(MIXED, k=rng.randint(0, 40))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op13


@pytest.fixture(scope="module", params=[WORD, BYTE])
def codec(request):
    from tokenizers import Tokenizer

    path = P.path(request.param)
    return path, Tokenizer.from_file(path), bpe.StreamEncoder.of(path)


def test_ids_are_the_librarys(codec, duck):
    path, library, encoder = codec
    rng = random.Random(5)
    texts = [t or "" for (t,) in duck.execute("select text from documents").fetchall()] + mixed(1500)
    texts += ["".join(rng.choices(list(library.get_vocab()), k=30)).replace("</w>", "") for _ in range(500)]
    texts += ["a" * 9000, "ab" * 5000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20000))]
    ids, size = encoder.encode(pa.array(texts, pa.large_string()))
    at = np.concatenate([[0], np.cumsum(size)])
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert ids[at[i] : at[i + 1]].tolist() == want.ids, text[:80]


def test_stream_needs_no_more_than_its_lookahead(codec):
    _, library, encoder = codec
    m, rng, vocabulary = encoder.merges, random.Random(7), [t.replace("</w>", "") for t in library.get_vocab()]
    for _ in range(60):
        word = "".join(rng.choices(rng.choices(vocabulary, k=30), k=400))
        symbols = [int(encoder.first[ord(c)]) for c in word if ord(c) < 0x200 and encoder.first[ord(c)] >= 0]
        for step in (1, 7, 5000):
            got = list(m.stream((symbols[i : i + step] for i in range(0, len(symbols), step)), window=1))
            assert got == m.merge(symbols)[0]


def test_stream_emits_before_the_word_ends(codec):
    m, encoder = codec[2].merges, codec[2]
    given = 0

    def portions():
        nonlocal given
        while True:  # a word without an end
            given += 100
            yield [int(encoder.first[ord("a")]), int(encoder.first[ord("b")])] * 50

    stream = m.stream(portions(), window=1)
    seen = sum(1 for _ in zip(range(5000), stream))
    assert seen == 5000 and given <= 5000 * m.longest + 3 * (m.lookahead + m.longest)


def test_merge_lists_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], None)


def test_decoder_is_the_librarys_in_any_portions(codec):
    path, library, _ = codec
    rng, decoder = random.Random(3), bpe.Decoder(path)
    for _ in range(300):
        ids = rng.choices(range(library.get_vocab_size() + 2), k=40)
        want = library.decode(ids, skip_special_tokens=False)
        assert decoder.text(np.array(ids)) == want
        assert "".join([*(decoder.push(np.array(ids[i : i + 3])) for i in range(0, 40, 3)), decoder.finish()]) == want


def test_op13_over_documents(spark, sf_dir, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(WORD))
    got = {r.doc_id: r[1:] for r in queries.queries()["op13_bpe_codec"](spark, sf_dir).collect()}
    rows = duck.execute("select doc_id, coalesce(text, '') from documents").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in [*CLASH, "a_ids", "groups", "block", "decoded"]])


def test_codec_on_odd_and_empty_tables(spark, odd):
    path = P.path(WORD)
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in ODD)
    assert all(r.ids == [] and r.decoded == "" for r in got if r.doc_id in (3, 4, 5))
    assert bpe.decode(bpe.encode(odd.limit(0), path), path).collect() == []
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(1, None), (2, [None, 320, 10**6])], "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()] == ["", bpe.Decoder(path).text(np.array([320]))]
    with pytest.raises(ValueError):
        bpe.encode(odd, path, keep=("ids",))


def test_a_word_of_a_megabyte():
    encoder, rng = bpe.StreamEncoder.of(P.path(WORD)), random.Random(1)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    ids, _ = encoder.encode(pa.array([word], pa.large_string()))
    assert bpe.Decoder(P.path(WORD)).text(ids).replace(" ", "") == word + "</w>"


# op11


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    library, inverse = Tokenizer.from_file(P.path(BYTE)), {c: b for b, c in enumerate(bpe.byte_letters())}
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=P.path(PIECE))
    of_a = lambda t: [(i, bytes(inverse[c] for c in library.id_to_token(i))) for i in library.encode(" " + t, add_special_tokens=False).ids]
    of_b = lambda t: [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(t)]
    return of_a, of_b


def aligned(text, of_a, of_b):
    """(A ids, B ids, overlaps, groups) of a text, by comparing all token ranges."""
    a, b = of_a(text or ""), of_b(text or "")
    whole = (" " + (text or "")).encode()
    if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], [], [], ""
    end_a, end_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
    start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    over = np.argwhere((start_a[:, None] < end_b) & (start_b < end_a[:, None])) if len(a) * len(b) < 10**7 else None
    cuts = sorted(set(end_a.tolist()) & set(end_b.tolist()))
    groups = []
    for lo, hi in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(i) for (i, _), e in zip(t[x:y], range(y - x))) for t, x, y in ((a, *np.searchsorted(end_a, [lo, hi], "right")), (b, *np.searchsorted(end_b, [lo, hi], "right")))))
    links = [(a[np.searchsorted(end_a, c)][0], b[np.searchsorted(end_b, c)][0]) for c in cuts]
    over = None if over is None else [(int(i), int(j), bool(end_a[i] == end_b[j])) for i, j in over]
    return [i for i, _ in a], [i for i, _ in b], over, ";".join(groups), links


def test_align_equals_comparing_all_ranges(spark, duck):
    of_a, of_b = sides()
    texts = [t for (t,) in duck.execute("select text from documents order by doc_id limit 60").fetchall()] + mixed(400, 9) + [None, "", " ", "a ", "  a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align(docs, P.path(BYTE), P.path(PIECE)).collect()}
    assert any(t and not got[i].a_ids for i, t in enumerate(texts)) and len(got) == len(texts)
    for i, text in enumerate(texts):
        want = aligned(text, of_a, of_b)
        assert (got[i].a_ids, got[i].b_ids, got[i].groups) == (want[0], want[1], want[3]), text
        if want[2] is not None:
            assert [tuple(x) for x in got[i].overlaps] == want[2], text


def test_op11_counts_over_the_corpus(spark, sf_dir, duck, monkeypatch):
    of_a, of_b = sides()
    monkeypatch.setattr(alignment, "BLOCK", 1 << 16)
    got = {r.doc_id: r.asDict() for r in queries.queries()["op11_tokenizer_alignment"](spark, sf_dir).collect()}
    rows = {i: aligned(t, of_a, of_b) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    links = {i: x[4] if len(x) > 4 else [] for i, x in rows.items()}
    count = collections.Counter(p for x in links.values() for p in x)
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    assert got.keys() == rows.keys()
    for i, x in rows.items():
        want = {"doc_id": i, "n_a": len(x[0]), "n_b": len(x[1]), "n_groups": len(links[i]), "n_links": len(links[i]), "n_best": sum(count[p] == most[p[1]] for p in links[i]), "count_sum": sum(count[p] for p in links[i]), "groups_sha256": sha(x[3]) if x[0] else ""}
        assert got[i] == want


def test_alignment_on_odd_and_empty_tables(spark, odd):
    of_a, of_b = sides()
    done, counts = alignment.link_counts(odd, P.path(BYTE), P.path(PIECE))
    got = done.collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in ODD)
    assert all((r.n_a, r.n_links if "n_links" in r else r.n_groups, r.groups_sha256) == (0, 0, "") for r in got if r.doc_id in (3, 4))
    links = collections.Counter(p for r in ODD if r[1] for p in aligned(r[1], of_a, of_b)[4])
    assert {(r.a, r.b): r["count"] for r in counts.collect()} == links
    done, counts = alignment.link_counts(odd.limit(0), P.path(BYTE), P.path(PIECE))
    assert done.collect() == [] and counts.collect() == []
    assert alignment.align(odd.limit(0).select("doc_id", "text"), P.path(BYTE), P.path(PIECE)).collect() == []


# op12


def whitened(rows):
    """(deviations, whitened, explained) of integer vectors, in Python integers and numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(dim)]
    d = [[n * v[i] - s[i] for i in range(dim)] for v in x]
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dim)] for i in range(dim)])
    value, basis = np.linalg.eigh(v)
    value, basis = value[::-1][:32], basis[:, ::-1][:, :32]
    return [sum(c * c for c in r) for r in d], (np.array(d) / n) @ basis / np.sqrt(value), value / np.trace(v), basis


def test_op12_equals_plain_covariance(spark, sf_dir, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()[:]
    got = collections.defaultdict(dict)
    for r in queries.queries()["op12_embedding_whitening"](spark, sf_dir).collect():
        got[r.vec_id][r.component] = r
    deviation, want, explained, _ = whitened([v for _, v in rows])
    assert len(got) == len(rows) and all(sorted(x) == list(range(1, 33)) for x in got.values())
    w = np.array([[got[i][k].whitened for k in range(1, 33)] for i, _ in rows])
    assert [got[i][1].deviation for i, _ in rows] == deviation
    assert np.abs(np.abs((w * want).mean(axis=0)) - 1).max() < 1e-9
    assert np.allclose([got[rows[0][0]][k].explained for k in range(1, 33)], explained, rtol=1e-9)
    error = {r.identity_error for x in got.values() for r in x.values()}
    assert len(error) == 1 and error.pop() < 1e-9
    assert {r.n for x in got.values() for r in x.values()} == {len(rows)}


def test_sums_are_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 38), 1 << 38, (3000, 3)).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    n, whole, rest, v = whitening.covariance(rows, "embedding", 3)
    d = [[n * (int(c) * 64 + 1_000_000) - (w * n + r) for c, w, r in zip(row, whole, rest)] for row in x.tolist()]
    assert all(sum(r[i] for r in d) == 0 for i in range(3))
    assert all(v[i, j] == sum(r[i] * r[j] for r in d) / n**3 for i in range(3) for j in range(3))
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(rows, whitening.fit(rows)).collect()}
    assert got == {i: sum(c * c for c in r) for i, r in enumerate(d)}


def test_whitening_of_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 3.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [2.0, 0.0]), (11, [1e300, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, component string")
    used = whitening.usable(table, "embedding")
    assert sorted(str(r.vec_id) for r in used.collect()) == ["1", "1", "10", "None"]
    model = whitening.fit(used)
    assert model.n == 4 and whitening.identity_error(used, model) < 1e-9
    same = whitening.usable(table.where("vec_id = 1"), "embedding")
    model = whitening.fit(same)
    assert whitening.identity_error(same, model) == 0 and all(r.whitened == [0, 0] and r.deviation == 0 for r in whitening.whiten(same, model).collect())
    none = whitening.usable(table.limit(0), "embedding")
    assert whitening.fit(none) is None
    table.select("vec_id", "embedding").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op12_embedding_whitening(spark, str(tmp_path)).collect() == []
