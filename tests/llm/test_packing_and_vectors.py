"""Sum-of-squares packing, hard negatives and whitening against brute force."""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revtide.llm import bytebpe, negatives, queries, sumofsquares, whitening

SF = "/root/testdata/sf0.001"
LONG = "a" + " " * 300_000 + "b " + "\n \t" * 2_000 + "word " * 100_000 + "<|endoftext|> 日本語"
ODD = [None, "", " ", "  a  b ", "\n", "日本語 한국 \U0001f600", "x<|endoftext|>y", "x" * 3_000, "the the", "the the", LONG]


@pytest.fixture(scope="module")
def documents(spark):
    real = queries.open_table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (10_008, "other")], "doc_id long, text string")
    return real.unionByName(odd).selectExpr("*", "1 AS part", "2 AS number", "3 AS ids", "4 AS length", "5 AS piece").repartition(3)


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(bytebpe.load_model())


def test_ids_are_the_tokenizers(encoder):
    plain = Tokenizer.from_file(bytebpe.MODEL)
    assert encoder.fast is not None
    contexts = [f"a{chr(p)}b 1{chr(p)}2 .{chr(p)}, {chr(p)}{chr(p)} {chr(p)}" for p in range(256)]
    white = ["a" + " " * n + t for n in (63, 64, 65, 300, 511, 512, 5_000) for t in ("", "b", "\nb", "\t" + " " * 70)]
    mixed = ["a" + "\n \t" * 400 + "b", "it's 3rd ...  x", *[t for t in ODD if t]]
    for text in contexts + white + mixed:
        assert encoder(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_a_vocabulary_that_ranks_do_not_tell(tmp_path):
    """A token whose parts merge in no order of ids goes the plain way."""
    own = Tokenizer.from_file(bytebpe.MODEL).to_str().replace('"add_prefix_space":false', '"add_prefix_space":true')
    path = tmp_path / "model.json"
    path.write_text(own, encoding="utf-8")
    model = bytebpe.load_model(str(path))
    assert not model.by_rank
    assert bytebpe.Encoder(model)("to be").tolist() == Tokenizer.from_str(own).encode("to be", add_special_tokens=False).ids


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in pairwise(own))
        assert own[-1].offset + own[-1].length <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pieces_are_whole_documents(documents, encoder, capacity):
    packed = sumofsquares.pack_documents(documents, capacity=capacity, block=150)
    rows = packed.collect()
    found = check_packed(rows, capacity)
    assert found <= 1.03 * sum(r.length for r in rows) / capacity + 2
    want = {}
    for r in documents.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append([*(encoder(r.text).tolist() if r.text else []), 2])
    got = {}
    for r in sorted(rows, key=lambda r: r.piece):
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    for name, texts in want.items():
        if len(texts) == 1:
            own = got[name]
            assert [r.piece for r in own] == list(range(len(own)))
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == texts[0]
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
            assert all(r.length == capacity for r in own[1:])
        else:
            assert sum(r.length for r in got[name]) == sum(map(len, texts))


def test_sequences_join_their_pieces(documents):
    packed = sumofsquares.pack_documents(documents.where("length(text) < 2000 or text is null"))
    packed = packed.sparkSession.createDataFrame(packed.collect(), packed.schema)
    by = {}
    for r in sorted(packed.collect(), key=lambda r: r.offset):
        by.setdefault(r.sequence_id, []).append(r)
    rows = sumofsquares.sequences(packed).collect()
    assert len(rows) == len(by)
    for r in rows:
        own = by[r.sequence_id]
        assert bytes(r.ids) == b"".join(bytes(p.ids) for p in own)
        assert r.cu_seqlens == np.cumsum([0, *(p.length for p in own)]).tolist()


def test_packing_report(documents, encoder):
    rows = sumofsquares.packing_report(documents.where("doc_id < 10000")).collect()
    check_packed(rows, 1024)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in rows:
        ids = np.append(encoder(texts[r.doc_id] or ""), 2).astype("<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
    assert sumofsquares.packing_report(documents.limit(0)).count() == 0


def test_the_rule():
    """Each piece goes where the sum of squares becomes smallest, the fullest of equal places."""
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(1, 13, 300)
    capacity = 12
    sequence, offset, filled = sumofsquares.sum_of_squares(lengths, capacity)
    levels: dict[int, int] = {}

    def squares(sizes):
        return sum(sizes.count(g) ** 2 for g in range(1, capacity))

    for need, at, level in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        choices = {}
        for name, size in [*levels.items(), (len(levels), 0)]:
            if size + need <= capacity and (size < capacity):
                choices.setdefault(size, squares([*(v for k, v in levels.items() if k != name), size + need]))
        least = min(choices.values())
        assert level == max(s for s, v in choices.items() if v == least)
        assert levels.get(at, 0) == level
        levels[at] = level + need
    assert filled.tolist() == [levels[i] for i in range(len(levels))]


def mined(rows, step, positives=5, count=10):
    """(anchor, positive, rank, negative, scores) by comparing all."""
    good = [(i, lab, v) for i, lab, v, *_ in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    cut = [(i, lab, [int(x) for x in np.floor(256 * np.array(v, np.float32).astype(float))]) for i, lab, v in good]
    out = []
    for a, (i, lab, v) in enumerate(cut):
        if i % step:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, b, m) for b, (j, m, w) in enumerate(cut) if b != a and len(w) == len(v))
        for s, j, _, _ in [o for o in others if o[3] == lab][:positives]:
            near = [o for o in others if o[3] != lab and -30 * s <= -100 * o[0] <= -90 * s][:count]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=(6, 12))
    rows = [(i, int(rnd.integers(3)), (0.2 * (centre[i % 6] + 0.4 * rnd.normal(size=12))).tolist()) for i in range(400)]
    rows += [(1_000 + i, i % 2, rows[4][2]) for i in range(150)]  # copies: ties
    rows += [(2_000 + i, i % 2, [0.1 * i, 0.2]) for i in range(6)] + [(2_010, 0, [300.0, 0.0]), (3_000, 1, []), (3_010, 1, [])]
    rows += [(4_000, None, rows[0][2]), (4_010, 1, None), (4_020, 1, [None] * 12), (4_030, 1, [float("nan")] * 12), (4_040, 1, [float("inf")] * 12), (None, 1, rows[0][2])]
    rows += [(20, 2, rows[7][2])]  # an id twice
    if small:
        for name, value in (("BLOCK", 16), ("GROUP", 5), ("PACK", 4), ("HELD", 2), ("SORTED", 64)):
            monkeypatch.setattr(negatives, name, value)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS block", "2 AS id", "3 AS v", "4 AS anchor").repartition(5)
    got = sorted(map(tuple, negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0).collect()))
    assert got == mined(rows, 10)
    if not small:
        assert negatives.mine_hard_negatives(table.limit(0), F.lit(True)).count() == 0


def test_the_curve_passes_neighbours():
    side, dims = 8, 3
    points = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
    order = np.argsort(negatives.hilbert(points, 3))
    assert len(np.unique(negatives.hilbert(points, 3))) == side**dims
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rnd = np.random.default_rng(4)
    score = rnd.integers(-(10**18), 10**18, 1_000)
    for percent in (30, 90):
        low, high = negatives._share(score, percent, True), negatives._share(score, percent, False)
        for s, a, b in zip(score.tolist(), low.tolist(), high.tolist(), strict=True):
            assert a == -(-percent * s // 100) and b == percent * s // 100
    wide = rnd.integers(-(2**24), 2**24, (5, 700))
    assert negatives.products(wide, wide).tolist() == [[sum(x * y for x, y in zip(a, b, strict=True)) for b in wide.tolist()] for a in wide.tolist()]


MATRICES = {
    "plain": lambda r: r.normal(size=(300, 24)),
    "few rows": lambda r: r.normal(size=(3, 10)),
    "one row": lambda r: r.normal(size=(1, 4)),
    "equal rows": lambda r: np.ones((5, 4)),
    "identity": lambda r: np.vstack([np.eye(20)] * 3),
    "clusters": lambda r: np.diag([5.0] * 10 + [3.0] * 10 + [1e-3] * 20) @ np.linalg.qr(r.normal(size=(40, 40)))[0],
    "graded": lambda r: np.diag(10.0 ** -np.arange(20)) @ np.linalg.qr(r.normal(size=(20, 20)))[0],
    "copies of columns": lambda r: np.repeat(r.normal(size=(100, 5)), 3, axis=1),
    "columns of zeros": lambda r: r.normal(size=(100, 8)) * np.array([1, 0, 2, 0, 3, 0, 0, 4]),
    "equal blocks": lambda r: np.kron(np.eye(8), r.normal(size=(10, 5))),
}


@pytest.mark.parametrize("name", list(MATRICES))
def test_singular_values_and_vectors(name):
    a = MATRICES[name](np.random.default_rng(3))
    r = whitening._factor(a)
    diagonal, upper, right = whitening.bidiagonalise(r)
    values = whitening.dqds(diagonal, upper)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-12, atol=1e-14 * max(want[0], 1e-300))
    if name == "graded":  # small ones as well, as far as the matrix holds them
        assert np.allclose(values[:12], 100.0 ** -np.arange(12), rtol=1e-4)
    k = min(8, int((values > values[0] * 1e-28).sum()))
    vectors = np.array([whitening.reflect_back(z, right) for z in whitening.right_vectors(diagonal, upper, values, k)]).reshape(k, -1)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max(initial=0) < 1e-12
    assert np.abs(vectors @ r.T @ r - values[:k, None] * vectors).max(initial=0) < 1e-12 * max(values[0], 1e-300)


def test_small_values_keep_their_digits():
    """A bidiagonal matrix gives its singular values to high relative accuracy, however small."""
    diagonal, upper = 10.0 ** -np.arange(12.0), 0.1 * 10.0 ** -np.arange(11.0)
    values = whitening.dqds(diagonal, upper)
    assert np.isclose(np.log(values).sum(), 2 * np.log(diagonal).sum(), rtol=1e-14)


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 20)
    monkeypatch.setattr(whitening, "STACK", 2)
    rnd = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 12)) * np.arange(1, 13))]
    rows += [(500, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]
    other = [(600 + i, v.tolist()) for i, v in enumerate(rnd.normal(size=(20, 3)))] + [(700, [1.0]), (701, [1.0]), (702, []), (703, [1e11, 2.0])]
    bad = [(800, None), (801, [None] * 12), (802, [float("nan")] * 12), (803, [float("inf")] + [0.0] * 11)]
    table = spark.createDataFrame(rows + other + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS width", "3 AS v").repartition(9)
    got = whitening.whiten(table).collect()
    assert len(got) == len(rows) + len(other)
    for group, width in ((rows, 12), (other[:20], 3)):
        x = np.floor(1024 * np.array([v for _, v in group], np.float32).astype(float)).astype(np.int64) + 100_000
        n, sums = len(x), x.sum(0)
        centred = (n * x - sums) / n
        e, u = np.linalg.eigh(centred.T @ centred / n)
        e, u = e[::-1], u[:, ::-1]
        k = min(8, width)
        want = centred @ u[:, :k] / np.sqrt(e[:k])
        own = [r for r in got if len(r.whitened) == k and r.n == n]
        assert len(own) == n and all(np.allclose(r.explained, e[:k] / e.sum()) and r.identity_error < 1e-9 for r in own)
        found = {(r.vec_id, int(r.deviation)): np.array(r.whitened) for r in own}
        far = ((n * x - sums) ** 2).sum(1).tolist()
        signs = np.sign(sum(found[name, d] * w for (name, _), d, w in zip(group, far, want, strict=True)))
        for (name, _), d, w in zip(group, far, want, strict=True):
            assert np.allclose(found[name, d] * signs, w, atol=1e-9)
    rest = {r.vec_id: r for r in got if r.vec_id in (700, 701, 702, 703)}
    assert rest[700].whitened == rest[702].whitened == [] and rest[703].deviation == 0
    assert whitening.whiten(table.limit(0)).count() == 0


def test_enormous_deviations(spark):
    table = spark.createDataFrame([(1, [1e11, 2.0]), (2, [-1e11, 2.0]), (3, [5e10, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(table).collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in ([1e11, 2.0], [-1e11, 2.0], [5e10, 1.0])]
    for name, row in zip((1, 2, 3), x, strict=True):
        assert int(got[name].deviation) == sum((3 * c - sum(r[d] for r in x)) ** 2 for d, c in enumerate(row))
    assert whitening.whitening_report(table).where("deviation is null").count() > 0
