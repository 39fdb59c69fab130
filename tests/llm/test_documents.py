"""Operators on documents against brute-force versions, on the small tables and on made-up edge cases."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revtide.llm import fmindex, queries, setsketch, superkmers

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the small table and some edge cases: nulls, empty, short, long, repeated."""
    real = [(r.doc_id, r.text) for r in queries.open_table(spark, SF, "documents").select("doc_id", "text").collect()]
    words = [f"w{i}é" for i in range(200)]
    block, base = " ".join(words[:60]), [f"v{i}" for i in range(80)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 80, 20)]
    odd = [None, "", " \n\t", "one", "Two Words", "one", "x " * 300, block, "before\n" + block + " after", block.upper(), " ".join(words * 40), *near, " ".join(base)]
    return real + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, block), (10_007, block)]


@pytest.fixture(scope="module")
def documents(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    # Names that operators use inside.
    clash = {c: F.lit(1) for c in ("hits", "removal", "row", "doc", "n", "sketch", "key", "late", "score", "packed")}
    return table.withColumns(clash).repartition(5)


def test_decontamination(spark, documents, rows):
    bench = [(r.item_id, r.text) for r in queries.open_table(spark, SF, "benchmark").collect()]
    bench += [(901, "one"), (902, None), (903, ""), (None, "two words"), (904, "Two, WORDS!"), (904, "two words"), (905, " ".join(f"w{i}é" for i in range(20)))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    windows: dict[tuple, set[str]] = {}
    for item, text in bench:
        w = ALNUM.findall(lower(text or ""))
        if item is not None and w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    expected = []
    for doc, text in rows:
        w = ALNUM.findall(lower(text or ""))
        hit, items = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    items |= found
                    hit[i : i + size] = [True] * size
        n = sum(hit)
        expected.append((doc, len(w), n, len(items), sha(",".join(sorted(items))), n > 0 and 20 * n >= len(w)))
    got = [tuple(r) for r in fmindex.contamination_report(documents, table).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    # Benchmark in several blocks: the same hits.
    one = fmindex.find_contamination(documents.select("doc_id", "text"), table)
    more = fmindex.find_contamination(documents.select("doc_id", "text"), table, block_chars=400)
    assert sorted(map(str, one.collect())) == sorted(map(str, more.collect()))
    kept = fmindex.drop_contaminated(documents, table)
    assert kept.columns == documents.columns
    assert kept.count() == sum(not e[5] for e in expected)


def test_decontamination_of_nothing(spark, documents):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.contamination_report(documents, nothing).where("n_hit > 0 or contaminated").count() == 0
    assert fmindex.contamination_report(documents.limit(0), nothing).count() == 0


@pytest.mark.parametrize("crowd", [5_000, 1])
def test_repeats(documents, rows, crowd):
    first: dict[tuple, int] = {}
    split = [(doc, WHITE.findall(text or "")) for doc, text in rows]
    for doc, w in split:
        for i in range(len(w) - 49):
            if doc is not None:
                t = tuple(w[i : i + 50])
                first[t] = min(first.get(t, doc), doc)
    expected = []
    for doc, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if doc is not None and first[tuple(w[i : i + 50])] < doc:
                gone[i : i + 50] = [True] * 50
        expected.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    found = superkmers.find_repeats(documents, "_removal", crowd=crowd).select("doc_id", "_removal.*")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_repeats_keeps_columns(documents):
    cut = superkmers.cut_repeats(documents)
    assert cut.columns == documents.columns
    assert cut.count() == documents.count()
    assert superkmers.repeats_report(documents.limit(0)).count() == 0


def test_near_duplicates(documents, rows):
    sets: dict[int, frozenset] = {}
    for doc, text in rows:
        w = WHITE.findall(lower(text or ""))
        if doc is not None:
            sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    component = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    got = setsketch.near_duplicate_report(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)
    kept = setsketch.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d in sets if component[d] == d} | {None}


def test_near_duplicates_of_a_crowd(spark):
    """A loose group larger than a block: links run over blocks, tiles and leaders."""
    import random

    rnd = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(116)) for t in texts]
    component = list(range(len(sets)))
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(table).collect()}
    assert got == dict(enumerate(component))
    assert setsketch.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("root", [2, 64])
def test_cells_of_a_mixed_bucket(spark, monkeypatch, root):
    """Each pair but those of the largest component meets once; a bucket of four times the rows makes less than 16 times."""
    monkeypatch.setattr(setsketch, "CELL_ROOT", root)

    def cells(size: int):
        # a component of two thirds, the rest in threes
        component = [0 if d < 2 * size // 3 else d // 3 for d in range(size)]
        others = spark.createDataFrame([(7, 1, d, c) for d, c in enumerate(component)], "key long, band int, doc long, component long")
        classes = spark.createDataFrame([(d, 100) for d in range(size)], "doc long, n long")
        return component, setsketch._cells(others, classes, 0.75).select("c.cell", "c.with", "doc", "minor", "own").collect()

    made = {}
    for size in (300, 1_200):
        component, found = cells(size)
        made[size] = len(found)
        met: dict[tuple[int, int], int] = {}
        for cell in {r.cell for r in found}:
            held = [r for r in found if r.cell == cell]
            kinds = {min(r["with"], 0) for r in held}
            assert len(kinds) == 1
            for x, a in enumerate(held) if size == 300 else ():
                for b in held[x + 1 :]:
                    minors = a.minor + b.minor
                    if minors == 1 or minors == 2 and (kinds == {-2} or kinds == {0} and a.own != b.own):
                        met[min(a.doc, b.doc), max(a.doc, b.doc)] = met.get((min(a.doc, b.doc), max(a.doc, b.doc)), 0) + 1
        if size == 300:
            assert met == {(a, b): 1 for b in range(size) for a in range(b) if component[a] or component[b]}
    assert made[1_200] <= 10 * made[300]
    assert root == 2 or made == {300: 300, 1_200: 1_200}


def test_joins_of_mixed_buckets_are_of_documents(spark, monkeypatch):
    """What is compared in mixed buckets is looked up once a document, not once for each of its buckets."""
    docs, buckets = 30, 20
    others = spark.createDataFrame([(k, k, d, d % 3) for d in range(docs) for k in range(buckets)], "key long, band int, doc long, component long")
    # All agree in band 0, so each pair is found in bucket 0; the first three are alike.
    sketch = [bytes([7] * 5 + [(d * 31 + i * 7) % 50 for i in range(setsketch.REGISTERS - 5)]) for d in range(docs)]
    classes = spark.createDataFrame([(d, 100, bytearray(sketch[d if d > 2 else 0])) for d in range(docs)], "doc long, n long, sketch binary")
    made, join = [], type(others).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "doc" and how is None:
            made.append(out.count())
        return out

    monkeypatch.setattr(type(others), "join", counted)
    rest = setsketch._residual(others, classes, 0.75, False)
    pairs = {(min(p), max(p)) for r in rest.collect() for p in zip(r.a, r.b, strict=True)}
    # equal sketches of three components
    assert {(0, 1), (0, 2), (1, 2)} <= pairs and all(a % 3 != b % 3 for a, b in pairs)
    assert made and max(made) <= docs
