"""Toxicity, packing, sampling and counting of tokens, and the pipeline."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__
import corpus_pipeline
from revtide.llm import packing, queries, sampling, tokencount, toxicity, vocabulary
from revtide.llm.words import mix

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b ", "▁x y▁", "\n", "日本語 한국 \U0001f600", "x" * 3000, "the the", "the the"]


@pytest.fixture(scope="module")
def documents(spark):
    real = queries.open_table(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b")], "doc_id long, text string")
    return real.unionByName(odd).selectExpr("*", "1 AS counts", "2 AS key", "3 AS label", "4 AS ids").repartition(3)


@pytest.fixture(scope="module")
def pieces():
    return vocabulary.load_vocabulary()


def test_counts_equal_the_tokenizer(documents, pieces):
    exact = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.scores.items()], unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace()
    rows = tokencount.count_tokens(documents, "_counts").select("text", "_counts.n_tokens").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.n_tokens == (len(exact.encode(r.text).ids) if r.text else 0)
    assert tokencount.token_count_report(documents.limit(0)).count() == 0


def test_counts_with_ties():
    """Scores that tie: the piece that begins first wins, unknown characters in a row are one token."""
    words = {"▁": -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -3.0, "ba": -2.0, "aba": -3.0, "▁ab": -4.0}
    own = vocabulary.Vocabulary({p: i for i, p in enumerate(words)}, words, [], min(words.values()) - 10, list(words))
    exact = Tokenizer(models.Unigram([("<unk>", -4.0), *words.items()], unk_id=0, byte_fallback=False))
    exact.pre_tokenizer = pre_tokenizers.Metaspace()
    counter = tokencount.Counter(own)
    for n in range(3**6):
        text = "".join("abz"[n // 3**i % 3] for i in range(6)) + (" ba" if n % 2 else "")
        assert counter.text(text)[0] == len(exact.encode(text).ids), text


def test_samples_are_distinct_and_decode(documents):
    rows = sampling.segmentation_report(documents.withColumnRenamed("ids", "other"), k=3).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for doc, found in by.items():
        if not texts[doc]:
            assert [r.sample for r in found] == [None]
            continue
        assert all(r.restored for r in found)
        assert len({r.ids_hash for r in found}) == len(found)
        assert all(0 < r.inclusion <= 1 for r in found)
        found.sort(key=lambda r: r.sample)
        assert all(a.perturbed >= b.perturbed for a, b in zip(found, found[1:], strict=False))
    again = sampling.segmentation_report(documents.select("doc_id", "text").repartition(7), k=3).collect()
    digest = lambda rows: Counter((r.doc_id, r.sample, r.ids_hash) for r in rows)
    assert digest(again) == digest(rows)


def test_samples_follow_the_distribution():
    words = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "ba": 5, "▁ab": 6}
    scores = {p: -1.0 - 0.3 * i for i, p in enumerate(words)}
    table = sampling.PieceTable(vocabulary.Vocabulary(words, scores, list(range(10, 266)), -20.0, [*words]))
    n = 40_000
    found = sampling.sample_segmentations(["ab ba"] * n, mix(np.arange(n).astype(np.uint64)), table, 2)

    def ways(word):
        if not word:
            return [((), 0.0)]
        return [((words[word[:i]], *rest), scores[word[:i]] + s) for i in range(1, len(word) + 1) if word[:i] in words for rest, s in ways(word[i:])]

    every = {a + b: math.exp(x + y) for a, x in ways("▁ab") for b, y in ways("▁ba")}
    total = sum(every.values())
    chance = {a: p / total for a, p in every.items()}
    pairs = Counter((tuple(s[0][0].tolist()), tuple(s[1][0].tolist())) for s in found)
    for a, p in chance.items():
        for b, q in chance.items():
            expected = 0.0 if a == b else p * q / (1 - p)
            assert abs(pairs[a, b] / n - expected) < 0.01
    for s in found[:500]:
        assert all(abs(x[1] - math.log(chance[tuple(x[0].tolist())])) < 1e-9 for x in s)
    weights = [sum(math.exp(x[1]) / x[3] for x in s) for s in found]
    assert abs(np.mean(weights) - 1) < 0.02


def test_common_words_stay_when_room_runs_out(pieces, monkeypatch):
    """They are built once, also when the words of single slices are forgotten, and no sample depends on it."""
    monkeypatch.setattr(sampling, "REMEMBERED", 3_000)
    build, built = sampling.build_lattice, Counter()
    table = sampling.PieceTable(pieces)
    words = sampling.Words(table)
    for step in range(30):
        texts = [" ".join(["the", "▁of", "and日", *(f"rare{step}word{j}" for j in range(20))]), "the  and日", ""]
        keys = mix(np.arange(3, dtype=np.uint64) + np.uint64(step))
        with monkeypatch.context() as m:
            m.setattr(sampling, "build_lattice", lambda new, table: built.update(new) or build(new, table))
            found = sampling.draw(texts, keys, words, 3)
        alone = sampling.draw(texts, keys, sampling.Words(table), 3)
        for name in found.__dataclass_fields__:
            assert np.allclose(getattr(found, name), getattr(alone, name), rtol=1e-12), name
    assert len(words.numbers) < 400 and built["rare0word0"] == 1
    assert built["the"] == built["▁of"] == built["and日"] == 1


def test_all_segmentations_when_k_is_large():
    words = {"▁": 0, "a": 1, "▁a": 2}
    table = sampling.PieceTable(vocabulary.Vocabulary(words, {"▁": -1.0, "a": -1.0, "▁a": -1.5}, list(range(10, 266)), -20.0, [*words]))
    (found,) = sampling.sample_segmentations(["a"], np.zeros(1, np.uint64), table, 5)
    assert sorted(tuple(x[0].tolist()) for x in found) == [(0, 1), (2,)] and all(x[3] == 1.0 for x in found)


@pytest.mark.parametrize("capacity", [7, 2_048])
def test_packing_loses_nothing(documents, capacity):
    rows = packing.pack_tokens(documents, capacity=capacity, block_ids=20_000).collect()
    encoding = packing.load_encoding()
    held = defaultdict(list)
    for r in rows:
        ids, positions, ends = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2"), r.cu_seqlens
        assert len(ids) == len(positions) == capacity and ends[0] == 0 and ends[-1] <= capacity
        for s, (a, b) in zip(r.segments, pairwise(ends), strict=True):
            assert b - a == s.length and positions[a:b].tolist() == list(range(b - a))
            held[s.doc].append((s.offset, ids[a:b].tolist()))
        assert set(ids[ends[-1] :].tolist()) <= {packing.END}
    assert len({(r.part, r.pack) for r in rows}) == len(rows)
    for r in documents.where("text != ''").collect():
        whole = [x for _, part in sorted(held[None if r.doc_id is None else str(r.doc_id)]) for x in part]
        assert encoding.decode(whole[:-1]) == r.text and whole[-1] == packing.END
    assert packing.packing_report(documents.limit(0)).count() == 0


def test_long_white_space_in_packing(spark):
    """Runs that the pattern's matcher can't take; short of that, the same ids with and without it."""
    encoding = packing.load_encoding()
    for run in (" " * 1_500, "\n" * 1_001, " \n\t" * 700, "\u2003" * 1_200 + " ", "\xa0" * 1_000 + "\n"):
        for text in (run, "a" + run, run + "b", f"it's{run}b{run}", f"{run}.\x1c{run}\x1c", f"1{run}" * 3):
            assert packing.encode(encoding, text) == encoding.encode_ordinary(text)
    long = "a" + " " * 10_000_000 + "\n" * 1_000_000 + "b"
    rows = packing.pack_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string")).select("cu_seqlens", "ids").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u2")[: r.cu_seqlens[-1]] for r in rows])
    assert sorted(ids.tolist()) == sorted([*packing.encode(encoding, long), packing.END])


def test_best_fit_takes_the_tightest_row():
    lengths = [4, 4, 8, 1, 3, 10, 2, 6, 5]
    rows = packing.best_fit_decreasing(lengths, 10)
    assert sorted(p for row in rows for p in row) == list(range(len(lengths)))
    rooms: list[int] = []
    for need in sorted(lengths, reverse=True):  # the same by looking at every row
        fits = [room for room in rooms if room >= need]
        rooms.append(10)
        if fits:
            rooms.pop()
            rooms.remove(min(fits))
            rooms.append(min(fits))
        rooms[-1] -= need
    assert sorted(10 - sum(lengths[p] for p in row) for row in rows) == sorted(rooms)


def test_restoring_disguised_words(spark):
    model = toxicity.character_model(queries.open_table(spark, "/root/testdata/sf0.01", "documents"))
    read = toxicity.Restorer(model)
    said = read(["a m0r0n and", "s c u m here", "clownnnn", "worthle$$", "plain text, 22.249.23.55", None, "x\x01y"]).decode().split("\x01")
    assert said == ["a moron and", "scum here", "clown", "worthless", "plain text, 22.249.23.55", "", "x y", ""]


def test_toxicity_is_learnt_and_held_out(spark):
    docs, labels = (queries.open_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    odd = spark.createDataFrame([(90_000, None), (90_001, ""), (None, "a moron")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    rows = toxicity.toxicity_report(table.selectExpr("*", "1 AS score"), labels).collect()
    assert len(rows) == table.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(1)), labels)
    assert kept.count() == sum(r.predicted == 0 for r in rows if r.doc_id is not None and r.doc_id < 90_000)
    nothing = toxicity.toxicity_report(docs.limit(0), labels.limit(0))
    assert nothing.count() == 0


def test_pipeline_stages_keep_their_promises(spark):
    """Each stage by itself, on what the one before kept; the operators have brute-force tests of their own."""
    docs = queries.open_table(spark, SF, "documents")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        assert after and {r.doc_id for r in after} <= set(before)
        if number < 4:
            assert docs.columns == columns
            if number != 2:
                assert all(before[r.doc_id] == r.text for r in after)
    assert all(r.restored in (True, None) for r in after)
    assert set(__spark_entry__.queries()) >= {"pipeline", *queries.QUERIES}
