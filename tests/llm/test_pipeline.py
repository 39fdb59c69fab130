"""Each pipeline stage on odd rows and on an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline
from revtide.llm import queries

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(70))
ODD = [
    (None, "a row without id"), (None, None), (90_001, None), (90_002, ""), (90_003, " \n\t"), (90_004, "one"), (90_004, "one"),
    (90_005, PASSAGE), (90_006, "Before it stands something else. " * 20 + PASSAGE + " and after it too"), (90_007, PASSAGE.upper()),
    (90_008, "x" * 200_000), (90_009, " " * 100_000 + "y"),
]


@pytest.fixture(scope="module")
def documents(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    real = queries.open_table(spark, SF, "documents").where("doc_id < 60")
    return real.unionByName(odd).selectExpr("*", "1 AS score", "2 AS doc", "3 AS row", "4 AS late", "5 AS removal", "6 AS key").repartition(3)


def test_stages_on_odd_rows(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents, SF)
        assert out.columns == documents.columns
        found[name] = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    clean = {row for row in ODD if row[1] is None or len(row[1]) < 20}
    for name, rows in found.items():
        assert clean - {(90_004, "one")} <= rows or name == "near_dedup"
    # the passage in capitals has the same words, so it goes; in another stage only equal letters count
    assert (90_007, PASSAGE.upper()) not in found["near_dedup"] and (90_007, PASSAGE.upper()) in found["substring_dedup"]
    cut = next(t for i, t in found["substring_dedup"] if i == 90_006)
    assert PASSAGE not in cut and cut.endswith("and after it too") and (90_005, PASSAGE) in found["substring_dedup"]
    rows = stages["sentencepiece"](spark, documents, SF).collect()
    assert all(r.restored for r in rows if r.sample is not None)
    assert {r.doc_id for r in rows if r.sample is None} >= {90_001, 90_002}


def test_stages_on_an_empty_table(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).count() == 0
