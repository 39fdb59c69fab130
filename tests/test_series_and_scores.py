from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revtide.functions.cooling import ACTIVITY
from revtide.operators import gaps as G
from revtide.operators import series as S
from revtide.operators import temperature as H

K, STEP, AMB = ACTIVITY.rate, ACTIVITY.step, ACTIVITY.ambient


def fold(times):
    t, last, out = 0.0, None, []
    for x in times:
        if last is None:
            t = STEP
        else:
            t = STEP + AMB + (t - AMB) * math.exp(-K * max(0.0, (x - last).total_seconds() / 3600))
        last = x
        out.append(t)
    return out


def test_fill_strip_and_end(make_revisions, make_changes):
    rev = make_revisions([(1, "2020-01-01 08:00:00", "a"), (2, "2020-01-02 08:00:00", "a"), (3, "2020-01-06 08:00:00", "a")])
    ch = make_changes([(1, "/x", "A", 3, 3), (2, "/x", "M", 5, 0), (3, "/x", "M", 2, 0)])
    assert rows(S.loc_trend(rev, ch)) == [
        (date(2020, 1, 2), 5), (date(2020, 1, 5), 5), (date(2020, 1, 6), 7), (date(2020, 1, 7), 7),
    ]


def test_directory_size_never_negative(make_revisions, make_changes):
    rev = make_revisions([(i, f"2020-01-0{i} 08:00:00", "a") for i in (1, 2, 3)])
    ch = make_changes([(1, "/d/x", "A", 5, 0), (2, "/d/x", "M", 0, 9), (3, "/d/x", "M", 3, 0)])
    assert [r[1] for r in rows(S.dir_loc_trend(rev, ch, ["/d"]), "day", "loc")][:3] == [5, 0, 3]
    assert [r[1] for r in rows(S.loc_trend(rev, ch), "day", "loc")][:3] == [5, -4, -1]


@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_clamp_identity(deltas):
    x = s = low = 0
    for d in deltas:
        x = max(0, x + d)
        s += d
        low = min(low, s)
        assert x == s - min(0, low)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_file_temperature_is_the_fold(spark, make_revisions, make_changes, width):
    rnd = random.Random(7)
    base = datetime(1990, 1, 1)
    revs, chs, want = [], [], {}
    times = {}
    for r in range(1, 60):
        t = base + timedelta(hours=rnd.randrange(0, 300_000))  # the clock jumps both ways
        revs.append((r, t.isoformat(sep=" "), "a"))
        for p in rnd.sample(["/a", "/b", "/c"], rnd.randrange(1, 4)):
            n = rnd.choice([1, 1, 2])
            chs += [(r, p, "M")] * n
            times.setdefault(p, []).extend([(r, t)] * n)
    for p, ev in times.items():
        for (r, _), v in zip(ev, fold([t for _, t in ev])):
            want[(p, r)] = v
    got = {
        (x.changedpath, x.revno): x.temperature
        for x in H.file_temperature(make_revisions(revs), make_changes(chs), shares=width).collect()
    }
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)
    last = {p: fold([t for _, t in ev])[-1] for p, ev in times.items()}
    scores = H.file_scores(make_revisions(revs), make_changes(chs), shares=width).collect()
    assert {x.changedpath: pytest.approx(x.last_temperature, abs=1e-8) for x in scores} == last
    assert {x.changedpath: x.n_changes for x in scores} == {p: len(ev) for p, ev in times.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=25))
def test_author_temperature_is_the_fold(make_revisions, hours):
    base = datetime(2015, 1, 1)
    times = sorted(base + timedelta(hours=h) for h in hours)
    rev = make_revisions([(i + 1, t.isoformat(sep=" "), "a") for i, t in enumerate(times)])
    want = dict(zip(times, fold(times)))  # the last of equal times wins
    got = {r.commitdate: r.temperature for r in H.author_temperature(rev).collect()}
    assert got == {t: pytest.approx(v, abs=1e-9) for t, v in want.items()}
    end = datetime.combine(times[-1].date(), datetime.min.time()) + timedelta(days=1)
    final = AMB + (fold(times)[-1] - AMB) * math.exp(-K * (end - times[-1]).total_seconds() / 3600)
    assert H.author_scores(rev).first().temperature == pytest.approx(final, abs=1e-9)


def test_index_with_empty_revisions(make_revisions, make_changes):
    rev = make_revisions([(1, "2020-01-01 01:00:00", "a"), (2, "2020-01-02 01:00:00", "a"), (3, "2020-01-12 01:00:00", "a")])
    ch = make_changes([(2, "/x", "A")])
    assert rows(H.revision_temperature(rev, ch), "revno", "temperature") == [(1, 0.0), (2, 10.0), (3, 0.0)]
    got = rows(H.revision_activity_index(rev, ch), "day", "activity")
    assert got[0] == (date(2020, 1, 2), 10.0)
    assert got[1][1] == pytest.approx(AMB + (10 - AMB) * math.exp(-K * 240))
    assert len(got) == 2  # nothing before the first heat


def test_active_authors_follow_shown_spelling(make_revisions):
    rev = make_revisions([(1, "2020-01-01", "Bob"), (2, "2020-01-02", "bob"), (3, "2020-01-03", ""), (4, "2020-01-03", "eve")])
    assert rows(H.active_authors(rev), "author") == [("Bob",), ("eve",)]
    assert rows(H.author_cloud(rev), "author") == [("",), ("Bob",), ("bob",), ("eve",)]


def test_gap_rules(make_revisions):
    rev = make_revisions([
        (1, "2020-01-01 00:00:00", "a"), (2, "2020-01-17 00:00:00", "a"), (3, "2020-01-17 00:30:00", "a"),
        (4, "2020-01-18 00:00:00", "solo"),
    ])
    hist = {r.label: r.commits for r in G.commit_gap_histogram(rev).collect()}
    assert hist["8-16 days"] == 0 and hist["0-1 hr"] == 1 and sum(hist.values()) == 1
    stats = {r.author: (r.mean_days, r.stddev) for r in G.commit_gap_stats(rev).collect()}
    assert stats["solo"] == (0.0, 0.0)
    assert stats["a"][0] == pytest.approx((16 + 0.5 / 24) / 3)
    unbiased = {r.author: r.mean_days for r in G.commit_gap_stats(rev, unbiased=True).collect()}
    assert unbiased["a"] == pytest.approx((16 + 0.5 / 24) / 2)
    band = {r.author: r for r in G.commit_gap_band(rev).collect()}
    assert band["a"].lo == 0.0


def test_previous_value_crosses_buckets(spark):
    from revtide.operators.base import prev_value

    df = spark.range(0, 100).select((F.col("id") * 7).alias("o"), (F.col("id") * F.col("id")).alias("v"))
    got = prev_value(df, [], F.floor(F.col("o") / 50), ["o"], {"p": "v"}).orderBy("o").collect()
    assert [r.p for r in got] == [None] + [i * i for i in range(99)]


def test_revision_gaps_others(make_revisions):
    rev = make_revisions([(1, "2020-01-01 00:00:00", "a"), (2, "2020-01-01 02:00:00", ""), (3, "2020-01-01 01:00:00", "a"), (4, "2020-01-01 01:30:00", "b")])
    assert rows(G.revision_gaps(rev, 1), "revno", "author", "hours") == [(2, "others", 2.0), (3, "a", -1.0), (4, "others", 0.5)]
    assert rows(G.revision_gaps(rev), "revno", "author")[0] == (2, "others")  # '' is listed as unknown


def test_result_does_not_depend_on_partitions(spark):
    from conftest import SMALL

    from revtide.adapters import order_changes, order_revisions

    a = H.hot_files(order_revisions(spark, SMALL), order_changes(spark, SMALL))
    b = H.hot_files(order_revisions(spark, SMALL).repartition(7), order_changes(spark, SMALL).repartition(13))
    for x, y in zip(rows(a), rows(b)):
        assert x[0] == y[0] and x[1] == pytest.approx(y[1])


def test_trend_ends_at_basic_stats(spark):
    from conftest import SMALL

    from revtide.adapters import order_changes, order_revisions
    from revtide.operators.aggregates import basic_stats

    rev, ch = order_revisions(spark, SMALL), order_changes(spark, SMALL)
    b = basic_stats(rev, ch).first()
    assert S.loc_trend(rev, ch).orderBy(F.col("day").desc()).first().loc == b["loc"]
    assert S.file_count_trend(rev, ch).orderBy(F.col("day").desc()).first().files == b.num_files


def test_buckets_hold_equal_shares(spark):
    """Sparse numbers, one single day, one single moment: buckets follow the order and none holds a growing share."""
    from revtide.operators.base import share_bucket

    n = 4_000
    sparse = "CAST(pow(1.005, id) AS BIGINT) + id"
    cases = {
        "sparse": (f"{sparse} AS a", "id AS b"),
        "one day": ("timestamp '2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 100) AS a", "id AS b"),
        "one moment": ("timestamp '2020-01-01 00:00:00' AS a", "id AS b"),
        "half one moment": ("CASE WHEN id % 2 = 0 THEN 5000 ELSE id END AS a", "id AS b"),
        "nulls": ("CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS a", "id AS b"),
    }
    for name, (a, b) in cases.items():
        df = spark.range(n).selectExpr(a, b).repartition(5)
        got = df.withColumn("_b", share_bucket(df, "a", "b", 16)).collect()
        order = sorted(got, key=lambda r: (r.a is not None, r.a if r.a is not None else 0, r.b))
        buckets = [r["_b"] for r in order]
        assert buckets == sorted(buckets), name
        assert max(buckets.count(x) for x in set(buckets)) <= n / 16 * 1.7, name


@pytest.mark.parametrize("same", [False, True])
def test_scans_over_one_day(spark, make_revisions, same):
    """All commits on one day, or at one moment: gaps, ranks and running scores as in a plain walk."""
    from revtide.operators import gaps as GP

    base = datetime(2020, 5, 1)
    revs = [(r * r * 1_000_003, (base + timedelta(seconds=0 if same else r)).isoformat(sep=" "), "ab"[r % 3 > 0]) for r in range(1, 300)]
    log = make_revisions(revs)
    ranks = {(r.author, r.revno): r["rank"] for r in GP.rank_desc(log).collect()}
    by = {}
    for revno, when, who in revs:
        by.setdefault(who, []).append((revno, datetime.fromisoformat(when)))
    assert ranks == {(who, own[-i][0]): i for who, own in by.items() for i in range(1, len(own) + 1)}
    gaps = {(r.author, r.revno): r.gap_days for r in GP.author_gaps(log).collect()}
    for who, own in by.items():
        for a, b in zip([None, *own], own):
            want = None if a is None else (b[1] - a[1]).total_seconds() / 86_400
            assert gaps[who, b[0]] == (want if want is None else pytest.approx(want))
    got = {(r.author, r.commitdate): r.temperature for r in H.author_temperature(log).collect()}
    for who, own in by.items():
        for (_, when), value in zip(own, fold([w for _, w in own])):
            if not same:
                assert got[who, when] == pytest.approx(value)
    activity = H.revision_activity_index(log, temperatures=log.selectExpr("revno", "commitdate", "CAST(revno % 97 AS DOUBLE) AS temperature"))
    peak = 0.0
    want = {}
    for revno, when, _ in revs:
        t = datetime.fromisoformat(when)
        peak = max(peak, float(revno % 97))
        want[t] = peak
    assert {r.commitdate: r.activity for r in activity.collect()} == {k: pytest.approx(v) for k, v in want.items() if v > 1.1}


def test_tasks_hold_a_bounded_number_of_rows(spark, make_revisions, make_changes, monkeypatch):
    from revtide.operators import base

    df = spark.range(100).withColumn("k", F.col("id") % 50)
    assert base.dealt(df, ["k"], 100) is df
    assert base.dealt(df, ["k"], 100, 10).rdd.getNumPartitions() == 10
    rev = make_revisions([(n, f"2020-01-{n % 28 + 1:02}", "x") for n in range(1, 200)])
    ch = make_changes([(n, f"/p{n % 7}", "M", 1, 0) for n in range(1, 200)])
    plain = rows(H.file_temperature(rev, ch))
    monkeypatch.setattr(H, "dealt", lambda d, keys, n: base.dealt(d, keys, n, 10))
    many = H.file_temperature(rev, ch)
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert rows(many) == plain
