from __future__ import annotations

import os
import random

from conftest import rows
from pyspark.sql import functions as F

from revtide.operators import dirstate as DS
from revtide.operators import logprep as L
from revtide.operators import text as X
from revtide.session import ensure_checkpoint_dir

DIFF = """Index: trunk/a.c
===================================================================
--- trunk/a.c\t(revision 1)
+++ trunk/a.c\t(revision 2)
@@ -1,2 +1,3 @@
-old
+new
+newer
 same
Index: trunk/b.c
===================================================================
--- trunk/b.c\t(revision 1)
+++ trunk/b.c\t(revision 2)
@@ -1 +0,0 @@
-gone
--- looks like a header
Property changes on: trunk/c.c
___________________________________________________________________
+ not a line
"""


def test_diff_counts(spark):
    df = spark.createDataFrame([(7, DIFF), (8, "no header\n+x\n")], "revno long, diff string")
    assert rows(L.diff_line_counts(df), "revno", "changedpath", "linesadded", "linesdeleted") == [
        (7, "/trunk/a.c", 2, 1), (7, "/trunk/b.c", 0, 1), (7, "/trunk/c.c", 0, 0),
    ]


def test_diff_last_block_wins(spark):
    text = "Index: a\n+1\nIndex: a\n+1\n+2\nProperty changes on: a\n+3\n"
    df = spark.createDataFrame([(1, text)], "revno long, diff string")
    assert rows(L.diff_line_counts(df), "changedpath", "linesadded") == [("/a", 2)]


def test_copy_source_is_inherited(make_changes):
    ch = make_changes([
        (5, "/b/", "A", 0, 0, "/a/", 3), (5, "/b/sub/", "A", 0, 0, "/other/", 4),
        (5, "/b/x", "M"), (5, "/b/sub/y", "D"), (5, "/bc/z", "M"), (5, "/b/n", "A"), (6, "/b/x", "M"),
    ])
    got = {(r.revno, r.changedpath): (r.copyfrompath, r.copyfromrev) for r in L.inherit_copyfrom(ch).collect()}
    assert got[(5, "/b/x")] == ("/a/x", 3)
    assert got[(5, "/b/sub/y")] == ("/other/y", 4)
    assert got[(5, "/bc/z")] == got[(5, "/b/n")] == got[(6, "/b/x")] == (None, None)
    assert got[(5, "/b/")] == ("/a/", 3)
    assert len(got) == 7


def _tree():
    return [
        (1, "/trunk/a", "A", 10, 0), (1, "/trunk/b", "A", 5, 0), (1, "/trunk/c", "A", 4, 0),
        (2, "/trunk/b", "D", 0, 5), (2, "/trunk/c", "D", 0, 4),
        (3, "/trunk/c", "A", 6, 0), (3, "/trunk/a", "M", 2, 1),
        (4, "/trunk/a", "M", 100, 0),
        (5, "/tags/1/", "A", 0, 0, "/trunk/", 3),
        (6, "/tags/1/", "D"),
        (7, "/tags/2/", "A", 0, 0, "/tags/1/", 5),
    ]


def test_directory_copies_and_deletes(make_changes):
    out = DS.expand_directories(make_changes(_tree()))
    assert rows(out, "revno", "changedpath", "changetype", "linesadded", "linesdeleted") == [
        (5, "/tags/1/a", "A", 11, 0), (5, "/tags/1/c", "A", 6, 0),
        (6, "/tags/1/a", "D", 0, 11), (6, "/tags/1/c", "D", 0, 6),
        (7, "/tags/2/a", "A", 11, 0), (7, "/tags/2/c", "A", 6, 0),
    ]
    assert rows(out.filter("revno = 7"), "copyfrompath", "copyfromrev") == [("/tags/1/a", 5), ("/tags/1/c", 5)]


def test_directory_copies_keep_only_their_result(spark, make_changes):
    """Rounds delete what they stored: only the result stays in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = DS.expand_directories(make_changes(_tree()))
    assert out.count() == 6 and len(set(os.listdir(folder)) - before) == 1


def test_copy_respects_the_same_revision(make_changes):
    ch = make_changes([
        (1, "/t/a", "A", 1, 0), (1, "/t/d/x", "A", 2, 0), (1, "/t/d/y", "A", 3, 0), (1, "/old/z", "A", 9, 0),
        (2, "/b/", "A", 0, 0, "/t/", 1), (2, "/b/a", "M", 5, 0), (2, "/b/d/", "D"), (2, "/old/", "D"),
        (3, "/c/", "A", 0, 0, "/b/", 2),
    ])
    out = DS.expand_directories(ch)
    # /b/a has a row of its own, /b/d/ goes with its directory, /old/ is deleted for real
    assert rows(out, "revno", "changedpath", "changetype", "linesdeleted") == [(2, "/old/z", "D", 9)]


def test_long_chain_of_copies(make_changes):
    log = [(1, "/d0/x", "A", 3, 0)] + [(i + 1, f"/d{i}/", "A", 0, 0, f"/d{i - 1}/", i) for i in range(1, 6)]
    out = DS.expand_directories(make_changes(log))
    assert rows(out, "revno", "changedpath", "linesadded") == [(i + 1, f"/d{i}/x", 3) for i in range(1, 6)]


def test_live_files(make_changes):
    ch = make_changes(_tree())
    assert rows(DS.live_files(ch, "/trunk/", 2), "changedpath") == [("/trunk/a",)]
    assert rows(DS.live_files(ch, "/trunk/", 4), "changedpath", "addrevno") == [("/trunk/a", 1), ("/trunk/c", 3)]


def test_expansion_per_repository(make_changes):
    a = make_changes(_tree()).withColumn("repo_id", F.lit(1))
    b = make_changes([(1, "/trunk/q", "A", 1, 0), (5, "/tags/9/", "A", 0, 0, "/trunk/", 2)]).withColumn("repo_id", F.lit(2))
    out = DS.expand_directories(a.unionByName(b), ["repo_id"])
    assert rows(out.filter("repo_id = 2"), "changedpath") == [("/tags/9/q",)]
    assert out.filter("repo_id = 1").count() == 6


def test_line_count_resolution(spark, make_changes):
    ch = make_changes([(2, "/n.c", "A"), (2, "/g.c", "D"), (2, "/r.c", "R"), (2, "/s.c", "R"), (2, "/m.c", "M"), (2, "/p.png", "A"), (2, "/d/", "A")])
    lines = spark.createDataFrame([(2, "/n.c", 7), (1, "/g.c", 9), (2, "/r.c", 4), (2, "/p.png", 3)], "revno long, changedpath string, lines long")
    diffs = spark.createDataFrame([(2, "/s.c", 2, 1), (2, "/m.c", 3, 4)], "revno long, changedpath string, linesadded long, linesdeleted long")
    got = {r.changedpath: (r.linesadded, r.linesdeleted) for r in L.resolve_line_counts(ch, lines, diffs).collect()}
    assert got == {"/n.c": (7, 0), "/g.c": (0, 9), "/r.c": (4, 0), "/s.c": (2, 1), "/m.c": (3, 4), "/p.png": (0, 0), "/d/": (0, 0)}


def test_path_ids_are_dense(spark):
    old = spark.createDataFrame([(1, "/a"), (2, "/b")], "path_id long, path string")
    new = spark.createDataFrame([(f"/n{i}",) for i in range(50)] + [("/a",), (None,), ("",)], "path string")
    out = L.encode_paths(old, new)
    assert sorted(r.path_id for r in out.collect()) == list(range(1, 53))
    assert out.filter("path = '/a'").first().path_id == 1


def test_words(make_revisions):
    rev = make_revisions([(1, "2020-01-01", "a", "Fix fixed fixing another a 123abc\tFIX"), (2, "2020-01-01", "a", "islands fix")])
    assert rows(X.word_frequency(rev, 1)) == [("fix", 5)]
    got = dict(rows(X.word_frequency(rev, 1, "exact")))
    assert got == {"fix": 5, "another": 1, "islands": 1, "123abc": 1}


def test_stem_chains(spark):
    df = spark.createDataFrame([("add", 1), ("adds", 2), ("addsing", 4), ("addsinged", 8), ("bus", 3), ("buses", 1), ("xs", 5)], "word string, freq long")
    # "buses" loses "s" first; without that stem it tries "es"
    assert rows(X.merge_stems(df)) == [("add", 15), ("bus", 4), ("xs", 5)]


def _simulate(log):
    """The rows of directory copies and deletes, revision by revision, from all rows before."""
    real = [(r[0], r[1], r[2], r[3], r[4]) for r in log if not r[1].endswith("/")]
    made = []
    for rev in sorted({r[0] for r in log}):
        ops = [r for r in log if r[0] == rev and r[1].endswith("/")]

        def state(directory, read, rev=rev):
            seen = {}
            rows = [r for r in real if r[0] <= read] + [r for r in made if r[0] <= min(read, rev - 1)]
            for r in rows:
                if r[1].startswith(directory) and r[1] != directory:
                    add, gone, net = seen.get(r[1], (None, None, 0))
                    if r[2] in ("A", "R"):
                        add = max(add or -1, r[0])
                    if r[2] == "D":
                        gone = max(gone or -1, r[0])
                    seen[r[1]] = (add, gone, net + r[3] - r[4])
            return seen

        new, used = [], set()
        deletes = {r[1] for r in ops if r[2] == "D"}
        targets = {}
        for r in {(r[1], r[5], r[6]) for r in ops if len(r) > 5 and r[5]}:
            for path, (add, gone, net) in state(r[1], r[2]).items():
                targets.setdefault(r[0] + path[len(r[1]) :], []).append((add, len(r[0]), path, gone, net, r[2]))
        own = {r[1] for r in real if r[0] == rev}
        for target, found in targets.items():
            added = [f for f in found if f[0] is not None]
            if not added or target in own:
                continue
            best = max(added, key=lambda f: f[:3])
            if best[0] < max([f[3] for f in found if f[3] is not None], default=-1):
                continue
            over = {d for d in deletes if target.startswith(d)}
            used |= over
            if not over:
                new.append((rev, target, "A", max(best[4], 0), 0))
        for d in deletes - used:
            for path, (add, gone, net) in state(d, rev).items():
                if add is not None and add >= (-1 if gone is None else gone):
                    new.append((rev, path, "D", 0, max(net, 0)))
        made += new
    return sorted(set(made))


def test_directories_against_simulation(make_changes):
    """Copies of copies, deletes, files that come back, many revisions of a file, two sources for a target."""
    for seed in range(2):
        r = random.Random(seed)
        dirs = ["/a/", "/b/", "/a/x/", "/c/", "/d/", "/c/x/"]
        log = []
        for rev in range(1, 40):
            for _ in range(r.randint(1, 3)):
                path = r.choice(dirs) + r.choice("fgh")
                if not any(x[:2] == (rev, path) for x in log):
                    log.append((rev, path, r.choice("AAMMDR"), r.randint(0, 9), r.randint(0, 3)))
            if rev % 4 == 0:
                src, dst = r.sample(dirs, 2)
                if not dst.startswith(src):
                    log.append((rev, dst, "A", 0, 0, src, rev - r.randint(1, 5)))
                if r.random() < 0.4:
                    log.append((rev, r.choice([d for d in dirs if d != dst]), "D", 0, 0))
        got = rows(DS.expand_directories(make_changes(log)), "revno", "changedpath", "changetype", "linesadded", "linesdeleted")
        assert got == _simulate(log)


def test_intervals_and_lookup(make_changes):
    r = random.Random(5)
    log = [(rev, f"/d/{r.choice('ab') if rev % 3 else 'hot'}", r.choice("AMDR"), r.randint(0, 9), r.randint(0, 9)) for rev in r.sample(range(1, 400), 150)]
    changes = make_changes(log)
    table = DS.path_intervals(changes, shares=16)
    found = {(x.changedpath, x.valid_from): x for x in table.collect()}
    by = {}
    for x in sorted(log):
        by.setdefault(x[1], []).append(x)

    def known(path, rev):
        seen = [x for x in by[path] if x[0] <= rev]
        last = lambda kinds: max((x[0] for x in seen if x[2] in kinds), default=None)
        return (last("AR"), last("D"), sum(x[3] - x[4] for x in seen))

    assert len(found) == len(log)
    for path, own in by.items():
        for x, then in zip(own, [*own[1:], None], strict=True):
            got = found[path, x[0]]
            assert (got.addrevno, got.delrevno, got.net_lines) == known(path, x[0])
            assert got.valid_to == (then[0] - 1 if then else None)
    asked = changes.sparkSession.createDataFrame([(p, rev, rev * 7) for p in by for rev in range(0, 410, 9)], "changedpath string, at long, tag long")
    got = {(x.changedpath, x.at): (x.addrevno, x.delrevno, x.net_lines) for x in DS.as_of(table, asked, "at", shares=16).collect()}
    want = {(p, rev): known(p, rev) for p in by for rev in range(0, 410, 9) if by[p][0][0] <= rev}
    assert got == want
