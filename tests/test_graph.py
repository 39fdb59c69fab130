"""Graph measures against direct computations on small random graphs."""

from __future__ import annotations

import itertools
import math
import random
from collections import deque

import pytest
from conftest import rows
from pyspark.sql import functions as F

from revtide.operators import edges as E
from revtide.operators import graph as G

SCHEMA = "src string, dst string, weight double"


def random_graph(seed, n=14, m=22):
    rnd = random.Random(seed)
    pairs = rnd.sample(list(itertools.combinations(range(n), 2)), m)
    return [(f"n{a:02}", f"n{b:02}", float(rnd.randint(1, 5))) for a, b in pairs]


def neighbours(edges):
    adj = {}
    for a, b, _ in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def bfs(adj, s):
    d, q = {s: 0}, deque([s])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in d:
                d[v] = d[u] + 1
                q.append(v)
    return d


def components(adj):
    seen, out = set(), []
    for u in sorted(adj):
        if u not in seen:
            c = set(bfs(adj, u))
            seen |= c
            out.append(c)
    return out


@pytest.fixture(params=[1, 2, 3])
def graph(request, spark):
    e = random_graph(request.param)
    return e, spark.createDataFrame(e, SCHEMA)


def test_components(graph):
    e, df = graph
    want = {u: min(c) for c in components(neighbours(e)) for u in c}
    assert {r.node: r.component for r in G.connected_components(df).collect()} == want


def test_long_path_components(spark):
    e = [(f"p{i:03}", f"p{i + 1:03}", 1.0) for i in range(60)] + [("q1", "q2", 1.0)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(e, SCHEMA)).collect()}
    assert len(got) == 63 and set(got.values()) == {"p000", "q1"}
    inside = G.largest_component(spark.createDataFrame(e, SCHEMA))
    assert inside.count() == 60


def test_closeness_and_eccentricity(graph):
    e, df = graph
    adj = neighbours(e)
    n = len(adj)
    want, ecc = {}, {}
    for u in adj:
        d = bfs(adj, u)
        ecc[u] = max(d.values())
        want[u] = (len(d) - 1) / sum(d.values()) * (len(d) - 1) / (n - 1)
    got = {r.node: r.closeness for r in G.closeness_centrality(df).collect()}
    assert got == {u: pytest.approx(v) for u, v in want.items()}
    assert {r.node: r.eccentricity for r in G.eccentricity(df).collect()} == ecc
    stats = G.graph_stats(df).first()
    assert (stats.n_nodes, stats.n_edges, stats.radius, stats.diameter) == (n, len(e), min(ecc.values()), max(ecc.values()))
    assert {r.node for r in G.graph_center(df).collect()} == {u for u in ecc if ecc[u] == min(ecc.values())}


def test_weighted_distances(graph):
    e, df = graph
    nodes = sorted(neighbours(e))
    d = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for a, b, w in e:
        d[a, b] = d[b, a] = w
    for k, i, j in itertools.product(nodes, nodes, nodes):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    got = {(r.source, r.node): r.distance for r in G.shortest_paths(df, "weight").collect()}
    assert got == {k: v for k, v in d.items() if v < math.inf}


def test_betweenness(graph):
    e, df = graph
    adj = neighbours(e)
    nodes = sorted(adj)
    n = len(nodes)
    dist = {u: bfs(adj, u) for u in nodes}

    def count(s, t):
        if s == t:
            return 1
        return sum(count(s, v) for v in adj[t] if dist[s].get(v) == dist[s][t] - 1)

    node_b = dict.fromkeys(nodes, 0.0)
    edge_b = {tuple(sorted((a, b))): 0.0 for a, b, _ in e}
    for s in nodes:
        for t in nodes:
            if s == t or t not in dist[s]:
                continue
            total = count(s, t)
            for v in nodes:
                if v not in (s, t) and v in dist[s] and dist[s][v] + dist[v].get(t, 99) == dist[s][t]:
                    node_b[v] += count(s, v) * count(v, t) / total
            for a, b in edge_b:
                for x, y in ((a, b), (b, a)):
                    if x in dist[s] and t in dist[y] and dist[s][x] + 1 + dist[y][t] == dist[s][t]:
                        edge_b[a, b] += count(s, x) * count(y, t) / total
    got = {r.node: r.betweenness for r in G.betweenness(df).collect()}
    assert got == {u: pytest.approx(v / ((n - 1) * (n - 2))) for u, v in node_b.items()}
    got = {(r.src, r.dst): r.betweenness for r in G.edge_betweenness(df).collect()}
    assert got == {k: pytest.approx(v / (n * (n - 1))) for k, v in edge_b.items()}


def test_k_core(graph):
    e, df = graph
    adj = neighbours(e)
    while True:
        weak = [u for u in adj if len(adj[u]) < 3]
        if not weak:
            break
        for u in weak:
            for v in adj.pop(u):
                if v in adj:
                    adj[v].discard(u)
    want = sorted((a, b) for a, b, _ in e if a in adj and b in adj)
    assert rows(G.k_core(df, 3), "src", "dst") == want


def test_spanning_tree(graph):
    e, df = graph
    parent = {u: u for u in neighbours(e)}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    want = []
    for w, a, b in sorted((w, a, b) for a, b, w in e):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.append((a, b, w))
    assert rows(G.minimum_spanning_tree(df), "src", "dst", "weight") == sorted(want)


def test_trim(spark):
    # two triangles joined by one bridge: only the bridge is above the limit
    e = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0)]
    e += [("x", "y", 1.0), ("y", "z", 1.0)]
    kept = rows(G.trim_by_edge_betweenness(spark.createDataFrame(e, SCHEMA)), "src", "dst")
    assert ("c", "d") not in kept and len(kept) == len(e) - 1


def test_blocked_pairs_are_complete(make_changes):
    log = [(1, f"/f{i:03}", "M") for i in range(60)] + [(1, "/f000", "M"), (2, "/f001", "M"), (2, "/f002", "M")]
    ch = make_changes(log)
    whole = rows(E.cochange_edges(ch))
    assert len(whole) == 60 * 59 // 2
    assert rows(E.cochange_edges(ch, block=7)) == whole
    assert dict(((a, b), w) for a, b, w in whole)["/f001", "/f002"] == 2.0
    assert dict(((a, b), w) for a, b, w in whole)["/f000", "/f001"] == 2.0


def _coauthor_log(seed, n=300):
    rnd = random.Random(seed)
    revs = [(r, "2020-01-01", rnd.choice("abcde")) for r in range(1, n)]
    chs = [(r, p, "M", rnd.randrange(0, 9), 0) for r, _, _ in revs for p in rnd.sample(["/x", "/y", "/z"], rnd.randrange(1, 3))]
    return revs, chs


def test_coauthors(make_revisions, make_changes):
    revs, chs = _coauthor_log(5)
    who = {r: a for r, _, a in revs}
    want = {}
    for p in ("/x", "/y", "/z"):
        seen = []
        for r, q, _, loc, _ in chs:
            if q == p and loc > 0:
                for a in seen:
                    if a != who[r]:
                        want[who[r], a] = want.get((who[r], a), 0) + loc
                if who[r] not in seen:
                    seen.append(who[r])
    got = {(r.src, r.dst): r.weight for r in E.coauthor_edges(make_revisions(revs), make_changes(chs)).collect()}
    assert got == want


def test_coauthors_small_case(make_revisions, make_changes):
    rev = make_revisions([(1, "2020-01-01", "x"), (2, "2020-01-02", "y"), (3, "2020-01-03", "x")])
    ch = make_changes([(1, "/p", "A", 5, 0), (2, "/p", "M", 3, 0), (3, "/p", "M", 2, 0)])
    assert rows(E.coauthor_edges(rev, ch)) == [("x", "y", 2.0), ("y", "x", 3.0)]
    assert rows(E.coauthor_matrix(rev, ch)) == [("x", "x", 5 + 7), ("x", "y", 3), ("y", "x", 5), ("y", "y", 3)]


@pytest.mark.parametrize("direct", [0, 150, 10_000])
def test_coauthor_matrix(make_revisions, make_changes, direct):
    revs, chs = _coauthor_log(9)
    who = {r: a for r, _, a in revs}
    want = {}
    for r, p, _, _, _ in chs:
        for r2, p2, _, loc, _ in chs:
            if p2 == p and r2 <= r:
                want[who[r], who[r2]] = want.get((who[r], who[r2]), 0) + loc
    got = {(x.src, x.dst): x.weight for x in E.coauthor_matrix(make_revisions(revs), make_changes(chs), direct_rows=direct).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_networks_drop_unknown_and_light_edges(make_revisions, make_changes):
    from revtide.plans.networks import author_network

    rev = make_revisions([(1, "2020-01-01", "a"), (2, "2020-01-01", "a"), (3, "2020-01-01", "unknown"), (4, "2020-01-01", "unknown"), (5, "2020-01-01", "b")])
    ch = make_changes([(1, "/p", "A"), (2, "/p", "M"), (3, "/p", "M"), (4, "/p", "M"), (5, "/p", "M")])
    assert rows(author_network(rev, ch)) == [("a", "/p", pytest.approx(1 / math.log(2)))]


def test_treemap(spark):
    from revtide.operators.treemap import path_treemap

    e = [("/t/a/x", "/t/a/y", 1.0), ("/t/a/y", "/t/b/z", 1.0), ("/o/k", "/o/l", 1.0)]
    counts = spark.createDataFrame([("/t/a/x", 2), ("/t/a/y", 3), ("/t/b/z", 4), ("/o/k", 1), ("/o/l", 1)], "changedpath string, n_changes long")
    out = {r.node: r for r in path_treemap(spark.createDataFrame(e, SCHEMA), counts, "/", 2).collect()}
    assert out["Root"]["size"] == 9
    assert out["Root/subgraph 1/t/a"]["size"] == 5
    assert out["Root/subgraph 1/t/a/y"].centrality == pytest.approx(1.0)
    assert out["Root/subgraph 1/t/a/x"].centrality == pytest.approx(2 / 3)
    assert out["Root/subgraph 1/t/a/x"].parent == "Root/subgraph 1/t/a"
    assert not any("/o" in n for n in out)


def test_bounded_hops(spark):
    e = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)]
    got = rows(G.hop_profile(spark.createDataFrame(e, SCHEMA), max_hops=1))
    assert got == [("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 3), ("c", 0, 1), ("c", 1, 3), ("d", 0, 1), ("d", 1, 2)]


def test_parallel_edges_count_with_the_least_length(spark):
    rows = [("a", "b", 3.0), ("b", "a", 1.0), ("b", "c", 2.0), ("b", "c", 5.0), ("c", "c", 0.5)]
    for order in (rows, rows[::-1]):
        links = G.both_ways(spark.createDataFrame(order, "src string, dst string, weight double"), "weight")
        assert {tuple(r) for r in links.collect()} == {("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("c", "b", 2.0)}


def test_measures_in_batches(graph):
    """Batches of sources add up to what all give at once."""
    _, df = graph
    assert rows(G.hop_profile(df, batch=3)) == rows(G.hop_profile(df))
    whole = {r.node: r.betweenness for r in G.betweenness(df).collect()}
    assert {r.node: r.betweenness for r in G.betweenness(df, pair_rows=60).collect()} == {k: pytest.approx(v) for k, v in whole.items()}
    none = df.limit(0)
    assert G.hop_profile(none).count() == G.betweenness(none).count() == G.edge_betweenness(none).count() == 0


def hung(links, top):
    """(parent, root, depth, size) of each node of a tree that hangs from ``top``."""
    adj = neighbours([(a, b, 0) for a, b in links])
    parent, order = {top: None}, [top]
    for u in order:
        for v in adj[u]:
            if v not in parent:
                parent[v] = u
                order.append(v)
    size, depth = dict.fromkeys(order, 1), {top: 0}
    for u in order[1:]:
        depth[u] = depth[parent[u]] + 1
    for u in reversed(order[1:]):
        size[parent[u]] += size[u]
    return {u: (parent[u], top, depth[u], size[u]) for u in order}


def test_rooted_forest(spark):
    """A chain, a star, random trees and a pair; some with a root that is asked for."""
    rnd = random.Random(8)
    trees = [
        [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)],
        [(f"s{i:03}", "s_hub") for i in range(120)],
        [(f"r{i:02}", f"r{rnd.randrange(i):02}") for i in range(1, 60)],
        [("p1", "p0")],
    ]
    df = spark.createDataFrame([e for t in trees for e in t], "src string, dst string")
    for asked in ({}, {1: "s_hub", 2: "r30"}):
        roots = spark.createDataFrame([(r,) for r in asked.values()], "node string") if asked else None
        want = {}
        for i, t in enumerate(trees):
            want |= hung(t, asked.get(i, min(x for e in t for x in e)))
        got = {r.node: (r.parent, r.root, r.depth, r["size"]) for r in G.root_forest(df, roots).collect()}
        assert got == want
    assert G.root_forest(df.limit(0)).count() == 0


def test_betweenness_tree(graph):
    e, df = graph
    got = {r.node: r for r in G.betweenness_tree(df, "weight").collect()}
    scores = {(r.src, r.dst): round(r.betweenness, 6) for r in G.edge_betweenness(df, normalized=False).collect()}
    parent = {u: u for u in neighbours(e)}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    links = []
    for _, a, b in sorted((w, a, b) for (a, b), w in scores.items()):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            links.append((a, b))
    between = {r.node: r.betweenness for r in G.betweenness(df).collect()}
    close = {r.node: r.closeness for r in G.closeness_centrality(df, "weight").collect()}
    parts = {}
    for u in parent:
        parts.setdefault(find(u), []).append(u)
    want = {}
    for part in parts.values():
        top = min(part, key=lambda u: (-round(between[u], 9), u))
        want |= hung([x for x in links if x[0] in part], top) if len(part) > 1 else {}
    assert {u: (r.parent, r.root, r.depth, r["size"]) for u, r in got.items()} == want
    for u, r in got.items():
        assert r.betweenness == pytest.approx(between[u]) and r.closeness == pytest.approx(close[u])


def test_closeness_on_every_day(make_revisions, make_changes):
    """All days at once against a walk through each day's graph; authors in batches of one."""
    from revtide.operators.timeline import closeness_over_time

    rnd = random.Random(4)
    log = [(i, f"2020-01-{1 + i // 3:02} 10:00:00", rnd.choice("abcd")) for i in range(1, 70)]
    files = [(i, f"/f{rnd.randrange(12)}", "M") for i, _, _ in log if rnd.random() < 0.9]
    when = {i: (d[:10], a) for i, d, a in log}
    days = sorted({when[i][0] for i, _, _ in files})
    want = {}
    for day in days:
        adj = {}
        for i, path, _ in files:
            if when[i][0] <= day:
                adj.setdefault("a:" + when[i][1], set()).add("f:" + path)
                adj.setdefault("f:" + path, set()).add("a:" + when[i][1])
        for u in adj:
            if u.startswith("a:"):
                far = bfs(adj, u)
                r, d = len(far) - 1, sum(far.values())
                want[u[2:], day] = r / d * r / (len(adj) - 1)
    for pair_rows in (10_000_000, 1):
        table = closeness_over_time(make_revisions(log), make_changes(files), pair_rows=pair_rows)
        assert {(r.author, str(r.day)): r.closeness for r in table.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_core_peels_in_rounds_and_keeps_parallel_edges(spark):
    """A chain hangs from a clique of four; links given twice or backwards count once."""
    clique = [(a, b, 1.0) for a, b in itertools.combinations("abcd", 2)]
    e = [*clique, ("b", "a", 2.0), ("a", "b", 1.0), ("a", "a", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "e", 1.0), (None, "a", 1.0)]
    got = rows(G.k_core(spark.createDataFrame(e, SCHEMA), 3))
    assert got == sorted([*clique, ("a", "b", 1.0), ("b", "a", 2.0)])
    assert G.k_core(spark.createDataFrame(e, SCHEMA), 4).count() == 0


def test_hops_over_several_pieces_and_blocks(spark):
    """A ring longer than a block of nodes and a piece of sources, a hub with many leaves, and a pair."""
    n = 4500
    ring = spark.range(n).selectExpr("concat('r', id) AS src", f"concat('r', (id + 1) % {n}) AS dst", "1.0D AS weight")
    star = spark.range(5000).selectExpr("'hub' AS src", "concat('s', id) AS dst", "1.0D AS weight")
    e = ring.unionByName(star).unionByName(spark.createDataFrame([("p", "q", 1.0)], SCHEMA))
    found = G.hop_profile(e, max_hops=2).groupBy(F.substring("node", 1, 1).alias("kind"), "hops", "reached").count()
    want = [("h", 0, 1, 1), ("h", 1, 5001, 1), ("p", 0, 1, 1), ("p", 1, 2, 1), ("q", 0, 1, 1), ("q", 1, 2, 1)]
    want += [("r", 0, 1, n), ("r", 1, 3, n), ("r", 2, 5, n), ("s", 0, 1, 5000), ("s", 1, 2, 5000), ("s", 2, 5001, 5000)]
    assert rows(found) == sorted(want)
    assert len(G._batches(spark.range(5000).selectExpr("id AS _id", "1 AS component"), spark.range(9).selectExpr("1 AS component"), 5000, None, 9)) == 3


def test_hops_are_sent_once_to_a_block(spark):
    """What a step moves does not grow with a node's links: 200 neighbours in one block cost one row."""
    e = spark.range(200).selectExpr("'hub' AS src", "concat('s', id) AS dst", "1.0D AS weight")
    ways = []
    spread = G._spread_bits
    try:
        G._spread_bits = lambda w, *a: (ways.append(w.count()), spread(w, *a))[1]
        assert G.hop_profile(e).count() == 2 + 3 * 200
    finally:
        G._spread_bits = spread
    assert ways == [1 + 200]


def test_hops_in_tasks_as_in_rounds(spark, monkeypatch):
    """Components that fit a task give the rows that rounds of steps give: chunks of sources, shared bins, hubs, loops, lone nodes."""
    from revtide.operators import hops

    for module in (G, hops):
        monkeypatch.setattr(module, "TASK_BITS", 64)
    monkeypatch.setattr(hops, "ROWS", 7)
    monkeypatch.setattr(hops, "HUB", 9)
    rng = random.Random(3)
    e = [(f"m{rng.randrange(200)}", f"m{rng.randrange(200)}") for _ in range(420)]
    e += [("hub", f"s{i}") for i in range(70)] + [(f"c{i}", f"c{i + 1}") for i in range(8)]
    e += [(f"p{i}", f"q{i}") for i in range(90)] + [("l", "l"), (None, "x"), (None, None), ("p1", "q1"), ("q1", "p1")]
    df = spark.createDataFrame(e, "src string, dst string")
    whole = rows(G.hop_profile(df))
    assert whole == rows(G.hop_profile(df, task_nodes=0)) == rows(G.hop_profile(df, task_nodes=80))
    assert (None, 0, 1) in whole and ("l", 0, 1) in whole and ("x", 0, 1) in whole and ("hub", 1, 71) in whole and ("c0", 8, 9) in whole
    assert rows(G.hop_profile(df, max_hops=3)) == rows(G.hop_profile(df, max_hops=3, task_links=100)) == [r for r in whole if r[1] <= 3]


def test_hops_of_components_that_fit_a_task_take_no_rounds(spark, monkeypatch):
    """A ring of 60 nodes takes 30 steps; they are one job's, not a few jobs each."""
    kept = []
    for name in ("cut_lineage", "store"):
        monkeypatch.setattr(G, name, lambda df, f=getattr(G, name): (kept.append(1), f(df))[1])
    ring = spark.range(60).selectExpr("concat('r', id) AS src", "concat('r', (id + 1) % 60) AS dst")
    found = G.eccentricity(ring).select("eccentricity").distinct().collect()
    assert [r[0] for r in found] == [30] and len(kept) < 30


def test_walks_of_authors_move_numbers_only(spark, make_revisions, make_changes, monkeypatch):
    """Names stay out of the steps, and a step joins links in the one direction that it can go."""
    from revtide.operators import timeline

    seen = []
    walk = timeline._author_steps
    monkeypatch.setattr(timeline, "_author_steps", lambda links, own: (seen.append(dict(links.dtypes)), walk(links, own))[1])
    rev = make_revisions([(1, "2020-01-01", "a"), (2, "2020-01-02", "b"), (3, "2020-01-03", "b"), (4, "2020-01-04", None)])
    ch = make_changes([(1, "/x", "A"), (2, "/y", "A"), (3, "/x", "M"), (4, "/z", "A")])
    got = {(r.author, r.day.day): r.closeness for r in timeline.closeness_over_time(rev, ch).collect() if r.author}
    assert got[("a", 1)] == 1.0 and got[("a", 3)] == pytest.approx(3 / 6)
    assert seen == [{"a": "bigint", "f": "bigint", "day": "date"}]


def _odd_log(make_revisions, make_changes):
    import random

    r = random.Random(5)
    days = "2024-01-01 00:00:00"
    revs = [(n, days, r.choice(["a", "b", "c", "", None])) for n in range(1, 60)] + [(7, days, "b"), (8, days, None)]
    chs = [(r.randint(1, 62), r.choice(["/p", "/q", "/r", None]), "M", r.choice([0, 1, 5, 9]), 0) for _ in range(150)]
    chs += chs[:20]
    return make_revisions(revs), make_changes([(n, p or "/none", *x) for n, p, *x in chs]).withColumn(
        "changedpath", F.when(F.col("changedpath") != "/none", F.col("changedpath"))
    ), revs, chs


@pytest.mark.parametrize("busy_rows", [1, 1000])
def test_coauthor_edges_of_busy_and_other_paths(make_revisions, make_changes, monkeypatch, busy_rows):
    monkeypatch.setattr(E, "DIRECT_ROWS", 3)
    rev, ch, revs, chs = _odd_log(make_revisions, make_changes)
    mine = [(p, a or "Unknown", n, x) for n, p, _, x, _ in chs if p and x > 0 for m, _, a in revs if m == n]
    first = {}
    for p, a, n, _ in mine:
        first[p, a] = min(n, first.get((p, a), n))
    want = {}
    for p, a, n, x in mine:
        for (q, b), f in first.items():
            if q == p and b != a and f <= n:
                want[a, b] = want.get((a, b), 0) + x
    got = {(x.src, x.dst): x.weight for x in E.coauthor_edges(rev, ch, busy_rows=busy_rows).collect()}
    assert got == {k: w for k, w in want.items() if w > 1}


@pytest.mark.parametrize("busy_rows", [1, 1000])
@pytest.mark.parametrize("direct", [1, 4, 500])
def test_coauthor_matrix_of_busy_and_other_paths(make_revisions, make_changes, direct, busy_rows):
    rev, ch, revs, chs = _odd_log(make_revisions, make_changes)
    mine = [(p, a, n, x, i) for n, p, _, x, _ in chs if p for i, (m, _, a) in enumerate(revs) if m == n]
    # Rows of one revision given twice meet each other only on paths of few rows.
    size = {p: len({(n, i) for q, _, n, _, i in mine if q == p}) for p, *_ in mine}
    want = {}
    for p, a, n, _, i in mine:
        for q, b, m, x, j in mine:
            if p == q and (m < n or m == n and (i == j or size[p] <= direct and busy_rows > 1)):
                want[a, b] = want.get((a, b), 0) + x
    got = {(x.src, x.dst): x.weight for x in E.coauthor_matrix(rev, ch, direct_rows=direct, busy_rows=busy_rows).collect()}
    assert got == want


def test_coauthor_steps_move_narrow_rows(make_revisions, make_changes):
    """Paths go once to their task; what meets are numbers, and no authors are listed per row."""
    rev, ch, *_ = _odd_log(make_revisions, make_changes)
    for df in (E.coauthor_edges(rev, ch), E.coauthor_matrix(rev, ch)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "changedpath" not in plan


@pytest.mark.parametrize("block", [1, 3, 512])
def test_pairs_of_small_and_large_revisions(make_revisions, make_changes, block):
    r = random.Random(3)
    chs = [(r.randint(1, 12), f"/{r.choice('abcdefghij')}", "M", 1, 0) for _ in range(90)]
    rev, ch = make_revisions([(n, "2020-01-01", "x") for n in range(1, 13)]), make_changes(chs)
    want = {}
    for n, p, *_ in chs:
        for m, q, *_ in chs:
            if n == m and p < q:
                want[p, q] = want.get((p, q), 0) + 1
    assert {(x.src, x.dst): x.weight for x in E.cochange_edges(ch, block=block).collect()} == want
    heavy = E.cochange_edges_decayed(rev, ch, block=block, min_weight=40.0)
    assert {(x.src, x.dst): x.weight for x in heavy.collect()} == {k: 10.0 * w for k, w in want.items() if w >= 4}


def test_changes_move_once_to_their_revision(make_changes):
    """Rows are dealt by revision alone, so sizes and small revisions' pairs need no shuffle of their own."""
    plan = E.cochange_edges(make_changes([(1, "/a", "A"), (1, "/b", "A")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Final Plan ==")[0].count("hashpartitioning(revno#") >= 1
    assert "hashpartitioning(changedpath" not in plan and ", changedpath#" not in "".join(x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "hashpartitioning(" in x)
