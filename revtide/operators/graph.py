"""Graph measures over an undirected edge table (src, dst[, weight]).

Loops checkpoint each round and stop at a fixed point. Measures over all pairs take
sources in batches, each exact, and add up what the batches give, so what is held
at once is a batch times the nodes. Hop distances are kept as bits, one per source.
Components whose links one task can hold are counted there, chunk by chunk of their
sources. In larger ones bits stand in long columns, merged by bitwise or; only pieces that
changed in the last step travel, and once to each block of neighbours rather than along each link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revtide.operators.base import dense_ids, hash_bucket
from revtide.operators.edges import nodes_of
from revtide.operators.hops import GAINS, TASK_BITS, spreader
from revtide.session import cut_lineage, drop_stored, store

#: Sources of a piece of bits, and the long columns that hold it.
PIECE_BITS, WORDS = 2048, 32
#: (link, piece) rows that a step of hop counting may handle at once.
BIT_ROWS = 16_000_000
#: Nodes and links (both ways) of a component that one task may hold.
TASK_NODES, TASK_LINKS = 200_000, 4_000_000
#: Nodes or links of small components that share a task, about.
BIN_NODES, BIN_LINKS = 65_536, 1_000_000
#: Tasks that chunks of sources are dealt to at most.
MOST_TASKS = 4096
#: (source, node) rows that path counting may hold at once.
PAIR_ROWS = 20_000_000


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge in both directions, loops left out; of parallel edges the least of each ``extra`` column."""
    e = edges.filter(F.col("src") != F.col("dst"))
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
            F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
        )
    ).alias("e")
    out = e.select(ends, *extra).select("e.u", "e.v", *extra)
    return out.groupBy("u", "v").agg(*(F.min(c).alias(c) for c in extra)) if extra else out.distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Share of the other nodes each node is linked to."""
    degrees = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = degrees.agg(F.count(F.lit(1))).scalar()
    return degrees.select(
        "node", "degree", F.when(n > 1, F.col("degree") / (n - 1)).otherwise(F.lit(0.0)).alias("centrality")
    )


def k_core(edges: DataFrame, k: int = 5) -> DataFrame:
    """Edges between nodes of core number at least k: peel until nothing falls off.

    A round counts the ends of edges and, in 64 bits, what neighbours' hashes leave.
    Fewer ends than k are too few, k bits are enough; only nodes between the two have
    their distinct neighbours counted. Edges move only where many nodes fall off.
    """
    current = store(edges.filter(F.col("src") != F.col("dst")))
    mark = F.expr("shiftleft(1L, CAST(pmod(xxhash64(v), 64) AS int))")
    while True:
        ways = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
        ends = current.select(ways.alias("e")).select("e.u", "e.v")
        counts = store(ends.groupBy("u").agg(F.count(F.lit(1)).alias("_n"), F.bit_count(F.bit_or(mark)).alias("_sure")).filter(F.col("_sure") < k))
        unsure = ends.join(counts.filter(F.col("_n") >= k).select("u"), "u", "left_semi").distinct()
        few = unsure.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < k)
        weak = store(counts.filter(F.col("_n") < k).select("u").unionByName(few.select("u")))
        drop_stored(counts)
        if weak.isEmpty():
            return current
        kept = current.join(weak.withColumnRenamed("u", "src"), "src", "left_anti").join(
            weak.withColumnRenamed("u", "dst"), "dst", "left_anti"
        )
        current, old = store(kept.select(*edges.columns)), current
        drop_stored(old)
        drop_stored(weak)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component), a component being named by its smallest node.

    Alternates the two star steps: link larger neighbours to the smallest one, then
    smaller neighbours to the smallest one. Rows never outnumber the edges, and the
    number of rounds grows with the logarithm of the size.
    """
    edges = cut_lineage(edges.select("src", "dst"))
    e = cut_lineage(
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )

    def signature(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    before = signature(e)
    while True:
        sym = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (
            sym.filter(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(least, "u")
            .select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        e = cut_lineage(small)
        after = signature(e)
        if after == before:
            break
        before = after
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = (nodes if nodes is not None else nodes_of(edges)).select("node")
    return alone.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest component (the smallest name breaks a tie)."""
    edges = cut_lineage(edges)
    comp = cut_lineage(connected_components(edges))
    best = component_sizes(comp).orderBy(F.col("size").desc(), "component").limit(1)
    inside = comp.join(best, "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(inside, "src", "left_semi").select(*edges.columns)


def components_min_size(edges: DataFrame, n: int = 10) -> DataFrame:
    """(component, node, size) for components of at least n nodes."""
    comp = cut_lineage(connected_components(edges))
    sizes = component_sizes(comp).filter(F.col("size") >= n)
    return comp.join(sizes, "component").select("component", "node", "size")


def hop_profile(
    edges: DataFrame,
    max_hops: int | None = None,
    batch: int | None = None,
    bit_rows: int = BIT_ROWS,
    task_nodes: int = TASK_NODES,
    task_links: int = TASK_LINKS,
) -> DataFrame:
    """(node, hops, reached): how many nodes lie within ``hops`` of each node.

    Links work both ways, so a node counts the sources that reach it. Components of up to
    ``task_nodes`` nodes and ``task_links`` links are counted within tasks, each for a
    chunk of sources. In larger ones sources come in batches, each of so many pieces that
    a step handles about ``bit_rows`` (link, piece) rows, or of ``batch`` sources, if that is
    given; what each adds per node and hop is summed. Only hops that reach new nodes are
    listed, and hop 0 always is.
    """
    edges = store(edges.select("src", "dst"))
    names = store(nodes_of(edges).select("node", F.monotonically_increasing_id().alias("_n")))
    pairs = edges.filter(F.col("src") != F.col("dst"))
    for end in ("src", "dst"):
        pairs = pairs.join(names.select(F.col("node").alias(end), F.col("_n").alias(f"_{end}")), end)
    pairs = store(pairs.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct())
    drop_stored(edges)
    comp = store(connected_components(pairs))
    alone = names.join(comp.select(F.col("node").alias("_n")), "_n", "left_anti").select("node", F.lit(0).alias("hops"), F.lit(1).cast("long").alias("reached"))
    inside = pairs.join(comp.withColumnRenamed("node", "src"), "src")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    sizes = store(sizes.join(inside.groupBy("component").agg((2 * F.count(F.lit(1))).alias("_links")), "component"))
    fits = (F.col("_size") <= task_nodes) & (F.col("_links") <= task_links) if batch is None else F.lit(False)

    gains = None
    bins, groups = _bins(sizes.filter(fits))
    if groups:
        near = store(both_ways(inside, "component").join(bins, "component").groupBy("_bin", "_chunks", "component", F.col("u").alias("_u")).agg(F.collect_list("v").alias("_to")))
        gains = _spread_bits(near, None, max_hops, groups)
        drop_stored(near)
    far = comp.join(sizes.filter(~fits).select("component"), "component", "left_semi")
    if batch is not None or not far.isEmpty():
        # Nodes of a component are numbered together: a node has no bits of other components.
        slot = hash_bucket(F.col("component").cast("string")) * 4 + F.pmod(F.xxhash64("node"), F.lit(4))
        ids = cut_lineage(dense_ids(far.withColumn("_slot", slot), F.col("_slot"), ["component", "node"], "_id", 0))
        links = both_ways(pairs).join(ids.select(F.col("node").alias("u"), F.col("_id").alias("_u"), "component"), "u")
        links = cut_lineage(links.join(ids.select(F.col("node").alias("v"), F.col("_id").alias("_v")), "v").select("_u", "_v", "component"))
        # One row per node and block of its neighbours: what a node sends goes once to each block.
        ways = links.groupBy("_u", F.expr("shiftright(_v, 12)").alias("_blk")).agg(F.collect_list("_v").alias("_to"))
        ways = cut_lineage(ways)
        for first, last in _batches(ids, links, ids.count(), batch, bit_rows):
            own = ids.filter((F.col("_id") >= first) & (F.col("_id") < last)).select("_id")
            part = _spread_bits(ways, own, max_hops).join(ids.select("_id", "node"), "_id").select("node", "hops", "gain")
            gains = part if gains is None else gains.unionByName(part)
    drop_stored(pairs)
    drop_stored(sizes)
    if gains is None:
        return alone
    total = gains.groupBy(F.col("node").alias("_n"), "hops").agg(F.sum("gain").alias("gain"))
    upto = W.partitionBy("_n").orderBy("hops").rowsBetween(W.unboundedPreceding, 0)
    summed = total.select("_n", "hops", F.sum("gain").over(upto).alias("reached"))
    return summed.join(names, "_n").select("node", "hops", "reached").unionByName(alone)


def _bins(sizes: DataFrame) -> tuple[DataFrame, int]:
    """(component, _bin, _chunks) of components that fit a task, and how many chunks there are in all.

    A component of over ``TASK_BITS`` nodes has a bin of its own; smaller ones of about
    the same size share bins of about ``BIN_NODES`` nodes, in which their bits share columns.
    """
    own = F.col("_size") > TASK_BITS
    kind = F.length(F.bin(F.col("_size") - 1))  # sizes up to the same power of two
    chunks = F.when(own, F.ceil(F.col("_size") / TASK_BITS)).otherwise(1).cast("int")
    sums = sizes.groupBy(F.when(own, -1).otherwise(kind).alias("k")).agg(
        F.sum("_size").alias("nodes"), F.sum("_links").alias("links"), F.sum(chunks).alias("chunks")
    )
    groups, bins = 0, F.lit(1)
    for k in sums.collect():  # one row per power of two
        shared = 1 + max(k["nodes"] // BIN_NODES, k["links"] // BIN_LINKS)
        groups += k["chunks"] if k["k"] < 0 else shared
        bins = bins if k["k"] < 0 else F.when(kind == k["k"], F.lit(shared)).otherwise(bins)
    shared_bin = -1 - (F.pmod(F.xxhash64("component"), bins) * 64 + kind)
    return sizes.select("component", F.when(own, F.col("component")).otherwise(shared_bin).alias("_bin"), chunks.alias("_chunks")), groups


def _batches(ids: DataFrame, links: DataFrame, n: int, batch: int | None, bit_rows: int) -> list[tuple[int, int]]:
    """Ranges of ids; the bits of a range's sources travel over about ``bit_rows`` (link, piece) rows a step."""
    if batch is not None:
        return [(a, a + batch) for a in range(0, n, batch)]
    piece = F.floor(F.col("_id") / PIECE_BITS).alias("piece")
    sizes = links.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    found = ids.select(piece, "component").distinct().join(sizes, "component", "left").groupBy("piece").agg(F.sum("_n").alias("_n"))
    out, first, load = [], 0, 0
    for p, rows in sorted((r["piece"], r["_n"] or 0) for r in found.collect()):  # one row per 2048 nodes
        if load and load + rows > bit_rows:
            out.append((first, p * PIECE_BITS))
            first, load = p * PIECE_BITS, 0
        load += rows
    return [*out, (first, n)] if n else []


def _spread_bits(ways: DataFrame, starts: DataFrame | None, max_hops: int | None, groups: int = 0) -> DataFrame:
    """(_id, hops, gain): sources of one batch that reach a node in just so many hops.

    Bits stand in ``WORDS`` long columns a piece of sources, so that they merge in hash
    aggregation. A step sends on only the pieces that the step before changed, once to
    each block of neighbours, and spreads them over the links where the block is merged.
    Without ``starts``, ``ways`` has whole components in bins, whose ``groups`` chunks of
    sources go to tasks that take all the steps by themselves: (node, hops, gain).
    """
    if starts is None:
        tasks = min(max(groups, int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
        dealt = ways.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).repartition(tasks, "_bin", "_chunk")
        return store(dealt.groupBy("_bin", "_chunk").applyInArrow(spreader(max_hops), GAINS))
    words = [f"w{i}" for i in range(WORDS)]
    place = F.pmod(F.col("_id"), F.lit(PIECE_BITS))
    bit = F.expr("shiftleft(1L, CAST(_p % 64 AS int))")
    state = starts.select("_id", F.floor(F.col("_id") / PIECE_BITS).alias("piece"), place.alias("_p")).select(
        "_id", "piece", F.lit(1).cast("long").alias("n"), F.lit(True).alias("fresh"),
        *(F.when(F.expr("_p DIV 64") == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)),
    )
    state = cut_lineage(state)
    out = state.select("_id", F.lit(0).alias("hops"), F.col("n").alias("gain"))
    hop = 0
    count = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("long")
    while max_hops is None or hop < max_hops:
        hop += 1
        sent = ways.join(state.filter("fresh").select(F.col("_id").alias("_u"), "piece", *words), "_u")
        sent = sent.select("_blk", "_to", "piece", F.lit(0).cast("long").alias("n"), *words)
        held = state.select(F.expr("shiftright(_id, 12)").alias("_blk"), F.array("_id").alias("_to"), "piece", "n", *words)
        dealt = sent.unionByName(held).repartition("_blk", "piece")
        merged = dealt.select("_blk", F.explode("_to").alias("_id"), "piece", "n", *words).groupBy("_blk", "piece", "_id").agg(
            F.max("n").alias("_was"), *(F.bit_or(w).alias(w) for w in words)
        )
        merged = merged.withColumn("n", count)
        state = cut_lineage(
            merged.select("_id", "piece", "n", (F.col("n") - F.col("_was")).alias("new"), (F.col("n") > F.col("_was")).alias("fresh"), *words)
        )
        gain = state.filter("fresh").groupBy("_id").agg(F.sum("new").alias("gain"))
        gain = cut_lineage(gain.select("_id", F.lit(hop).alias("hops"), "gain"))
        if gain.isEmpty():
            break
        out = out.unionByName(gain)
    return cut_lineage(out.groupBy("_id", "hops").agg(F.sum("gain").alias("gain")))


def _closeness_from(profile: DataFrame) -> DataFrame:
    w = W.partitionBy("node").orderBy("hops")
    gained = F.col("reached") - F.coalesce(F.lag("reached").over(w), F.lit(0))
    # Stored, as the number of nodes is taken from it too.
    sums = store(
        profile.withColumn("_gain", gained)
        .groupBy("node")
        .agg(F.max("reached").alias("_r"), F.sum(F.col("hops") * F.col("_gain")).alias("_d"))
    )
    n = sums.agg(F.count(F.lit(1))).scalar()
    r = F.col("_r") - 1
    return sums.select(
        "node",
        F.when((F.col("_d") > 0) & (n > 1), r / F.col("_d") * (r / (n - 1)))
        .otherwise(F.lit(0.0))
        .alias("closeness"),
    )


def closeness_centrality(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Reached nodes over their summed distance, scaled by the share reached.

    Distances are hops unless ``weight`` names a length column.
    """
    if weight is None:
        return _closeness_from(hop_profile(edges))
    edges = cut_lineage(edges)
    dist = shortest_paths(edges, weight)
    sums = dist.groupBy(F.col("source").alias("node")).agg(
        F.count(F.lit(1)).alias("_r"), F.sum("distance").alias("_d")
    )
    n = nodes_of(edges).agg(F.count(F.lit(1))).scalar()
    r = F.col("_r") - 1
    return sums.select(
        "node",
        F.when((F.col("_d") > 0) & (n > 1), r / F.col("_d") * (r / (n - 1)))
        .otherwise(F.lit(0.0))
        .alias("closeness"),
    )


def shortest_paths(edges: DataFrame, weight: str, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, distance) by repeated relaxation of improved distances only."""
    links = cut_lineage(
        both_ways(edges, weight).select("u", "v", F.col(weight).cast("double").alias("_len"))
    )
    starts = (sources if sources is not None else links.select(F.col("u").alias("node")).distinct()).select("node")
    best = cut_lineage(
        starts.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"))
    )
    active = best
    while not active.isEmpty():
        offers = (
            active.withColumnRenamed("node", "u")
            .join(links, "u")
            .groupBy("source", F.col("v").alias("node"))
            .agg(F.min(F.col("distance") + F.col("_len")).alias("_offer"))
        )
        merged = cut_lineage(
            best.join(offers, ["source", "node"], "full_outer").select(
                "source",
                "node",
                F.least("distance", "_offer").alias("distance"),
                (F.col("distance").isNull() | (F.col("_offer") < F.col("distance"))).alias("_new"),
            )
        )
        active = merged.filter("_new").drop("_new")
        best = merged.drop("_new")
    return best


def eccentricity(edges: DataFrame) -> DataFrame:
    """Hops to the farthest node reached."""
    return hop_profile(edges).groupBy("node").agg(F.max("hops").alias("eccentricity"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, links, radius, diameter."""
    edges = cut_lineage(edges)
    ecc = eccentricity(edges)
    links = both_ways(edges).agg((F.count(F.lit(1)) / 2).cast("long")).scalar()
    return ecc.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.min("eccentricity").alias("radius"),
        F.max("eccentricity").alias("diameter"),
    ).withColumn("n_edges", links)


def closeness_ranking(edges: DataFrame) -> DataFrame:
    return closeness_centrality(edges).orderBy(F.col("closeness").desc(), "node")


def graph_center(edges: DataFrame) -> DataFrame:
    """Nodes whose eccentricity equals the radius."""
    ecc = cut_lineage(eccentricity(edges))
    radius = ecc.agg(F.min("eccentricity")).scalar()
    return ecc.filter(F.col("eccentricity") == radius)


def _dependencies(
    edges: DataFrame, sources: DataFrame | None, pair_rows: int = PAIR_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node totals, edge totals, nodes): dependencies of all sources.

    Sources come in batches of so many that a batch has about ``pair_rows`` (source,
    node) rows; each batch's sums are added to those before.
    """
    edges = cut_lineage(edges)
    links = cut_lineage(both_ways(edges))
    nodes = cut_lineage(nodes_of(edges))
    starts = nodes if sources is None else sources.select("node").distinct()
    starts = cut_lineage(dense_ids(starts, hash_bucket("node"), ["node"], "_id", 0))
    count, size = starts.count(), nodes.count()
    batch = max(1, pair_rows // max(size, 1))
    by_node = nodes.select("node", F.lit(0.0).alias("total"))
    by_edge = links.filter(F.col("u") < F.col("v")).select(
        F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("total")
    )
    for first in range(0, count, batch):
        own = starts.filter((F.col("_id") >= first) & (F.col("_id") < first + batch))
        node_part, edge_part = _batch_dependencies(links, own.select("node"))
        by_node = cut_lineage(by_node.unionByName(node_part).groupBy("node").agg(F.sum("total").alias("total")))
        by_edge = cut_lineage(by_edge.unionByName(edge_part).groupBy("src", "dst").agg(F.sum("total").alias("total")))
    return by_node, by_edge, nodes


def _batch_dependencies(links: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Path counts by level from the sources of a batch, then dependencies back down, summed over the sources."""
    level = cut_lineage(
        starts.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("sigma"))
    )
    levels = [level]
    seen = level.select("s", "node")
    while True:
        nxt = (
            level.withColumnRenamed("node", "u")
            .join(links, "u")
            .groupBy("s", F.col("v").alias("node"))
            .agg(F.sum("sigma").alias("sigma"))
            .join(seen, ["s", "node"], "left_anti")
        )
        level = cut_lineage(nxt)
        if level.isEmpty():
            break
        levels.append(level)
        # A neighbour lies at most one level back, so two levels suffice.
        seen = level.select("s", "node").unionByName(levels[-2].select("s", "node"))
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    node_total: DataFrame | None = None
    edge_total: DataFrame | None = None
    for upper in reversed(levels[:-1]):
        flow = cut_lineage(
            delta.select("s", F.col("node").alias("w"), F.col("sigma").alias("_sw"), "delta")
            .join(links.select(F.col("u").alias("w"), F.col("v").alias("node")), "w")
            .join(upper, ["s", "node"])
            .select("s", "node", "w", (F.col("sigma") / F.col("_sw") * (1 + F.col("delta"))).alias("c"))
        )
        over = flow.groupBy(F.least("node", "w").alias("src"), F.greatest("node", "w").alias("dst")).agg(F.sum("c").alias("total"))
        edge_total = over if edge_total is None else edge_total.unionByName(over)
        gained = flow.groupBy("s", "node").agg(F.sum("c").alias("_g"))
        delta = cut_lineage(
            upper.join(gained, ["s", "node"], "left").select(
                "s", "node", "sigma", F.coalesce("_g", F.lit(0.0)).alias("delta")
            )
        )
        passed = delta.filter(F.col("s") != F.col("node")).select("node", F.col("delta").alias("total"))
        node_total = passed if node_total is None else node_total.unionByName(passed)
    if node_total is None or edge_total is None:
        none = links.limit(0)
        return (
            none.select(F.col("u").alias("node"), F.lit(0.0).alias("total")),
            none.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("total")),
        )
    return node_total, edge_total


def betweenness(
    edges: DataFrame, normalized: bool = True, sources: DataFrame | None = None, pair_rows: int = PAIR_ROWS
) -> DataFrame:
    """Share of shortest paths through each node."""
    totals, _, nodes = _dependencies(edges, sources, pair_rows)
    n = nodes.agg(F.count(F.lit(1))).scalar()
    scale: Column = F.lit(0.5)
    if normalized:
        scale = F.when(n > 2, F.lit(1.0) / ((n - 1) * (n - 2))).otherwise(F.lit(0.5))
    return totals.select("node", (F.col("total") * scale).alias("betweenness"))


def edge_betweenness(
    edges: DataFrame, normalized: bool = True, sources: DataFrame | None = None, pair_rows: int = PAIR_ROWS
) -> DataFrame:
    """Share of shortest paths over each edge."""
    _, totals, nodes = _dependencies(edges, sources, pair_rows)
    n = nodes.agg(F.count(F.lit(1))).scalar()
    scale: Column = F.lit(0.5)
    if normalized:
        scale = F.when(n > 1, F.lit(1.0) / (n * (n - 1))).otherwise(F.lit(0.5))
    return totals.select("src", "dst", (F.col("total") * scale).alias("betweenness"))


def trim_by_edge_betweenness(edges: DataFrame) -> DataFrame:
    """In components of more than 3 edges, drop edges above mean + one deviation.

    Counts are compared inside each component, where scaling does not matter.
    """
    edges = cut_lineage(edges)
    scores = cut_lineage(edge_betweenness(edges, normalized=False))
    comp = connected_components(edges)
    placed = scores.join(comp.withColumnRenamed("node", "src"), "src")
    limits = placed.groupBy("component").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.avg("betweenness") + F.stddev_pop("betweenness")).alias("_limit"),
    )
    kept = (
        placed.join(limits, "component")
        .filter((F.col("_n") <= 3) | (F.col("betweenness") <= F.col("_limit")))
        .select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    )
    keyed = edges.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return keyed.join(kept, ["_a", "_b"], "left_semi").select(*edges.columns)


def minimum_spanning_tree(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Lightest spanning forest; ties go to the smaller end points.

    Each round every component takes its lightest outgoing edge and merges over it.
    """
    pool = cut_lineage(
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.min(F.col(weight).cast("double")).alias("w"))
        .select("src", "dst", "w", F.col("src").alias("cs"), F.col("dst").alias("cd"))
    )
    tree: DataFrame | None = None
    while not pool.isEmpty():
        best = F.min(F.struct("w", "src", "dst", "cs", "cd")).alias("e")
        ends = pool.select(F.explode(F.array("cs", "cd")).alias("c"), "w", "src", "dst", "cs", "cd")
        chosen = cut_lineage(ends.groupBy("c").agg(best).select("e.*").distinct())
        picked = chosen.select("src", "dst", F.col("w").alias(weight))
        tree = picked if tree is None else tree.unionByName(picked)
        comp = cut_lineage(
            connected_components(chosen.select(F.col("cs").alias("src"), F.col("cd").alias("dst")))
        )
        a = comp.select(F.col("node").alias("cs"), F.col("component").alias("_s"))
        b = comp.select(F.col("node").alias("cd"), F.col("component").alias("_d"))
        pool = cut_lineage(
            pool.join(a, "cs").join(b, "cd")
            .filter(F.col("_s") != F.col("_d"))
            .select("src", "dst", "w", F.col("_s").alias("cs"), F.col("_d").alias("cd"))
        )
    if tree is None:
        return edges.select("src", "dst", F.col(weight).cast("double").alias(weight)).limit(0)
    return tree


def _next_in_ring(links: DataFrame) -> DataFrame:
    """(u, v, w): after ``v``, ``w`` is the next neighbour of ``u``; the last is followed by the first.

    Neighbours stand in the order of (a hash bucket, name); each bucket of a hub is put
    in order by itself, and the ends of buckets are linked through one row each.
    """
    e = links.withColumn("_b", F.pmod(F.xxhash64("v"), F.lit(64)))
    inside = e.withColumn("_w", F.lead("v").over(W.partitionBy("u", "_b").orderBy("v")))
    heads = e.groupBy("u", "_b").agg(F.min("v").alias("_head"))
    ring = W.partitionBy("u").orderBy("_b")
    heads = heads.select(
        "u",
        "_b",
        F.coalesce(F.lead("_head").over(ring), F.first("_head").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_then"),
    )
    return inside.join(heads, ["u", "_b"]).select("u", "v", F.coalesce("_w", "_then").alias("w"))


def root_forest(tree: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, parent, root, depth, size) of a forest of undirected edges (src, dst).

    A tree hangs from its node in ``roots`` (node; one per tree), or else from its
    smallest one. Every edge is walked down and up on one tour around its tree; the
    tour's order comes from pointer jumping, so rounds grow with the logarithm of
    the nodes, also for a chain. ``size`` counts a node and all below it.
    """
    links = cut_lineage(both_ways(tree))
    comp = cut_lineage(connected_components(links.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    if roots is None:
        tops = comp.select("component", F.col("component").alias("root")).distinct()
    else:
        own = comp.join(roots.select("node").distinct(), "node", "left_semi").groupBy("component").agg(F.min("node").alias("_r"))
        tops = comp.select("component").distinct().join(own, "component", "left").select("component", F.coalesce("_r", "component").alias("root"))
    placed = cut_lineage(comp.join(tops, "component").select("node", "root"))
    # After walking u to v the tour goes on from v to the neighbour that follows u there.
    ring = _next_in_ring(links).select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("w").alias("x"))
    tour = ring.join(placed.select(F.col("node").alias("v"), "root"), "v")
    first = links.join(placed.filter("node = root").select(F.col("node").alias("u")), "u").groupBy("u").agg(
        F.min(F.struct(F.pmod(F.xxhash64("v"), F.lit(64)), "v"))["v"].alias("_first")
    )
    tour = tour.join(first.select(F.col("u").alias("root"), "_first"), "root")
    # It ends before it would leave its root by the first edge again.
    ended = (F.col("v") == F.col("root")) & (F.col("x") == F.col("_first"))
    jump = cut_lineage(
        tour.select(
            "u",
            "v",
            F.when(~ended, F.col("v")).alias("nu"),
            F.when(~ended, F.col("x")).alias("nv"),
            F.lit(1).cast("long").alias("left"),
        )
    )
    while not jump.filter(F.col("nu").isNotNull()).isEmpty():
        ahead = jump.select(
            F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("_nu"), F.col("nv").alias("_nv"), F.col("left").alias("_more")
        )
        jump = cut_lineage(
            jump.join(ahead, ["nu", "nv"], "left").select(
                "u", "v", F.col("_nu").alias("nu"), F.col("_nv").alias("nv"), (F.col("left") + F.coalesce("_more", F.lit(0))).alias("left")
            )
        )
    # An edge is walked down before it is walked up: down has more of the tour left.
    back = jump.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("_up"))
    down = jump.join(back, ["u", "v"]).filter(F.col("left") > F.col("_up")).select(
        F.col("v").alias("node"), F.col("u").alias("parent"), ((F.col("left") - F.col("_up") + 1) / 2).cast("long").alias("size")
    )
    known = placed.join(down, "node", "left").withColumn("_to", F.col("parent"))
    known = cut_lineage(known.withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")))
    while not known.filter(F.col("_to").isNotNull()).isEmpty():
        ahead = known.select(F.col("node").alias("_to"), F.col("_to").alias("_next"), F.col("depth").alias("_more"))
        known = cut_lineage(
            known.join(ahead, "_to", "left").select(
                "node", "parent", "root", "size", F.col("_next").alias("_to"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")
            )
        )
    whole = known.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    return known.join(whole, "root").select("node", "parent", "root", "depth", F.coalesce("size", "_n").alias("size"))


def betweenness_tree(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """The lightest spanning forest of the links weighed by their betweenness, as a hierarchy.

    One row per node: node, parent (null for a root), root, depth, size, closeness (along
    ``weight`` if given) and betweenness. A tree hangs from its node of largest
    betweenness, the smallest of equals.
    """
    edges = cut_lineage(edges)
    by_node, by_edge, nodes = _dependencies(edges, None)
    n = nodes.agg(F.count(F.lit(1))).scalar()
    # Weights are only compared; rounding keeps equal ones equal however they were summed.
    weighed = by_edge.select("src", "dst", F.round(F.col("total"), 6).alias("weight"))
    tree = cut_lineage(minimum_spanning_tree(weighed))
    comp = connected_components(tree)
    score = by_node.select("node", (F.col("total") * F.when(n > 2, F.lit(1.0) / ((n - 1) * (n - 2))).otherwise(F.lit(0.5))).alias("betweenness"))
    score = cut_lineage(score)
    top = comp.join(score, "node").groupBy("component").agg(
        F.min(F.struct(-F.round("betweenness", 9), F.col("node").alias("node")))["node"].alias("node")
    )
    return root_forest(tree, top).join(closeness_centrality(edges, weight), "node").join(score, "node")
