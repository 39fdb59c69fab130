"""Edge tables: who touched what, what changed together, who worked on whose files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from revtide.functions.cooling import EDGES, CoolingModel
from revtide.operators.base import attach, busy_key, dealt, per_group, revno_share
from revtide.schema import UNKNOWN_AUTHOR
from revtide.session import cut_lineage, store

# Changed paths per block when a large revision is cut up for pairing.
PAIR_BLOCK = 512
# Revisions of one path that are paired with each other as a block.
DIRECT_ROWS = 256
# Rows of one path up to which one task holds them.
BUSY_ROWS = 200_000


def author_file_edges(
    revisions: DataFrame, changes: DataFrame, group_cols: Sequence[str] = ()
) -> DataFrame:
    """(author, path) with the number of change rows."""
    on = [*group_cols, "revno"]
    per_rev = changes.groupBy(*on, "changedpath").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_rev.join(revisions.select(*on, "author"), on)
        .groupBy(*group_cols, F.col("author").alias("src"), F.col("changedpath").alias("dst"))
        .agg(F.sum("_n").cast("double").alias("weight"))
    )


def rev_file_edges(changes: DataFrame, weight: float = 2.0, group_cols: Sequence[str] = ()) -> DataFrame:
    return changes.select(
        *group_cols,
        F.col("revno").cast("string").alias("src"),
        F.col("changedpath").alias("dst"),
        F.lit(weight).alias("weight"),
    ).distinct()


def _pairs(sized: DataFrame, on: list[str], block: int) -> DataFrame:
    """Pairs (src, dst, _pairs, _w) of distinct items of one revision, smaller one first.

    ``sized`` is unique per (``on``, item ``_x``) and dealt by ``on``, with a row count
    ``_n``, a weight ``_w`` and the ``_size`` of its revision. A revision of up to ``block``
    items is paired in its own row. A larger one is cut into hashed blocks and paired block
    against block, so that its pairs are made by many tasks, each holding two blocks.
    """
    sized = sized.filter(_whole(on))
    few = sized.filter((F.col("_size") <= block) & F.col("_x").isNotNull())
    rows = few.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("_x", "_n"))).alias("_all"), F.first("_w").alias("_w"))
    ones = rows.filter(F.size("_all") > 1).select(*on, "_w", "_all", F.posexplode("_all").alias("_at", "_one"))
    small = ones.select(*on, "_w", "_one", F.explode(F.slice("_all", F.col("_at") + 2, F.size("_all"))).alias("_two")).select(
        *on, "_w", F.col("_one._x").alias("src"), F.col("_two._x").alias("dst"), (F.col("_one._n") * F.col("_two._n")).alias("_pairs")
    )

    blocks = F.ceil(F.col("_size") / max(block, 1)).cast("int")
    many = sized.filter(F.col("_size") > block).withColumn("_blk", F.pmod(F.xxhash64("_x"), blocks).cast("int"))
    blk, last = F.col("_blk"), blocks - 1
    left = many.select(
        *on,
        "_w",
        F.col("_x").alias("_p1"),
        F.col("_n").alias("_n1"),
        blk.alias("_i"),
        F.explode(F.sequence(blk, last)).alias("_j"),
    )
    right = many.select(
        *on,
        F.col("_x").alias("_p2"),
        F.col("_n").alias("_n2"),
        F.explode(F.sequence(F.lit(0), blk)).alias("_i"),
        blk.alias("_j"),
    )
    both = left.join(right, [*on, "_i", "_j"]).filter(
        (F.col("_i") != F.col("_j")) | (F.col("_p1") < F.col("_p2"))
    )
    large = both.select(
        *on,
        "_w",
        F.least("_p1", "_p2").alias("src"),
        F.greatest("_p1", "_p2").alias("dst"),
        (F.col("_n1") * F.col("_n2")).alias("_pairs"),
    )
    return small.unionByName(large)


def _weighted_pairs(
    changes: DataFrame, heat: DataFrame | None, g: list[str], min_weight: float | None, block: int
) -> DataFrame:
    """Edge weights from changes and weights ``_w`` per revision.

    Change rows go to their revision's task once; sizes are counted and small revisions
    paired there.
    """
    on, path = [*g, "revno"], [*g, "changedpath"]
    rows = changes.count()
    items = dealt(changes.select(*on, "changedpath").repartition(*on), on, rows).groupBy(*on, "changedpath").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*on)
    sized = items.withColumn("_size", F.count(F.lit(1)).over(whole)).withColumn("_most", F.max("_n").over(whole))
    if heat is None:
        sized = sized.withColumn("_w", F.lit(1.0))
    else:
        # A revision given several times weighs on both ends of its pairs.
        sized = sized.join(heat.groupBy(*on).agg((F.sum("_w") * F.count(F.lit(1))).alias("_w")), on)
    if min_weight is None:
        return _summed(_pairs(sized.withColumnRenamed("changedpath", "_x"), on, block), g)
    # No edge of a path weighs more than the path's own rows, each taken with the
    # most frequent path of its revision. Paths below the limit have no edge to
    # keep: exact, and it takes one-time mass imports out before pairs are made.
    reach = (
        sized.groupBy(*path)
        .agg(F.sum(F.col("_w") * F.col("_n") * F.col("_most")).alias("_bound"))
        .filter(F.col("_bound") >= min_weight * (1 - 1e-9))
    )
    # Pairs are made of numbers; only edges that are kept get their paths back.
    names = store(reach.select(*path, F.monotonically_increasing_id().alias("_x")))
    numbered = dealt(sized.join(names, path).select(*on, "_x", "_n", "_size", "_w").repartition(*on), on, rows)
    kept = filter_edges(_summed(_pairs(numbered, on, block), g), min_weight)
    first = names.select(*g, F.col("_x").alias("src"), F.col("changedpath").alias("_p1"))
    second = names.select(*g, F.col("_x").alias("dst"), F.col("changedpath").alias("_p2"))
    return kept.join(first, [*g, "src"]).join(second, [*g, "dst"]).select(
        *g, F.least("_p1", "_p2").alias("src"), F.greatest("_p1", "_p2").alias("dst"), "weight"
    )


def _summed(pairs: DataFrame, g: list[str]) -> DataFrame:
    return pairs.groupBy(*g, "src", "dst").agg(F.sum(F.col("_w") * F.col("_pairs")).alias("weight"))


def cochange_edges(
    changes: DataFrame,
    group_cols: Sequence[str] = (),
    block: int = PAIR_BLOCK,
    min_weight: float | None = None,
) -> DataFrame:
    """Paths changed in the same revision; weight = number of co-occurring rows.

    With ``min_weight`` lighter edges are left out, mostly before they are built.
    """
    g = list(group_cols)
    return _weighted_pairs(changes, None, g, min_weight, block)


def cochange_edges_decayed(
    revisions: DataFrame,
    changes: DataFrame,
    model: CoolingModel = EDGES,
    group_cols: Sequence[str] = (),
    block: int = PAIR_BLOCK,
    min_weight: float | None = None,
) -> DataFrame:
    """Co-change weight that cools by the day, as of the last commit day in scope."""
    g = list(group_cols)
    on = [*g, "revno"]
    touched = revisions.join(changes.select(*on).distinct(), on, "left_semi")
    ends = per_group(touched, g, F.to_date(F.max("commitdate")).alias("_max_day"))
    dated = attach(revisions.select(*on, "commitdate"), ends, g)
    age = F.greatest(F.datediff(F.col("_max_day"), F.to_date("commitdate")), F.lit(0))
    heat = dated.select(
        *on, (F.lit(model.step) * F.exp(-F.lit(model.rate * 24.0) * age)).alias("_w")
    )
    return _weighted_pairs(changes, heat, g, min_weight, block)


def nodes_of(edges: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """End points of the edges, each once."""
    return edges.select(
        *group_cols, F.explode(F.array("src", "dst")).alias("node")
    ).distinct()


def filter_edges(edges: DataFrame, min_weight: float = 1.0) -> DataFrame:
    """Edges of at least ``min_weight``; nodes left without an edge go with them."""
    return edges.filter(F.col("weight") >= min_weight)


def drop_node(edges: DataFrame, node: str = UNKNOWN_AUTHOR) -> DataFrame:
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def inverse_log_weights(edges: DataFrame) -> DataFrame:
    """Weights as distances: 1 / ln(weight), with 1 taken as 1.0001."""
    w = F.col("weight")
    return edges.withColumn("weight", F.lit(1.0) / F.log(F.when(w == 1, F.lit(1.0001)).otherwise(w)))


def _named_author() -> Column:
    a = F.col("author")
    return F.when(a.isNull() | (a == ""), F.lit("Unknown")).otherwise(a)


def coauthor_edges(
    revisions: DataFrame,
    changes: DataFrame,
    min_weight: float = 1.0,
    group_cols: Sequence[str] = (),
    busy_rows: int = BUSY_ROWS,
) -> DataFrame:
    """Lines an author added to files that others had worked on before.

    Every author's first revision of a path meets, of each other author, the sum of lines
    from there on: one row a pair and path. Paths of over ``busy_rows`` rows are ranked
    in buckets instead, so that none is one task's.
    """
    g = list(group_cols)
    path = [*g, "changedpath"]
    added = changes.filter((F.col("linesadded") > 0) & F.col("copyfrompath").isNull())
    busy = busy_key(added, path, busy_rows)
    rows = added.select(*path, "revno", F.col("linesadded").alias("_loc")).join(
        revisions.select(*g, "revno", _named_author().alias("author")), [*g, "revno"]
    )
    few = rows if busy is None else rows.filter(~busy)
    spans = _spans(few.withColumn("_n", F.col("_loc")), path, DIRECT_ROWS)
    firsts = spans.filter(F.col("_p").isNull()).select(*g, *_PATH_KEY, F.col("author").alias("dst"), F.col("revno").alias("_ry"), F.lit(1).alias("_e"), "_blk", F.lit(False).alias("_strict"))
    pairs = _meet(spans, firsts, g)
    if busy is not None:
        pairs = pairs.unionByName(_busy_coauthors(cut_lineage(rows.filter(busy)), path, g))
    return (
        pairs.filter(F.col("src") != F.col("dst"))
        .groupBy(*g, "src", "dst")
        .agg(F.sum("_w").cast("double").alias("weight"))
        .filter(F.col("weight") > min_weight)
    )


# A path as a number: its hash, and its place among paths of that hash.
_PATH_KEY = ["_h", "_d"]


def _whole(keys: list[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in keys])


def _spans(rows: DataFrame, path: list[str], block: int) -> DataFrame:
    """Rows of paths that fit one task, with what their author adds from there on.

    Adds to (path, revno, author, ``_n``) the number of the path, a block ``_blk`` of at most
    ``block`` of its revisions, the path's ``_rows``, the author's previous revision ``_p`` and its block ``_pblk``,
    and the sum ``_w`` of ``_n`` from this row to the author's last.
    """
    named = rows.filter(_whole(path)).withColumn("_h", F.xxhash64(*path)).repartition("_h")
    on = ["_h", *path]
    by_rev = W.partitionBy(*on).orderBy("revno")
    mine = W.partitionBy(*on, "author").orderBy("revno")
    whole = F.count(F.lit(1)).over(by_rev.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    placed = named.withColumn("_rows", whole).withColumn("_blk", F.floor((F.dense_rank().over(by_rev) - 1) / max(block, 1)).cast("int")).withColumn(
        "_d", F.dense_rank().over(W.partitionBy("_h").orderBy(*path))
    )
    out = placed.select(
        *path[:-1],
        *_PATH_KEY,
        "author",
        "revno",
        "_loc",
        "_n",
        "_rows",
        "_blk",
        F.lag("revno").over(mine).alias("_p"),
        F.lag("_blk").over(mine).alias("_pblk"),
        F.sum("_n").over(mine.rowsBetween(0, W.unboundedFollowing)).alias("_w"),
    )
    return store(out)


def _meet(spans: DataFrame, events: DataFrame, g: list[str]) -> DataFrame:
    """(src, dst, _w): for every event of dst, what src adds to the path from then on.

    Both meet per block of a path: a span reaches back to the author's previous revision,
    so it is put into each block from that one's on. An event finds one span of an author;
    a strict one takes only what comes in later revisions.
    """
    cells = spans.filter(F.col("_p").isNull() | (F.col("_p") < F.col("revno"))).select(
        *g,
        *_PATH_KEY,
        F.col("author").alias("src"),
        "_p",
        F.col("revno").alias("_rx"),
        "_w",
        F.explode(F.sequence(F.coalesce("_pblk", F.lit(0)), F.col("_blk"))).alias("_blk"),
    )
    met = cells.join(events, [*g, *_PATH_KEY, "_blk"])
    before = F.when(F.col("_strict"), F.col("_ry") < F.col("_rx")).otherwise(F.col("_ry") <= F.col("_rx"))
    after = F.when(F.col("_strict"), F.col("_ry") >= F.col("_p")).otherwise(F.col("_ry") > F.col("_p"))
    return met.filter(before & (F.col("_p").isNull() | after)).select(
        *g, "src", "dst", (F.col("_w") * F.col("_e")).alias("_w")
    )


def _busy_coauthors(rows: DataFrame, path: list[str], g: list[str]) -> DataFrame:
    """(src, dst, _w) of paths with very many rows, which are ranked bucket by bucket.

    Per path, authors are ranked by first appearance; an author's lines are summed
    between two such appearances and totalled from the latest one backwards. That
    gives each (author, earlier author) pair its lines without pairing rows.
    """
    rows = rows.select(*path, "author", "revno", "_loc", F.lit(0).alias("_first"))
    firsts = rows.groupBy(*path, "author").agg(F.min("revno").alias("revno")).select(
        *path, "author", "revno", F.lit(0).cast("long").alias("_loc"), F.lit(1).alias("_first")
    )
    events = rows.unionByName(firsts).withColumn("_b", revno_share(rows))
    in_bucket = (
        W.partitionBy(*path, "_b")
        .orderBy("revno", F.col("_first").desc())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    counted = events.withColumn("_k", F.sum("_first").over(in_bucket))
    sizes = events.groupBy(*path, "_b").agg(F.sum("_first").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*path).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    offsets = sizes.select(*path, "_b", (upto - F.col("_n")).alias("_off"))
    ranked = cut_lineage(
        counted.join(offsets, [*path, "_b"])
        .withColumn("_k", F.col("_k") + F.col("_off"))
        .groupBy(*path, "author", "_k", "_first")
        .agg(F.sum("_loc").alias("_loc"))
    )

    order = ranked.filter(F.col("_first") == 1).select(*path, F.col("author").alias("dst"), "_k")
    cells = ranked.filter(F.col("_first") == 0).select(*path, "author", "_k", "_loc")
    mine = W.partitionBy(*path, "author")
    later = F.sum("_loc").over(
        mine.orderBy(F.col("_k").desc()).rowsBetween(W.unboundedPreceding, 0)
    )
    prev = F.coalesce(F.lag("_k").over(mine.orderBy("_k")), F.lit(0))
    spread = cells.select(*path, "author", "_k", later.alias("_w"), prev.alias("_p")).select(
        *path,
        F.col("author").alias("src"),
        "_w",
        F.explode(F.sequence(F.col("_p") + 1, F.col("_k"))).alias("_k"),
    )
    return spread.join(order, [*path, "_k"]).select(*g, "src", "dst", "_w")


def coauthor_matrix(
    revisions: DataFrame,
    changes: DataFrame,
    dense: bool = False,
    group_cols: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
    busy_rows: int = BUSY_ROWS,
) -> DataFrame:
    """For every change of an author, the lines added so far to that path, by author.

    Turned round: every row of a path meets, of each author, the number of changes from
    there on, in blocks of ``direct_rows`` revisions. On a path of over ``busy_rows`` rows,
    "row y not later than row x" is split by the highest bit in which their revision
    numbers differ: in each such block pair only per-author totals meet, never rows.
    """
    g = list(group_cols)
    path = [*g, "changedpath"]
    busy = busy_key(changes, path, busy_rows)
    on = [*g, "revno"]
    rows = (
        changes.select(*path, "revno", "linesadded")
        .repartition(*on)
        .groupBy(*on, "changedpath")
        .agg(F.sum("linesadded").alias("_loc"), F.count(F.lit(1)).alias("_n"))
        .join(revisions.select(*on, "author"), on)
    )
    few = rows if busy is None else rows.filter(~busy)
    spans = _spans(few, path, direct_rows)
    # Where a revision is given several times, its rows on a path of over ``direct_rows`` rows meet only themselves.
    strict = (F.col("_rows") > direct_rows).alias("_strict")
    events = spans.select(*g, *_PATH_KEY, F.col("author").alias("dst"), F.col("revno").alias("_ry"), F.col("_loc").alias("_e"), "_blk", strict)
    own = spans.filter(strict).select(*g, F.col("author").alias("src"), F.col("author").alias("dst"), (F.col("_n") * F.col("_loc")).alias("_w"))
    pairs = _meet(spans, events, g).unionByName(own)
    if busy is not None:
        pairs = pairs.unionByName(_busy_pairs(cut_lineage(rows.filter(busy)), path, g))
    cells = pairs.groupBy(*g, "src", "dst").agg(F.sum("_w").alias("weight"))
    if not dense:
        return cells
    # The full matrix is what is asked for: every author against the list of all authors.
    names = revisions.select(*g, "author").distinct()
    listed = per_group(names, g, F.sort_array(F.collect_set("author")).alias("_all"))
    grid = attach(names, listed, g).select(*g, F.col("author").alias("src"), F.explode("_all").alias("dst"))
    return grid.join(cells, [*g, "src", "dst"], "left").select(
        *g, "src", "dst", F.coalesce("weight", F.lit(0)).alias("weight")
    )


def _busy_pairs(rows: DataFrame, path: list[str], g: list[str]) -> DataFrame:
    """(src, dst, _w) of paths with very many rows, from per-author totals of bit-wise halves."""
    many = rows.filter(_whole(path))
    same = many.select(
        *g, F.col("author").alias("src"), F.col("author").alias("dst"), (F.col("_n") * F.col("_loc")).alias("_w")
    )
    # Bits of the largest revision number; 63 covers any long.
    top = F.length(F.bin(many.agg(F.coalesce(F.max("revno"), F.lit(0))).scalar()))
    halves = many.withColumn("_bit", F.explode(F.sequence(F.lit(0), top - 1)))
    block = F.expr("shiftright(revno, _bit)")
    halves = (
        halves.withColumn("_blk", block)
        .groupBy(*path, "author", "_bit", F.expr("shiftright(_blk, 1)").alias("_pair"), (F.col("_blk") % 2).alias("_side"))
        .agg(F.sum("_n").alias("_n"), F.sum("_loc").alias("_loc"))
    )
    late = halves.filter(F.col("_side") == 1).select(*path, "_bit", "_pair", F.col("author").alias("src"), "_n")
    early = halves.filter(F.col("_side") == 0).select(*path, "_bit", "_pair", F.col("author").alias("dst"), "_loc")
    across = late.join(early, [*path, "_bit", "_pair"]).select(
        *g, "src", "dst", (F.col("_n") * F.col("_loc")).alias("_w")
    )
    return same.unionByName(across)
