"""Near-duplicate documents by SetSketch registers, exact in the end.

A register of a set is the smallest of exponentially distributed values of its elements, kept as a truncated
logarithm (``REGISTERS`` of one byte each, base ``BASE``). An element's values come in ascending order with
exponential spacings, each for a register of its own choice, so most elements stop after one or two. Registers of a
union are the larger ones of both, and registers of similar sets agree often.

1. Documents with the same shingle set form a class; only one of each class goes on.
2. ``BANDS`` groups of ``ROWS`` registers are bucket keys. Every member of a bucket is compared with the bucket's
   leader: that is one pair a member, however large the bucket.
3. Pairs whose registers, estimated jointly by maximum likelihood, speak against the threshold by four standard
   deviations are dropped; the others are confirmed on their full shingle sets.
4. Buckets whose members are not all of one component after that get a new leader, by another hash, and every member
   of another component is compared with it, as long as such a round links a twentieth of what the first one did. So a
   group whose members link in many ways becomes one component.
5. In buckets that are still mixed, the members outside the bucket's largest component are compared with all others, in
   cells inside tasks. Members of that component need not meet each other. A bucket of up to ``CELL_ROOT`` squared rows
   is one cell, so each member is sent once; cells grow with the square root of larger ones, and so does the number
   of cells that get a member. First each gives its likeliest partner in a cell alone; where more were likely and confirming those
   has not made one component of the bucket, all likely pairs are confirmed. A task gives only the links that join
   components, so no link is lost, and nothing that leaves a task grows with the square of a group.
6. Links give the components.

All of this is done on classes of equal sets, numbered by themselves; documents get their class's result at the end.

A link at the threshold shares no bucket with a probability of about one in 80,000 and fails the likelihood test
with about one in 30,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtide.llm.common import discard, materialize, text_slices, whole_groups
from revtide.llm.words import as_long, gram_hashes, mix, split_words
from revtide.operators.graph import connected_components

REGISTERS, BASE, SCALE = 256, 1.1, 20.0
BANDS, ROWS = 40, 5
#: Pairs of a leader, or documents with the same home, that go into one tile.
BLOCK = 256
#: A block of a bucket of n documents has up to this times the square root of n; a cell compares two blocks.
CELL_ROOT = 64
#: Pairs stay while the threshold is less likely than the best estimate by a factor of at most e to this (four deviations).
DOUBT = 8.0

_LOG_BASE = math.log(BASE)


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and where each text's begin.

    A text with fewer than ``n`` words has its whole sequence as one shingle; without words it has none.
    """
    words = split_words(texts, lower=True)
    counts = words.counts
    full = gram_hashes(words.hashes, n)
    short = {size: gram_hashes(words.hashes, size) for size in range(1, n) if (counts == size).any()}
    sets = []
    for d, size in enumerate(counts.tolist()):
        a = int(words.first[d])
        if size >= n:
            sets.append(np.unique(full[a : a + size - n + 1]))
        elif size:
            sets.append(mix(short[size][a : a + 1] + np.uint64(size)))
        else:
            sets.append(np.zeros(0, np.uint64))
    lengths = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(lengths)])


def registers(elements: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of several sets, one row each; an empty set has zeros."""
    sizes = np.diff(first)
    least = np.full((len(sizes), m), np.inf)
    todo = np.flatnonzero(sizes > 0)
    reach = math.log(m) + 3
    while len(todo):
        member = np.concatenate([np.arange(first[d], first[d + 1]) for d in todo.tolist()])
        row = np.repeat(todo, sizes[todo])
        state, at, limit = elements[member], np.zeros(len(member)), reach / sizes[row]
        least[todo] = np.inf
        while len(state):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            near = at <= limit
            state, at, limit, row = state[near], at[near], limit[near], row[near]
            np.minimum.at(least.reshape(-1), row * m + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.int64) % m, at)
        todo = todo[np.isinf(least[todo]).any(1)]
        reach += 6
    with np.errstate(divide="ignore"):
        level = np.floor((math.log(SCALE) - np.log(least)) / _LOG_BASE)
    return np.where(np.isinf(least), 0, np.clip(level, 0, 255)).astype(np.uint8)


def likely(above: np.ndarray, below: np.ndarray, same: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood of two sketches leaves room for a similarity of ``threshold``.

    above, below, same: registers of the first set that are larger, smaller and equal; sizes are exact.
    """
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(u, v)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        chance = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE, 1e-12, 1)
        p, q = chance(u - v * j), chance(v - u * j)
        return above * np.log(p) + below * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))

    grid = [log_likelihood(top * step / 48) for step in range(49)]
    best = np.max(grid, axis=0)
    peak = top * np.argmax(grid, axis=0) / 48
    return (top >= threshold) & ((peak >= threshold) | (log_likelihood(np.full_like(top, threshold)) >= best - DOUBT))


def _digests(elements: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Size and two sums of hashes of each set: what a set is told by."""
    out = [pa.array(np.diff(first))]
    for salt in (0, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)))])
        out.append(pa.array(as_long(total[first[1:]] - total[first[:-1]])))
    return out


def _sketches(documents: DataFrame, n: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                elements, first = shingle_sets(batch.column(1).slice(a, b - a), n)
                sketch = registers(elements, first)
                columns = [batch.column(0).slice(a, b - a), *_digests(elements, first), pa.array([r.tobytes() for r in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "h1", "h2", "sketch"])

    return documents.mapInArrow(scan, "doc long, n long, h1 long, h2 long, sketch binary")


def _full_sets(documents: DataFrame, n: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                elements, first = shingle_sets(batch.column(1).slice(a, b - a), n)
                sets = [elements[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_digests(elements, first), pa.array(sets, pa.binary())], names=["least", "n", "h1", "h2", "shingles"])

    return documents.mapInArrow(scan, "least long, n long, h1 long, h2 long, shingles binary")


def _tasks(spark: SparkSession) -> int:
    """Partitions of stages that work in Python: few bytes there are much work, so they must not be put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _likely_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``pairs`` (a, b, ...) whose sketches leave room for the threshold."""
    slim = classes.select("doc", "n", "sketch")
    both = pairs.join(slim.toDF("a", "n_a", "s_a"), "a").join(slim.toDF("b", "n_b", "s_b"), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            s, t = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
            above, below = (s > t).sum(1), (s < t).sum(1)
            good = likely(above, below, REGISTERS - above - below, col["n_a"].to_numpy().astype(float), col["n_b"].to_numpy().astype(float), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(judge, "a long, b long")


def _confirm(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) among the pairs of ``tiles`` (tile, a array, b array), confirmed on full sets.

    Each set goes once to each tile that needs it. A tile gives a spanning forest of its links.
    """
    need = tiles.select("tile", F.explode(F.array_union("a", "b")).alias("doc")).distinct().join(sets, "doc")
    rows = need.select("tile", "doc", "shingles", F.lit(None).cast("array<long>").alias("a"), F.lit(None).cast("array<long>").alias("b"))
    rows = rows.unionByName(tiles.select("tile", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("shingles"), "a", "b"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            tile = table.column("tile").to_numpy()
            docs, blobs, left, right = (table.column(c).to_pylist() for c in ("doc", "shingles", "a", "b"))
            edges = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1, append=tile[-1] + 1))
            src, dst = [], []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                held = {docs[i]: np.frombuffer(blobs[i], np.uint64) for i in range(x, y) if docs[i] is not None}
                parent = {d: d for d in held}

                def root(d: int, parent=parent) -> int:
                    while parent[d] != d:
                        parent[d] = d = parent[parent[d]]
                    return d

                for i in range(x, y):
                    if docs[i] is None:
                        for a, b in zip(left[i], right[i], strict=True):
                            ra, rb = root(a), root(b)
                            if ra != rb and _similar(held[a], held[b], percent):
                                parent[ra] = rb
                                src.append(a)
                                dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return rows.repartition(_tasks(tiles.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(confirm, "src long, dst long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _stars(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links among pairs (a: leader, b): the likely ones are confirmed, a leader's pairs in tiles of bounded size."""
    stars = materialize(_likely_pairs(pairs.distinct(), classes, threshold), "stars")
    sizes = stars.groupBy("a").agg(F.count("*").alias("size"))
    tile = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK)))
    tiles = stars.join(sizes, "a").groupBy(tile.alias("tile")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    out = materialize(_confirm(tiles, sets, percent), "links")
    discard(stars)
    return out


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, band, doc) of buckets that hold more than one component, with their components."""
    named = members.select("key", "band", "doc").join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = named.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return materialize(named.join(mixed.where("low < high").select("key", "size"), "key"), "mixed")


def _joined(links: DataFrame, more: DataFrame, mixed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links, the labels they give, and what of ``mixed`` remains so."""
    links = links.unionByName(more)
    labels = _relabel(links)
    return links, labels, _mixed(mixed, labels)


def _relabel(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links).toDF("doc", "component"), "labels")


def _of_docs(rows: DataFrame, told: list[str], each: list[str]) -> DataFrame:
    """One row for each ``doc`` with its ``told`` columns and, as ``rows``, an array of structs of the ``each`` columns.

    What is known of documents is joined to this and not to their rows, which are up to ``BANDS`` for each, and more where
    a bucket has several cells.
    """
    return rows.groupBy("doc").agg(*(F.first(c).alias(c) for c in told), F.collect_list(F.struct(*each)).alias("rows"))


def _cells(others: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Members of mixed buckets, once for each cell (``c``) that they are compared in.

    A cell's rows agree on ``c.with``; each pair that is to be compared meets in one cell.
    """
    sized = _of_docs(others, ["component"], ["key", "band"]).join(classes.select("doc", "n"), "doc")
    sized = sized.select("doc", "component", "n", F.inline("rows"))
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    tops = parts.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("all"))
    blocks = lambda n: F.ceil(n / (CELL_ROOT * F.sqrt("all"))).cast("int")
    tops = tops.select("key", F.col("top.component").alias("most"), blocks(F.col("top.rows")).alias("majors"), blocks(F.col("all") - F.col("top.rows")).alias("minors"))
    spans = parts.join(tops, "key").where("component != most").groupBy("key", "most", "majors", "minors").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sized.join(spans, "key").withColumn("minor", F.col("component") != F.col("most"))
    # Sets that link are of similar size: members of the largest component that are like none of the others meet nothing.
    rows = rows.where(F.col("minor") | (F.col("n") >= F.col("low") * threshold) & (F.col("n") * threshold <= F.col("high")))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors")).cast("long")).cast("int")
    rows = rows.withColumn("own", own)
    # Cells: a block of the others with a block of the largest component, and two blocks of the others. The first kind's
    # cells on the diagonal (with: -2, others: -1) also compare their block of the others with itself.
    cell = lambda c, b: F.struct(F.xxhash64("key", F.lit(0), c, b).alias("cell"), F.when(F.pmod(c, F.col("majors")) == b, -2).otherwise(-1).alias("with"))
    across = F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda b: cell(F.col("own"), b))
    among = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("minors") - 1), lambda c: c != F.col("own")),
        lambda c: F.struct(F.xxhash64("key", F.lit(1), F.least("own", c), F.greatest("own", c)).alias("cell"), c.alias("with")),
    )
    back = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda c: cell(c, F.col("own")))
    return rows.withColumn("c", F.explode(F.when(F.col("minor"), F.concat(across, among)).otherwise(back)))


def _residual(others: DataFrame, classes: DataFrame, threshold: float, best_only: bool) -> DataFrame:
    """Likely pairs of different components that share a bucket; ``others``: members of mixed buckets.

    Rows either hold pairs (tile, a, b) or, with ``best_only``, the ``key`` of a bucket that has more likely pairs than
    the best of each member.
    """
    # One of a document's buckets, chosen alike by all, keeps documents of a group together when tiles are cut.
    home = others.groupBy("doc").agg(F.min_by("key", F.xxhash64("key")).alias("home"))
    crowd = home.groupBy("home").agg(F.count("*").alias("crowd"))
    home = home.join(crowd, "home").select("doc", F.xxhash64("home", F.pmod(F.xxhash64("doc"), F.ceil(F.col("crowd") / BLOCK))).alias("home"))
    cells = _cells(others, classes, threshold).select("doc", "component", "n", "key", "band", "minor", "own", "c.cell", "c.with")
    rows = _of_docs(cells, ["component", "n"], ["cell", "key", "band", "minor", "own", "with"])
    rows = rows.join(classes.select("doc", "sketch"), "doc").join(materialize(home, "home"), "doc")
    rows = rows.select("doc", "component", "n", "sketch", "home", F.inline("rows"))
    rows = rows.select("cell", "key", "band", "doc", "component", "n", "sketch", "home", "minor", "own", "with")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell, key, band, doc, component, size, home, minor, own, other = (table.column(c).to_numpy() for c in ("cell", "key", "band", "doc", "component", "n", "home", "minor", "own", "with"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            again: list[int] = []
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                among = other[x] >= 0
                own_too = other[x] == -2
                for i in (x + np.flatnonzero(minor[x:y])).tolist():
                    if among:
                        j = np.arange(i + 1, y)
                        j = j[(component[j] != component[i]) & (own[j] != own[i])]
                    else:
                        j = np.arange(x, y)
                        j = j[~minor[x:y] | (own_too & (j > i) & (component[x:y] != component[i]))]
                    ratio = np.minimum(size[i], size[j]) / np.maximum(size[i], size[j])
                    j = j[ratio >= threshold]
                    if not len(j):
                        continue
                    equal = sketch[j] == sketch[i]
                    bands = equal[:, : BANDS * ROWS].reshape(len(j), BANDS, ROWS).all(2)
                    first = bands.argmax(1) == band[i]
                    j = j[first]
                    above, same = (sketch[i] > sketch[j]).sum(1), equal[first].sum(1)
                    good = np.flatnonzero(likely(above, REGISTERS - above - same, same, np.full(len(j), float(size[i])), size[j].astype(float), threshold)) if len(j) else j
                    if best_only and len(good) > 1:
                        again.append(int(key[i]))
                        good = good[[same[good].argmax()]]
                    if len(good):
                        found.append((np.full(len(good), i), j[good]))
            if again:
                keys = np.unique(again)
                none = pa.nulls(len(keys), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), none, none, pa.array(keys)], names=["tile", "a", "b", "key"])
            if not found:
                continue
            left, right = (np.concatenate(f) for f in zip(*found, strict=True))
            with np.errstate(over="ignore"):
                tile = mix(home[np.where(home[left] < home[right], left, right)].view(np.uint64)) + home[np.where(home[left] < home[right], right, left)].view(np.uint64)
            order = np.argsort(tile, kind="stable")
            left, right, tile = left[order], right[order], tile[order]
            cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            ends = pa.array(np.append(cuts, len(tile)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(tile[cuts])), pa.ListArray.from_arrays(ends, pa.array(doc[left])), pa.ListArray.from_arrays(ends, pa.array(doc[right])), pa.nulls(len(cuts), pa.int64())],
                names=["tile", "a", "b", "key"],
            )

    dealt = rows.repartition(_tasks(others.sparkSession), "cell").sortWithinPartitions("cell")
    return materialize(dealt.mapInArrow(compare, "tile long, a array<long>, b array<long>, key long"), "rest")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``documents``.

    Words are runs of anything but ASCII white space, lower-cased (A-Z). Documents link if
    100 * intersection >= ``percent`` * union of their shingle sets; component_id is the smallest id that links
    reach. A null or empty text has no shingles and links with nothing, whatever other rows of its id hold. Ids are integers; a row without id gets a
    null component and links with nothing. Rows that share an id are one document with all its rows' sets: what links
    with any of them is in its component, and each row is returned with its own set's size. Other columns are ignored;
    an empty table gives no rows.
    """
    slim = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    threshold = percent / 100
    told = ["n", "h1", "h2"]
    sketched = materialize(_sketches(slim, n), "sketches")
    classes = sketched.where("n > 0 and doc is not null").groupBy(*told).agg(F.min("doc").alias("least"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    keys = F.array(*(F.struct(F.xxhash64(F.substring("sketch", b * ROWS + 1, ROWS), F.lit(b)).alias("key"), F.lit(b).alias("band")) for b in range(BANDS)))
    buckets = classes.select("doc", F.explode(keys).alias("k")).select("doc", "k.key", "k.band")
    order = F.struct(F.xxhash64("doc").alias("rank"), F.col("doc"))
    leaders = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min(order)["doc"].alias("leader")).where("size > 1").select("key", "leader")
    members = materialize(buckets.join(materialize(leaders, "leaders"), "key"), "members")
    wanted = classes.join(members.select("doc").distinct(), "doc", "left_semi").select("least", *told, "doc")
    texts = slim.where("doc is not null").join(wanted.select(F.col("least").alias("doc")).distinct(), "doc", "left_semi")
    sets = materialize(_full_sets(texts, n).join(wanted, ["least", *told]).select("doc", "shingles"), "sets").dropDuplicates(["doc"])

    links = _stars(members.where("doc != leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")), classes, sets, threshold, percent)
    # Sets of one id belong together whatever they hold.
    of_id = sketched.where("n > 0 and doc is not null").select(F.col("doc").alias("id"), *told).distinct()
    several = of_id.groupBy("id").agg(F.count("*").alias("sets")).where("sets > 1").select("id")
    owners = of_id.join(several, "id").join(classes.select(*told, "doc"), told)
    links = links.unionByName(materialize(owners.groupBy("id").agg(F.min("doc").alias("src")).join(owners, "id").select("src", F.col("doc").alias("dst")).where("src != dst"), "owners"))
    labels = _relabel(links)
    mixed = _mixed(members, labels)
    discard(members)
    enough = links.count() / 20
    for step in range(1, 100):
        rank = F.struct(F.xxhash64("doc", F.lit(step)).alias("rank"), F.col("doc"), F.col("component").alias("own"))
        heads = mixed.groupBy("key").agg(F.min(rank).alias("head"))
        pairs = mixed.join(heads, "key").where(F.col("component") != F.col("head.own"))
        more = _stars(pairs.select(F.col("head.doc").alias("a"), F.col("doc").alias("b")), classes, sets, threshold, percent)
        new = more.count()
        if not new:
            break
        links, labels, mixed = _joined(links, more, mixed)
        if new < enough:
            break

    rest = _residual(mixed, classes, threshold, True)
    more = materialize(_confirm(rest.where("tile is not null").drop("key"), sets, percent), "links")
    again = materialize(rest.where("key is not null").select("key").distinct(), "again")
    links, labels, left = _joined(links, more, mixed.join(again, "key", "left_semi"))
    discard(mixed)
    discard(rest)
    rest = _residual(left, classes, threshold, False)
    more = materialize(_confirm(rest.drop("key"), sets, percent), "links")
    if not more.isEmpty():
        labels = _relabel(links.unionByName(more))
    known = classes.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = materialize(known.join(least, "component").select(*told, "component_id"), "components")
    out = sketched.select("doc", *told).join(known, told, "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_duplicate_report(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``near_duplicates`` with the decision: the smallest document of a component is kept."""
    found = near_duplicates(documents, id_col)
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, all columns; rows that repeat the kept id all stay."""
    gone = near_duplicate_report(documents, id_col).where(~F.col("kept")).select(id_col)
    return documents.join(gone.distinct(), id_col, "left_anti").select(documents.columns)
