"""Near-duplicate vectors by lattice hashing, links confirmed by cosine in double precision.

Each of ``TABLES`` tables projects a unit vector to eight random dimensions and decodes the point to the nearest of
the E8 lattice. A vector owns that cell and also visits the ``PROBES`` neighbouring cells nearest to its point. In a
cell every owner meets all others; pairs that meet in several cells are counted in the first only. Equal vectors are
one class, so copies cost nothing. Large cells are cut into blocks that meet block against block, and a task gives one
row a vector: how many it is linked to, and a member of its component; no pairs leave it.

A pair at cosine 0.9 is missed with a probability of about 0.01, closer ones far more rarely.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.llm.common import materialize, whole_groups
from revtide.llm.words import as_long, mix
from revtide.operators.graph import connected_components

TABLES, PROBES, SCALE = 8, 3, 1.6
#: Vectors of a cell that one task compares with as many others.
BLOCK = 512


def _roots() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            point = np.zeros(8)
            point[i], point[j] = a, b
            found.append(point)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


def _nearest_d8(points: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(points)
    off = points - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(points: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the better of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(points), _nearest_d8(points - 0.5) + 0.5
    better = ((points - whole) ** 2).sum(1) <= ((points - half) ** 2).sum(1)
    return np.where(better[:, None], whole, half)


def _code(cells: np.ndarray, table: int) -> np.ndarray:
    out = mix(np.full(len(cells), table + 1, np.uint64))
    for d in range(8):
        out = mix(out ^ (np.rint(2 * cells[:, d]).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return out


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the cell that each vector owns and of those it visits, by table."""
    random = np.random.default_rng(unit.shape[1])
    own = np.empty((len(unit), TABLES), np.uint64)
    visits = np.empty((len(unit), TABLES, PROBES), np.uint64)
    for t in range(TABLES):
        points = unit @ random.normal(size=(unit.shape[1], 8)) / SCALE
        home = nearest_e8(points)
        own[:, t] = _code(home, t)
        towards = np.argsort(-((points - home) @ ROOTS.T), axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            visits[:, t, p] = _code(home + ROOTS[towards[:, p]], t)
    return own, visits


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    raw = values.reshape(len(column), -1)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _same_width(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one dimension each."""
    widths = batch.column(batch.schema.get_field_index(name)).value_lengths().to_numpy()
    for width in np.unique(widths):
        yield batch.filter(pa.array(widths == width))


def _entries(classes: DataFrame) -> DataFrame:
    """(cell, owner) rows of every class vector."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _same_width(whole, "embedding") if whole.num_rows else ():
                own, visits = cells(_vectors(batch.column(2)))
                for t in range(TABLES):
                    codes = np.concatenate([own[:, t : t + 1], visits[:, t]], axis=1)
                    rows = np.repeat(np.arange(len(codes)), 1 + PROBES)
                    part = batch.take(pa.array(rows))
                    extra = [pa.array(as_long(codes.reshape(-1))), pa.array(np.tile(np.arange(1 + PROBES) == 0, len(codes)))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=["vec", "size", "embedding", "cell", "owner"])

    return classes.select("vec", "size", "embedding").mapInArrow(scan, "vec long, size long, embedding array<float>, cell long, owner boolean")


def _tile(unit: np.ndarray, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, cell: np.uint64, apart: np.ndarray | None, least: float) -> tuple[np.ndarray, ...] | None:
    """Of one cell: vectors with links, how many rows they are linked to, and the smallest id of their component here."""
    close = unit @ unit.T >= least
    close &= owner[:, None] | owner[None, :]
    np.fill_diagonal(close, False)
    if apart is not None:
        close &= apart[:, None] != apart[None, :]
    left, right = np.nonzero(np.triu(close))
    if not len(left):
        return None
    used, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    own, visits = cells(unit[used])
    a, b = where[: len(left)], where[len(left) :]
    same = own[a] == own[b]
    from_b = (own[a][:, :, None] == visits[b]).any(2)
    from_a = (own[b][:, :, None] == visits[a]).any(2)
    meet = same | from_a | from_b
    table = int(np.argmax((own[a[0]] == cell) | (own[b[0]] == cell)))
    first = ~meet[:, :table].any(1)
    # In one table two cells may hold a pair; that of the smaller id counts.
    low_a = ids[used[a]] < ids[used[b]]
    low_cell = np.where(low_a, from_b[:, table], from_a[:, table])
    counted = np.where(same[:, table], True, np.where(low_cell, np.where(low_a, own[a, table], own[b, table]) == cell, True))
    keep = first & counted
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    label = np.arange(len(used))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    links = np.bincount(a, sizes[used[b]], minlength=len(used)) + np.bincount(b, sizes[used[a]], minlength=len(used))
    out = np.flatnonzero(links > 0)
    return ids[used[out]], links[out].astype(np.int64), ids[used[label[out]]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id) of every row of ``vectors``.

    Rows link if found and their cosine is at least ``cosine`` in double precision; equal vectors always do. A vector
    that is null, empty, zero or has null or non-finite components links with nothing, nor does a row without id;
    vectors of different dimension never link. Components take the smallest id that links reach. Repeated rows count
    each; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<float>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = materialize(rows.where(good).groupBy("embedding").agg(F.min("vec").alias("vec"), F.count("*").alias("size")), "vectors")
    entries = materialize(_entries(classes), "entries")
    crowd = entries.groupBy("cell").agg(F.count("*").alias("crowd"), F.max("owner").alias("owned")).where("crowd > 1 and owned").select("cell", "crowd")
    met = entries.join(materialize(crowd, "cells"), "cell")
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec"), blocks.cast("long")).cast("int")
    met = met.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    tile = F.xxhash64("cell", F.least("own", "with"), F.greatest("own", "with"))
    met = met.select(tile.alias("tile"), "cell", "owner", "vec", "size", "embedding", "own", "with")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            whole = table.combine_chunks().to_batches()[0]
            for batch in _same_width(whole, "embedding"):
                unit = _vectors(batch.column(batch.schema.get_field_index("embedding")))
                tile, cell, owner, vec, size, own, other = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("tile", "cell", "owner", "vec", "size", "own", "with"))
                edges = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1, append=tile[-1] + 1))
                parts = []
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    apart = None if (own[x:y] == other[x:y]).all() else own[x:y]
                    got = _tile(unit[x:y], vec[x:y], size[x:y].astype(float), owner[x:y], cell[x : x + 1].view(np.uint64)[0], apart, cosine)
                    if got is not None:
                        parts.append(got)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], names=["vec", "links", "root"])

    found = met.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "vec long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("vec").alias("src"), F.col("root").alias("dst"))).toDF("vec", "component")
    known = classes.join(links, "vec", "left").join(parts, "vec", "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component"))
    key = F.when(good, F.col("embedding"))
    out = rows.withColumn("embedding", key).join(materialize(known, "known"), "embedding", "left")
    return out.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component_id"))


def near_vector_report(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``near_vectors`` with the decision: the smallest vector of a component is kept."""
    found = near_vectors(vectors, id_col)
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
