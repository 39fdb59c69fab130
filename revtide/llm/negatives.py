"""Hard negatives by exact inner products, read from Hilbert-ordered blocks that zone maps choose.

1. Rows are sorted along a Hilbert curve over their most varying dimensions and written as Parquet, one row per block of
   some hundred vectors, with the least and greatest entry of each dimension (the zone map), its labels' range and its
   smallest id.
2. Anchors go in groups. A group is held against packs of zone maps: interval arithmetic bounds each anchor's product
   with all rows of a block from both sides. Only blocks whose bounds meet one of the anchor's score windows are read.
3. ``search`` first reads for each window the few blocks whose middle promises most. The k-th best row found there
   narrows the window from below; then all blocks are read that may still hold better rows. Nothing else is cut.
4. One search gives the positives (same label, no bounds), a second one the negatives in each positive's window.

Anchors are a fixed share of all rows and meet packs of zone maps and blocks, never single rows; what the tasks keep
per window is its best k rows. Zone maps prune what is clustered; vectors without structure are read in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtide.llm.common import materialize

#: Components become floor(SCALE * component); larger ones than LIMIT count as not finite, so that products are exact.
SCALE, LIMIT = 256, 2.0**16
#: Rows of a block, anchors of a group, zone maps of a pack, groups that one task holds against a block, rows of a sorted partition.
BLOCK, GROUP, PACK, HELD, SORTED = 256, 128, 2_048, 256, 16_384
#: Blocks read first for each window and pack.
SEEDS = 2
#: Dimensions of the Hilbert curve and bits of each.
CURVE, BITS = 8, 7

_MOST = np.iinfo(np.int64).max
_ROWS = "id long, label long, v array<long>, anchor boolean"
_BLOCKS = "block long, width int, size int, ids binary, labels binary, matrix binary, low binary, high binary, least_id long, least_label long, most_label long, anchors binary"
_REQUESTS = "group long, width int, size int, ids binary, labels binary, places binary, matrix binary, windows int, low binary, tie binary, high binary"
_PACKS = "pack int, width int, blocks binary, low binary, high binary, least_id binary, least_label binary, most_label binary"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of small non-negative integers along the Hilbert curve through their grid."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    # Undo the turns of ever smaller cells, then read the bits across dimensions as a Gray code.
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for d in range(n):
            turned = (x[d] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = out << 1 | (x[d] >> b) & 1
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in doubles where no sum can leave their range of integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    widths = batch.column(batch.schema.get_field_index(name)).value_lengths().to_numpy()
    for width in np.unique(widths):
        yield batch if (widths == width).all() else batch.filter(pa.array(widths == width))


def _spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each vector length: the most varying dimensions, their means and deviations. One small row per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in _by_width(whole, "v") if whole.num_rows else ():
                x = _matrix(batch.column(0)).astype(float)
                own = np.array([np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0)])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + own
        for width, own in sums.items():
            columns = [pa.array(np.full(width, width, np.int32)), pa.array(np.arange(width, dtype=np.int32)), *map(pa.array, own)]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "place", "n", "sum", "squares"])

    found = rows.select("v").mapInArrow(add, "width int, place int, n double, sum double, squares double")
    mean = F.sum("sum") / F.sum("n")
    table = found.groupBy("width", "place").agg(mean.alias("mean"), (F.sum("squares") / F.sum("n") - mean * mean).alias("variance"))
    # The widest dimensions of each vector length are all that reaches the driver.
    order = Window.partitionBy("width").orderBy(F.desc("variance"), "place")
    first = table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CURVE).orderBy("width", "rank").collect()
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for width in {r.width for r in first}:
        own = [r for r in first if r.width == width]
        out[width] = (np.array([r.place for r in own]), np.array([r["mean"] for r in own]), np.sqrt(np.maximum([r.variance for r in own], 1e-9)))
    return out


def write_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (id, label, v, anchor) in the order of the curve, with zone maps, written to the shared folder.

    Equal vectors have one place on the curve; there the id decides, so however many there are they fill many blocks.
    """
    spread = rows.sparkSession.sparkContext.broadcast(_spreads(rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_width(whole, "v") if whole.num_rows else ():
                x = _matrix(batch.column(2))
                if x.shape[1]:
                    dims, mean, deviation = spread.value[x.shape[1]]
                    cell = np.clip((x[:, dims] - mean) / deviation / 3 * (1 << (BITS - 1)) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
                    curve = hilbert(cell.astype(np.int64), BITS)
                else:
                    curve = np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], names=[*batch.schema.names, "curve"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= BLOCK:
                yield from blocks(rest.slice(0, BLOCK), part, made)
                rest, made = rest.slice(BLOCK), made + BLOCK
        if rest is not None and rest.num_rows:
            yield from blocks(rest, part, made)

    def blocks(table: pa.Table, part: int, made: int) -> Iterator[pa.RecordBatch]:
        whole = table.combine_chunks().to_batches()[0]
        for number, batch in enumerate(_by_width(whole, "v")):
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(2)).astype(np.int32)
            anchors = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int32)
            values = (part << 36 | made + number, x.shape[1], len(x), ids.tobytes(), labels.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), int(ids.min()), int(labels.min()), int(labels.max()), anchors.tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _BLOCKS.split(", ")], values, strict=True))], schema=_arrow(_BLOCKS))

    placed = rows.select("id", "label", "v", "anchor").mapInArrow(place, _ROWS + ", curve long")
    placed = materialize(placed, "placed")
    tasks = max(1, math.ceil(placed.count() / SORTED))
    ordered = placed.repartitionByRange(tasks, "curve", "id").sortWithinPartitions("curve", "id", "label")
    return materialize(ordered.select("id", "label", "v", "anchor").mapInArrow(cut, _BLOCKS), "blocks")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(fields: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _packs(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps, many to a row, and the number of packs they are dealt to."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for whole in batches:
            widths = whole.column(1).to_numpy()
            for width in np.unique(widths):
                own = whole.filter(pa.array(widths == width))
                for at in range(0, own.num_rows, PACK):
                    zone = own.slice(at, PACK)
                    numbers = [zone.column(i).to_numpy().tobytes() for i in (0, 4, 5, 6)]
                    bounds = [b"".join(zone.column(i).to_pylist()) for i in (2, 3)]
                    yield pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _PACKS.split(", ")], (part, int(width), numbers[0], *bounds, *numbers[1:]), strict=True))], schema=_arrow(_PACKS))

    zones = blocks.select("block", "width", "low", "high", "least_id", "least_label", "most_label")
    dealt = zones.repartition(max(1, math.ceil(zones.count() / PACK)), "block")
    packs = materialize(dealt.mapInArrow(pack, _PACKS), "packs")
    return packs, (packs.agg(F.max("pack")).first()[0] or 0) + 1


def _requests(blocks: DataFrame) -> DataFrame:
    """Groups of anchors, each with one window without bounds."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for block, width, size, ids, labels, matrix, anchors in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                at = np.frombuffer(anchors, np.int32)
                x = np.frombuffer(matrix, np.int32).reshape(size, width)[at]
                own = held.setdefault(width, [])
                own += zip(np.frombuffer(ids, np.int64)[at], np.frombuffer(labels, np.int64)[at], np.int64(block) * BLOCK + at, x, strict=True)
                while len(own) >= GROUP:
                    yield group(own[:GROUP], width, part << 40 | made)
                    del own[:GROUP]
                    made += 1
        for width, own in held.items():
            if own:
                yield group(own, width, part << 40 | made)
                made += 1

    def group(own: list[tuple], width: int, number: int) -> pa.RecordBatch:
        n = len(own)
        ids, labels, places = (np.array([o[i] for o in own], np.int64).tobytes() for i in range(3))
        values = (number, width, n, ids, labels, places, np.array([o[3] for o in own], np.int32).tobytes(), 1, np.full(n, -_MOST).tobytes(), np.full(n, _MOST).tobytes(), np.full(n, _MOST).tobytes())
        return pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in _REQUESTS.split(", ")], values, strict=True))], schema=_arrow(_REQUESTS))

    wanted = blocks.where(F.length("anchors") > 0).select("block", "width", "size", "ids", "labels", "matrix", "anchors")
    return materialize(wanted.mapInArrow(gather, _REQUESTS), "anchors")


def _unpack(row: dict) -> dict:
    """The arrays of a request."""
    n, m = row["size"], row["windows"]
    out = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "places")}
    out |= {c: np.frombuffer(row[c], np.int64).reshape(n, m) for c in ("low", "tie", "high")}
    return out | {"matrix": np.frombuffer(row["matrix"], np.int32).reshape(n, row["width"]).astype(np.int64)}


def choose(requests: DataFrame, packs: DataFrame, count: int, same: bool, seeds: int = 0) -> DataFrame:
    """(block, group, wanted): the anchors (by place in their group) that must read a block.

    With ``seeds``, only so many blocks for each window and pack: those whose middle lies nearest to the window's top.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = _unpack(row)
                blocks, least_id, least_label, most_label = (np.frombuffer(row[c], np.int64) for c in ("blocks", "least_id", "least_label", "most_label"))
                low, high = (np.frombuffer(row[c], np.int32).reshape(len(blocks), -1).astype(np.int64) for c in ("zone_low", "zone_high"))
                plus, minus = np.maximum(a["matrix"], 0), np.minimum(a["matrix"], 0)
                most = products(plus, high) + products(minus, low)
                least = products(plus, low) + products(minus, high)
                own = a["labels"][:, None]
                fits = (own >= least_label) & (own <= most_label) if same else (own != least_label) | (own != most_label)
                need = np.zeros(most.shape, bool)
                for w in range(row["windows"]):
                    bottom, tie, top = (a[c][:, w : w + 1] for c in ("low", "tie", "high"))
                    meets = fits & (least <= top) & ((most > bottom) | ((most == bottom) & (least_id <= tie)))
                    if seeds and len(blocks) > seeds:
                        far = np.abs(np.minimum(top, 2**61) - (most // 2 + least // 2)).astype(float)
                        far[~meets] = np.inf
                        nearest = np.argpartition(far, seeds - 1, axis=1)[:, :seeds]
                        chosen = np.zeros(meets.shape, bool)
                        np.put_along_axis(chosen, nearest, True, axis=1)
                        meets &= chosen
                    need |= meets
                read = np.flatnonzero(need.any(0))
                wanted = [np.flatnonzero(need[:, b]).astype(np.int32).tobytes() for b in read.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(blocks[read]), pa.array(np.full(len(read), row["group"])), pa.array(wanted, pa.binary())], names=["block", "group", "wanted"])

    zones = packs.withColumnsRenamed({"low": "zone_low", "high": "zone_high"})
    dealt = requests.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return dealt.join(zones, ["pack", "width"]).mapInArrow(bound, "block long, group long, wanted binary")


def scan(chosen: DataFrame, requests: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(group, place, window, score, id): of what each task reads, the best ``k`` rows of every window."""
    held = F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(requests.count() / HELD))))
    asked = chosen.join(requests, "group").withColumn("part", held)
    parts = asked.select("block", "part").distinct()
    plain = ["part", "block", "kind", "size", "ids", "labels", "matrix"]
    rows = blocks.join(parts, "block").withColumn("kind", F.lit(0)).select(*plain, "width")
    rows = rows.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["part"] != part:
                    yield from results(best)
                    best, part = {}, row["part"]
                if row["kind"] == 0:
                    block = (row["block"], *(np.frombuffer(row[c], np.int64) for c in ("ids", "labels")), np.frombuffer(row["matrix"], np.int32).reshape(row["size"], row["width"]).astype(np.int64))
                else:
                    compare(row, block, best)
        yield from results(best)

    def compare(row: dict, block: tuple, best: dict) -> None:
        a = _unpack(row)
        number, ids, labels, matrix = block
        at = np.frombuffer(row["wanted"], np.int32)
        if row["group"] not in best:
            empty = np.full((row["size"], row["windows"], k), -_MOST)
            best[row["group"]] = (empty, np.full(empty.shape, _MOST))
        scores, names = best[row["group"]]
        score = products(a["matrix"][at], matrix)
        own = a["labels"][at][:, None]
        fits = (own == labels) if same else (own != labels)
        # a row's own place: block and position
        fits &= a["places"][at][:, None] != np.int64(number) * BLOCK + np.arange(len(ids))
        for w in range(row["windows"]):
            low, tie, high = (a[c][at, w][:, None] for c in ("low", "tie", "high"))
            last_score, last_name = scores[at, w, -1][:, None], names[at, w, -1][:, None]
            good = fits & (score <= high) & ((score > low) | ((score == low) & (ids <= tie)))
            good &= (score > last_score) | ((score == last_score) & (ids < last_name)) | (last_name == _MOST)
            for i in np.flatnonzero(good.any(1)).tolist():
                hit = np.flatnonzero(good[i])
                s = np.concatenate([scores[at[i], w], score[i, hit]])
                n = np.concatenate([names[at[i], w], ids[hit]])
                order = np.lexsort((n, -s))[:k]
                scores[at[i], w], names[at[i], w] = s[order], n[order]

    def results(best: dict) -> Iterator[pa.RecordBatch]:
        for group, (scores, names) in best.items():
            place, window, rank = np.nonzero(names != _MOST)
            values = (np.full(len(place), group), place.astype(np.int32), window.astype(np.int32), scores[place, window, rank], names[place, window, rank])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["group", "place", "window", "score", "id"])

    dealt = rows.repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    return dealt.mapInArrow(read, "group long, place int, window int, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each window, ranked from 1."""
    order = Window.partitionBy("group", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(requests: DataFrame, packs: DataFrame, count: int, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(group, place, window, rank, score, id): the ``k`` best rows of each window, of the anchor's label or of others."""
    first = materialize(_best(scan(choose(requests, packs, count, same, SEEDS), requests, blocks, same, k), k).where(F.col("rank") == k), "seeds")
    known = first.groupBy("group").agg(F.collect_list(F.struct("place", "window", "score", "id")).alias("known"))  # at most GROUP times the windows

    def tighten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = _unpack(row)
                low, tie = a["low"].copy(), a["tie"].copy()
                for x in row.pop("known") or ():
                    low[x["place"], x["window"]], tie[x["place"], x["window"]] = x["score"], x["id"]
                yield pa.RecordBatch.from_pylist([row | {"low": low.tobytes(), "tie": tie.tobytes()}], schema=_arrow(_REQUESTS))

    columns = [f.split()[0] for f in _REQUESTS.split(", ")]
    tight = materialize(requests.join(known, "group", "left").select(*columns, "known").mapInArrow(tighten, _REQUESTS), "requests")
    chosen = materialize(choose(tight, packs, count, same), "chosen")
    return _best(materialize(scan(chosen, tight, blocks, same, k), "found"), k)


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of integer scores, rounded up or down, without leaving 64 bits."""
    sign = -1 if up else 1
    whole, rest = np.divmod(sign * score, 100)
    return sign * (whole * percent + rest * percent // 100)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90)
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(256 * component). ``anchor`` says which rows of ``vectors`` are anchors. Positives
    are an anchor's best other rows of its label; for each, the best rows of other labels follow whose score is
    between the two percentages of the positive's. Higher scores first, ties by smaller id. Labels and ids are integers.
    A row takes no part if its id, label or vector is null or a component null, non-finite or of ``LIMIT`` or more; vectors
    of different dimension never meet. Rows that repeat an id are rows of their own: each anchors if ``anchor`` says so.
    An empty table gives no rows; other columns are ignored.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = named.where("id is not null and label is not null and v is not null").where(~F.coalesce(bad, F.lit(True)))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))
    blocks = write_blocks(rows)
    packs, count = _packs(blocks)
    requests = _requests(blocks)
    best = materialize(search(requests, packs, count, blocks, True, positives), "positives")
    known = best.groupBy("group").agg(F.collect_list(F.struct("place", "rank", "score")).alias("known"))  # at most GROUP times ``positives``

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low = np.full((row["size"], positives), _MOST)
                high, tie = np.full_like(low, -_MOST), np.full_like(low, _MOST)
                for x in row.pop("known"):
                    score = np.int64(x["score"])
                    low[x["place"], x["rank"] - 1] = _share(score, percent[0], True)
                    high[x["place"], x["rank"] - 1] = _share(score, percent[1], False)
                new = {"windows": positives, "low": low.tobytes(), "high": high.tobytes(), "tie": tie.tobytes()}
                yield pa.RecordBatch.from_pylist([row | new], schema=_arrow(_REQUESTS))

    columns = [f.split()[0] for f in _REQUESTS.split(", ")]
    wanted = materialize(requests.join(known, "group").select(*columns, "known").mapInArrow(windows, _REQUESTS), "windows")
    found = search(wanted, packs, count, blocks, False, negatives)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["group", "place", "anchor_id"])

    anchors = requests.select("group", "ids").mapInArrow(name, "group long, place int, anchor_id long")
    each = best.select("group", "place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors, ["group", "place"])
    mined = found.select("group", "place", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return each.join(mined, ["group", "place", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negative_report(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``mine_hard_negatives`` with every hundredth id as anchors, labels of every seventh id moved on by one."""
    label = F.when(F.col(id_col) % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select(id_col, label.alias("label"), "embedding"), F.col(id_col) % 100 == 0, id_col)
