"""Documents packed into token sequences by the sum-of-squares rule.

1. ``cut_documents`` tokenises every whole text and cuts what is longer than a sequence into full pieces and a shorter
   first one. Every piece gets a number of its own (task and place), so that it can be told apart whatever its id.
2. ``place_pieces`` moves only numbers and lengths. A task takes a block of pieces, longest first, and puts each where
   the sum over all gaps of (open sequences with this gap) squared becomes smallest: beside others in an open sequence,
   or alone in a new one; of equal places the fullest. So no gap gets common, and later pieces find one that fits.
3. Sequences that end full are done. The pieces of the others are packed anew in rounds, by ever fewer tasks, until
   one block holds all of them (or a round brings them down by less than ``FALL``). Each block repeats that within
   itself as long as it saves sequences. Blocks are bounded, so are all tasks.

A round leaves open sequences of every task; after the rounds there is one such remainder, whatever the input's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.bytebpe import MODEL, Encoder, load_model
from revtide.llm.common import materialize, text_slices

#: Ids of a sequence, the id that ends a document, and pieces that one task packs together.
CAPACITY, END, BLOCK = 1_024, 2, 100_000
#: Least share by which a round has to bring down the pieces that are left, and times that a block is gone through again.
FALL, AGAIN = 0.1, 30

_PLACED = "part int, number long, length int, sequence_id long, offset int, full boolean"


def cut_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, model_path: str = MODEL) -> DataFrame:
    """Pieces of all documents: part and number (which name a piece), ``id_col``, piece, start, length, ids.

    A document's ids are the tokenizer's without special tokens added, then ``end_id``; a null or empty text has just
    that one. One with more than ``capacity`` ids is cut into pieces of so many; what is over comes first. ``start``
    counts the ids before a piece, ``ids`` are little-endian unsigned 32-bit numbers. Every row is cut, also those
    without id or with another row's; other columns are left out. Numbers depend on how the rows are dealt to tasks:
    write the result before using it twice.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    model = documents.sparkSession.sparkContext.broadcast(load_model(model_path))
    kind = documents.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("number", T.LongType()),
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = Encoder(model.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                rows, places, starts, lengths, blobs = [], [], [], [], []
                for row, text in enumerate(batch.column(1).slice(a, b - a).to_pylist(), a):
                    ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                    ends = np.arange(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                    begins = np.concatenate([[0], ends[:-1]])
                    rows += [row] * len(ends)
                    places += range(len(ends))
                    starts += begins.tolist()
                    lengths += (ends - begins).tolist()
                    blobs += [ids[x:y].tobytes() for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(rows), part, np.int32)),
                    pa.array(np.arange(made, made + len(rows))),
                    batch.column(0).take(pa.array(rows)),
                    pa.array(places, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int32()),
                    pa.array(blobs, pa.binary()),
                ]
                made += len(rows)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the ids in each sequence; pieces are taken in the given order."""
    # Half the change of the sum: 1/2 - count for leaving a level, 1/2 + count for entering one; a full one has no gap.
    count = np.zeros(capacity + 1)
    enter = np.zeros(capacity + 1)
    enter[1:capacity] = 0.5
    leave = np.full(capacity + 1, np.inf)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        level = 0
        if need < capacity:
            change = leave[1 : capacity - need + 1] + enter[need + 1 :]
            best = len(change) - 1 - int(change[::-1].argmin())
            if change[best] <= enter[need]:
                level = best + 1
        if level:
            at = waiting[level].pop()
            count[level] -= 1
            enter[level] = count[level] + 0.5
            leave[level] = 0.5 - count[level] if count[level] else np.inf
        else:
            at = len(filled)
            filled.append(0)
        sequence[i], offset[i] = at, level
        filled[at] = level = level + need
        if level < capacity:
            waiting[level].append(at)
            count[level] += 1
            enter[level] = count[level] + 0.5
            leave[level] = 0.5 - count[level]
    return sequence, offset, np.array(filled, np.int64)


def repeated(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sequence, offset and whether that sequence is full, of each piece, and the number of sequences.

    The pieces of sequences that stay open are gone through again as long as that saves any.
    """
    sequence, offset, filled = sum_of_squares(lengths, capacity)
    for _ in range(AGAIN):
        left = np.flatnonzero(filled[sequence] < capacity)
        own, place, levels = sum_of_squares(lengths[left], capacity)
        if len(levels) >= int((filled < capacity).sum()):
            break
        sequence[left], offset[left] = own + len(filled), place
        used, sequence = np.unique(sequence, return_inverse=True)
        filled = np.concatenate([filled, levels])[used]
    return sequence, offset, filled[sequence] == capacity, len(filled)


def _pack(pieces: DataFrame, capacity: int, step: int, block: int) -> DataFrame:
    """One round over (part, number, length): every piece with its sequence, and whether that became full."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        task = step << 56 | TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                size += held[-1].num_rows
                if size >= block:
                    out, new = packed(held, task + made)
                    yield out
                    held, size, made = [], 0, made + new
        if held:
            yield packed(held, task + made)[0]

    def packed(held: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(held).combine_chunks()
        part, number, length = (table.column(c).to_numpy() for c in ("part", "number", "length"))
        order = np.lexsort((number, part, -length))
        part, number, length = part[order], number[order], length[order]
        sequence, offset, full, made = repeated(length, capacity)
        values = (part, number, length, first + sequence, offset.astype(np.int32), full)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["part", "number", "length", "sequence_id", "offset", "full"]), made

    return pieces.select("part", "number", "length").mapInArrow(scan, _PLACED)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(part, number, sequence_id, offset) of all ``pieces`` (part, number, length of 1 to ``capacity``)."""
    rest, rows, step = pieces, pieces.count(), 0
    done: list[DataFrame] = []
    while True:
        tasks = max(1, math.ceil(rows / block))
        placed = materialize(_pack(rest.repartition(tasks, "part", "number"), capacity, step, 2 * block), "placed")
        left = placed.where(~F.col("full")).count() if tasks > 1 else 0
        if not left or left > (1 - FALL) * rows:
            done.append(placed)
            break
        done.append(placed.where("full"))
        rest, rows, step = placed.where(~F.col("full")), left, step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("part", "number", "sequence_id", "offset")


def pack_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, model_path: str = MODEL, block: int = BLOCK) -> DataFrame:
    """All pieces of ``cut_documents`` with their ids, the sequence they are packed into and their offset in it.

    Sequences have at most ``capacity`` ids, and pieces lie in them side by side from 0. See ``cut_documents`` for
    nulls, empty and long texts and repeated rows; an empty table gives no pieces.
    """
    pieces = materialize(cut_documents(documents, id_col, text_col, capacity, end_id, model_path), "pieces")
    placed = place_pieces(pieces.select("part", "number", "length"), capacity, block)
    return pieces.join(placed, ["part", "number"]).drop("part", "number")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack_documents``: its ids, and where each piece's ids begin and the last one's end.

    A sequence is at most one row of ``capacity`` ids, so its pieces are few.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = packed.groupBy("sequence_id").agg(own.alias("own"))
    ends = F.concat(F.col("own")["offset"], F.array(F.element_at("own", -1)["offset"] + F.element_at("own", -1)["length"]))
    return grouped.select("sequence_id", F.aggregate("own", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"), ends.alias("cu_seqlens"))


def packing_report(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces of ``pack_documents`` with a digest in place of their ids, which go no further than their task.

    What is written between the steps is one narrow row per piece.
    """
    cut = cut_documents(documents, id_col).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    pieces = materialize(cut, "pieces")
    placed = place_pieces(pieces.select("part", "number", "length"))
    return pieces.join(placed, ["part", "number"]).select(id_col, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
