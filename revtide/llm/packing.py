"""Token ids packed into fixed-length rows, best fit decreasing.

A task tokenises its documents and packs them in blocks of bounded size: pieces in falling order of length, each into
the row with the least room that still holds it. A segment tree over room sizes finds that row. A document longer than
a row is split into whole rows and a rest; nothing is lost, and every piece says which document and offset it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import text_slices

#: The file's place is a parameter; this is where the box has it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's texts are split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The free id that ends a document and fills up rows.
END = 50_256
#: Ids in a row, and ids that a task packs together.
CAPACITY, BLOCK_IDS = 2_048, 2_000_000

# What the pattern takes for white space. Its matcher fails on very long runs, so it gets none of 1,000 and more.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

SEGMENT = T.StructType([T.StructField("doc", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.IntegerType())])
ROWS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("pack", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)
_ARROW_SEGMENT = pa.struct([("doc", pa.string()), ("offset", pa.int64()), ("length", pa.int32())])
_NAMES = [f.name for f in ROWS.fields]


class RoomTree:
    """Segment tree over room sizes 0 to ``capacity``: finds the smallest size of at least so much that some row has."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node //= 2

    def at_least(self, need: int) -> int:
        """The smallest room of ``need`` or more, or -1."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces of equal length keep their order, so do rows of equal room (last opened first)."""
    tree = RoomTree(capacity)
    waiting: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[piece]
        room = tree.at_least(need)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = waiting[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        if room > need:
            waiting.setdefault(room - need, []).append(row)
            tree.add(room - need, 1)
    return rows


def load_encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text. The pattern takes a run of white space, less its last character before a word, as one piece."""
    runs = list(_LONG_SPACE.finditer(text))
    if not runs:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in runs:
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at : run.start()]) + encoding._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def _ranks(path: str) -> dict[bytes, int]:
    return load_encoding(path)._mergeable_ranks


def pack_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, vocabulary_path: str = RANKS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows of all documents: part and pack name a row; ids and positions are ``capacity`` little-endian uint16 each.

    A document's ids are its tokens and ``end_id``; positions begin anew with each segment; cu_seqlens are the
    segments' cumulative lengths from 0; what is left of a row is filled with ``end_id`` at position 0 behind the last
    of them. Segments name the document (its id as text, null if it has none), the offset of their first id in it
    and their length. A null or empty text has no segment; repeated rows are packed each; other columns are ignored.
    Ids must be below 65,536 and rows at most so long.
    """
    if not 0 < capacity <= 65_536:
        raise ValueError("capacity must be from 1 to 65536")
    ranks = documents.sparkSession.sparkContext.broadcast(_ranks(vocabulary_path))
    slim = documents.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where("text is not null and text != ''")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        part, packs, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                names = batch.column(0).slice(a, b - a).to_pylist()
                for name, text in zip(names, batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    ids = np.array([*encode(encoding, text), end_id], np.uint16)
                    for at in range(0, len(ids), capacity):
                        held.append((name, at, ids[at : at + capacity]))
                    size += len(ids)
                    if size >= block_ids:
                        yield from block(held, part, packs)
                        packs, held, size = packs + len(held), [], 0
        if held:
            yield from block(held, part, packs)

    def block(held: list[tuple[str | None, int, np.ndarray]], part: int, first: int) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for number, row in enumerate(best_fit_decreasing([len(ids) for _, _, ids in held], capacity)):
            matrix = np.full(capacity, end_id, "<u2")
            positions = np.zeros(capacity, "<u2")
            ends, segments = [0], []
            for piece in row:
                name, at, ids = held[piece]
                matrix[ends[-1] : ends[-1] + len(ids)] = ids
                positions[ends[-1] : ends[-1] + len(ids)] = np.arange(len(ids))
                ends.append(ends[-1] + len(ids))
                segments.append({"doc": name, "offset": at, "length": len(ids)})
            out.append((part, first + number, matrix.tobytes(), positions.tobytes(), ends, segments))
            if len(out) == 500:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(_ARROW_SEGMENT))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=_NAMES)

    return slim.mapInArrow(scan, ROWS)


def write_packed(documents: DataFrame, path: str, **options) -> None:
    """Pack and write as Parquet files."""
    pack_tokens(documents, **options).write.parquet(path)


def packing_report(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per packed row: its ids, cumulative lengths, documents and offsets, and digests of ids and positions."""
    segments = F.col("segments")
    return pack_tokens(documents, id_col).select(
        "part",
        "pack",
        "ids",
        "cu_seqlens",
        segments["doc"].alias("docs"),
        segments["offset"].alias("offsets"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("positions", 256).alias("positions_sha256"),
    )
