"""Exact removal of passages that an earlier document has, by super-k-mers.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of the runs of ``m``
words in it, so equal windows have equal minimisers wherever they stand. Consecutive windows of a document that
share a minimiser form a super-k-mer.

1. Every document gives its super-k-mers as (minimiser, place), without text. Minimisers of a single document
   are dropped: their windows cannot repeat in another one.
2. The other super-k-mers travel to their bucket (the minimiser) as one packed string of words each. Equal strings
   are merged first, keeping the smallest document, so a passage that a third of all documents share is one row.
3. In its bucket, sorting the windows of all strings gives the smallest document of each window. A bucket with more
   than ``crowd`` strings is not sorted by one task: its windows are spread by their own hash instead.
4. Each place learns which of its windows start in a smaller document; the covered words are removed.

Windows are compared by a 64-bit hash among those of one 64-bit minimiser, so two different windows would have to
agree in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import discard, free_name, materialize, text_slices, with_column
from revtide.llm.words import as_long, gram_hashes, split_words, window_starts

#: Words of a window and of the runs that its minimiser is taken from.
WINDOW, RUN = 50, 12
#: Windows of a super-k-mer at most; a longer run of windows is cut (texts that repeat one word).
LONGEST = 128
#: Strings that one task may sort together.
CROWD = 5_000

REMOVAL = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_ARROW_REMOVAL = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_PLACES = "bucket long, start int, windows int, row long, doc long"


def super_kmers(hashes: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts' words: minimiser, number of the first window's word, and windows of each super-k-mer."""
    starts = window_starts(first, k)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    least = gram_hashes(hashes, m)
    width, span = k - m + 1, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    value = least[starts]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)])
    begin = np.flatnonzero(new)
    within = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
    begin = np.flatnonzero(new | (within % LONGEST == 0))
    return value[begin], starts[begin], np.diff(np.append(begin, len(starts)))


def _places(documents: DataFrame, text_col: str, k: int, m: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2)):
                words = split_words(batch.column(2).slice(a, b - a))
                bucket, start, windows = super_kmers(words.hashes, words.first, k, m)
                at = np.searchsorted(words.first, start, side="right") - 1
                row, doc = (batch.column(i).slice(a, b - a).to_numpy()[at] for i in (0, 1))
                values = (as_long(bucket), (start - words.first[at]).astype(np.int32), windows.astype(np.int32), row, doc)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["bucket", "start", "windows", "row", "doc"])

    return documents.where("doc is not null").select("row", "doc", text_col).mapInArrow(scan, _PLACES)


def _packed(documents: DataFrame, places: DataFrame, text_col: str, k: int) -> DataFrame:
    """Places with their words as one string."""
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("bucket", "start", "windows")).alias("at"))
    # Rows that repeat an id and its text have the same places: one of them is enough.
    texts = documents.where("doc is not null").select("row", "doc", text_col).join(wanted, "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, texts, at = (batch.column(i) for i in range(4))
            for i in range(len(batch)):
                words = (texts[i].as_py() or "").encode("utf-8", "replace").split()
                own = at[i].values
                bucket, start, windows = (own.field(j) for j in range(3))
                strings = [b" ".join(words[s : s + n + k - 1]) for s, n in zip(start.to_pylist(), windows.to_pylist(), strict=True)]
                size = len(strings)
                yield pa.RecordBatch.from_arrays(
                    [bucket, start, pa.array(strings, pa.binary()), pa.array(np.repeat(rows[i].as_py(), size)), pa.array(np.repeat(docs[i].as_py(), size))],
                    names=["bucket", "start", "packed", "row", "doc"],
                )

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in cut(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 5_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    packed = texts.mapInArrow(together, "bucket long, start int, packed binary, row long, doc long")
    return packed.withColumn("string", F.xxhash64("packed"))


def _windows(packed: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of packed strings, and the number of its string."""
    words = split_words(packed.cast(pa.string()))
    starts = window_starts(words.first, k)
    hashes = gram_hashes(words.hashes, k)[starts] if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(words.first, starts, side="right") - 1


def _earliest(packed: DataFrame, k: int, crowd: int) -> DataFrame:
    """(bucket, string, first): of each different packed string, the smallest document of each of its windows in turn."""
    crowded = packed.select("bucket", "string").distinct().groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > crowd)
    # Few rows: one for every ``crowd`` strings at most.
    crowded = materialize(crowded.select("bucket"), "crowded")
    strings = packed.groupBy("bucket", "string").agg(F.min("doc").alias("doc"), F.first("packed").alias("packed"))

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            last = rest.column("bucket")[-1].as_py()
            whole = int(np.searchsorted(rest.column("bucket").to_numpy(), last))
            if whole:
                yield count(rest.slice(0, whole).combine_chunks())
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield count(rest.combine_chunks())

    def count(table: pa.Table) -> pa.RecordBatch:
        bucket, string, doc = (table.column(c).to_numpy() for c in ("bucket", "string", "doc"))
        hashes, owner = _windows(table.column("packed").combine_chunks(), k)
        order = np.lexsort((doc[owner], hashes, bucket[owner]))
        b, h = bucket[owner][order], hashes[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (h[1:] != h[:-1])]) if len(order) else np.zeros(0, bool)
        first = np.empty(len(order), np.int64)
        first[order] = doc[owner][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        ends = np.searchsorted(owner, np.arange(len(bucket) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(string), pa.ListArray.from_arrays(pa.array(ends), pa.array(first))], names=["bucket", "string", "first"])

    columns = ["bucket", "string", "doc", "packed"]
    calm = strings.join(crowded, "bucket", "left_anti").select(columns).repartition("bucket").sortWithinPartitions("bucket")
    calm = calm.mapInArrow(sort_windows, "bucket long, string long, first array<long>")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = _windows(batch.column(3), k)
            bucket, string, doc = (batch.column(i).to_numpy()[owner] for i in range(3))
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            values = (bucket, string, doc, place.astype(np.int32), as_long(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["bucket", "string", "doc", "place", "window"])

    windows = strings.join(crowded, "bucket", "left_semi").select(columns).mapInArrow(spread, "bucket long, string long, doc long, place int, window long")
    least = materialize(windows.groupBy("bucket", "window").agg(F.min("doc").alias("least")), "windows")
    spread_out = (
        windows.join(least, ["bucket", "window"])
        .groupBy("bucket", "string")
        .agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("all"))
        .select("bucket", "string", F.col("all")["least"].alias("first"))
    )
    return calm.unionByName(spread_out)


def find_repeats(documents: DataFrame, removal: str = "removal", id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, m: int = RUN, crowd: int = CROWD) -> DataFrame:
    """``documents`` with a struct column ``removal``: n_words, n_removed and kept, the words left joined by one space.

    A word goes if any window of ``k`` words that covers it also starts in a document with a smaller id; all windows
    are judged on the input. Words are runs of anything but ASCII white space. Ids are integers. A null or empty
    text has no words; a document without id, or with fewer than ``k`` words, keeps all. Rows that share an id never
    remove each other's words. All other columns stay; ``removal`` must be a new name.
    """
    row, doc = free_name(documents, "row"), free_name(documents, "doc")
    named = documents.select("*", F.xxhash64(id_col, text_col).alias(row), F.col(id_col).cast("long").alias(doc))
    slim = named.select(F.col(row).alias("row"), F.col(doc).alias("doc"), F.col(text_col).alias("text"))
    every = materialize(_places(slim, "text", k, m), "places")
    shared = every.groupBy("bucket").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("bucket")
    places = every.join(materialize(shared, "buckets"), "bucket", "left_semi").select("bucket", "start", "windows", "row").distinct()
    packed = materialize(_packed(slim, places, "text", k), "packed")
    discard(every)
    first = materialize(_earliest(packed, k, crowd), "earliest")
    late = F.filter(F.transform("first", lambda x, i: F.when(x < F.col("doc"), F.col("start") + i)), lambda x: x.isNotNull())
    removed = (
        packed.select("bucket", "string", "start", "row", "doc")
        .join(first, ["bucket", "string"])
        .select("row", late.alias("late"))
        .where(F.size("late") > 0)
        .groupBy("row")
        .agg(F.flatten(F.collect_list("late")).alias("late"))
    )
    starts = free_name(named, "late")
    joined = named.join(removed.select(F.col("row").alias(row), F.col("late").alias(starts)), row, "left").drop(row, doc)
    joined = joined.select(*documents.columns, starts)
    schema = T.StructType([*documents.schema.fields, T.StructField(removal, REMOVAL)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in text_slices(texts):
                part = batch.slice(a, b - a)
                late = part.column(part.num_columns - 1)
                found = []
                for i, text in enumerate(texts.slice(a, b - a).to_pylist()):
                    words = (text or "").encode("utf-8", "replace").split()
                    gone = 0
                    if late[i].is_valid and words:
                        change = np.zeros(len(words) + 1, np.int64)
                        at = np.unique(late[i].values.to_numpy())
                        change[at] += 1
                        change[at + k] -= 1
                        keep = np.cumsum(change[:-1]) == 0
                        gone = len(words) - int(keep.sum())
                        kept = [words[j] for j in np.flatnonzero(keep).tolist()]
                    else:
                        kept = words
                    found.append({"n_words": len(words), "n_removed": gone, "kept": b" ".join(kept).decode()})
                yield with_column(part.drop_columns([part.schema.names[-1]]), removal, pa.array(found, _ARROW_REMOVAL))

    return joined.mapInArrow(cut, schema)


def repeats_report(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: words, words removed and the digest of the words kept."""
    found = find_repeats(documents.select(id_col, "text"), id_col=id_col)
    removal = F.col("removal")
    return found.select(
        id_col,
        removal["n_words"].alias("n_words"),
        removal["n_removed"].alias("n_removed"),
        F.sha2(removal["kept"], 256).alias("kept_sha256"),
    )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """Documents without the repeated words; a text that loses none stays as it is. ``n_chars`` follows if there is one."""
    name = free_name(documents, "removal")
    found = find_repeats(documents, name)
    cut = found.withColumn("text", F.when(F.col(name)["n_removed"] > 0, F.col(name)["kept"]).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(name)["n_removed"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(documents.columns)
