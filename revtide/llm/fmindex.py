"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents inside a task. Its words that the benchmark has at all become integer symbols;
stretches of such words too short for any test phrase cannot hold one and are left out, the others form the
shard's text, ended each by a separator. Over that text the task builds a suffix array, its Burrows-Wheeler
transform, a wavelet matrix for ranks and a sample of suffix positions. All test phrases are then searched
backwards at once, their occurrences located by walking to the next sampled position, and the covered words
merged to removal spans.

Phrases are the distinct windows of ``window`` words of each benchmark item; an item with fewer words is one
phrase. The benchmark is sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one pass each, so
what is broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import free_name, materialize, text_slices, with_column
from revtide.llm.words import NOT_ALNUM, split_words

#: Characters of benchmark text that one pass over the documents searches.
BLOCK_CHARS = 16_000_000
#: Every so many suffix positions are kept.
SAMPLE_EVERY = 8

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
_ARROW_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("item_ids", pa.list_(pa.string())),
    ]
)


@dataclass
class Phrases:
    """Test phrases as rows of symbols 1.. (0 fills up), and the items that hold each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    item_of: np.ndarray
    item_ids: list[str]


def phrases(rows: list[tuple[str, str]], window: int) -> Phrases:
    """Phrases of benchmark rows (item id, text)."""
    words = split_words(pa.array([text for _, text in rows], pa.string()), NOT_ALNUM, lower=True)
    vocabulary, codes = np.unique(words.hashes, return_inverse=True)
    codes = codes.astype(np.int64) + 1
    ids = sorted({item for item, _ in rows})
    number = {item: i for i, item in enumerate(ids)}
    made: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    for d, (item, _) in enumerate(rows):
        own = codes[words.first[d] : words.first[d + 1]]
        if len(own) >= window:
            made.append(np.lib.stride_tricks.sliding_window_view(own, window))
        elif len(own):
            made.append(np.pad(own, (0, window - len(own)))[None, :])
        else:
            continue
        owner.append(np.full(len(made[-1]), number[item]))
    if not made:
        nothing = np.zeros(0, np.int64)
        return Phrases(vocabulary, np.zeros((0, window), np.int64), nothing, np.zeros(1, np.int64), nothing, ids)
    symbols, which = np.unique(np.concatenate(made), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(symbols) + 1))
    return Phrases(vocabulary, symbols, (symbols > 0).sum(1), first, pairs[:, 1], ids)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; separators (0) rank by their place, so all suffixes differ."""
    n = len(text)
    zeros = text == 0
    rank = text + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[: n - step]
        key = rank * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if int(rank.max()) == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in prefixes, one bit vector with running counts per level."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(sequence.max()).bit_length()) if len(sequence) else 1
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        lo, hi = np.zeros_like(at), at
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            up = ((symbol >> level) & 1).astype(bool)
            lo = np.where(up, zeros + ones[lo], lo - ones[lo])
            hi = np.where(up, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Index of a text of symbols in which 0 ends every stretch."""

    def __init__(self, text: np.ndarray, sample_every: int = SAMPLE_EVERY):
        order = suffix_array(text)
        self.n = len(text)
        self.last = text[order - 1]
        self.top = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.tree = WaveletMatrix(self.last)
        stretch_start = np.concatenate([[True], text[:-1] == 0])
        kept = (order % sample_every == 0) | stretch_start[order]
        self.sampled = kept
        self.position = np.where(kept, order, 0)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase the range of suffixes that begin with it."""
        lo = np.zeros(len(symbols), np.int64)
        hi = np.full(len(symbols), self.n, np.int64)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            go = np.flatnonzero((step < lengths) & (lo < hi))
            if not len(go):
                break
            symbol = symbols[go, lengths[go] - 1 - step]
            absent = symbol > self.top
            symbol = np.where(absent, 0, symbol)
            low = self.before[symbol] + self.tree.rank(symbol, lo[go])
            high = self.before[symbol] + self.tree.rank(symbol, hi[go])
            lo[go], hi[go] = low, np.where(absent, low, high)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by their rank."""
        out = np.zeros(len(rows), np.int64)
        todo, row, walked = np.arange(len(rows)), rows, 0
        while len(todo):
            here = self.sampled[row]
            out[todo[here]] = self.position[row[here]] + walked
            todo, row = todo[~here], row[~here]
            symbol = self.last[row]
            row = self.before[symbol] + self.tree.rank(symbol, row)
            walked += 1
        return out


def _shard(texts: pa.Array, wanted: Phrases, old: list[dict] | None) -> list[dict]:
    """Hits of one shard; ``old`` holds what earlier benchmark blocks found."""
    words = split_words(texts, NOT_ALNUM, lower=True)
    n = len(words.hashes)
    covered = np.zeros(n + 1, np.int64)
    found_doc, found_item = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n and len(wanted.symbols):
        at = np.minimum(np.searchsorted(wanted.vocabulary, words.hashes), len(wanted.vocabulary) - 1)
        known = wanted.vocabulary[at] == words.hashes
        document = np.repeat(np.arange(len(texts)), words.counts)
        edge = np.concatenate([[True], (known[1:] != known[:-1]) | (document[1:] != document[:-1])])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, n))
        use = known[begin] & (size >= int(wanted.lengths.min()))
        begin, size = begin[use], size[use]
        if len(begin):
            ends = np.cumsum(size + 1)
            place = np.repeat(begin - (ends - size - 1), size + 1) + np.arange(int(ends[-1]))
            text = np.zeros(len(place), np.int64)
            inside = np.ones(len(place), bool)
            inside[ends - 1] = False
            text[inside] = at[place[inside]] + 1
            index = FMIndex(text)
            lo, hi = index.search(wanted.symbols, wanted.lengths)
            count = hi - lo
            phrase = np.repeat(np.arange(len(count)), count)
            rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            start = place[index.locate(rows)]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + wanted.lengths[phrase], -1)
            held = np.diff(wanted.item_first)[phrase]
            owner = np.repeat(wanted.item_first[phrase] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
            pairs = np.unique(np.stack([np.repeat(document[start], held), wanted.item_of[owner]], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
            found_doc, found_item = pairs[:, 0], pairs[:, 1]
    hit = np.cumsum(covered[:-1]) > 0
    out = []
    for d in range(len(texts)):
        a, b = int(words.first[d]), int(words.first[d + 1])
        own = hit[a:b]
        ids = {wanted.item_ids[i] for i in found_item[np.searchsorted(found_doc, d) : np.searchsorted(found_doc, d + 1)]}
        if old is not None:
            own = own.copy()
            for span in old[d]["spans"]:
                own[span["first"] : span["last"] + 1] = True
            ids.update(old[d]["item_ids"])
        spans: list[dict] = []
        if own.any():
            step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            spans = [{"first": f, "last": e - 1} for f, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)]
        out.append({"n_words": b - a, "n_hit": int(own.sum()), "spans": spans, "item_ids": sorted(ids)})
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_chars: int) -> Iterator[Phrases]:
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    for b in range(blocks):
        yield phrases([(r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()], window)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    hits: str = "hits",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``documents`` with a struct column ``hits``: n_words, n_hit, spans (first and last word, from 0) and item_ids.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A null or empty text has no
    words and no hits. Benchmark rows without id or text are left out; rows that repeat an id count as one item.
    An empty benchmark hits nothing. Repeated documents are judged each by itself; other columns stay as they
    are, and ``hits`` must be a name that ``documents`` hasn't (``common.free_name`` finds one).
    """
    out = documents
    spark = documents.sparkSession
    for number, block in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_chars)):
        shared = spark.sparkContext.broadcast(block)
        schema = T.StructType([*documents.schema.fields, T.StructField(hits, HITS)])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, later=number > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                for a, b in text_slices(texts):
                    part = batch.slice(a, b - a)
                    old = part.column(part.schema.get_field_index(hits)).to_pylist() if later else None
                    found = pa.array(_shard(texts.slice(a, b - a), shared.value, old), _ARROW_HITS)
                    if later:
                        part = part.drop_columns([hits])
                    yield with_column(part, hits, found)

        if number:
            out = materialize(out, "decontamination")
        out = out.mapInArrow(scan, schema)
    return out


def is_contaminated(hits: Column) -> Column:
    """At least one word in twenty is hit."""
    return (hits["n_hit"] > 0) & (F.lit(20) * hits["n_hit"] >= hits["n_words"])


def contamination_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, the digest of the items found and the verdict."""
    slim = documents.select(F.col(id_col), F.col("text"))
    hits = F.col("hits")
    return find_contamination(slim, benchmark).select(
        id_col,
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["item_ids"], ","), 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that ``is_contaminated`` doesn't convict, with all their columns."""
    name = free_name(documents, "hits")
    found = find_contamination(documents, benchmark, hits=name)
    return found.where(~is_contaminated(F.col(name))).drop(name)
