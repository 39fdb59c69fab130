"""Toxicity of texts that hide their words: restore them through a noisy channel, then score what they say.

1. ``character_model`` counts character trigrams of all texts and turns them into log probabilities.
2. ``restore`` finds stretches that look disguised (letters mixed with digits or signs, letters repeated three
   times or more, single letters with separators between) and decodes each: a lattice of what every character may
   stand for, the best path by channel cost plus language model (Viterbi over the last two letters).
3. ``train`` learns from labelled rows which byte n-grams of restored words tell toxic texts, ``score_toxicity``
   applies that to every whole text.

The classifier is fitted on at most about ``SAMPLE_ROWS`` labelled rows (picked by a hash of the id) and keeps
``FEATURES`` n-grams; both bounds are parameters. The character counts cover all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtide.llm.common import SLICE_BYTES, free_name, materialize, text_slices, with_column
from revtide.llm.words import mix

#: Labelled rows that the classifier is fitted on, about.
SAMPLE_ROWS = 40_000
#: N-grams that the classifier may use.
FEATURES = 8_000
#: An n-gram has to be so many times as frequent in toxic texts (as a logarithm).
LEAST_LOG_RATIO = 1.0
#: N-grams are told apart by this many bits of a hash.
FEATURE_BITS = 22
#: Lengths of n-grams in UTF-8 bytes.
GRAMS = (4, 5, 6, 8)
#: A text with this score or more is taken for toxic.
THRESHOLD = 0.3

#: Symbols of the character model: 0 a word's edge, 1 to 26 a to z, then letters from U+00DF to U+00FF, then any other.
SYMBOLS = 61

# What signs and digits stand for in disguised words.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: Log probabilities of the channel: a sign for a letter, a sign meant as such, a letter repeated, a separator put in, one meant as such.
SUBSTITUTED, LITERAL, REPEATED, SPACED, SEPARATED = np.log([0.05, 0.001, 0.3, 0.5, 0.5]).tolist()

#: Separators that may stand between the single letters of a word.
SEPARATORS = " .-_*"
#: Fewer single letters in a row are left alone.
SPACED_LETTERS = 4
#: Between texts of a slice.
_END = 1


def _bytes_in(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_SIGN, _SEPARATOR = _bytes_in("".join(c for c in STANDS_FOR if c.isascii())), _bytes_in(SEPARATORS)
_TRAILING_SIGN = _SIGN & ~_bytes_in("!")
_LETTER = _bytes_in("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_SPACE = np.arange(256) <= 0x20


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for point in range(len(table)):
        letter = chr(point).lower()
        if not letter.isalpha() or len(letter) > 1:
            table[point] = SYMBOLS - 1 if letter.isalpha() else 0
        elif "a" <= letter <= "z":
            table[point] = ord(letter) - ord("a") + 1
        elif 0xDF <= ord(letter) <= 0xFF:
            table[point] = 27 + ord(letter) - 0xDF
        else:
            table[point] = SYMBOLS - 1
    return table


_SYMBOL = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Model symbols of a text, runs of edges as one."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where(points < len(_SYMBOL), _SYMBOL[np.minimum(points, len(_SYMBOL) - 1)], SYMBOLS - 1)
    return out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])] if len(out) else out


def character_model(documents: DataFrame, text_col: str = "text", k: float = 5.0) -> np.ndarray:
    """Log probability of a symbol after two others, [a, b, c], from the trigrams of all texts.

    What reaches the driver is one count per trigram of ``SYMBOLS`` symbols, however many texts there are.
    Without any text all symbols are equally likely.
    """
    size = SYMBOLS**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                s = symbols("  ".join(t or "" for t in batch.column(0).slice(a, b - a).to_pylist()))
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    rows = documents.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(size)
    for gram, n in rows.toLocalIterator():
        counts[gram] = n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    single = (one + 1) / (one.sum() + SYMBOLS)
    pair = (two + k * single) / (two.sum(1, keepdims=True) + k)
    return np.log((three + k * pair[None]) / (three.sum(2, keepdims=True) + k)).astype(np.float32)


def decode(stretch: str, model: list, spaced: bool = False) -> str:
    """The likeliest reading of a disguised stretch.

    Ties go to the reading found first: substitutions in the order of ``STANDS_FOR``, then the sign itself.
    """
    lower = stretch.lower()
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for i, c in enumerate(lower):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if (i > 0 and lower[i - 1] == c) and (lower[i - 2 : i - 1] == c or lower[i + 1 : i + 2] == c):
                options.append(("", REPEATED))
        elif spaced:
            options += [("", SPACED), (" ", SEPARATED)]
        else:
            options += [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
            options.append((c, LITERAL))
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in beam.items():
            for letter, cost in options:
                new, state = score + cost, (a, b)
                if letter:
                    point = ord(letter[0])
                    s = int(_SYMBOL[point]) if point < len(_SYMBOL) else SYMBOLS - 1
                    if s or b:
                        new += model[a][b][s]
                        state = (b, s)
                if state not in step or new > step[state][0]:
                    step[state] = (new, (path, letter))
        beam = step
    _, path = max(beam.values(), key=lambda x: x[0])
    letters: list[str] = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Restores texts; readings of stretches seen before are remembered (a bounded number of them)."""

    def __init__(self, model: np.ndarray):
        table = model.tolist()
        self.read = lru_cache(65_536)(lambda stretch, spaced: decode(stretch, table, spaced).encode("utf-8", "replace"))

    def __call__(self, texts: list[str | None]) -> bytes:
        """The texts in lower case, disguised stretches restored, each text ended by ``_END``."""
        raw = b"".join((t or "").lower().encode("utf-8", "replace").replace(b"\x01", b" ") + b"\x01" for t in texts)
        data = np.frombuffer(raw, np.uint8)
        out, done = [], 0
        for a, b, spaced in self._disguised(data):
            if a >= done:
                out += [raw[done:a], self.read(raw[a:b].decode("utf-8", "replace"), spaced)]
                done = b
        return b"".join([*out, raw[done:]]) if out else raw

    def _disguised(self, data: np.ndarray) -> list[tuple[int, int, bool]]:
        """Disguised stretches in order: begin, end, whether separators stand between its letters."""
        letter, sign = _LETTER[data], _SIGN[data]
        mixed = np.flatnonzero((sign[:-1] & letter[1:]) | (letter[:-1] & _TRAILING_SIGN[data[1:]]))
        same = letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
        wide = (data[:-5] >= 0xC0) & (data[:-5] == data[2:-3]) & (data[2:-3] == data[4:-1]) & (data[1:-4] == data[3:-2]) & (data[3:-2] == data[5:])
        at = np.concatenate([mixed, np.flatnonzero(same), np.flatnonzero(wide)])
        spaces = np.flatnonzero(_SPACE[data])
        token = np.unique(np.searchsorted(spaces, at))
        found = []
        for i in token.tolist():
            a, b = (int(spaces[i - 1]) + 1 if i else 0), int(spaces[i])
            while b > a and data[b - 1] in b".,;:!?)":
                b -= 1
            if b > a:
                found.append((a, b, False))
        alone = letter & (data < 0x80)
        alone[1:] &= ~letter[:-1]
        alone[:-1] &= ~letter[1:]
        joined = alone[:-2] & _SEPARATOR[data[1:-1]] & alone[2:]
        reach = 2 * (SPACED_LETTERS - 2)
        until = 0
        for i in np.flatnonzero(np.logical_and.reduce([joined[k : len(joined) - reach + k] for k in range(0, reach + 1, 2)])).tolist() if len(joined) > reach else []:
            if i >= until:
                until = i
                while until < len(joined) and joined[until]:
                    until += 2
                until += 1
                found.append((i, until, True))
        return sorted(found)


#: ASCII bytes other than letters become spaces.
_LETTERS = bytes(x if chr(x).isalpha() or x >= 0x80 or x == _END else 0x20 for x in range(256))


def _features(texts: list[str | None], restore: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashed n-grams of their restored texts, n-gram by n-gram (repeats included).

    An n-gram lies within one word but may take in the space before and after it.
    """
    data = np.frombuffer(b"\x01" + restore(texts).translate(_LETTERS), np.uint8)
    n = len(data)
    space = (data == 0x20) | (data == _END)
    document = np.cumsum(data == _END, dtype=np.int32) - 1
    following = np.minimum.accumulate(np.where(space, np.arange(n, dtype=np.int32), n)[::-1])[::-1]
    room = np.append(following[1:], n) - np.arange(n, dtype=np.int32) + 1
    letters = np.where(space, 0x20, data).astype(np.uint64)
    docs, grams = [], []
    at, packed, size = np.arange(n), letters, 1
    for length in GRAMS:
        keep = (room[at] >= length) & (at + length <= n)
        at, packed = at[keep], packed[keep]
        for i in range(size, length):
            packed = packed | letters[at + i] << np.uint64(8 * i)
        size = length
        code = mix(packed + np.uint64(length * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - FEATURE_BITS)
        docs.append(np.minimum(document[at + 1], len(texts) - 1) if len(at) else document[at])
        grams.append(code.astype(np.int64))
    return np.concatenate(docs).astype(np.int64), np.concatenate(grams)


@dataclass
class Classifier:
    """Weights of the kept n-grams by their code (0 elsewhere) and the bias."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Place of each code among ``codes``, plus 1; 0 for other codes."""
        table = np.zeros(1 << FEATURE_BITS, np.int32)
        table[self.codes] = np.arange(1, len(self.codes) + 1)
        return table


def _active(texts: list[str | None], restore: Restorer, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of document and place of a kept n-gram."""
    docs, grams = _features(texts, restore)
    place = table[grams]
    known = place > 0
    pairs = np.unique(docs[known].astype(np.int64) << np.int64(32) | (place[known] - 1))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _fit(labels: np.ndarray, docs: np.ndarray, places: np.ndarray, size: int, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features by accelerated gradient steps."""
    weights, bias = np.zeros(size), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    active = np.bincount(docs, minlength=len(labels))
    often = np.bincount(places, minlength=size)
    scale = 1.0 / (ridge + 0.25 * often * max(1.0, float(np.sqrt(active.max(initial=1)))))
    speed, speed_bias = np.zeros(size), 0.0
    for _ in range(rounds):
        ahead, ahead_bias = weights + 0.9 * speed, bias + 0.9 * speed_bias
        margin = np.bincount(docs, ahead[places], minlength=len(labels)) + ahead_bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        speed = 0.9 * speed - 0.5 * scale * (np.bincount(places, error[docs], minlength=size) + ridge * ahead)
        speed_bias = 0.9 * speed_bias - error.mean()
        weights, bias = weights + speed, bias + speed_bias
    return weights, bias


def train(labelled: DataFrame, model: np.ndarray, text_col: str = "text", label_col: str = "label") -> Classifier:
    """Classifier from rows with a text and a label 0 or 1; other labels and null texts are left out.

    With no rows of one of the labels, every text gets the share of label 1 (one half without any row).
    """
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(model)
    sample = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, total = Restorer(shared.value), np.zeros((2, 1 << FEATURE_BITS), np.int32)
        last = np.zeros(1 << FEATURE_BITS, np.int32)
        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE_BYTES // 2):
                docs, grams = _features(batch.column(0).slice(a, b - a).to_pylist(), restore)
                order = np.argsort(docs, kind="stable")
                first = np.searchsorted(docs[order], np.arange(b - a + 1))
                for d, label in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                    own = grams[order[first[d] : first[d + 1]]]
                    place = np.arange(len(own), dtype=np.int32)
                    last[own] = place
                    total[label, own[last[own] == place]] += 1
        seen = np.flatnonzero(total.any(0))
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, total[1][part].astype(np.int64), total[0][part].astype(np.int64))], names=["code", "toxic", "clean"])

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = min(max((toxic + 1) / (toxic + clean + 2), 0.01), 0.99)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    rate = (F.col("toxic") + F.lit(0.5)) / F.lit(toxic + 1.0)
    base = (F.col("clean") + F.lit(0.5)) / F.lit(clean + 1.0)
    kept = (
        sample.mapInArrow(counted, "code long, toxic long, clean long")
        .groupBy("code")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= 2)
        .select("code", F.col("toxic"), F.log(rate / base).alias("ratio"))
        .where(F.col("ratio") >= LEAST_LOG_RATIO)
        .select("code", (F.col("toxic") * F.col("ratio")).alias("gain"))
        .orderBy(F.desc("gain"), "code")
        .limit(FEATURES)
    )
    codes = np.array([r.code for r in kept.collect()], np.int64)
    table = spark.sparkContext.broadcast(Classifier(codes, np.zeros(len(codes)), 0.0).table())

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            for a, b in text_slices(batch.column(0), SLICE_BYTES // 2):
                docs, places = _active(batch.column(0).slice(a, b - a).to_pylist(), restore, table.value)
                first = np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first), pa.array(places.astype(np.int32)))], names=["label", "places"])

    rows = sample.mapInArrow(reduced, "label int, places array<int>").toArrow()
    found = rows.column("places").combine_chunks()
    docs = np.repeat(np.arange(len(rows)), np.diff(found.offsets.to_numpy()))
    weights, bias = _fit(rows.column("label").to_numpy().astype(float), docs, found.values.to_numpy().astype(np.int64), len(codes))
    return Classifier(codes, weights, bias)


def held_out(id_col: Column) -> Column:
    """Rows whose labels must not be learnt from."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels to learn from: not held out, label 0 or 1, about ``rows`` of them picked by a hash of the id.

    An id that is labelled twice counts with its larger label.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    n = known.count()
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.lit(round(1_000_000 * min(1.0, rows / max(n, 1))))
    texts = documents.select(F.col(id_col).alias("id"), "text").where("text is not null")
    return texts.join(known.where(part), "id").select("text", "label")


def score_toxicity(documents: DataFrame, labels: DataFrame, score: str = "score", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``documents`` with a column ``score`` from 0 to 1; higher means label 1 likelier.

    A null or empty text is scored by the bias alone. ``score`` must be a new name.
    """
    spark = documents.sparkSession
    model = character_model(documents, text_col)
    sample = labelled_sample(documents.withColumnRenamed(text_col, "text"), labels, id_col)
    fitted = train(materialize(sample, "labelled"), model, label_col="label")
    shared = spark.sparkContext.broadcast((model, fitted))
    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted = shared.value
        restore, table = Restorer(model), fitted.table()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in text_slices(texts, SLICE_BYTES // 2):
                docs, places = _active(texts.slice(a, b - a).to_pylist(), restore, table)
                margin = np.bincount(docs, fitted.weights[places], minlength=b - a) + fitted.bias
                yield with_column(batch.slice(a, b - a), score, pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))

    return documents.mapInArrow(judge, schema)


def toxicity_report(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, whether its label was held out, score and verdict."""
    scored = score_toxicity(documents.select(id_col, "text"), labels)
    return scored.select(
        id_col,
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents below the threshold, with all their columns."""
    name = free_name(documents, "score")
    return score_toxicity(documents, labels, score=name).where(F.col(name) < THRESHOLD).drop(name)
