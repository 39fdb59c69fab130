"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists all vocabulary pieces in a word; dynamic programming over their ends carries the best
score and its number of pieces, no back pointers. Rules are those of the ``tokenizers`` library's Unigram model
behind a splitting Metaspace pre-tokenizer: every space (or U+2581) begins a word, a text begins one too; of equal
scores the piece that begins first wins; a character without a piece of its own may be unknown, at the least score of
the vocabulary less 10; unknown characters in a row are one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from revtide.llm.common import text_slices, with_column
from revtide.llm.vocabulary import PIECES, SPACE, Vocabulary, load_vocabulary

#: Words that a task remembers.
REMEMBERED = 300_000

COUNTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())])
_ARROW_COUNTS = pa.struct([("n_tokens", pa.int64()), ("log_prob", pa.float64())])


class Counter:
    """Counts tokens of words and texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.scores:
            self.automaton.make_automaton()
        self.unknown = vocabulary.unknown_score
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        best, pieces, unknown = [0.0], [0], [False]
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        at, match = next(matches, (-1, None))
        for end in range(1, len(word) + 1):
            score, count, odd, single = None, 0, False, False
            while at == end - 1:  # longest first, that is, in the order of begins
                length, gain = match
                total = best[end - length] + gain
                if score is None or total > score:
                    score, count = total, pieces[end - length] + 1
                single |= length == 1
                at, match = next(matches, (-1, None))
            if not single and (score is None or best[-1] + self.unknown > score):
                score, count, odd = best[-1] + self.unknown, pieces[-1] + (not unknown[-1]), True
            best.append(score)
            pieces.append(count)
            unknown.append(odd)
        return pieces[-1], best[-1]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        known = self.known
        if text[0] in (" ", SPACE):  # no word before the first space
            words = words[1:]
        count, score = 0, 0.0
        for w in words:
            got = known.get(w)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[w] = self.word(SPACE + w)
            count += got[0]
            score += got[1]
        return count, score


def count_tokens(documents: DataFrame, counts: str = "counts", text_col: str = "text", vocabulary_path: str = PIECES, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``documents`` with a struct column ``counts``: n_tokens and log_prob of the best segmentation.

    A null or empty text has no tokens. Repeated rows count each; other columns stay; ``counts`` must be a new name.
    The vocabulary (a fixed file of some MB at most) is read by the driver and sent to the tasks.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary(vocabulary_path))
    schema = T.StructType([*documents.schema.fields, T.StructField(counts, COUNTS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in text_slices(texts):
                found = [counter.text(t or "") for t in texts.slice(a, b - a).to_pylist()]
                arrays = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())]
                yield with_column(batch.slice(a, b - a), counts, pa.StructArray.from_arrays(arrays, fields=list(_ARROW_COUNTS)))

    return documents.mapInArrow(scan, schema)


def token_count_report(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: tokens and score of the best segmentation."""
    return count_tokens(documents.select(id_col, "text")).select(id_col, "counts.n_tokens", "counts.log_prob")
