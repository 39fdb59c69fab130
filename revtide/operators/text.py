"""Word counts of log messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.operators.base import top_n
from revtide.session import cut_lineage

# Words left out of the counts. A run of digits counts as one too.
STOP_WORDS = (
    "an", "the", "me", "my", "we", "you", "he", "she", "it", "are", "is", "am",
    "will", "shall", "should", "would", "had", "have", "has", "was", "were", "be", "been",
    "this", "that", "there",
    "who", "when", "how", "where", "which",
    "already", "after", "by", "on", "or", "so", "also", "got", "get", "do", "don't", "from",
    "all", "but",
    "yet", "to", "in", "out", "of", "for", "if", "yes", "no", "not", "may", "can", "could",
    "at", "as", "with", "without",
)
# Suffixes merged into their stem, in this order of preference.
SUFFIXES = ("ed", "ing", "s", "es")

# White space as Python's unicode \s sees it.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def words(
    revisions: DataFrame, stop_words: str = "prefix", group_cols: Sequence[str] = ()
) -> DataFrame:
    """One row per kept word occurrence, lower case.

    ``prefix`` drops every word that begins with a stop word; ``exact`` only the
    stop words themselves.
    """
    if stop_words not in ("prefix", "exact"):
        raise ValueError("stop_words must be 'prefix' or 'exact'")
    tail = "" if stop_words == "prefix" else "$"
    stop = r"(?i)^(?:\d+|" + "|".join(STOP_WORDS) + ")" + tail
    w = F.col("word")
    return (
        revisions.select(*group_cols, F.explode(F.split("msg", _SPACE)).alias("word"))
        .filter((F.length(w) >= 2) & ~w.rlike(stop))
        .select(*group_cols, F.lower(w).alias("word"))
    )


def merge_stems(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Add the count of a word ending in a known suffix to its stem, if that occurs.

    A word's parent is its first matching stem; counts go to the end of the chain.
    """
    group_cols = list(group_cols)
    counts = cut_lineage(counts)
    w = F.col("word")
    options = F.filter(
        F.array(
            *[
                F.when(
                    w.endswith(s),
                    F.struct(F.lit(i).alias("p"), F.left(w, F.length(w) - F.lit(len(s))).alias("stem")),
                )
                for i, s in enumerate(SUFFIXES)
            ]
        ),
        lambda o: o.isNotNull(),
    )
    stems = counts.select(*group_cols, F.col("word").alias("stem"))
    parents = (
        counts.select(*group_cols, "word", F.explode(options).alias("o"))
        .select(*group_cols, "word", "o.p", "o.stem")
        .join(stems, [*group_cols, "stem"])
        .groupBy(*group_cols, "word")
        .agg(F.min_by("stem", "p").alias("parent"))
    )
    parents = cut_lineage(parents)
    # Each doubling halves a chain; a chain is no longer than its run of suffix letters.
    run = F.length(F.regexp_extract("word", "((?:ed|ing|s|es)+)$", 1))
    longest = parents.agg(F.max(run)).first()[0] or 0
    for _ in range(max(longest, 1).bit_length() if longest else 0):
        up = parents.select(*group_cols, F.col("word").alias("parent"), F.col("parent").alias("_up"))
        parents = parents.join(up, [*group_cols, "parent"], "left").select(
            *group_cols, "word", F.coalesce("_up", "parent").alias("parent")
        )
    rooted = counts.join(parents, [*group_cols, "word"], "left")
    return rooted.groupBy(*group_cols, F.coalesce("parent", "word").alias("word")).agg(
        F.sum("freq").alias("freq")
    )


def word_frequency(
    revisions: DataFrame,
    min_freq: int = 3,
    stop_words: str = "prefix",
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Words of the messages of in-scope revisions, one message per revision."""
    counts = (
        words(revisions, stop_words, group_cols)
        .groupBy(*group_cols, "word")
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= min_freq)
    )
    return merge_stems(counts, group_cols)


def tag_cloud(revisions: DataFrame, n: int = 50, group_cols: Sequence[str] = ()) -> DataFrame:
    """The n most frequent words in alphabetical order."""
    freq = word_frequency(revisions, 5, group_cols=group_cols)
    best = top_n(freq, n, [F.col("freq").desc(), F.col("word")], group_cols)
    return best.orderBy(*group_cols, "word")
