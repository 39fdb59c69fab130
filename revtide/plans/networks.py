"""The two networks built out of the edge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revtide.operators import edges as E
from revtide.operators.graph import k_core

# Weight below which an edge is dropped, and the core kept.
AUTHOR_MIN_WEIGHT = 1.1
FILE_MIN_WEIGHT = 1.0
FILE_CORE = 5


def author_network(revisions: DataFrame, changes: DataFrame) -> DataFrame:
    """Author-file graph without anonymous and one-off links; weights as distances."""
    links = E.drop_node(E.author_file_edges(revisions, changes))
    return E.inverse_log_weights(E.filter_edges(links, AUTHOR_MIN_WEIGHT))


def file_network(
    revisions: DataFrame,
    changes: DataFrame,
    core: int = FILE_CORE,
    exclude_deleted: bool = False,
) -> DataFrame:
    """Core of the cooled co-change graph."""
    if exclude_deleted:
        from revtide.operators.aggregates import deleted_paths

        changes = changes.join(deleted_paths(changes), "changedpath", "left_anti")
    links = E.cochange_edges_decayed(revisions, changes, min_weight=FILE_MIN_WEIGHT)
    return k_core(links, core)
