"""Commit-history analytics as Spark DataFrame plans.

Every operator is a function from DataFrames to a DataFrame: nothing runs until
the caller triggers an action. Two inputs recur:

* ``revisions`` - one row per revision,
* ``changes``   - one row per changed path and revision.

Both may carry leading grouping columns (say ``repo_id``), named through
``group_cols``, so that one job serves many repositories.
"""

__version__ = "0.1.0"
