"""Joins of many rows with a small row per key, when some keys may hold most of the rows.

Adaptive execution splits the rows of a hot key if both join inputs come straight
from an exchange. A lookup that was just reduced to one row per key does not, so it
is checkpointed first: its rows are few and narrow, and what is left is an ordinary
join that the engine broadcasts or splits by the true sizes it sees at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from classatlas.session import ensure_checkpoint_dir


def join_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a lookup of few rows per key; ``rows`` may have keys of any frequency.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Rows with a NULL
    key find no partner, as in any equi-join. The lookup is computed and written here,
    while the plan is built; with ``spark.cleaner.referenceTracking.cleanCheckpoints``
    Spark removes its files once the result is no longer referenced.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.join(lookup.checkpoint(), on, how)
