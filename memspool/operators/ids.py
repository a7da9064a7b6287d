"""Ids that sort by creation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sortable_id
from .merge import placed


def allocated(rows: DataFrame, order: tuple[str, ...], at: Column, parts: tuple[str, ...], name: str = "id", place: str = "place") -> DataFrame:
    """``rows`` with an id and their place in the order of the columns ``order``.

    Ids of a later run (``at``, a time stamp that is the same for all rows) sort behind those of an earlier one, and within a run as the rows do.  Places are counted
    by ranges, so no task numbers all rows; they follow from the rows alone, so a task that runs again gives the same ids.  ``parts`` are hashed
    into the id, which keeps runs of one millisecond apart.
    """
    counted = placed(rows.withColumn("__all", F.lit(0)), ("__all",), order).drop("__all").withColumnRenamed("pos", place)
    return counted.withColumn(name, sortable_id(F.unix_millis(at), F.col(place), *parts))
