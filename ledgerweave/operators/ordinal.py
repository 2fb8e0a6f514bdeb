"""Order-dependent helpers that stay distributed.

The reconciliation rules depend on sheet order ("first non-null", "last
pair wins", first-in-first-out pairing).  A global ``row_number()`` without
``partitionBy`` would pull every row into one task, and a per-group window
puts a whole hot group into one task.  Instead:

* ``dense_ordinal`` sorts with a range exchange (Spark samples the sort key,
  so a hot prefix is split over many partitions), tags rows with their
  position inside the partition, writes that once to the shared checkpoint
  folder and adds per-partition offsets (written too, one row per partition,
  so the broadcast is bounded by the partition count, not the data).
* ``rank_in_group`` turns the global ordinal into a rank inside each group by
  subtracting the group's first ordinal (one row per group, aggregated
  map-side first and written, so the join reads two tables: AQE broadcasts
  the small one by its bytes, or splits a hot group's partition).
* ``first_n_per_group`` keeps the first ``n`` rows per group in two stages:
  top-n inside salted sub-groups, then top-n of at most ``n * salts``
  candidates per group.  Exact, and no task sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

_LOW_BITS = (1 << 33) - 1


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dense_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str = "ordinal",
                  start: int = 0, post: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``name`` = dense position of each row in ``order_by`` order.

    ``order_by`` must be a total order (unique) for the result to be stable.
    ``post`` is a row-wise projection run after the range exchange and
    before the write: it keeps the order and runs with the exchange's
    parallelism, whatever the partitioning of the input was.
    """
    ordered = df.orderBy(*_cols(order_by))
    if post is not None:
        ordered = post(ordered)
    tagged = materialize(ordered.withColumn("_lw_mid", F.monotonically_increasing_id()), "ordinal")
    pid = F.shiftright(F.col("_lw_mid"), 33)
    sizes = tagged.groupBy(pid.alias("_lw_pid")).agg(F.count(F.lit(1)).alias("_lw_n"))
    # one row per partition: a prefix sum over a table whose size is the
    # partition count, never the data
    offsets = sizes.select(
        "_lw_pid",
        F.coalesce(
            F.sum("_lw_n").over(Window.orderBy("_lw_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_lw_off"),
    )
    offsets = materialize(offsets, "ordinal-offsets")
    out = tagged.join(F.broadcast(offsets), pid == F.col("_lw_pid"), "inner")
    local = F.col("_lw_mid").bitwiseAND(F.lit(_LOW_BITS))
    return out.withColumn(name, (F.col("_lw_off") + local + F.lit(start)).cast("bigint")).drop(
        "_lw_mid", "_lw_pid", "_lw_off"
    )


def rank_in_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str | Column],
                  name: str = "rank", start: int = 1,
                  post: Callable[[DataFrame], DataFrame] | None = None,
                  sort_by: Sequence[str | Column] | None = None) -> DataFrame:
    """``row_number() over (partition by group_by order by order_by)`` without
    sending a whole group to one task.

    ``sort_by`` may name another order of the rows that is the same inside
    every group and keeps groups together (say, by one number instead of a
    text that hardly differs: Spark compares the first column by a prefix)."""
    ordered = dense_ordinal(df, sort_by or [*group_by, *order_by], name="_lw_ord", post=post)
    firsts = ordered.groupBy(*group_by).agg(F.min("_lw_ord").alias("_lw_first"))
    out = ordered.join(materialize(firsts, "ordinal-firsts"), list(group_by), "inner")
    return out.withColumn(name, (F.col("_lw_ord") - F.col("_lw_first") + F.lit(start)).cast("bigint")).drop(
        "_lw_ord", "_lw_first"
    )


def first_n_per_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], n: int,
                      salt_from: Sequence[str], salts: int = 16, name: str | None = None) -> DataFrame:
    """Rows ranked ``<= n`` inside each group, in ``order_by`` order.

    ``salt_from`` names columns hashed into ``salts`` sub-groups.  Stage one
    keeps the top ``n`` of every sub-group (a hot group is spread over
    ``salts`` tasks), stage two ranks at most ``n * salts`` rows per group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_from]), F.lit(salts))
    w1 = Window.partitionBy(*group_by, "_lw_salt").orderBy(*order_by)
    stage1 = (
        df.withColumn("_lw_salt", salt)
        .withColumn("_lw_r1", F.row_number().over(w1))
        .where(F.col("_lw_r1") <= n)
        .drop("_lw_r1", "_lw_salt")
    )
    rank_col = name or "_lw_r2"
    w2 = Window.partitionBy(*group_by).orderBy(*order_by)
    out = stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= n)
    return out if name else out.drop(rank_col)
