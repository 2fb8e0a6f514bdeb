"""The reconciliation run: which stage reads which, and what is materialised.

Each stage is a lazy DataFrame plan.  Stages read by several later jobs are
written once as Parquet into the shared checkpoint folder
(``spark.checkpoint.dir``): the numbered lines of the landing books (row
numbers fixed forever; cells and typed columns are projections over them),
the consolidated 2B book, the joined books, the pair
table (through its ordinal) and the reviewed pairs.  A lost executor then
recomputes from the last written table, not from the raw scans, and
``pair_id`` never changes between review and finish.
"""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators import lines as L
from ..operators import pairing as P
from ..session import sorting_splits
from ..sources.scratch import materialize as write_stage
from ..operators.ordinal import dense_ordinal
from ..sources import derived as D

DEFAULT_RETURN_MONTH = "1997-01"

_RUNS: dict[tuple[str, str], "Run"] = {}
_LOCK = threading.Lock()


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write the rows once to the shared checkpoint folder."""
    return write_stage(df, name)


class Run:
    """One reconciliation over the books derived from ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, return_month: str = DEFAULT_RETURN_MONTH):
        self.spark = spark
        self.sf_dir = sf_dir
        self.return_month = return_month

    # -- sources ---------------------------------------------------------
    @cached_property
    def lines(self) -> DataFrame:
        """The facts of all lines, sorted, numbered in every sheet and written once."""
        return D.numbered_lines(D.line_facts(self.spark, self.sf_dir))

    @property
    def pr_table(self) -> DataFrame:
        return L.typed_pr_lines(self.pr_landing)

    @property
    def b2_table(self) -> DataFrame:
        return L.typed_b2_rows(self.b2_landing)

    @property
    def pr_landing(self) -> DataFrame:
        """The purchase register as uploaded (text cells only)."""
        return D.pr_landing(self.lines)

    @property
    def b2_landing(self) -> DataFrame:
        """The 2B sheets as uploaded (text cells only)."""
        return D.b2_landing(self.lines)

    # -- typed lines (projections, made where they are read) --------------
    @property
    def pr_lines(self) -> DataFrame:
        return self.pr_table

    @property
    def b2_lines(self) -> DataFrame:
        return L.typed_b2_lines(self.b2_table)

    @property
    def b2_lines_whole(self) -> DataFrame:
        """The same rows for a reader of every cell."""
        return L.typed_b2_lines(L.typed_b2_rows(D.b2_landing(self.lines, by_sheet=False)))

    @property
    def pr_raw(self) -> DataFrame:
        """The purchase register after F1 (imports dropped)."""
        return L.pr_clean(self.pr_lines)

    @property
    def b2b_raw(self) -> DataFrame:
        return L.b2b_clean(self.b2_lines)

    @property
    def cdnr_raw(self) -> DataFrame:
        return L.cdnr_signed(self.b2_lines)

    # -- consolidation ---------------------------------------------------
    @property
    def pr_cons(self) -> DataFrame:
        return C.consolidate_pr(self.pr_raw)

    @cached_property
    def b2_cons(self) -> DataFrame:
        cons = C.consolidate_by_key(L.matchable_2b(self.b2_lines_whole), C.B2_FIRST, extra_keys=["sheet"])
        with sorting_splits(self.spark):
            cons = materialize(cons, "b2_cons")
        return C.rescue_empty_inv_key(cons)

    # -- pairing ---------------------------------------------------------
    @cached_property
    def joined(self) -> DataFrame:
        both = P.outer_join(P.suffix_pr(self.pr_cons), P.suffix_2b(self.b2_cons))
        with sorting_splits(self.spark):
            return materialize(both, "joined")

    @cached_property
    def pairs(self) -> DataFrame:
        """The pair table; ``pair_id`` is assigned by a written ordinal, so it
        never changes between review and finish."""
        rows = P.fuzzy_rescue(self.joined)
        rows = materialize(P.show_cdnr_gstin(P.invoice_type(P.classify(rows))), "rows")
        rows = P.with_vendor_names(rows).withColumn("_o", P.pair_order()[2])
        out = dense_ordinal(rows, ["gst_key", "inv_key", "_o"], name="pair_id", start=0)
        return out.select(*P.PAIR_COLUMNS)

    @cached_property
    def status(self) -> DataFrame:
        return P.status_lookup(self.pairs)

    # -- review ----------------------------------------------------------
    @cached_property
    def reviewed(self) -> DataFrame:
        """Pairs after J9 with the derived reviewer decisions."""
        from ..operators import review as R

        return materialize(R.apply_review(self.pairs, R.derived_decisions(self.pairs)), "reviewed")

    @property
    def run_id(self) -> str:
        return "run-" + self.sf_dir.rstrip("/").rsplit("/", 1)[-1]


def get_run(spark: SparkSession, sf_dir: str) -> Run:
    """The run for ``sf_dir`` in this session (stages are built once)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        run = _RUNS.get(key)
        if run is None:
            run = _RUNS[key] = Run(spark, sf_dir.rstrip("/"))
        return run
