"""Benchmark: the reconciliation's headline stages on $BENCH_SF_DIR.

Every iteration starts a fresh run from the raw parquet tables (no stage is
reused between iterations), so the numbers are end-to-end: ingest and row
numbering, consolidation + pairing, then the reports that read the pair
table.  One cold iteration, then ``BENCH_WARM`` warm ones; the reported
value is the median warm end-to-end time.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerweave.operators import comments as CM  # noqa: E402
from ledgerweave.operators import dashboard as DB  # noqa: E402
from ledgerweave.operators import itc as ITC  # noqa: E402
from ledgerweave.operators import pairing as P  # noqa: E402
from ledgerweave.operators import schema_match as SM  # noqa: E402
from ledgerweave.plans.reconcile import Run  # noqa: E402
from ledgerweave.session import build_session  # noqa: E402
from ledgerweave.sources import catalog as CT  # noqa: E402


def whole(df) -> None:
    """Every column of every row (a count would let Spark prune the work)."""
    df.write.format("noop").mode("overwrite").save()


def one_iteration(spark, sf_dir: str) -> dict[str, float]:
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    run = Run(spark, sf_dir)
    timed("ingest", lambda: (run.pr_landing, run.b2_landing))
    timed("reconcile", lambda: run.pairs)
    timed("dashboard", lambda: DB.dashboard(run.pairs).collect())
    timed("itc_table", lambda: ITC.itc_table(run.b2_lines, run.status, run.return_month).collect())
    timed("recon_sheet", lambda: whole(P.recon_projection(run.pairs)))
    timed("comments", lambda: [whole(df) for df in (
        CM.pr_comments(run.pr_raw, run.b2_lines, run.status), CM.b2_comments(run.b2b_raw, run.pr_raw, run.status),
        CM.b2_comments(run.cdnr_raw, run.pr_raw, run.status))])
    timed("review", lambda: run.reviewed)

    def schema():
        cleaned = SM.clean_headers(CT.catalog(spark, sf_dir))
        return whole(SM.resolve_roles(cleaned, SM.present_values(CT.cells(spark, sf_dir), cleaned)))

    timed("schema_roles", schema)
    times["end_to_end"] = round(sum(times.values()), 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warm_n = int(os.environ.get("BENCH_WARM", "2"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    cold = one_iteration(spark, sf_dir)
    warm = [one_iteration(spark, sf_dir) for _ in range(warm_n)]
    queries = {k: statistics.median(w[k] for w in warm) for k in cold} if warm else dict(cold)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "reconcile_end_to_end_median_warm",
        "value": queries["end_to_end"],
        "unit": "sec",
        "queries": queries,
        "cold": cold,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "warm_runs": warm_n,
    }))


if __name__ == "__main__":
    main()
