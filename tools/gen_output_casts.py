"""Regenerate ledgerweave/plans/output_casts.py from the Spark output schemas.

    python tools/gen_output_casts.py

For every registered query, records which output columns are DECIMAL and
which are DATE, so the SQL twin can be given the same output types as the
Spark side (money as DOUBLE, dates as ISO text).
"""

from __future__ import annotations

import os
import pprint
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql.types import DateType, DecimalType  # noqa: E402

from ledgerweave.plans.queries import QUERIES  # noqa: E402
from ledgerweave.session import build_session  # noqa: E402


def main() -> None:
    spark = build_session("local[4]", 8)
    out = {}
    for name in sorted(QUERIES):
        schema = QUERIES[name](spark, "/root/testdata/sf0.001").schema
        dec = [f.name for f in schema.fields if isinstance(f.dataType, DecimalType)]
        dat = [f.name for f in schema.fields if isinstance(f.dataType, DateType)]
        if dec or dat:
            out[name] = {"double": dec, "date": dat}
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                        "ledgerweave", "plans", "output_casts.py")
    with open(path, "w") as f:
        f.write('"""Output columns whose type is normalised at the query boundary (generated by\n'
                'tools/gen_output_casts.py; tests check it against the Spark schemas)."""\n\n')
        f.write("OUTPUT_CASTS = " + pprint.pformat(out, width=110, sort_dicts=True) + "\n")
    print(f"{len(out)} queries with casts")


if __name__ == "__main__":
    main()
