"""Output typing at the driver contract boundary.

Inside the library money is DECIMAL(38,2) and dates are DATE.  At the
boundary both engines hand the same plain types to any consumer: money as
DOUBLE (the exact decimal rounded once to the nearest double, identically in
both engines) and dates as ISO ``yyyy-MM-dd`` text.  ``OUTPUT_CASTS`` lists,
per query, the columns the SQL twin casts the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from .output_casts import OUTPUT_CASTS


def normalize_output(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def wrap_sql(name: str, sql: str) -> str:
    casts = OUTPUT_CASTS.get(name)
    if not casts:
        return sql
    parts = [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in casts["double"]]
    parts += [f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in casts["date"]]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{sql}\n) AS q"
