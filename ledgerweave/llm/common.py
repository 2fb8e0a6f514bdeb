"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize

def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder (which drops the shuffle files) and read back."""
    return materialize(df, name)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id LONG, text STRING): the two columns an operator reads, whatever else the table has."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def span_text(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


#: What operators keep in this Python worker between tasks: operator -> how to let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Note that an operator keeps a model or a memory in this worker for its next task."""
    _KEPT[owner] = drop


def let_go(owner: str) -> None:
    """Free what other operators keep in this worker, at the beginning of a task of ``owner``.

    Spark reuses its Python workers, so those of a pipeline would gather the models of all its stages."""
    others = [name for name in _KEPT if name != owner]
    for name in others:
        _KEPT.pop(name)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries give memory back by themselves
            ctypes.CDLL(None).malloc_trim(0)


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of some thousand texts instead of Spark's ten thousand rows, unless the session has a number of its own:
    a batch is held by the executor and by its Python worker, each way."""
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, str(rows))


#: Rows whose results a task holds at a time.
ROWS = 1024


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``ROWS`` rows: what is made of a part is passed on before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def plainly_named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as c0, c1, ...: Arrow functions refuse names with a dot."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def named_back(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The first columns under their own names again."""
    return df.select(*[F.col(f"`{now}`").alias(then) for now, then in zip(df.columns, [*columns, *df.columns[len(columns):]])])


def annotate(df: DataFrame, text_col: str, fields: Sequence[tuple[str, str, pa.DataType]],
             make: Callable[[], Callable[[str | None], tuple]], owner: str = "") -> DataFrame:
    """Every column of ``df`` as it is, and ``fields`` computed from the text of each row.

    ``make`` runs once a task and returns the function of one text; ``owner``
    names the operator if it keeps something in its workers.  A column
    of ``df`` that has the name of a field is replaced.
    """
    names = [name for name, _, _ in fields]
    kept = [c for c in df.columns if c not in names]
    at = kept.index(text_col)
    modest_batches(df.sparkSession)
    plain = plainly_named(df, kept)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"`{name}` {kind}" for name, kind, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        of = make()
        for batch in in_parts(batches):
            texts = batch.column(at)
            rows = [of(texts[i].as_py()) for i in range(batch.num_rows)]
            new = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return named_back(plain.mapInArrow(run, schema), kept)
