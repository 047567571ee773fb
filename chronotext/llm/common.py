"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python workers hold one slice of a batch as objects at a time, so that memory follows this and not Arrow's batch size.
SLICE_BYTES = 1 << 20
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Only where Spark runs in one process, as in tests, a folder of its own will
    do; on a cluster without a named one this is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="chronotext-")
        _left[named] = spark
    sc.setCheckpointDir(named)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by then; the folder is the cluster's scratch space
        pass


_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    for path, spark in _left.items():
        _remove(spark, path)


#: Paths of the tables made inside the `settled` under way, if any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet in the shared checkpoint folder and read them back: the lineage is cut, columns are
    compressed and pruned. The files go with `free`, or when the session's process ends."""
    spark = df.sparkSession
    checkpoint_ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    _left[path] = spark
    if _made.get() is not None:
        _made.get().append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folder_of[out] = path
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, as a table; all tables that were made on the way to it are deleted."""
    paths: list[str] = []
    token = _made.set(paths)
    try:
        out = table(make())
    finally:
        _made.reset(token)
    for path in paths:
        if path != _folder_of[out] and path in _left:
            _remove(_left.pop(path), path)
    if _made.get() is not None:
        _made.get().append(_folder_of[out])
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables of `table` whose consumers are all written."""
    for df in tables:
        path = _folder_of.pop(df, None)
        if path:
            _remove(_left.pop(path), path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never broadcast. Spark takes a side's size from the compressed files
    below it, which says nothing of the rows that `explode` makes, so a side far beyond the driver can pass for a small one."""
    return df.hint("merge")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of a row as the struct `row`, beside the given columns: no name of the input can clash with an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *columns)


def unpacked(rows: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `row` again, some of them changed."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in rows.schema["row"].dataType.names])


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near `limit` bytes; a longer text is a piece of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size + 64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def map_slices(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """`mapInArrow` over pieces of bounded text size. `make` runs once in each task and returns the function for a piece."""

    def run(batches):
        work = make()
        for batch in batches:
            for piece in slices(batch, column, limit):
                out = work(piece)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
