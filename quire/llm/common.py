"""What the operators of this subpackage share: written tables, identities, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores added until no column of the input has it (Spark compares without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def held_out(doc_id: Column, mod: int, left: int = 2) -> Column:
    """crc32 of the id as text leaves `left`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == left


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Arrow batches of at most so many bytes, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """What a task has freed goes back to the system: Python workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def with_columns(df: DataFrame, fn: Callable[..., list[pa.Array]], fields: list[T.StructField], state: Callable[[], object] | None = None) -> DataFrame:
    """df with the columns that fn makes of each Arrow batch; every other column passes through untouched.
    state: makes what fn is also given, once for each task, and which ends with the task."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = () if state is None else (state(),)
        for batch in batches:
            made = [a.cast(t) if a.type != t else a for a, t in zip(fn(batch, *own), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
            del batch, made
        del own
        give_back()

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, col: str) -> pa.Array:
    """The column as text; nulls read as empty."""
    a = batch.column(batch.schema.get_field_index(col))
    return a.fill_null("") if a.null_count else a


def list_array(values: pa.Array, counts) -> pa.ListArray:
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
