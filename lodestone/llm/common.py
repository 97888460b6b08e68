"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and one machine does all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


_made: list[list[str]] = []


def own_path(spark: SparkSession, label: str) -> str:
    """A new path for this application in the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, outlast: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    With ``outlast`` an enclosing :func:`scratch` leaves it.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    if _made and not outlast:
        _made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path  # noqa: SLF001 - lets discard() find the files
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - the file system behind any Spark path
    with contextlib.suppress(Exception):
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def stored(spark: SparkSession, path: str) -> bool:
    """Whether something lies at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - the file system behind any Spark path
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)  # noqa: SLF001


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes within are deleted at the end; what needs them must be saved by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_lodestone_path", None):
            _delete(df.sparkSession, path)


def clear_written(spark: SparkSession) -> None:
    """Delete every table that this application wrote to the shared folder; call it once its results are saved."""
    _delete(spark, _own_dir(spark))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that have ended: it acts on what the driver's JVM has collected.

    The first round frees the plans, the second what only they held.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()  # noqa: SLF001
        time.sleep(0.3)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as the text 'null'."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % 5) == 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches, rows: int = 256, chars: int = 4_000_000):
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``chars`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(chars / max(1, batch.nbytes / batch.num_rows))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_batch(names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """A copy of ``schema`` with more fields (StructType.add changes its object in place)."""
    return T.StructType([*schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items())])


def windows(text: str, seam: re.Pattern, size: int = 1_000_000) -> Iterator[str]:
    """``text`` in pieces, each cut after the first match of ``seam`` past ``size`` characters, so that nothing larger is matched at once."""
    at = 0
    while len(text) - at > size and (found := seam.search(text, at + size)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]
