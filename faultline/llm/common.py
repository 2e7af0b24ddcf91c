"""Helpers shared by the operators: shared folder, stage tables, column guards."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Words are maximal runs of anything but these six bytes.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, notebooks in local mode) a
    temporary folder is made and set as the session's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: dict[str, list[tuple[str, str | None]]] = {}


def workspace(spark: SparkSession, label: str, table_name: str | None = None) -> str:
    """A new, unused folder below the shared one; ``release`` deletes it, and the catalog's table if it holds one."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append((path, table_name))
    return path


def made(spark: SparkSession) -> int:
    """How many stage tables this session has; a mark for ``release``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Deletes the stage tables of this session from a mark on, but the last few.

    Results read them lazily: call it once these are written.
    """
    mine = _made.get(spark.sparkContext.applicationId, [])
    paths = mine[since : len(mine) - but_last]
    del mine[since : len(mine) - but_last]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, table_name in paths:
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's partition count; it is the one knob that scales with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, count: int | None = None) -> DataFrame:
    """Deal rows evenly, for stages whose input has few large files."""
    return df.repartition(count or partitions(df.sparkSession))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  Plain ``lower`` is the same, and faster, on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fold_of_py(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def arrow_schema(schema: str | T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine (never copied into the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_temp(suffix: str = "") -> str:
    """A task-private scratch file for memory mapping; the task deletes it."""
    handle, path = tempfile.mkstemp(suffix=suffix, prefix="faultline-")
    os.close(handle)
    return path


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers live on between tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
