"""Reading, writing and naming shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantgauge.session import configure, fresh_folder

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that they
    need not find it on a path of their own."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir=None), "plantgauge.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    configure(spark)
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keeps_names(*own: str):
    """For operators that add columns beginning with ``own`` while they work: columns of the
    caller whose names begin so are renamed before and named back after it."""

    def wrap(operator):
        @functools.wraps(operator)
        def run(df, *args, **options):
            clash = [c for c in df.columns if c.lower().startswith(own)]
            aside = {c: f"kept{i}_{c}" for i, c in enumerate(clash)}
            if not aside:
                return operator(df, *args, **options)
            moved = lambda v: aside.get(v, v) if isinstance(v, str) else v
            out = operator(df.withColumnsRenamed(aside), *map(moved, args), **{k: moved(v) for k, v in options.items()})
            return out.withColumnsRenamed({b: a for a, b in aside.items()})

        return run

    return wrap


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: its rows are settled
    and a lost executor costs no recomputation of what came before. With ``free``
    the shuffle files of this write go when it is done."""
    spark = df.sparkSession
    path, before = fresh_folder(spark, name), spark.conf.get(FREE_SHUFFLES, "false")
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory of this process back; a worker that waits for its next task holds it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` whose workers hold no freed memory between tasks."""

    def run(batches):
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def whole_text(name: str = "text") -> F.Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def chunks(lengths, budget: int = 4_000_000):
    """(first, last) row ranges whose summed lengths stay near ``budget``; a row
    above it is a range of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > budget:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)
