"""Writers and result reuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    df.write.mode(mode).option("header", True).csv(path, compression=compression)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    df.write.mode(mode).json(path, compression=compression)
    return path


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Features by split, so that a reader of one split prunes the others."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def stored_or_computed(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The stored result if there is one, else compute, store and read back."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str, features: int | None = None) -> PipelineModel | None:
    """The stored pipeline, or None if it is absent or of another width."""
    try:
        model = PipelineModel.load(path)
    except Exception:  # the ML reader raises many kinds for a missing folder
        return None
    last = model.stages[-1]
    if features is not None and last.numFeatures != features:
        return None
    return model


def trained_or_loaded(
    path: str, train: Callable[[], PipelineModel], features: int | None = None, force: bool = False
) -> PipelineModel:
    model = None if force else load_model(path, features)
    if model is None:
        model = train()
        save_model(model, path)
    return model
