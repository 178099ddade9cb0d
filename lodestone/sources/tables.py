"""Tables from CSV files with types inferred, vectors and settings, as DataFrames and plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header and inferred types, or Parquet; a path that is not there raises."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON: profiles, results of experiments, costs or descriptions."""
    df.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Settings:
    """What the steps of a run take; all have defaults."""

    semantic_threshold: float = 0.7
    fuzzy_least: float = 95.0
    compression: int = 2
    bm25_weight: float = 1.0
    dense_weight: float = 1.0
    cutoffs: tuple[int, ...] = field(default=(1, 5, 10, 20))


def settings(values: dict[str, object]) -> Settings:
    """Settings from a map, such as a parsed file; names it doesn't know raise."""
    return Settings(**values)
