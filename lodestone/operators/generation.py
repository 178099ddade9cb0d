"""Descriptions of datasets by a model that is plugged in, or by templates; the model runs in the tasks, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import title_case

#: A model: takes a list of prompts and gives their answers. It is pickled to the tasks, so it must make its connections there.
Model = Callable[[list[str]], list[str]]


def with_retries(model: Model, tries: int = 3, wait: float = 1.0) -> Model:
    """The model, asked again after 1, 2, 4 ... times ``wait`` seconds if it fails; the last failure is raised."""

    def asked(prompts: list[str]) -> list[str]:
        for n in range(tries):
            try:
                return model(prompts)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        return []

    return asked


def first_that_answers(models: list[tuple[float, Model]]) -> Model:
    """The cheapest (cost, model) that answers; the next one is asked where one fails."""
    order = [m for _, m in sorted(models, key=lambda x: x[0])]

    def asked(prompts: list[str]) -> list[str]:
        for model in order[:-1]:
            try:
                return model(prompts)
            except Exception:  # noqa: BLE001
                continue
        return order[-1](prompts)

    return asked


def generate(prompts: DataFrame, model: Model) -> DataFrame:
    """prompts (id, prompt) with answer; equal prompts are asked once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=model(batch["prompt"].tolist()))

    answers = prompts.select("prompt").distinct().mapInPandas(run, "prompt string, answer string")
    return prompts.join(answers, "prompt", "left").select("id", "prompt", "answer")


def encode(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """rows with vector, of length 1, from an encoder that is plugged in and run in the tasks."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[columns].assign(vector=[list(map(float, v)) for v in encoder(batch[text].tolist())])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    made = rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("vector", ArrayType(DoubleType()))]))
    return made.withColumn("vector", unit_vector(F.col("vector")))


def unit_vector(c):
    """The vector with length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def user_descriptions(datasets: DataFrame) -> DataFrame:
    """dataset, title, description, tags by template from columns (dataset, place, column_name, semantic_type, domain)."""
    d = datasets.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("domain")).alias("tags"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "column_name"))), lambda x: x["column_name"]).alias("names"),
    )
    title = title_case(F.regexp_replace("dataset", r"[_\-\s]+", " "))
    told = F.concat(title, F.lit(" holds "), "n", F.lit(" columns: "), F.array_join("names", ", "), F.lit("."))
    return d.select("dataset", title.alias("title"), told.alias("description"), "tags")


def search_descriptions(users: DataFrame, keywords: DataFrame) -> DataFrame:
    """dataset, text: the description for users followed by the keywords (dataset, keyword) of its concepts, sorted, each once."""
    k = keywords.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_set("keyword")), " ").alias("words"))
    return users.join(k, "dataset", "left").select("dataset", F.concat_ws(" ", "description", "words").alias("text"))
