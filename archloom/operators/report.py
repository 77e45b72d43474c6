"""The report of a run: numbers observed while its tables are written, and lists of what is left to do as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

EXCEPTIONS = "list string, at string, what string"


def write_observed(rows: DataFrame, folder: str, /, **numbers: Column) -> dict[str, int]:
    """Writes ``rows`` to ``folder`` and gives the aggregates ``numbers`` over them, from the same pass.

    They are observed above all shuffles, in the stage that writes, of which each partition counts once however often
    a lost executor's task is run again. Aggregates must be whole numbers and not distinct; of no rows they are 0.
    """
    seen = Observation()
    rows.observe(seen, *[c.alias(name) for name, c in numbers.items()]).write.parquet(folder)
    found = seen.get
    return {name: int(found.get(name) or 0) for name in numbers}


def listed(rows: DataFrame, name: str, at: Column, what: Column | None = None) -> DataFrame:
    """``rows`` as entries of the exception list ``name``; what is null is empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (at, F.lit("") if what is None else what)]
    return rows.select(F.lit(name).alias("list"), text[0].alias("at"), text[1].alias("what"))


def write_report(spark: SparkSession, folder: str, numbers: dict[str, int], exceptions: DataFrame) -> None:
    """``numbers`` as one JSON row in ``folder``/numbers, ``exceptions`` (see ``listed``) as JSON by list in ``folder``/exceptions.

    The lists grow with the run and stay tables; only the numbers pass the driver.
    """
    schema = ", ".join(f"`{name}` long" for name in numbers)
    spark.createDataFrame([tuple(numbers.values())], schema).coalesce(1).write.mode("overwrite").json(f"{folder}/numbers")
    exceptions.write.mode("overwrite").partitionBy("list").json(f"{folder}/exceptions")


def read_numbers(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{name}` long" for name in names)).json(f"{folder}/numbers")


def read_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EXCEPTIONS).json(f"{folder}/exceptions").select("list", "at", "what")
