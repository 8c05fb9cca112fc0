"""Network files: variables, structure and conditional tables as rows, read by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_variables(spark: SparkSession, path: str) -> DataFrame:
    """file, name, type, states (those that a variable lists; empty for booleans and numbers)."""
    rows = spark.read.format("xml").option("rowTag", "var").schema("_name string, _type string, _params string").load(path)
    states = F.filter(F.transform(F.split(F.coalesce("_params", F.lit("")), ";"), F.trim), lambda s: s != "")
    return rows.select(F.input_file_name().alias("file"), F.col("_name").alias("name"), F.col("_type").alias("type"), states.alias("states"))


def read_nodes(spark: SparkSession, path: str, row_tag: str = "branchPoint") -> DataFrame:
    """file, variable, type, parents (in order), params (the text of the node's table, null for a node without)."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("_type string, _var string, parent array<struct<_var: string>>, params string").load(path)
    parents = F.transform(F.coalesce("parent", F.array().cast("array<struct<_var:string>>")), lambda p: p["_var"])
    return rows.select(F.input_file_name().alias("file"), F.col("_var").alias("variable"), F.col("_type").alias("type"), parents.alias("parents"), "params")


def table_rows(nodes: DataFrame) -> DataFrame:
    """file, variable, row, condition (values of the parents), numbers: the lines of the conditional tables. A line is ``row: numbers; (condition)``; a root has
    ``numbers;`` alone, row 0. Other lines are left out."""
    number = r"[-+0-9.eE]+"
    line = nodes.select("file", "variable", F.explode(F.split(F.coalesce("params", F.lit("")), r"\R")).alias("line")).select("file", "variable", F.trim("line").alias("line"))
    told = line.where(F.col("line").rlike(rf"^(\d+:)?\s*{number}(\s*,\s*{number})*\s*;"))
    row = F.regexp_extract("line", r"^(\d+):", 1)
    numbers = F.regexp_extract("line", r"^(?:\d+:)?\s*([^;]*?)\s*;", 1)
    condition = F.regexp_extract("line", r"\(([^)]*)\)", 1)
    return told.select(
        "file", "variable", F.when(row != "", row.cast("int")).otherwise(0).alias("row"),
        F.filter(F.transform(F.split(condition, ","), F.trim), lambda x: x != "").alias("condition"), F.transform(F.split(numbers, ","), lambda x: F.trim(x).cast("double")).alias("numbers"),
    )
