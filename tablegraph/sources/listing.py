"""Which files a load consists of, and the table each belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.text import quoted


@dataclass(frozen=True)
class TableFiles:
    """One table of a load: its name, its path, how many files it has and the largest one's size."""

    name: str
    path: str
    n_files: int
    largest: int


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def table_entry(file_path: Column) -> Column:
    """The file a row came from: the file itself, or the folder Spark wrote it as.

    A folder named ``orders.csv`` holding ``part-...`` files is one file called
    ``orders.csv`` to a reader, which is how a large one is stored.
    """
    parent = F.regexp_extract(file_path, r"([^/]+)/part-[^/]+$", 1)
    own = F.regexp_extract(file_path, r"([^/]+)$", 1)
    return F.when(parent.rlike(r"\.[A-Za-z]+$"), parent).otherwise(own)


def file_listing(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Path and byte length of each file of a format; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
        .where(F.lower(table_entry(F.col("path"))).endswith("." + extension))
    )


def table_files(spark: SparkSession, path: str, extension: str) -> list[TableFiles]:
    """The tables of a load in file-name order; one row of metadata per table."""
    own = F.col("path")
    entry = table_entry(own)
    location = F.when(
        F.regexp_extract(own, r"([^/]+)$", 1) == entry, own
    ).otherwise(F.regexp_replace(own, r"/[^/]+$", ""))
    rows = (
        file_listing(spark, path, extension)
        .groupBy(entry.alias("entry"), location.alias("location"))
        .agg(F.count("*").alias("n_files"), F.max("length").alias("largest"))
        .withColumn("name", stem(quoted("entry")))
        .orderBy("entry", "location")
        .collect()
    )
    return [TableFiles(row["name"], row["location"], row["n_files"], row["largest"]) for row in rows]
