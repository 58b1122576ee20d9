"""Where a table's data files are: an interface, and folders of Parquet as its first form."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import SparkSession


class Catalog(Protocol):
    def location(self, table: str) -> str: ...

    def files(self, table: str) -> list[str]:
        """The live data files."""


class ParquetFolderCatalog:
    """Tables are Parquet files or folders; `alias.name` resolves to the alias's folder."""

    def __init__(self, spark: SparkSession, aliases: dict[str, str]):
        self.spark, self.aliases = spark, aliases

    def location(self, table: str) -> str:
        alias, _, name = table.partition(".")
        if alias not in self.aliases or not name:
            raise KeyError(f"unknown table: {table}")
        return f"{self.aliases[alias].rstrip('/')}/{name.replace('.', '/')}.parquet"

    def files(self, table: str) -> list[str]:
        return data_files(self.spark, self.location(table))


def data_files(spark: SparkSession, path: str) -> list[str]:
    return sorted(spark.read.parquet(path).inputFiles())
