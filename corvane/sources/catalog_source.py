"""Where the catalog's tables come from: Parquet files, a relational database, or rows in memory."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.schema import schema

KINDS = ("demo", "parquet", "postgres")


def resolve_source(value: str | None = None) -> str:
    """The kind of source: `value`, else the variable CATALOG_DATA_SOURCE, else demo. An unknown one is an error, never replaced silently."""
    chosen = os.environ.get("CATALOG_DATA_SOURCE", "") if value is None else value
    if chosen in ("", "demo"):
        return "demo"
    if chosen not in KINDS:
        raise ValueError(f"unknown catalog data source: {chosen}")
    return chosen


class Tables:
    """The catalog's tables by name. A table that the source lacks is empty, with its schema."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _load(self, name: str) -> DataFrame | None:
        raise NotImplementedError

    def __getitem__(self, name: str) -> DataFrame:
        """All columns of a table, repeats included."""
        shape = schema(name)
        df = self._load(name)
        if df is None:
            return self.spark.createDataFrame([], shape)
        return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields])

    def rows(self, name: str, *columns: str | Column, where: Column | str | None = None) -> DataFrame:
        """The named columns of the rows that satisfy `where`, exact repeats of rows once.

        Only the columns that the query uses in the end and those of `where` are read, and filters reach the scan. A table with ids has one row for each;
        where rows of one id differ against that rule, any of them stands for it. Rows of a table without id repeat if they do so in all
        columns, which a hash of the row tells, so that no other column is shuffled.
        """
        df = self[name]
        kept = df if where is None else df.where(where)
        if "id" in df.columns:
            return kept.dropDuplicates(["id"]).select(*columns)
        return kept.select(*columns, F.xxhash64(*df.columns).alias("_row")).distinct().drop("_row")


class ParquetTables(Tables):
    """One Parquet file or folder for each table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark)
        if not folder:
            raise ValueError("a Parquet source needs a folder")
        self.folder = folder.rstrip("/")

    def _load(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class JdbcTables(Tables):
    """Tables of a relational database.

    A table named in `ranges` as (column, lower, upper, tasks) is read by that many tasks over ranges of a number or timestamp; any other by one.
    """

    def __init__(self, spark: SparkSession, url: str | None, options: Mapping[str, str] | None = None, ranges: Mapping[str, tuple[str, str, str, int]] | None = None) -> None:
        super().__init__(spark)
        if not url:
            raise ValueError("a relational source needs a URL")
        self.url, self.options, self.ranges = url, dict(options or {}), dict(ranges or {})

    def read_options(self, name: str) -> dict[str, str]:
        """The reader's options of a table."""
        split = self.ranges.get(name)
        ranged = {} if split is None else {"partitionColumn": split[0], "lowerBound": str(split[1]), "upperBound": str(split[2]), "numPartitions": str(split[3])}
        return {"url": self.url, "dbtable": name, **self.options, **ranged}

    def _load(self, name: str) -> DataFrame | None:
        return self.spark.read.format("jdbc").options(**self.read_options(name)).load()


class MemoryTables(Tables):
    """Rows given as dictionaries, for small catalogs and tests."""

    def __init__(self, spark: SparkSession, rows: Mapping[str, Iterable[Mapping[str, object]]]) -> None:
        super().__init__(spark)
        self.given = rows

    def _load(self, name: str) -> DataFrame | None:
        if name not in self.given:
            return None
        shape = schema(name)
        return self.spark.createDataFrame([tuple(r.get(f) for f in shape.names) for r in self.given[name]], shape)


def open_tables(spark: SparkSession, kind: str | None = None, *, folder: str = "", url: str | None = None, rows: Mapping[str, Iterable[Mapping[str, object]]] | None = None) -> Tables:
    """The tables of the resolved source; the demo catalog if none is named."""
    chosen = resolve_source(kind)
    if chosen == "parquet":
        return ParquetTables(spark, folder)
    if chosen == "postgres":
        return JdbcTables(spark, url or os.environ.get("DATABASE_URL"))
    from corvane.sources.demo import DEMO_ROWS

    return MemoryTables(spark, rows or DEMO_ROWS)
