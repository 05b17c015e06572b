"""Writers: CSV, JSON lines, outlines, workbooks, and tables that are replaced by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.export import cells
from ..operators.outline import valid_nodes


def write_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, nested fields as JSON."""
    cells(rows).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_outline(nodes: DataFrame, path: str) -> None:
    """Node rows, checked, as JSON lines."""
    write_json_lines(valid_nodes(nodes), path)


def write_workbook(rows: DataFrame, path: str, most: int = 1_048_575) -> None:
    """An XLSX file on the driver, for tables of a workbook's size; larger ones are refused. Needs a writer for pandas."""
    frame = cells(rows).limit(most + 1).toPandas()
    if len(frame) > most:
        raise ValueError(f"a workbook holds {most} rows")
    frame.to_excel(path, index=False)


def append(rows: DataFrame, path: str, *by: str) -> None:
    """Adds rows to a table of appended facts."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str = "dataset_id") -> None:
    """Replaces the partitions that occur among the rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(stored: DataFrame, new: DataFrame, key: str, listed_only: bool = False) -> DataFrame:
    """Rows of new replace those of the same key; with listed_only rows that new does not name go."""
    latest = new.dropDuplicates([key])
    return latest if listed_only else stored.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)


def csv_cell(value: Column) -> Column:
    """A field as CSV writes it by hand: quoted if it holds a comma, a quote or a line's end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
