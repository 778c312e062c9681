"""Result tables written as Parquet, CSV or JSON; a workbook is a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, lead: list[str] | None = None) -> DataFrame:
    """Leading columns first, columns with a leading underscore dropped, nested values as JSON."""
    names = [c for c in (lead or []) if c in df.columns] + [c for c in df.columns if c not in (lead or []) and not c.startswith("_")]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(F.col(c)).alias(c) if isinstance(kinds[c], nested) else F.col(c) for c in names))


def write_csv(df: DataFrame, path: str, lead: list[str] | None = None) -> None:
    flat(df, lead).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def write_by_signer(marks: DataFrame, path: str) -> None:
    """Marks in a folder for each signer: rows are dealt by signer and a salt, so that none fills one task."""
    salt = F.pmod(F.xxhash64("sig_id"), F.lit(8))
    marks.repartition("signer_id", salt).write.mode("overwrite").partitionBy("signer_id").parquet(path)
