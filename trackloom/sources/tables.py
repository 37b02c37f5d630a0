"""Tolerant CSV tables, typed sinks, reruns by file name, and the reference index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_header(names: list[str]) -> list[str]:
    """Unnamed columns are called unnamed, repeated names get __dup1, __dup2 ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        name = (name or "").strip().lstrip("﻿") or "unnamed"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name if not k else f"{name}__dup{k}")
    return out


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line to the files that begin with it; files without a line that says something are left out."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    if len(lines.inputFiles()) == 1:
        first = lines.limit(1).collect()
        return {first[0][0]: [path]} if first else {}
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    heads = lines.select("value", F.col("_metadata.file_path").alias("file"), at.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("head"))
    found: dict[str, list[str]] = {}
    for file, head in heads.orderBy("file").collect():
        found.setdefault(head, []).append(file)
    return found


def read_table(spark: SparkSession, path: str, keep_file: bool = False, multiline: bool = True) -> DataFrame:
    """All columns as text, short rows padded with empty text, header cleaned. Files with other headers are read under their own and united
    by column name; columns that a file lacks are null. A quoted value may hold line breaks, which makes each file one task; without
    `multiline` large files are split."""
    import csv

    out = None
    for head, files in _headers(spark, path).items():
        names = clean_header(next(csv.reader([head])))
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("escape", '"').option("multiLine", multiline)
        df = reader.schema(", ".join(f"`c{i}` string" for i in range(len(names)))).csv(files)
        cols = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
        one = df.select(*cols, *([F.col("_metadata.file_path").alias("_file")] if keep_file else []))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return spark.createDataFrame([], "unnamed string") if out is None else out


def read_tables(spark: SparkSession, paths: list[str], keep_file: bool = True) -> DataFrame:
    """Union of tables with differing headers; columns that a table lacks are null."""
    if not paths:
        raise ValueError("no files to read")
    out = read_table(spark, paths[0], keep_file)
    for p in paths[1:]:
        out = out.unionByName(read_table(spark, p, keep_file), allowMissingColumns=True)
    return out


def id_from_file(column: str, pattern: str = r"path_window_(\d+)") -> Column:
    """A number that the file name carries, null if it does not."""
    return F.nullif(F.regexp_extract(F.col(column), pattern, 1), F.lit("")).try_cast("int")


def as_text(df: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    """Columns as a CSV wants them: numbers to fixed decimals, truth as 1 and 0, arrays joined by semicolons, null as empty text."""
    decimals = decimals or {}
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in decimals:
            text = F.format_string(f"%.{decimals[name]}f", c.cast("double"))
        elif kind == "boolean":
            text = c.cast("int").cast("string")
        elif kind.startswith("array"):
            text = F.array_join(c.cast("array<string>"), ";")
        else:
            text = c.cast("string")
        out.append(F.when(c.isNull(), "").otherwise(text).alias(name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, header: list[str] | None = None, decimals: dict[str, int] | None = None) -> None:
    """CSV with a header; named columns that the table lacks are empty."""
    if header:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in header])
    as_text(df, decimals).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def write_reference_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("flight_id").parquet(path)


def read_reference_index(spark: SparkSession, path: str, flights: list[str] | None = None) -> DataFrame:
    """The index; of the named flights only the partitions are read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("flight_id").isin(flights)) if flights is not None else df


def reference_subset(index: DataFrame, wanted: DataFrame, column: str = "ref_index") -> DataFrame:
    """The rows of an index whose number is among the wanted ones, numbered anew from 0 in their old order; the old number stays as source_ref_index."""
    from ..operators.windows import number_rows

    ids = wanted.select(F.col(column).cast("long").alias("_wanted")).distinct()
    kept = index.join(ids, F.col("ref_index") == F.col("_wanted"), "left_semi").withColumnRenamed("ref_index", "source_ref_index")
    return number_rows(kept, ["source_ref_index"], "ref_index").withColumn("ref_index", F.col("ref_index") - 1)


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """A reference index from a compressed archive of parallel arrays. The archive is read where it lies, by the driver."""
    import io

    import numpy as np
    import pandas as pd

    raw = spark.sparkContext.binaryFiles(path).values().first()
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        arrays = {k: z[k] for k in z.files}
    columns = {}
    for name, values in arrays.items():
        if values.ndim == 2:
            columns["descriptor"] = [row.astype("float32").tolist() for row in values]
        else:
            columns[name] = [None if isinstance(v, float) and v != v else v for v in values.tolist()]
    n = max(len(v) for v in columns.values())
    pdf = pd.DataFrame({"ref_index": range(n), **columns})
    df = spark.createDataFrame(pdf)
    return df.withColumn("descriptor", F.col("descriptor").cast("array<float>")) if "descriptor" in columns else df
