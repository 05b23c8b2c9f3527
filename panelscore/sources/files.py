"""Files and tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscore.functions.scalar import nan_to_null
from panelscore.schema import ENTITY, INDICATOR, LONG_COLUMNS, PERIOD, VALUE, require
from panelscore.session import exists, remove, rename


def read_wide_csv(
    spark: SparkSession, path: str, codes: Sequence[str], entity: str = ENTITY, period: str = PERIOD
) -> DataFrame:
    """Wide panel with a header. Types come from the model, not from a second pass over the data."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in (entity, period) if c not in header]
    if missing:
        raise ValueError(f"missing column(s) {missing} in {path}")
    types = {entity: T.StringType(), period: T.IntegerType()}
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType() if c in codes else T.StringType())) for c in header])
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(
        F.upper(F.trim(F.col(entity))).alias(ENTITY),
        F.col(period).alias(PERIOD),
        *[nan_to_null(F.col(f"`{c}`")).alias(c) for c in codes if c in header],
    )


def read_long(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), ENTITY, INDICATOR, PERIOD, VALUE)


def load_config(path: str) -> Mapping:
    """A small JSON or YAML configuration file on the driver."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading YAML needs the yaml module; convert the file to JSON") from exc
    return yaml.safe_load(text) or {}


def ratings_rows(config: Mapping, agencies: Sequence[str] = ("S&P", "Moody's", "Fitch")) -> list[tuple]:
    """(entity, agency, letter) from a parsed ratings file."""
    return [
        (str(e["iso3"]).upper(), a, str(e[a]))
        for e in config.get("entries") or []
        if isinstance(e, Mapping) and e.get("iso3")
        for a in agencies
        if e.get(a)
    ]


def write_table(
    df: DataFrame, path: str, partition_by: str | None = PERIOD, fmt: str = "parquet", replace: Sequence[int] | None = None
) -> None:
    """An idempotent load.

    Without ``replace`` a full reload: afterwards the table holds ``df`` and nothing else. With it, those partition values
    are replaced, also by nothing where ``df`` has no row of them, and all others stay. Rows are gathered by partition value
    before the write, and a value with a large share of the rows is split.

    Replacements are written aside as a whole before any partition is touched, so ``df`` may read the table and a write that
    fails changes nothing; the partitions are then swapped one after the other. ``versions.commit`` swaps them in one step.
    """
    spark = df.sparkSession
    if replace is not None:
        if partition_by is None:
            raise ValueError("only partitions can be replaced")
        df = df.where(F.col(partition_by).isin([int(v) for v in replace]))
    root = path.rstrip("/")
    target = f"{root}/_aside-{uuid.uuid4().hex}" if replace is not None else path
    if partition_by is not None:
        df = df.hint("rebalance", F.col(partition_by))
    # Said at the writer, so that no session setting turns a full reload into a partial one.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", 5_000_000)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(target)
    for value in replace or ():
        part = f"{partition_by}={int(value)}"
        remove(spark, f"{root}/{part}")
        if exists(spark, f"{target}/{part}"):
            rename(spark, f"{target}/{part}", f"{root}/{part}")
    if replace is not None:
        remove(spark, target)


def route_sources(parts: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of what the collectors delivered; a source that delivered nothing is left out."""
    frames = [
        df.withColumn(INDICATOR, F.lit(code)) if INDICATOR not in df.columns else df
        for code, df in parts.items()
        if df is not None
    ]
    if not frames:
        raise ValueError("no source delivered data")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select(*[c for c in LONG_COLUMNS if c in out.columns])
