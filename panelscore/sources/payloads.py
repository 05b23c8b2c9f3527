"""Landed provider payloads to long rows (S1-S5). One input row is one payload or one CSV line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscore.operators.derive import year_end
from panelscore.schema import ENTITY, FLAG, INDICATOR, PERIOD, SOURCE, VALUE

RECORDS = (
    "array<struct<countryiso3code:string, country:struct<id:string>, date:string, value:double>>"
)
SDMX = (
    "struct<dataSets:array<struct<series:map<string,struct<observations:map<string,array<double>>>>>>,"
    "structure:struct<dimensions:struct<"
    "series:array<struct<id:string,`values`:array<struct<id:string>>>>,"
    "observation:array<struct<id:string,`values`:array<struct<id:string>>>>>>>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("origin")
    )


def _long(df: DataFrame, source: Column) -> DataFrame:
    return df.withColumn(SOURCE, source).withColumn(FLAG, F.lit("ok"))


def records_to_long(
    payloads: DataFrame, payload: str = "payload", keep_nulls: bool = False, stamp: str | None = None
) -> DataFrame:
    """``[meta, rows]`` JSON. A short, broken or null payload gives no rows.

    The batch form drops null values and reads the entity from each row; the single form
    (``stamp`` names a column holding the requested entity) keeps nulls and stamps that entity.
    """
    rest = [c for c in payloads.columns if c != payload]
    rows = F.from_json(F.get_json_object(payload, "$[1]"), RECORDS)
    out = payloads.select(*rest, F.explode(rows).alias("_r"))
    code = F.coalesce(F.nullif(F.col("_r.countryiso3code"), F.lit("")), F.col("_r.country.id"))
    entity = F.col(stamp) if stamp else F.nullif(code, F.lit(""))
    out = out.select(
        *[c for c in rest if c != stamp],
        F.upper(entity).alias(ENTITY),
        F.col("_r.date").try_cast("int").alias(PERIOD),
        F.col("_r.value").alias(VALUE),
    ).where(F.col(PERIOD).isNotNull() & F.col(ENTITY).isNotNull())
    if not keep_nulls and stamp is None:
        out = out.where(F.col(VALUE).isNotNull())
    return _long(out, F.lit("World Bank"))


def lines_to_annual(
    lines: DataFrame, keys: Sequence[str], start: int, end: int, line: str = "line"
) -> DataFrame:
    """``date,value`` lines to a mean per year; unreadable dates or numbers are dropped."""
    parts = F.split(F.col(line), ",")
    rows = lines.select(
        *keys,
        F.try_to_timestamp(F.get(parts, 0), F.lit("yyyy-MM-dd")).alias("_day"),
        F.get(parts, 1).try_cast("double").alias(VALUE),
    ).where(F.col("_day").isNotNull() & F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    rows = rows.withColumn(PERIOD, F.year("_day").cast("int")).where(F.col(PERIOD).between(int(start), int(end)))
    return rows.groupBy(*keys, PERIOD).agg(F.avg(VALUE).alias(VALUE))


def read_annual_csv(spark: SparkSession, path: str, series: str, start: int, end: int) -> DataFrame:
    """S2 over CSV files with columns observation_date and <series>; other columns give no rows."""
    raw = spark.read.option("header", True).csv(path)
    if not {"observation_date", series} <= set(raw.columns):
        return spark.createDataFrame([], f"{PERIOD} int, {VALUE} double")
    lines = raw.select(F.concat_ws(",", F.col("observation_date"), F.col(f"`{series}`")).alias("line"))
    return lines_to_annual(lines, [], start, end)


def _parsed(payloads: DataFrame, payload: str) -> DataFrame:
    # Some providers wrap the message in {"data": ...}.
    body = F.coalesce(F.get_json_object(payload, "$.data"), F.col(payload))
    return payloads.withColumn("_m", F.from_json(body, SDMX)).drop(payload)


def _observations(parsed: DataFrame, rest: list[str]) -> DataFrame:
    series = F.get(F.col("_m.dataSets"), 0)["series"]
    out = parsed.select(*rest, "_m", F.explode(series).alias("_key", "_series"))
    out = out.select(*rest, "_m", "_key", F.explode("_series.observations").alias("_index", "_obs"))
    return out.select(
        *rest, "_m", "_key", F.col("_index").try_cast("int").alias("_index"), F.get(F.col("_obs"), 0).alias(VALUE)
    ).where(F.col("_index").isNotNull() & F.col(VALUE).isNotNull())


def quarterly_to_annual(payloads: DataFrame, payload: str = "payload", digits: int | None = 4) -> DataFrame:
    """S3: quarterly SDMX-JSON, one entity per payload; the last quarter present stands for the year."""
    rest = [c for c in payloads.columns if c != payload]
    rows = _observations(_parsed(payloads, payload), rest)
    times = F.get(F.filter(F.col("_m.structure.dimensions.observation"), lambda d: d["id"] == "TIME_PERIOD"), 0)
    label = F.get(times["values"], F.col("_index"))["id"]
    rows = rows.withColumn("_label", label).where(F.col("_label").isNotNull())
    quarter = F.when(
        F.col("_label").contains("Q"),
        F.coalesce(F.substring_index("_label", "Q", -1).try_cast("int"), F.lit(4)),
    ).otherwise(1)
    rows = rows.select(
        *rest, F.substring("_label", 1, 4).try_cast("int").alias(PERIOD), quarter.alias("_quarter"), VALUE
    ).where(F.col(PERIOD).isNotNull())
    return year_end(rows, [*rest, PERIOD], "_quarter", VALUE, digits)


def series_to_long(payloads: DataFrame, entities: DataFrame, aliases: DataFrame, payload: str = "payload") -> DataFrame:
    """SDMX-JSON with one series per entity; only entities of the panel are kept."""
    rest = [c for c in payloads.columns if c != payload]
    rows = _observations(_parsed(payloads, payload), rest)
    dims = F.col("_m.structure.dimensions.series")
    found = F.array_position(F.transform(dims, lambda d: d["id"]), "REF_AREA").cast("int")
    at = F.when(found > 0, found - 1).otherwise(0)
    index = F.get(F.split("_key", ":"), at).try_cast("int")
    code = F.get(F.get(dims, at)["values"], index)["id"]
    periods = F.flatten(F.transform(F.col("_m.structure.dimensions.observation"), lambda d: d["values"]))
    year = F.substring(F.get(periods, F.col("_index"))["id"], 1, 4).try_cast("int")
    rows = rows.select(*rest, code.alias("code"), year.alias(PERIOD), VALUE).where(
        F.col("code").isNotNull() & F.col(PERIOD).isNotNull()
    )
    return to_entity(rows, aliases).join(entities.select(ENTITY).distinct(), ENTITY, "left_semi")


def to_entity(df: DataFrame, aliases: DataFrame, code: str = "code") -> DataFrame:
    """Provider code to entity; an unmapped code passes through in upper case."""
    known = aliases.select(F.upper("code").alias("_code"), F.col(ENTITY).alias("_entity"))
    out = df.withColumn("_code", F.upper(F.col(code))).join(known, "_code", "left")
    rest = [c for c in df.columns if c != code]
    return out.select(F.coalesce("_entity", "_code").alias(ENTITY), *rest)


def to_code(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """S5, other direction: entity to provider code, passing unmapped entities through."""
    known = aliases.select(F.upper(ENTITY).alias("_entity"), F.col("code").alias("_code"))
    out = df.withColumn("_entity", F.upper(F.col(ENTITY))).join(known, "_entity", "left")
    return out.select(*df.columns, F.coalesce("_code", "_entity").alias("code"))


def stamp(df: DataFrame, indicator: str, source: str) -> DataFrame:
    """Give rows of one collector their indicator and source."""
    return df.withColumn(INDICATOR, F.lit(indicator)).withColumn(SOURCE, F.lit(source)).withColumn(FLAG, F.lit("ok"))
