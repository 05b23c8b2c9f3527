"""Landed provider files as a registered data source.

    register(spark)
    spark.read.format("landed_payloads").option("path", folder).option("kind", "records").load()

Files are dealt to partitions by size and parsed to Arrow batches where they are read; no whole document becomes a column
value. ``kind`` is ``records`` for ``[meta, rows]`` documents or ``observations`` for SDMX-JSON. With ``rejects`` set to true
the same files give one row for each that cannot be read as that kind, and why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from panelscore.operators.derive import year_end
from panelscore.schema import ENTITY, FLAG, PERIOD, SOURCE, VALUE
from panelscore.sources.payloads import to_entity

FORMAT = "landed_payloads"
SCHEMAS = {
    "records": f"origin string, {ENTITY} string, {PERIOD} int, {VALUE} double",
    "observations": f"origin string, code string, time string, label string, {VALUE} double",
    "rejects": "origin string, reason string",
}


def source_class() -> type[DataSource]:
    """The data source. Everything it needs is defined here, so it travels by value and workers need only pyarrow."""
    import json
    import os
    import re

    import pyarrow as pa
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schemas = dict(SCHEMAS)
    whole_number = re.compile(r"\s*[+-]?\d{1,9}\s*")
    batch_rows = 10_000

    def number(value: object) -> float | None:
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value else None

    def records(document: object):
        """Rows of entity, period and value; rows without any of them are left out."""
        if not (isinstance(document, list) and len(document) > 1 and isinstance(document[1], list)):
            raise ValueError("no [meta, rows] document")
        for row in document[1]:
            if not isinstance(row, dict):
                raise ValueError("a row is no object")
            country = row.get("country")
            code = row.get("countryiso3code") or (country.get("id") if isinstance(country, dict) else None)
            date, value = row.get("date"), number(row.get("value"))
            if code and date is not None and whole_number.fullmatch(str(date)) and value is not None:
                yield str(code).upper(), int(str(date)), value

    def observations(document: object):
        """Rows of entity code, TIME_PERIOD label, label among all observation dimensions, and value."""
        document = document.get("data", document) if isinstance(document, dict) else document
        if not isinstance(document, dict) or "dataSets" not in document or "structure" not in document:
            raise ValueError("no dataSets or no structure")
        dimensions = document["structure"]["dimensions"]
        series_dims, time_dims = dimensions.get("series") or [], dimensions.get("observation") or []
        at = next((k for k, d in enumerate(series_dims) if d.get("id") == "REF_AREA"), 0)
        codes = [v.get("id") for v in series_dims[at].get("values") or []] if series_dims else []
        times = next(([v.get("id") for v in d.get("values") or []] for d in time_dims if d.get("id") == "TIME_PERIOD"), [])
        labels = [v.get("id") for d in time_dims for v in d.get("values") or []]
        pick = lambda values, k: values[k] if 0 <= k < len(values) else None
        for key, series in ((document["dataSets"] or [{}])[0].get("series") or {}).items():
            place = pick(key.split(":"), at)
            code = pick(codes, int(place)) if place is not None and whole_number.fullmatch(place) else None
            for index, observed in (series.get("observations") or {}).items():
                value = number(observed[0]) if observed else None
                if value is not None and whole_number.fullmatch(index):
                    yield code, pick(times, int(index)), pick(labels, int(index)), value

    parsers = {"records": records, "observations": observations}

    class Files(InputPartition):
        def __init__(self, paths: list[str]):
            super().__init__(paths)
            self.paths = paths

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.root = options.get("path")
            if not self.root:
                raise ValueError("option path is missing")
            self.kind = options.get("kind", "records")
            if self.kind not in parsers:
                raise ValueError(f"kind is one of {sorted(parsers)}, not {self.kind}")
            self.rejects = options.get("rejects", "false").lower() == "true"
            self.suffix = options.get("suffix", ".json")
            self.size = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

        def _store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.root))

        def partitions(self):
            from pyarrow import fs

            store, base = self._store()
            info = store.get_file_info(base)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
            files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and (f.path.endswith(self.suffix) or f is info) and not os.path.basename(f.path).startswith(("_", ".")))
            out: list[list[str]] = []
            held = self.size
            for path, size in files:
                if held + size > self.size and (held or not out):
                    out.append([])
                    held = 0
                out[-1].append(path)
                held += size
            return [Files(paths) for paths in out] or [Files([])]

        def read(self, partition):
            store, _ = self._store()
            kind = "rejects" if self.rejects else self.kind
            names = [c.split()[0] for c in schemas[kind].split(", ")]
            types = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schemas[kind].split(", ")]

            def batch(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

            held: list[tuple] = []
            for path in partition.paths:
                try:
                    with store.open_input_stream(path) as stream:
                        rows = list(parsers[self.kind](json.loads(stream.read())))
                    found = [] if self.rejects else [(path, *r) for r in rows]
                except (ValueError, KeyError, TypeError, AttributeError) as error:
                    found = [(path, f"{type(error).__name__}: {error}"[:200])] if self.rejects else []
                held += found
                while len(held) >= batch_rows:
                    yield batch(held[:batch_rows])
                    held = held[batch_rows:]
            if held:
                yield batch(held)

    class LandedPayloads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "landed_payloads"

        def schema(self) -> str:
            kind = self.options.get("kind", "records")
            return schemas["rejects" if self.options.get("rejects", "false").lower() == "true" else kind]

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return LandedPayloads


def register(spark: SparkSession) -> None:
    spark.dataSource.register(source_class())


def read(spark: SparkSession, path: str, kind: str, rejects: bool = False, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(path=path, kind=kind, rejects=str(rejects).lower(), **options).load()


def records_to_long(rows: DataFrame) -> DataFrame:
    """The long rows of ``records``."""
    return rows.withColumn(SOURCE, F.lit("World Bank")).withColumn(FLAG, F.lit("ok"))


def quarterly_to_annual(rows: DataFrame, keys: list[str], digits: int | None = 4) -> DataFrame:
    """S3: ``observations`` of quarters; the last quarter present stands for the year."""
    quarter = F.when(F.col("time").contains("Q"), F.coalesce(F.substring_index("time", "Q", -1).try_cast("int"), F.lit(4))).otherwise(1)
    known = rows.where(F.col("time").isNotNull()).select(*keys, F.substring("time", 1, 4).try_cast("int").alias(PERIOD), quarter.alias("_quarter"), VALUE)
    return year_end(known.where(F.col(PERIOD).isNotNull()), [*keys, PERIOD], "_quarter", VALUE, digits)


def series_to_long(rows: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``observations`` of one series per entity; only entities of the panel are kept."""
    year = F.substring("label", 1, 4).try_cast("int").alias(PERIOD)
    known = rows.select("origin", "code", year, VALUE).where(F.col("code").isNotNull() & F.col(PERIOD).isNotNull())
    return to_entity(known, aliases).join(entities.select(ENTITY).distinct(), ENTITY, "left_semi")
