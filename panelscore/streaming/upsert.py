"""Structured Streaming from landed observation files into a versioned panel table (P1-P3, P5, S10 as a stream).

Each micro-batch is normalised, reduced to the last arrival per key and merged into the periods that it touches: one new
version of the table. Arrival order decides by ``seq``, not by batch, so files may come in any order, twice, or late: the
table ends as one batch run over all of them would leave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelscore.operators import clean
from panelscore.schema import PERIOD
from panelscore.session import checkpoint_folder, pin, unpin
from panelscore.sources import versions


def merge_batch(table: str, stream: str, lateness: int, aside: str | None = None) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: (rows, batch number) into a new version of ``table``.

    The version's facts hold the stream's last batch number, so a batch that runs again after a failure is skipped, and a
    watermark: the greatest period seen less ``lateness`` periods. Rows before the watermark of the batches so far are late:
    they are counted, and merged like all others, or with ``aside`` written there under their batch number instead.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = versions.current(spark, table)
        if held and held.facts.get(f"batch of {stream}", -1) >= number:
            return
        rows = pin(clean.drop_incomplete(clean.normalize(batch)))
        high = held.facts.get("high") if held else None
        late = F.lit(False) if high is None else F.col(PERIOD) < high - lateness
        n, many, newest = rows.agg(F.count(F.lit(1)), F.count_if(late), F.max(PERIOD)).first()
        if aside is not None:
            rows_late = rows.where(late)
            rows_late.write.mode("overwrite").parquet(f"{aside}/batch={number}")
        kept = rows.where(~late) if aside is not None else rows

        def facts(base: versions.Version | None) -> dict:
            was = base.facts if base else {}
            highs = [x for x in (was.get("high"), newest) if x is not None]
            return {f"batch of {stream}": number, "high": max(highs, default=None), "rows": was.get("rows", 0) + n, "late": was.get("late", 0) + many}

        versions.merge_rows(clean.keep_last(kept), table, lambda old, new: clean.keep_last(old.unionByName(new)), facts=facts)
        unpin(rows)

    return merge


def start(
    spark: SparkSession,
    landed: str,
    table: str,
    checkpoint: str,
    schema: StructType | str,
    fmt: str = "parquet",
    lateness: int = 0,
    aside: str | None = None,
    options: dict[str, str] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Merge the files that lie, or come to lie, in ``landed``: what is there now, or with ``every`` for ever.

    ``checkpoint`` keeps what was read and names the stream. ``options`` go to the file source, as ``maxFilesPerTrigger``
    or ``maxBytesPerTrigger``, which bound a micro-batch.
    """
    checkpoint_folder(spark)
    rows = spark.readStream.schema(schema).format(fmt).options(**(options or {})).load(landed)
    writer = rows.writeStream.foreachBatch(merge_batch(table, checkpoint.rstrip("/"), lateness, aside)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run(spark: SparkSession, landed: str, table: str, checkpoint: str, schema: StructType | str, **options) -> DataFrame | None:
    """Merge all that has landed and return the table, None if nothing ever has."""
    query = start(spark, landed, table, checkpoint, schema, **options)
    query.awaitTermination()
    return versions.read_version(spark, table) if versions.current(spark, table) else None
