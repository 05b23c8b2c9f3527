"""Network edges without looking at every pair of blocks (N2, N4, N8 above a threshold).

The angle arccos |r| between the lines of two centred vectors is a metric. Entities that have a change in every step are
dealt to the nearest of a few pivots and cut into blocks by their angle to it; a block knows its least and greatest angle to
every pivot. By the triangle inequality two blocks whose angles to some pivot lie further apart than arccos(threshold) hold
no edge between them and are never multiplied. Entities with gaps, whose correlations are over different steps and so no
metric, meet all others. Blocks that meet are multiplied exactly as in ``network.correlations``.

Neighbouring blocks travel together, as bands: an entity goes to each band that may hold an edge with its own, and there
the blocks are parted. The number of bands does not grow with the entities until a band fills a task, however small the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscore.operators import network
from panelscore.schema import ENTITY
from panelscore.session import pin

#: Pivots, and the vectors they are chosen from: any choice gives the same edges, a good one skips more.
PIVOTS, SAMPLE = 16, 2000
#: What rounding may add to an angle.
SLACK = 1e-7


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other by angle: the first, then always the one furthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = np.abs(sample @ sample[0])
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, np.abs(sample @ sample[chosen[-1]]))
    return sample[chosen]


def _unit(rows: np.ndarray) -> np.ndarray:
    centred = rows - rows.mean(axis=1, keepdims=True)
    return centred / np.linalg.norm(centred, axis=1, keepdims=True)


def _aligned(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Changes in the order of steps, and whether a vector has them all and is not nearly constant; the number of steps."""
    width = vectors.select(F.explode("steps").alias("step")).distinct().count()
    ordered = vectors.selectExpr(ENTITY, "array_sort(arrays_zip(steps, deltas)) AS z").selectExpr(ENTITY, "z.steps AS steps", "z.deltas AS deltas")
    spread = "aggregate(deltas, named_struct('lo', double('inf'), 'hi', double('-inf')), (a, x) -> named_struct('lo', least(a.lo, x), 'hi', greatest(a.hi, x)))"
    whole = F.expr(f"size(steps) = {width} AND exists(array({spread}), s -> s.hi - s.lo > 1e-5 * greatest(abs(s.hi), abs(s.lo), 1D))")
    return ordered.withColumn("_whole", F.coalesce(whole, F.lit(False))), width


def _angles(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(entity, pivot, angles): the nearest pivot and the angle to each of them. The task function travels by value."""

    def measure(batches):
        for b in batches:
            rows = np.array(b["deltas"].to_pylist(), np.float64).reshape(b.num_rows, -1)
            rows -= rows.mean(axis=1, keepdims=True)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            angles = np.arccos(np.clip(np.abs(rows @ pivots.T), 0.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [b[ENTITY], pa.array(angles.argmin(1), pa.int32()), pa.array(list(angles), pa.list_(pa.float64()))], names=[ENTITY, "pivot", "angles"]
            )

    return whole.select(ENTITY, "deltas").mapInArrow(measure, f"{ENTITY} string, pivot int, angles array<double>")


def _blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """(entity, block, angles): each pivot's entities in stretches of their angle to it, of about ``block_rows``."""
    own = F.element_at("angles", F.col("pivot") + 1)
    shares = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"), F.percentile_approx(own, [k / 64 for k in range(1, 64)], 1000).alias("cuts"))
    # One row per pivot. A stretch is a run of 64ths; one with more rows than a block, as equal angles make, is dealt by hash.
    stretch = F.floor(F.size(F.filter("cuts", lambda x: x < own)) * F.least("parts", F.lit(64)) / 64).cast("int")
    dealt = placed.join(F.broadcast(shares), "pivot").select(ENTITY, "angles", "pivot", stretch.alias("at"))
    sizes = dealt.groupBy("pivot", "at").agg(F.greatest(F.lit(1), F.round(F.count(F.lit(1)) / block_rows)).cast("int").alias("fine"))
    # At most 64 rows per pivot.
    dealt = dealt.join(F.broadcast(sizes), ["pivot", "at"])
    return dealt.select(ENTITY, "angles", F.concat_ws(":", "pivot", "at", F.pmod(F.xxhash64(ENTITY), "fine")).alias("block"))


def _bounds(angles: DataFrame, by: str) -> DataFrame:
    """(by, low, high): the least and greatest angle to every pivot, of rows (by, low, high)."""
    each = angles.select(by, F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy(by, "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("s")).selectExpr(by, "s.low AS low", "s.high AS high")


def _bands(sizes: DataFrame, band_rows: int) -> DataFrame:
    """(block, part, band, bound) of (block, rows): blocks in the order of their stretches, in bands of about ``band_rows``.

    Blocks of entities with gaps have bands of their own."""
    name = F.split("block", ":")
    order = [F.col("block").startswith("gaps:"), *[F.try_element_at(name, F.lit(k)).try_cast("int") for k in (1, 2, 3)], F.col("block")]
    # Few rows: one per block.
    here = Window.partitionBy(F.lit(0)).orderBy(*order)
    before = F.sum("rows").over(Window.partitionBy(order[0]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    numbered = sizes.select("block", (~order[0]).alias("bound"), F.row_number().over(here).alias("part"), F.floor(before / band_rows).alias("own"))
    return numbered.select("block", "part", "bound", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(~F.col("bound"), "own")).alias("band"))


def _meeting(summaries: DataFrame, angle: float) -> DataFrame:
    """Pairs (block, other), block <= other, that the triangle inequality does not part at any pivot."""
    width = max(angle, 1e-3)
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int"))).alias("_bin")
    left = summaries.select("block", "low", "high", bins(F.col("low")[0] - angle, F.col("high")[0] + angle))
    right = summaries.select(F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), bins(F.col("low")[0], F.col("high")[0]))
    near = F.forall(F.arrays_zip("low", "high", "low2", "high2"), lambda x: (x["low"] - x["high2"] <= angle) & (x["low2"] - x["high"] <= angle))
    return left.join(right, "_bin").where((F.col("block") <= F.col("other")) & near).select("block", "other").distinct()


def edges(
    vectors: DataFrame,
    min_pairs: int = network.MIN_PAIRS,
    threshold: float = network.THRESHOLD,
    block_rows: int = network.BLOCK_ROWS,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """(a, b, correlation, pairs) of |r| >= threshold, as ``network.correlations`` finds them, and one row (blocks, with_gaps,
    block_pairs, compared, skipped_share) that says what the bounds were worth.

    ``vectors`` is a table of ``network.delta_vectors``. With entities that have nothing in common (white noise) all angles are
    near 90 degrees and little can be skipped; the result is the same and the work that of all pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1 is needed")
    spark = vectors.sparkSession
    rows, width = _aligned(vectors.where("steps IS NOT NULL"))
    rows = pin(rows)
    whole = rows.where("_whole")
    some = whole.orderBy(F.xxhash64(ENTITY), ENTITY).limit(SAMPLE).select("deltas").collect() if width >= max(2, min_pairs) else []
    sample = _unit(np.array([r.deltas for r in some], np.float64)) if some else np.zeros((0, max(width, 1)))
    angle = float(np.arccos(threshold)) + SLACK
    if some:
        far = choose_pivots(sample, pivots)
        placed = pin(_blocks(_angles(whole, far), block_rows))
        summaries = pin(_bounds(placed.select("block", F.col("angles").alias("low"), F.col("angles").alias("high")), "block"))
        placed = placed.select(ENTITY, "block")
    else:
        far = sample
        placed = spark.createDataFrame([], f"{ENTITY} string, block string")
        summaries = spark.createDataFrame([], "block string, low array<double>, high array<double>")
    gaps = rows.where("NOT _whole") if some else rows
    parts = max(1, -(-gaps.count() // int(block_rows)))
    gaps = gaps.select(ENTITY, F.concat(F.lit("gaps:"), F.pmod(F.xxhash64(ENTITY), F.lit(parts)).cast("string")).alias("block"))
    every = pin(placed.unionByName(gaps))
    band_rows = network.rows_per_block(rows, every.count(), block_rows)
    numbers = pin(_bands(every.groupBy("block").agg(F.count(F.lit(1)).alias("rows")), band_rows))
    # Pairs of bands: no more than a few dozen bands until a band fills a task.
    of_band = _bounds(summaries.join(numbers, "block").select(F.col("band").alias("block"), "low", "high"), "block")
    bands = numbers.select("band", "bound").distinct()
    with_gaps = bands.where("NOT bound").select("band").crossJoin(bands.select(F.col("band").alias("other")))
    numbered = pin(_meeting(of_band, angle).union(with_gaps).select(F.least("block", "other").alias("_i"), F.greatest("block", "other").alias("_j")).distinct())
    ends = numbered.select("_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_own"))
    dealt = every.join(numbers.select("block", F.col("part").alias("_part"), F.col("bound").alias("_bound"), F.col("band").alias("_own")), "block")
    sent = dealt.join(rows.select(ENTITY, "steps", "deltas"), ENTITY).join(F.broadcast(ends), "_own")
    kernel = network.block_kernel(max(2, int(min_pairs)), float(threshold), sums=False, parted=(far, angle))
    found = sent.select("_i", "_j", "_own", "_part", "_bound", ENTITY, "steps", "deltas").groupBy("_i", "_j").applyInArrow(kernel, network.PAIR_SCHEMA)
    # What the bounds part, by blocks: counted when the report is read.
    free = F.count_if(~F.col("bound"))
    counted = numbers.agg(F.count(F.lit(1)).alias("blocks"), free.alias("with_gaps"))
    parted = _meeting(summaries, angle).agg(F.count(F.lit(1)).alias("met"))
    compared = F.col("met") + F.col("with_gaps") * (F.col("blocks") - F.col("with_gaps")) + F.floor(F.col("with_gaps") * (F.col("with_gaps") + 1) / 2)
    blocks = F.col("blocks")
    report = counted.crossJoin(parted).select("blocks", "with_gaps", F.floor(blocks * (blocks + 1) / 2).alias("block_pairs"), compared.alias("compared"))
    return network.pair_table(found), report.withColumn("skipped_share", F.round(1 - F.try_divide(F.col("compared"), F.col("block_pairs")), 4))
