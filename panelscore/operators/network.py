"""Co-movement network of score changes.

The correlation of every pair is the definition of this network, so its cost is quadratic in the
entities. What keeps it affordable: each entity is one row holding its vector of changes, entities
fall into equal hash blocks, and a task multiplies two blocks as matrices. No row per pair is ever
shuffled, and a task emits only the pairs above the threshold plus one partial sum per entity. The
number of blocks does not grow with the entities until a block fills a task, so the rows moved grow
with the entities and only the multiplications with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelscore.functions.ranks import global_index
from panelscore.schema import ENTITY, PERIOD
from panelscore.session import pin, unpin

SCORE = "risk_score"
# Defaults of the network.
MIN_PAIRS, THRESHOLD = 4, 0.5
BLOCK_ROWS = 2048
#: Blocks of many entities, changes in a block (16 MB of doubles a matrix), and rows of either side multiplied at once.
BLOCKS, BLOCK_CELLS, TILE_ROWS = 32, 1 << 21, 256
PAIR_SCHEMA = "kind string, a string, b string, correlation double, pairs bigint, abs_sum double, peers bigint"


def score_deltas(scores: DataFrame) -> DataFrame:
    """Change against the adjacent period present in the panel, null rows left out.

    Adjacent means the period before among those scored at all, not the calendar year before.
    """
    known = scores.where(F.col(SCORE).isNotNull()).select(F.upper(ENTITY).alias(ENTITY), PERIOD, SCORE)
    # Distinct periods: bounded by the calendar.
    ordered = Window.partitionBy(F.lit(0)).orderBy(PERIOD)
    periods = known.select(PERIOD).distinct().select(
        PERIOD, F.lag(PERIOD, 1).over(ordered).alias("_adjacent"), (F.row_number().over(ordered) - 1).alias("step")
    )
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    moved = known.select("*", F.lag(SCORE, 1).over(w).alias("_score"), F.lag(PERIOD, 1).over(w).alias("_period"))
    return (
        moved.join(F.broadcast(periods), PERIOD)
        .where(F.col("_period") == F.col("_adjacent"))
        .select(ENTITY, PERIOD, "step", (F.col(SCORE) - F.col("_score")).alias("delta"))
    )


def delta_vectors(scores: DataFrame) -> DataFrame:
    """One row per scored entity with its changes by step; entities without any change keep an empty list."""
    deltas = score_deltas(scores)
    packed = deltas.groupBy(ENTITY).agg(
        F.collect_list("step").alias("steps"), F.collect_list("delta").alias("deltas")
    )
    entities = scores.where(F.col(SCORE).isNotNull()).select(F.upper(ENTITY).alias(ENTITY)).distinct()
    return entities.join(packed, ENTITY, "left")


def block_kernel(least: int, threshold: float, sums: bool = True, parted: tuple[np.ndarray, float] | None = None):
    """The task function: all pairs between the rows of two blocks, a tile at a time. Everything it calls is local, so it
    travels by value and the workers need only numpy and pyarrow.

    Without ``sums`` it returns no rows of kind ``node``. ``parted`` names pivots and an angle: rows then have a ``_part``,
    and parts with ``_bound`` whose angles to some pivot lie further apart than that are not multiplied.
    """
    tile_rows, batch_rows = TILE_ROWS, 100_000

    def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Centred changes and their mask, with a column for every step that some row has."""
        lengths = pc.fill_null(pc.list_value_length(rows["steps"]), 0).to_numpy()
        steps, deltas = (pc.list_flatten(rows[c]).to_numpy() for c in ("steps", "deltas"))
        present = np.zeros(1 + steps.max(initial=-1), bool)
        present[steps] = True
        at = np.repeat(np.arange(len(rows)), lengths), (np.cumsum(present) - 1)[steps]
        values, mask = np.zeros((len(rows), present.sum())), np.zeros((len(rows), present.sum()))
        values[at], mask[at] = deltas, 1.0
        # Centring does not change a correlation; it keeps the sums below small.
        mean = values.sum(axis=1, keepdims=True) / np.maximum(mask.sum(axis=1, keepdims=True), 1.0)
        return (values - mean) * mask, mask

    def side(rows: np.ndarray, values: np.ndarray, mask: np.ndarray, part: np.ndarray, bound: np.ndarray) -> dict:
        """The rows of one block in the order of their parts, rows without gaps first, and the units they are cut into."""
        whole = mask[rows].all(axis=1)
        order = np.lexsort((~whole, part[rows]))
        rows, whole = rows[order], whole[order]
        x, m = values[rows], mask[rows]
        ends = np.flatnonzero((np.diff(part[rows]) != 0) | np.diff(whole)) + 1
        cuts = [c for s, e in zip([0, *ends], [*ends, len(rows)]) for c in range(s, e, tile_rows)]
        units = [(s, e, bool(whole[s])) for s, e in zip(cuts, [*cuts[1:], len(rows)])]
        squares = x * x
        out = {"rows": rows, "x": x, "m": m, "q": squares, "sum": x.sum(axis=1), "count": m.sum(axis=1), "squares": squares.sum(axis=1), "units": units}
        out["scale"] = np.abs(x).max(axis=1, initial=0.0) ** 2 + 1e-300
        if parted and units:
            pivots = parted[0]
            angles, held = np.zeros((len(rows), len(pivots))), bound[rows]
            if held.any():
                angles[held] = np.arccos(np.clip(np.abs(x[held] @ pivots.T) / np.sqrt(out["squares"][held])[:, None], 0.0, 1.0))
            free = ~held[cuts, None]
            out["low"] = np.where(free, -np.inf, np.minimum.reduceat(angles, cuts))
            out["high"] = np.where(free, np.inf, np.maximum.reduceat(angles, cuts))
        return out

    def tile(left: dict, right: dict, a: slice, b: slice, a_whole: bool, b_whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairwise-complete Pearson and the overlap; NaN where it is undefined. What has no gaps needs no sums per pair."""
        x, mx, y, my = left["x"][a], left["m"][a], right["x"][b], right["m"][b]
        n = right["count"][None, b] if a_whole else left["count"][a, None] if b_whole else mx @ my.T
        sx = left["sum"][a, None] if b_whole else x @ my.T
        qx = left["squares"][a, None] if b_whole else left["q"][a] @ my.T
        sy = right["sum"][None, b] if a_whole else mx @ y.T
        qy = right["squares"][None, b] if a_whole else mx @ right["q"][b].T
        with np.errstate(invalid="ignore", divide="ignore"):
            vx, vy = n * qx - sx * sx, n * qy - sy * sy
            # Relative to its own scale a constant series leaves only rounding noise.
            flat_x = vx <= 1e-20 + 1e-12 * n * n * left["scale"][a, None]
            flat_y = vy <= 1e-20 + 1e-12 * n * n * right["scale"][None, b]
            r = n * (x @ y.T) - sx * sy
            r *= np.where(flat_x | (n < least), np.nan, 1.0 / np.sqrt(vx))
            r *= np.where(flat_y, np.nan, 1.0 / np.sqrt(vy))
        return np.clip(r, -1.0, 1.0, out=r), n

    def runs(units: list, met: list):
        """Neighbouring units that are met, joined up to the size of a tile."""
        held = None
        for (s, e, whole), meets in zip(units, met):
            if held and meets and held[1] == s and held[2] == whole and e - held[0] <= tile_rows:
                held = (held[0], e, whole)
                continue
            if held:
                yield held
            held = (s, e, whole) if meets else None
        if held:
            yield held

    def tiles(left: dict, right: dict):
        """What is to be multiplied, each pair of rows once; the tile on the diagonal comes whole."""
        for k, (s, e, whole) in enumerate(left["units"]):
            met = [True] * len(right["units"])
            if parted and right["units"]:
                apart = (left["low"][k] - right["high"] > parted[1]) | (right["low"] - left["high"][k] > parted[1])
                met = (~apart.any(axis=1)).tolist()
            later = 0
            if left is right:
                yield slice(s, e), slice(s, e), whole, whole, True
                later = k + 1
            for s2, e2, whole2 in runs(right["units"][later:], met[later:]):
                yield slice(s, e), slice(s2, e2), whole, whole2, False

    def kernel(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[0].as_py(), key[1].as_py()
        rows = pa.Table.from_batches(batches).sort_by(ENTITY)
        names, own = rows[ENTITY].combine_chunks(), rows["_own"].to_numpy()
        values, mask = matrix(rows)
        part = rows["_part"].to_numpy() if parted else np.zeros(len(rows), np.int32)
        bound = rows["_bound"].to_numpy() if parted else np.zeros(len(rows), bool)
        left = side(np.flatnonzero(own == i), values, mask, part, bound)
        right = left if i == j else side(np.flatnonzero(own == j), values, mask, part, bound)
        abs_sum, peers = np.zeros(len(rows)), np.zeros(len(rows), np.int64)

        def batch(kind: str, a: pa.Array, b: pa.Array, r: pa.Array, n: np.ndarray, s: pa.Array, p: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([kind]).cast(names.type).take(pa.array(np.zeros(len(a), np.int64))), a, b, r, pa.array(n), s, pa.array(p)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "correlation", "pairs", "abs_sum", "peers"])

        def pairs(found: list) -> pa.RecordBatch:
            # Rows are sorted by name, so the smaller row has the smaller name.
            first, second, r, n = (np.concatenate(c) for c in zip(*found))
            ends = names.take(pa.array(np.minimum(first, second))), names.take(pa.array(np.maximum(first, second)))
            return batch("pair", *ends, pa.array(r), n, pa.nulls(len(r), pa.float64()), np.zeros(len(r), np.int64))

        found, held = [], 0
        for a, b, a_whole, b_whole, diagonal in tiles(left, right):
            r, n = tile(left, right, a, b, a_whole, b_whole)
            if diagonal:
                np.fill_diagonal(r, np.nan)
            size = np.abs(r)
            keep = size >= threshold
            if sums:
                finite = ~np.isnan(size)
                if not finite.all():
                    size[~finite] = 0.0
                at_a, at_b = left["rows"][a], right["rows"][b]
                abs_sum[at_a] += size.sum(axis=1)
                peers[at_a] += finite.sum(axis=1)
                if not diagonal:
                    abs_sum[at_b] += size.sum(axis=0)
                    peers[at_b] += finite.sum(axis=0)
            at = np.nonzero(np.triu(keep, 1) if diagonal else keep)
            if len(at[0]):
                found.append((left["rows"][a][at[0]], right["rows"][b][at[1]], r[at], np.broadcast_to(n, r.shape)[at].astype(np.int64)))
                held += len(at[0])
            if held >= batch_rows:
                yield pairs(found)
                found, held = [], 0
        if found:
            yield pairs(found)
        if sums:
            none = pa.nulls(len(rows), names.type), pa.nulls(len(rows), pa.float64()), np.zeros(len(rows), np.int64)
            yield batch("node", names, *none, pa.array(abs_sum), peers)

    return kernel


def rows_per_block(vectors: DataFrame, count: int, block_rows: int) -> int:
    """``block_rows`` or, for many entities, as many as leave ``BLOCKS`` blocks, in so far as a block fits a task.

    A row goes to every block: with blocks of fixed size the rows moved grow with the square of the entities.
    """
    if count <= BLOCKS * int(block_rows):
        return int(block_rows)
    width = vectors.agg(F.max(F.size("steps"))).first()[0] or 0
    return max(int(block_rows), min(-(-count // BLOCKS), BLOCK_CELLS // max(1, width)))


def correlations(
    vectors: DataFrame,
    min_pairs: int = MIN_PAIRS,
    threshold: float = THRESHOLD,
    block_rows: int = BLOCK_ROWS,
    entities: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Rows of kind ``pair`` (|r| >= threshold, overlap) and ``node`` (partial sums of |r|).

    ``threshold`` 0 gives the whole matrix and has to be asked for with ``whole``, for its rows grow with the square of the entities. ``entities`` may pass a known row count; it sizes the
    blocks so that a group never holds more than about two blocks of rows. ``block_rows`` is the least size of a block (``rows_per_block``).
    """
    if threshold <= 0 and not whole:
        raise ValueError("a threshold of 0 returns every pair; pass whole=True to mean it")
    count = vectors.count() if entities is None else int(entities)
    blocks = max(1, -(-count // rows_per_block(vectors, count, block_rows)))
    least = max(2, int(min_pairs))
    own = F.pmod(F.xxhash64(ENTITY), F.lit(blocks)).cast("int")
    # Every row visits each pairing of its block once: B copies of a block, never a copy per pair.
    sent = vectors.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", ENTITY, "steps", "deltas"
    )

    return sent.groupBy("_i", "_j").applyInArrow(block_kernel(least, float(threshold)), PAIR_SCHEMA)


def pair_table(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == "pair").select("a", "b", "correlation", "pairs")


def edges(found: DataFrame, max_edges: int | None = None) -> DataFrame:
    """The edges, or the ``max_edges`` strongest by rounded |r|, ties by name (a distributed top-k).

    Degree, sign share and clusters take all of them: a limited list makes loners of most entities.
    """
    rounded = pair_table(found).withColumn("correlation", F.bround("correlation", 4))
    if max_edges is None:
        return rounded
    return rounded.orderBy(F.abs("correlation").desc(), "a", "b").limit(int(max_edges))


def strongest(edge_table: DataFrame, k: int = 8) -> DataFrame:
    """N8."""
    return edge_table.orderBy(F.abs("correlation").desc(), "a", "b").limit(k)


def components(edge_table: DataFrame) -> DataFrame:
    """Smallest member of every connected component, for the nodes that have an edge.

    Minimum labels spread along the edges and then jump to the label of their label, so long chains
    shorten by half per round. Each round reads and writes pinned tables; the driver sees one number.
    """
    both = pin(
        edge_table.select("a", "b").unionByName(edge_table.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    held = labels = pin(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("offer"))
        spread = labels.join(offered, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_further"))
        moved = pin(
            spread.join(jump, F.col("label") == F.col("_at"), "left").select(
                "node", "old", F.least("label", F.coalesce("_further", "label")).alias("label")
            )
        )
        changed = moved.where(F.col("old") != F.col("label")).count()
        unpin(held)
        held, labels = moved, moved.select("node", "label")
        if changed == 0:
            unpin(both)
            return labels


def clusters(nodes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Cluster number of every entity, clusters ordered by their smallest member."""
    labels = components(edge_table)
    placed = nodes.select(ENTITY).join(labels, F.col(ENTITY) == F.col("node"), "left").select(
        ENTITY, F.coalesce("label", ENTITY).alias("label")
    )
    numbers = global_index(placed.select("label").distinct(), ["label"], "cluster")
    return placed.join(numbers, "label").select(ENTITY, "cluster", "label")


def nodes(found: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Mean |r| with all entities a finite r exists for, and the degree among the edges."""
    sums = found.where(F.col("kind") == "node").groupBy(F.col("a").alias(ENTITY)).agg(
        F.sum("abs_sum").alias("_s"), F.sum("peers").alias("_n")
    )
    ends = edge_table.select(F.explode(F.array("a", "b")).alias(ENTITY))
    degree = ends.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("degree"))
    return sums.join(degree, ENTITY, "left").select(
        ENTITY,
        F.bround(F.try_divide(F.col("_s"), F.col("_n")), 4).alias("integration"),
        F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
    )


def summary(found: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row. Every pair counts twice in the node sums, once from either end."""
    node = F.col("kind") == "node"
    per_entity = found.where(node).groupBy("a").agg(F.sum("abs_sum").alias("_s"), F.sum("peers").alias("_n"))
    totals = per_entity.agg(
        F.count(F.lit(1)).alias("entities"),
        F.bround(F.try_divide(F.sum("_s"), F.sum("_n")), 4).alias("mean_abs_correlation"),
    )
    kept = edge_table.agg(
        F.count(F.lit(1)).alias("edges"),
        F.bround(F.avg(F.when(F.col("correlation") >= 0, 1.0).otherwise(0.0)), 4).alias("positive_edge_share"),
    )
    # Two aggregates of one row each.
    joined = totals.crossJoin(kept)
    n = F.col("entities")
    return joined.select(
        "entities", F.floor(n * (n - 1) / 2).alias("pairs_considered"), "mean_abs_correlation", "edges", "positive_edge_share"
    )


def network(
    scores: DataFrame, min_pairs: int = MIN_PAIRS, threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(correlation rows, edges, nodes with cluster); the quadratic step runs once and is pinned."""
    vectors = pin(delta_vectors(scores))
    found = pin(correlations(vectors, min_pairs, threshold))
    kept = pin(edges(found))
    members = nodes(found, kept).join(clusters(vectors, kept), ENTITY)
    return found, kept, members
