"""Exact top-k by inner product as a Voronoi kNN join.

Vectors become integers, floor(1024 x). A further coordinate, the root of the greatest squared norm less a vector's own,
gives all vectors one length, so the greatest inner product is the least distance. Queries and data are grouped by the
nearest of a few pivots. Summaries (per data group: size and the least distances to its pivot; per query group: radius) bound
the k-th distance of each query group; a vector is copied to the query groups that it can still concern. Blocks of both
sides are solved with exact integer products, and the best k of the blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscore.llm import common as c
from panelscore.session import pin

PIVOTS, BLOCK = 16, 2048
#: Parts of a group's blocks; queries are copied to each, so that one group's work is not one task's.
PARTS = 8
#: Relative slack of the bounds, for rounding.
SLACK = 1e-9


def integer_vectors(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, dim, v): rows whose id is not null and whose vector has only finite components."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(finite).select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * 1024.0).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (lift * lift)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots[:, :-1].T + lift[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(d, 0))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point where every partial sum is exact, else integers of any size, held to 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(e) for e in r] for r in q], object) @ np.array([[int(e) for e in r] for r in x], object).T
    return np.clip(big, 1 - 2**63, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each row, positions of the k greatest scores, the smaller id first among equals, without the row's own id."""
    for r in range(len(scores)):
        use = np.flatnonzero(ids != own[r])
        s = scores[r, use]
        if len(s) > k:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            use = use[s >= bar]
        order = np.lexsort((ids[use], -scores[r, use]))[:k]
        yield use[order]


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with the rows of ``table`` of another id.

    Ties go to the smaller id. Rows without id, and vectors that are null or hold a null or a non-finite component, take no
    part. Vectors are compared with those of equal dimension. Rows that repeat an id count once, with
    the least of their vectors. Empty vectors score 0. Products beyond 64 bits are held at the limits.
    Other columns are not read; without rows on either side there is no result.
    """
    spark = table.sparkSession
    data, asked = (
        pin(integer_vectors(t, vector).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))) for t in (table, queries)
    )
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]
    parts = [_one_dimension(data.where(F.col("dim") == d), asked.where(F.col("dim") == d), d, k, pivots, block) for d in sorted(dims)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(data: DataFrame, asked: DataFrame, dim: int, k: int, pivots: int, block: int) -> DataFrame:
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    top = data.agg(F.coalesce(F.max(norm), F.lit(0.0))).first()[0]
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    points = np.array([r.v for r in chosen], float).reshape(len(chosen), dim)
    points = np.concatenate([points, _lifted(points, top)[:, None]], 1)
    near = k + 1

    def summary(batches):
        """Data groups: the ``near`` least distances to the pivot, one list for each task and group."""
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            x = _matrix(b["v"], dim)
            d = _distances(x, _lifted(x, top), points)
            cell = d.argmin(1)
            for g in np.unique(cell):
                held.setdefault(int(g), []).append(np.sort(d[cell == g, g])[:near])
        rows = [(g, np.sort(np.concatenate(m))[:near]) for g, m in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array([m.tolist() for _, m in rows], pa.list_(pa.float64()))], names=["cell", "least"])

    def group(batches):
        """Queries with their group and the distance to its pivot."""
        for b in batches:
            x = _matrix(b["v"], dim)
            d = _distances(x, np.zeros(len(x)), points) if len(points) else np.zeros((len(x), 1))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(d.argmin(1)), pa.array(d.min(1))], names=["vec_id", "v", "cell", "away"])

    grouped = pin(asked.select("vec_id", "v").mapInArrow(group, "vec_id long, v array<double>, cell long, away double"))
    radius = {r["cell"]: r["r"] for r in grouped.groupBy("cell").agg(F.max("away").alias("r")).collect()}
    least = data.select("vec_id", "v").mapInArrow(summary, "cell long, least array<double>").groupBy("cell").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, near).alias("least")
    ) if len(points) else None
    bound: dict[int, float] = {}
    summaries = least.collect() if least is not None else []
    for g, r in radius.items():
        far = sorted(np.linalg.norm(points[g] - points[s["cell"]]) + x for s in summaries for x in s["least"])
        # One of the counted vectors may be the query's own.
        bound[g] = (far[k] if len(far) > k else float("inf")) + r

    def replicate(batches):
        """Blocks of the vectors that some query group may need: ids and integers as bytes."""
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(g):
            ids, x = (np.concatenate(m) for m in zip(*waiting.pop(g), strict=True))
            for low in range(0, len(ids), block):
                yield g, ids[low : low + block].astype("<i8").tobytes(), x[low : low + block].astype("<f8").tobytes()

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["cell", "ids", "x"])

        for b in batches:
            x, ids = _matrix(b["v"], dim), b["vec_id"].to_numpy()
            d = _distances(x, _lifted(x, top), points)
            for g, limit in bound.items():
                use = d[:, g] - radius[g] <= limit * (1 + SLACK) + SLACK * np.sqrt(top) + 1e-6
                if use.any():
                    waiting.setdefault(g, []).append((ids[use], x[use]))
                    if sum(len(m[0]) for m in waiting[g]) >= block and (rows := list(flush(g))):
                        yield out(rows)
        rows = [r for g in list(waiting) for r in flush(g)]
        if rows:
            yield out(rows)

    blocks = data.select("vec_id", "v").mapInArrow(replicate, "cell long, ids binary, x binary").withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(PARTS)))
    own = Window.partitionBy("cell", "part").orderBy("vec_id")
    asked_blocks = (
        grouped.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, c.parallelism(data.sparkSession) // 8))))
        .withColumn("piece", F.floor((F.row_number().over(own) - 1) / 256))
        .groupBy("cell", "part", "piece")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
        .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("share"), "queries")
    )

    def solve(batches):
        for b in batches:
            out: list[tuple] = []
            for queries, ids, x in zip(b["queries"], b["ids"].to_pylist(), b["x"].to_pylist(), strict=True):
                asked_here = queries.values
                qid = asked_here.field("vec_id").to_numpy()
                q = _matrix(asked_here.field("v"), dim)
                vid = np.frombuffer(ids, "<i8")
                scores = exact_scores(q, np.frombuffer(x, "<f8").reshape(len(vid), dim))
                for r, at in enumerate(best(scores, vid, qid, k)):
                    out += zip([int(qid[r])] * len(at), vid[at].tolist(), scores[r, at].tolist(), strict=True)
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["query_id", "vec_id", "score"])

    return blocks.join(asked_blocks, ["cell", "share"]).select("queries", "ids", "x").mapInArrow(solve, "query_id long, vec_id long, score long")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
