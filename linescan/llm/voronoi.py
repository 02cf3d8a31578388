"""Exact top-k inner products by a Voronoi join.

Pivots are rows of the data, more of them where there is more data. Every vector
goes to the cell of its nearest pivot, and the data is laid down by cell.
Summaries of both sides bound what they can be worth to each other: of a data
cell, its radius and the distances of its nearest rows, of a query cell, its
radius and a score that each of its queries' k-th best reaches at least. Pairs of cells whose
bound is too low never meet; of the others, a vector is sent only to the query
cells that it may serve by its own bound. Groups of query cells meet their data
in small blocks, each solved by a matrix product, and the best of the blocks are
merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import runs
from .tables import keep, table

#: There are about as many pivots as the square root of the rows, so many at least and at most. They are a sample; every row is searched.
LEAST_PIVOTS, MOST_PIVOTS = 32, 2048
BLOCK_QUERIES, BLOCK_ROWS = 512, 4096
#: A sum of products below this is exact in doubles, whatever the order; below the other, in longs.
EXACT, LONGS = 2.0**50, 2.0**62
TOP = 2**63 - 2


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column of longs to a matrix; shorter rows are filled up with 0. Doubles where they are exact, else longs."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(flat) or max(abs(int(flat.min())), abs(int(flat.max()))) <= 2**53:
        flat = flat.astype(np.float64)
    if (ends == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), flat.dtype)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b; beyond the longs they are held at their ends."""
    bound = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < LONGS:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)
    return np.clip(whole, -TOP, TOP).astype(np.int64)


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest of each row, ties to the lower column."""
    columns = found.shape[1]
    if np.abs(found).max(initial=0) < 2**62 // (columns + 1):
        key = found * columns - np.arange(columns)
        if columns > k:
            top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            top = np.tile(np.arange(columns), (len(found), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    return np.argsort(-found, axis=1, kind="stable")[:, :k]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _assign(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``vectors`` plus cell, the nearest pivot, and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), width).astype(np.float64)
            far = (pivots**2).sum(1) - 2 * (x @ pivots.T)
            cell = far.argmin(1)
            distance = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], [*batch.schema.names, "cell", "distance"])

    return vectors.mapInArrow(assign, "rid long, vec_id long, asks boolean, x array<long>, cell int, distance double")


def least_scores(x: np.ndarray, pivots: np.ndarray, nearest: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of each query reaches at least, from the data's summaries.

    ``nearest`` are the distances of the k + 1 rows nearest to each pivot (infinite
    where there are fewer). Such a row scores at least q p - |q| d. One of them may be
    the query's own row, so the k + 1st of these scores counts.
    """
    low = np.full(len(x), -np.inf)
    if nearest.size <= k:
        return low
    for at in range(0, len(x), 256):
        q = x[at : at + 256].astype(np.float64)
        with np.errstate(invalid="ignore"):
            bounds = ((q @ pivots.T)[:, :, None] - norms(q)[:, None, None] * nearest).reshape(len(q), -1)
        bounds = np.nan_to_num(bounds, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        low[at : at + 256] = np.partition(bounds, -k - 1, axis=1)[:, -k - 1]
    return np.where(np.isinf(low), low, np.minimum(low - 1e-9 * np.abs(low) - 1e-6, TOP * (1 - 1e-9)))


def _asked(queries: DataFrame, pivots: np.ndarray, nearest: np.ndarray, width: int, k: int) -> DataFrame:
    """cell, distance and least score of each query."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = least_scores(matrix(batch.column("x"), width), pivots, nearest, k)
                yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("distance"), pa.array(low)], ["cell", "distance", "least"])

    return queries.select("cell", "distance", "x").mapInArrow(ask, "cell int, distance double, least double")


def may_meet(pivots: np.ndarray, names: np.ndarray, radius: np.ndarray, least: np.ndarray, data_radius: np.ndarray) -> np.ndarray:
    """For each data cell and each of the query cells ``names``: can any score between them count?

    With |q - p| <= r and |x - s| <= R, q x <= p s + r |s| + R |p| + r R.
    """
    own = pivots[names]
    most = pivots @ own.T + radius * norms(pivots)[:, None] + data_radius[:, None] * (norms(own) + radius)
    return most * (1 + 1e-9) + 1e-6 * (1 + np.abs(most)) >= least


def _groups_of(vectors: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[float, float]], data_radius: np.ndarray, width: int) -> DataFrame:
    """rid, vec_id, x, cells: the query cells of which some query may have the vector among its best.

    For a query q of a cell with pivot p and radius r: q x <= p x + r |x|.
    """
    names = np.array(sorted(cells))
    radius, least = (np.array([cells[c][i] for c in names]) for i in (0, 1))
    meets = may_meet(pivots, names, radius, least, data_radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            # Rows come by cell, so there are few runs.
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                if a == b or not meets[cell[a]].any():
                    continue
                part = batch.slice(a, b - a)
                some = np.flatnonzero(meets[cell[a]])
                x = matrix(part.column("x"), width).astype(np.float64)
                most = x @ pivots[names[some]].T + radius[some] * norms(x)[:, None]
                needed = most * (1 + 1e-9) + 1e-6 * (1 + np.abs(most)) >= least[some]
                ends = np.concatenate(([0], np.cumsum(needed.sum(1)))).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(names[some][np.nonzero(needed)[1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("vec_id"), part.column("x"), groups], ["rid", "vec_id", "x", "cells"])

    return vectors.select("rid", "vec_id", "x", "cell").mapInArrow(send, "rid long, vec_id long, x array<long>, cells array<int>")


def far_apart(points: np.ndarray, n: int) -> list[int]:
    """n of the points, each as far as can be from those before it."""
    taken, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(n, len(points)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[taken[-1]]) ** 2).sum(1))
    return taken


def chained(points: np.ndarray) -> list[int]:
    """The points in an order in which each is followed by the nearest one left."""
    left, order = list(range(1, len(points))), [0]
    while left:
        far = ((points[left] - points[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(far.argmin())))
    return order


def grouped_cells(queries: list[tuple[int, int]], block: int) -> dict[int, int]:
    """Cell to group: cells, in the order given with their number of queries, are put together
    up to ``block`` queries; a larger one is a group by itself."""
    out, group, filled = {}, 0, 0
    for cell, n in queries:
        if filled and filled + n > block:
            group, filled = group + 1, 0
        out[cell] = group
        filled += n
    return out


def top_k_join(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all other rows.

    ``vectors`` has vec_id and x, an array of integers; ``is_query`` marks the
    queries. Every row is a candidate for every query but itself: rows that
    repeat a vec_id, or a whole row, are rows of their own, and each query row has
    its own k ranks. Ties go to the smaller vec_id. Rows with a null vec_id, a null
    x or a null in x take no part. Vectors of different lengths are compared as if
    filled up with zeros. A query with fewer than k others gets all of them; no
    rows or no queries give none. Scores beyond the range of longs are held at its
    ends. ``pivots`` bounds the sample of rows that pivots are. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    valid = vectors.where("vec_id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    result = "query_id long, rank int, vec_id long, score long"
    rows = keep(valid.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), "x"), "vectors")
    n, width, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.count_if("asks")).first()
    if n < 2 or not asking:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    pivots = pivots or int(np.clip(np.sqrt(n), LEAST_PIVOTS, MOST_PIVOTS))
    # Of the distinct vectors, four times as many of least hash; a share of the rows holds enough of them, unless most are copies.
    code = F.pmod(F.xxhash64("x"), F.lit(1 << 30))
    few = rows.select("x").where(code <= int(min(1.0, 8 * pivots / n) * (1 << 30))).groupBy("x").agg(F.first(code).alias("code"))
    chosen = few.orderBy("code", "x").limit(4 * pivots).collect() or rows.select("x").limit(1).collect()
    points = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        points[i, : len(r.x)] = r.x
    points = points[far_apart(points, pivots)]
    # By cell, so that what follows reads a cell's rows together; a cell is dealt out, as one may hold most of the rows.
    salt = F.pmod(F.xxhash64("rid"), F.lit(max(16, n // 1_000_000)))
    assigned = keep(_assign(rows, points, width).repartition("cell", salt).sortWithinPartitions("cell"), "cells")
    # k + 1 distances of each cell: as many numbers as pivots, times that.
    near = Window.partitionBy("cell").orderBy("distance")
    closest = assigned.select("cell", "distance").withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    nearest = np.full((len(points), k + 1), np.inf)
    for r in closest.collect():
        nearest[r.cell, r.place - 1] = r.distance
    data_radius = np.zeros(len(points))
    for r in assigned.groupBy("cell").agg(F.max("distance").alias("radius")).collect():
        data_radius[r.cell] = r.radius
    queries = assigned.where("asks")
    asked = _asked(queries, points, nearest, width, k)
    summary = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("least").alias("least")).collect()
    sizes = {s.cell: s.n for s in summary}
    names = sorted(sizes)
    groups = grouped_cells([(names[i], sizes[names[i]]) for i in chained(points[names])], BLOCK_QUERIES)
    group_of = F.create_map(*(F.lit(v) for c, g in groups.items() for v in (c, g)))

    sent = _groups_of(assigned, points, {s.cell: (s.radius, s.least) for s in summary}, data_radius, width)
    sent = keep(sent.select("rid", "vec_id", "x", F.array_distinct(F.transform("cells", lambda c: group_of[c])).alias("groups")), "sent")
    loads = {r["group"]: r["n"] for r in sent.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()}
    n_queries: dict[int, int] = {}
    for c, g in groups.items():
        n_queries[g] = n_queries.get(g, 0) + sizes[c]
    data_blocks = {g: -(-loads.get(g, 1) // BLOCK_ROWS) for g in n_queries}
    query_blocks = {g: -(-n // BLOCK_QUERIES) for g, n in n_queries.items()}
    as_map = lambda d: F.create_map(*(F.lit(v) for kv in d.items() for v in kv))

    def dealt(df: DataFrame, own: dict, other: dict, names: tuple[str, str], is_q: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rid", F.lit(3)), as_map(own)[F.col("g")]).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), as_map(other)[F.col("g")] - 1))
        df = df.select("rid", "vec_id", "x", "g", block.alias(names[0])).withColumn(names[1], all_others)
        return df.select("rid", "vec_id", "x", "g", "qb", "db", F.lit(is_q).alias("q"))

    left = dealt(queries.withColumn("g", group_of[F.col("cell")]), query_blocks, data_blocks, ("qb", "db"), True)
    right = dealt(sent.withColumn("g", F.explode("groups")), data_blocks, query_blocks, ("db", "qb"), False)
    units = left.union(right).repartition("g", "qb", "db").sortWithinPartitions("g", "qb", "db")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, ["g", "qb", "db"]):
            unit = unit.sort_by([("vec_id", "ascending"), ("rid", "ascending")]).combine_chunks()
            mark = unit.column("q").to_numpy()
            if mark.all() or not mark.any():
                continue
            ids, rids = unit.column("vec_id").to_numpy(), unit.column("rid").to_numpy()
            x = matrix(unit.column("x").chunk(0), width)
            asked, there = np.flatnonzero(mark), np.flatnonzero(~mark)
            found = scores(x[asked], x[there])
            # Its own row, where it is in this block, comes behind all others and is dropped.
            own = rids[asked][:, None] == rids[there]
            found[own] = min(int(found.min()) - 1, 0)
            top = best(found, min(k + 1, len(there)))
            good = ~np.take_along_axis(own, top, 1)
            good &= np.cumsum(good, 1) <= k
            row, place = np.nonzero(good)
            column = top[row, place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids[asked][row]), pa.array(ids[asked][row]), pa.array(ids[there][column]), pa.array(found[row, column])], ["asked", "query_id", "vec_id", "score"]
            )

    partial = units.mapInArrow(solve, "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best scores of every fiftieth embedding against all others."""
    rows = table(spark, sf_dir, "embeddings").where(
        "embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))"
    )
    scaled = rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("x"))
    return top_k_join(scaled, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.row_no, q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v d ON q.row_no <> d.row_no WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) <= 5
"""
