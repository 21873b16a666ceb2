"""Exact top-k by inner product with a pivot table (LAESA).

All rows keep their distances to some tens of pivots, and live in cells by their nearest pivot, cut into
blocks of bounded size. For a query the table gives a lower bound of its distance to every row, hence an upper
bound of the inner product: 2 q.x = |q|^2 + |x|^2 - d(q, x)^2. A query first meets the block of its own
cell, which gives it a k-th best score to beat; then it goes to exactly those blocks whose
bound can reach that. Inside a block rows are scored in the order of their bounds until the next bound is below the
k-th best score. Nothing is skipped on a guess, so the result is exact.

Scores are integers; vectors are scaled and floored first. Bounds are widened by a relative error, and ties with
the k-th score are always scored.

Defined cases: vectors that are null or hold null or non-finite components take no part; repeated ids
are rows of their own, and a query does not see rows of its id; ties go to the smaller id; with
fewer than k candidates all come; vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckspark.llm.common import cut

PIVOTS = 32
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Rows that the pivots are chosen from, by the smallest hashes. They only steer the work.
PIVOT_SAMPLE = 2000


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, dims): components floor(scale * x), without rows that have none or unusable ones."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), whole.alias("v"), F.size(v).alias("dims")
    ).filter("id is not null")


def choose_pivots(rows: DataFrame, number: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots of each vector length from a bounded sample, each far from those before."""
    picked = rows.orderBy(F.xxhash64("v"), "id").select("v").limit(PIVOT_SAMPLE).collect()
    by_size: dict[int, list] = {}
    for row in picked:
        by_size.setdefault(len(row[0]), []).append(row[0])
    out = {}
    for size, vectors in by_size.items():
        x = np.unique(np.array(vectors, float).reshape(len(vectors), size), axis=0)
        chosen = [0]
        near = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(number, len(x)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[size] = x[chosen]
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, squares))


def with_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds each row's distances to the pivots, its norm and its cell; the pivots are of bounded number."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                own = sent.value.get(int(dims), np.zeros((1, int(dims))))
                x = _matrix(part["v"]) if dims else np.zeros((len(part), 0))
                table = _distances(x, own)
                yield part.assign(
                    table=list(table), norm=np.sqrt((x * x).sum(1)), cell=table.argmin(1).astype(np.int32)
                )

    return rows.mapInPandas(measure, "id long, v array<long>, dims int, table array<double>, norm double, cell int")


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        merged = self.rows[query] + list(zip((-scores).tolist(), ids.tolist(), strict=True))
        self.rows[query] = sorted(merged)[: self.k]

    def worst(self, query: int) -> float:
        return -self.rows[query][-1][0] if len(self.rows[query]) >= self.k else -np.inf


def _search(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows of a block for each query, in the order of the bounds."""
    x, tx, nx, ids = _matrix(data["v"]), _matrix(data["table"]), data["norm"].to_numpy(), data["id"].to_numpy()
    q, tq, nq, own = _matrix(queries["v"]), _matrix(queries["table"]), queries["norm"].to_numpy(), queries["id"].to_numpy()
    floor = queries["floor"].to_numpy(float)
    best = Best(len(q), k)
    for i in range(len(q)):
        near = np.abs(tx - tq[i]).max(1)
        bound = (nx * nx + nq[i] * nq[i] - near * near) / 2
        bound += 1e-9 * (np.abs(bound) + nx * nx + nq[i] * nq[i] + 1)
        alive = np.flatnonzero((bound >= floor[i]) & (ids != own[i]))
        # Exact stopping: blocks of candidates in bound order, until the next bound cannot reach the k-th best.
        step = 128
        while len(alive):
            if len(alive) > step:
                part = np.argpartition(-bound[alive], step - 1)
                now, alive = alive[part[:step]], alive[part[step:]]
            else:
                now, alive = alive, alive[:0]
            best.add(i, np.rint(x[now] @ q[i]).astype(np.int64), ids[now])
            least = max(floor[i], best.worst(i))
            alive = alive[bound[alive] >= least]
            step *= 2
    rows = [(int(own[i]), int(vec), -s) for i, found in enumerate(best.rows) for s, vec in found]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def _meet(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Searches each (cell, block) of ``data`` for the queries sent to it, in chunks of bounded size."""

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        return _search(left, right, k)

    on = ["dims", "cell", "block", "chunk"]
    data = data.toDF(*data.columns)  # both sides may stem from one frame
    return queries.groupBy(*on).cogroup(data.groupBy(*on)).applyInPandas(search, FOUND)


def exact_top_k(
    rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries among ``rows``; ``is_query`` is about the column id."""
    spark = rows.sparkSession
    whole = cut(integer_vectors(rows, key, vector, scale))
    data = cut(with_table(whole, choose_pivots(whole)).withColumn("_n", F.monotonically_increasing_id()))
    # Blocks of bounded size: a cell with many rows, or one vector that repeats, has many.
    sizes = cut(data.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
    blocked = cut(
        data.join(F.broadcast(sizes), ["dims", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64("_n"), F.col("blocks")).cast("int")
        ).drop("_n", "blocks")
    )
    chosen = blocked.filter(is_query).withColumn("floor", F.lit(float("-inf")))
    total = chosen.count()
    chunks = max(1, -(-total // QUERY_ROWS))
    # First: each query in the block where it lives. Chunks of queries of one block stay below its size.
    home = _meet(
        chosen.withColumn("chunk", F.lit(0)), blocked.withColumn("chunk", F.lit(0)), k
    )
    home = cut(home)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = (
        home.withColumn("_rank", F.row_number().over(by_score))
        .filter(F.col("_rank") == k)
        .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("reached"))
    )
    # Then: the blocks whose bound reaches that score. A block is bounded by its rows' distances to each pivot.
    spans = blocked.groupBy("dims", "cell", "block").agg(
        F.max("norm").alias("most"),
        *[F.min(F.get("table", F.lit(p))).alias(f"lo{p}") for p in range(PIVOTS)],
        *[F.max(F.get("table", F.lit(p))).alias(f"hi{p}") for p in range(PIVOTS)],
    )
    summary = spans.select(
        "dims",
        "cell",
        "block",
        "most",
        F.array_compact(F.array(*[F.col(f"lo{p}") for p in range(PIVOTS)])).alias("lo"),
        F.array_compact(F.array(*[F.col(f"hi{p}") for p in range(PIVOTS)])).alias("hi"),
    )
    targets = _targets(chosen.drop("floor").join(floors, "id", "left"), cut(summary), spark)
    sent = targets.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    copies = blocked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    rest = _meet(sent, copies, k)
    ranked = home.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _targets(queries: DataFrame, summary: DataFrame, spark) -> DataFrame:
    """The queries once for each block that can still improve them: one row per BLOCK_ROWS data rows is looked at.

    The summary goes around in groups of blocks, so that a task holds a bounded part of it.
    """
    groups = max(1, -(-summary.count() // 4096))
    parts = summary.withColumn("_group", F.pmod(F.xxhash64("cell", "block"), F.lit(groups)).cast("int"))
    asked = queries.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "_lane", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    )
    held = parts.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def choose(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, block_rows in right.groupby("dims"):
            mine = left[left["dims"] == dims]
            if not len(mine):
                continue
            t, norm = _matrix(mine["table"]), mine["norm"].to_numpy()
            floor = mine["reached"].fillna(-np.inf).to_numpy(float)
            for row in block_rows.itertuples(index=False):
                lo, hi = np.asarray(row.lo), np.asarray(row.hi)
                near = np.maximum(0, np.maximum(lo - t, t - hi)).max(1)
                most = row.most
                # q.x is at most |q||x|, and at most (|q|^2 + |x|^2 - near^2) / 2.
                bound = np.minimum(norm * most, (norm * norm + most * most - near * near) / 2)
                bound += 1e-9 * (np.abs(bound) + norm * norm + most * most + 1)
                home = (mine["cell"].to_numpy() == row.cell) & (mine["block"].to_numpy() == row.block)
                hit = (bound >= floor) & ~home
                if hit.any():
                    part = mine[hit][["id", "v", "dims", "table", "norm"]]
                    out.append(part.assign(floor=floor[hit], cell=row.cell, block=row.block))
        columns = ["id", "v", "dims", "table", "norm", "floor", "cell", "block"]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    kind = "id long, v array<long>, dims int, table array<double>, norm double, floor double, cell int, block int"
    on = ["_group", "_lane"]
    held = held.toDF(*held.columns)
    return asked.groupBy(*on).cogroup(held.groupBy(*on)).applyInPandas(choose, kind)
