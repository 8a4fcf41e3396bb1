"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Rows and queries are dealt into blocks by a hash of the row, and every block of queries meets every block of rows in a task of its own. A
block's index holds the postings (row, dimension, impact) in segments of descending impact: each segment takes the impacts down to half of
the largest left. All segments are worked off in that order, for a block of queries at a time, adding to the partial scores. After each one the
part still unread is bounded by the product of the query's length and that of the row's unread impacts. A row whose upper bound is below the
k-th best lower bound cannot be a member; the index is left when few rows remain possible, or is read to its end. Possible members are then
scored exactly in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import stage_path

QUERY_BLOCK = 1024
ROW_BLOCK = 8192
LEAST_BLOCKS = 16  # as many blocks of rows at least, for the sake of parallel work
FEW = 4  # the index is left when no more than so many times k rows are possible, on average
EXACT_32, EXACT_64 = 1 << 24, 1 << 53


def segments(v: np.ndarray) -> list[tuple[float, float]]:
    """(above, up to) bounds of the impact segments, descending: two halvings of the largest impact, and the rest in a last one."""
    top = float(np.abs(v).max(initial=0))
    bounds = [top / 2 ** k for k in range(3)]
    return list(zip([*bounds[1:], -1.0], bounds))


def _number_type(q: np.ndarray, v: np.ndarray) -> type:
    """Floating point where no sum can leave its whole numbers, else 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < EXACT_32 else np.float64 if most < EXACT_64 else np.int64


def best_in_block(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, v_rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): for each query, its k best rows of the block but its own, ties to the smaller id (`ids` are ranks of ids)."""
    nq, nv = len(q), len(v)
    kind = _number_type(q, v)
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    _, own_q, own_v = np.intersect1d(q_rows, v_rows, return_indices=True)
    length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    energy = (v.astype(float) ** 2).sum()
    impact, numbers = np.abs(v), q.astype(kind)
    partial = np.zeros((nq, nv), kind)
    for low, high in segments(v):
        partial += numbers @ np.where((impact > low) & (impact <= high), v, 0).astype(kind).T
        unread = np.where(impact <= low, v, 0).astype(float)
        over = low <= 0
        if not over and (kind is np.int64 or nv <= k or (unread ** 2).sum() > energy / 4):
            continue  # too much is unread for a proof
        # Once all is read, the bounds are the scores.
        slack = np.zeros((1, nv), kind) if over else (length[:, None] * (np.sqrt((unread ** 2).sum(axis=1)) * (1 + 1e-5) + 1e-3)[None, :]).astype(kind)
        partial[own_q, own_v] = least
        if nv <= k:
            possible = np.ones((nq, nv), bool)
        else:
            best = np.argpartition(partial, nv - k, axis=1)[:, nv - k:]
            sure = np.take_along_axis(partial, best, axis=1) - np.take_along_axis(np.broadcast_to(slack, partial.shape), best, axis=1)
            possible = partial + slack >= sure.min(axis=1)[:, None]
        possible[own_q, own_v] = False
        if over or possible.sum() <= FEW * k * nq:
            break
        partial[own_q, own_v] = 0
    at_q, at_v = np.nonzero(possible)
    exact = np.einsum("ij,ij->i", q[at_q], v[at_v])
    order = np.lexsort((v_rows[at_v], ids[at_v], -exact, at_q))
    at_q, at_v, exact = at_q[order], at_v[order], exact[order]
    keep = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, side="left") < k
    return at_q[keep], at_v[keep], exact[keep]


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, id, dims, v): v = floor(scale * x) of each component as a double. Vectors null or with null or non-finite components are left out."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = df.where(F.col(vector_col).isNotNull() & finite)
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.size(vector_col).alias("dims"), v.alias("v"))


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_row, query_id, rank, row, id, score) of the k rows of largest inner product with each query row, itself left out.

    `is_query` is a condition on the column `id`. Vectors only meet those of their own number of components. Rows with the same id are rows of
    their own; ties go to the smaller id (null last), then to the earlier row. Fewer than k others: all of them. No usable vectors: no rows.
    """
    rows, path = stage_path(quantised(df, id_col, vector_col, scale), "vectors")
    # The query side is a reading of its own: two sides of one reading share column ids, which a cogroup does not tell apart.
    queries = df.sparkSession.read.schema(rows.schema).parquet(path).where(is_query)
    n, n_queries = rows.count(), queries.count()
    row_blocks = max(-(-n // ROW_BLOCK), min(LEAST_BLOCKS, -(-n // 64)), 1)
    query_blocks = max(-(-n_queries // QUERY_BLOCK), 1)

    def block(count: int, salt: int):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")

    def copies(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select("dims", block(query_blocks, 1).alias("qb"), copies(row_blocks).alias("rb"), "row", "id", "v")
    right = rows.select("dims", copies(query_blocks).alias("qb"), block(row_blocks, 2).alias("rb"), "row", "id", "v")
    kind = dict(rows.dtypes)["id"]

    def matrix(t: pa.Table, dims: int) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dims)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        names = ["query_row", "query_id", "row", "id", "score"]
        rank = np.zeros(b.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            order = pc.sort_indices(b.column("id"), null_placement="at_end").to_numpy()
            values = b.column("id").take(pa.array(order))
            changed = [0, *[int(x != y) for x, y in zip(values.to_pylist(), values.slice(1).to_pylist())]]
            rank[order] = np.cumsum(changed)
            q_rows, v_rows = a.column("row").to_numpy(), b.column("row").to_numpy()
            at_q, at_v, score = best_in_block(matrix(a, dims), q_rows, matrix(b, dims), v_rows, rank, k)
        else:
            at_q = at_v = score = np.zeros(0, np.int64)
        i, j = pa.array(at_q, pa.int64()), pa.array(at_v, pa.int64())
        return pa.Table.from_arrays([a.column("row").take(i), a.column("id").take(i), b.column("row").take(j), b.column("id").take(j), pa.array(score)], names=names)

    found = left.groupBy("dims", "qb", "rb").cogroup(right.groupBy("dims", "qb", "rb")).applyInArrow(
        run, f"query_row long, query_id {kind}, row long, id {kind}, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "id", "score")


#: The same search for DuckDB (unique ids).
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
