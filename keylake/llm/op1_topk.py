"""Exact top-k search by inner product: distributed histogram selection.

Query vectors are a stated set that is scored against all rows in blocks: rows are dealt to row groups, queries
to query groups, and each (row group, query group) cell is one matrix product of bounded size. No pass sends on scores:
a pass sends, per cell and query, a histogram of the scores within the query's current window, cut below the cell's own
k-th value, which cannot exceed the global one. Adding the histograms up locates the bin of the global k-th score; the
next pass divides that bin, until a bin is one integer wide. The last pass keeps scores above the k-th, and of those
equal to it the smallest ids.

Defined cases: a null vector, or one with a null, NaN or infinite component, takes no part, nor does a null id;
vectors of other lengths than the query's are no candidates; candidates of a query are all rows with another id, repeated
rows each; a query whose id several rows have asks with the least of their vectors; a query with fewer than k candidates
gets all; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keylake.llm.common import load, materialize, parallelism

#: Bins of one histogram; the most numbers of a cell's rows and of its queries (the larger, the less is sent a product); rows
#: that make a group of their own worth while.
BINS, ROW_NUMBERS, QUERY_NUMBERS, LEAST_ROWS = 4096, 1 << 22, 1 << 20, 512
#: Scores that a task holds at once.
BLOCK_SCORES = 1 << 21
K, QUERY_EVERY, SCALE = 5, 50, 256
CELL = ["d", "g", "h"]


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x) with x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~bad


def _matrix(table: pa.Table, name: str, d: int) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy()
    return flat.reshape(len(table), d).astype(np.float64)


def _scores(queries: pa.Table, rows: pa.Table, d: int):
    """For blocks of queries: their positions, and the scores with the query's own row out of the way."""
    q, v = _matrix(queries, "v", d), _matrix(rows, "v", d)
    exact = d * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < 2**53
    q, v = (q, v) if exact else (q.astype(np.int64), v.astype(np.int64))
    q_id, v_id = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
    step = max(1, BLOCK_SCORES // max(len(v), 1))
    for at in range(0, len(q), step):
        score = (q[at : at + step] @ v.T).astype(np.int64)
        yield at, score, q_id[at : at + step, None] != v_id[None, :]


def _histograms():
    def cell(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(queries) and len(rows):
            ids, lo, span, width, need = (queries[c].to_numpy() for c in ("query_id", "lo", "span", "width", "need"))
            for at, score, other in _scores(queries, rows, key[0].as_py()):
                part = slice(at, at + len(score))
                n = len(score)
                offset = score - lo[part, None]
                bins = offset // width[part, None]
                within = other & (offset >= 0) & (offset < span[part, None])
                flat = (np.arange(n)[:, None] * BINS + bins)[within]
                count = np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
                above = count[:, ::-1].cumsum(1)[:, ::-1] - count  # in higher bins of this cell
                i, b = np.nonzero((count > 0) & (above < need[part, None]))
                for to, x in zip(out, (ids[part][i], b, count[i, b]), strict=True):
                    to.append(x)
        return pa.table({c: np.concatenate(x).astype(np.int64) if x else np.array([], np.int64) for c, x in zip(("query_id", "bin", "n"), out, strict=True)})

    return cell


def _winners(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
    out: list[list[np.ndarray]] = [[], [], []]
    if len(queries) and len(rows):
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        ids, lo, need, vec = queries["query_id"].to_numpy(), queries["lo"].to_numpy(), queries["need"].to_numpy(), rows["vec_id"].to_numpy()
        for at, score, other in _scores(queries, rows, key[0].as_py()):
            part = slice(at, at + len(score))
            level = score == lo[part, None]
            tie = level & other
            keep = other & (score > lo[part, None]) | tie & (tie.cumsum(1) <= need[part, None])
            i, j = np.nonzero(keep)
            for to, x in zip(out, (ids[part][i], vec[j], score[i, j]), strict=True):
                to.append(x)
    return pa.table({c: np.concatenate(x).astype(np.int64) if x else np.array([], np.int64) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k highest inner products per query: query_id, rank (from 1), vec_id, score.

    vectors: vec_id long, v array<long>; queries: query_id long, v array<long>. Ties go to the smaller vec_id.
    """
    vectors = materialize(spark, vectors.select("vec_id", "v"), "topk-vectors")  # read, scaled and checked once, not in each pass
    queries = materialize(spark, queries.select("query_id", "v"), "topk-queries")
    norm = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    (n, vn, width), (m, qn, _) = (df.agg(F.count(F.lit(1)), norm, F.max(F.size("v"))).first() for df in (vectors, queries))
    bound = min(int((vn or 0) * (qn or 0) * 1.0001) + 1, 2**61)
    per_cell = lambda numbers: max(1, numbers // max(width or 1, 1))
    g = max(1, math.ceil(n / per_cell(ROW_NUMBERS)), min(parallelism(spark), n // LEAST_ROWS))
    h = max(1, math.ceil(m / per_cell(QUERY_NUMBERS)))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    rows = vectors.select("vec_id", "v", F.size("v").alias("d"), deal("vec_id", g).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h")).groupBy(*CELL)
    asked = queries.select("query_id", "v", F.size("v").alias("d"), deal("query_id", h).alias("h"))

    def cells(state: DataFrame):
        mine = asked.join(state, "query_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"))
        return mine.groupBy(*CELL).cogroup(rows)

    width = math.ceil((2 * bound + 1) / BINS)
    state = queries.select("query_id", F.lit(-bound).cast("long").alias("lo"), F.lit(2 * bound + 1).cast("long").alias("span"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while True:
        found = cells(state).applyInArrow(_histograms(), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        found = state.join(found, "query_id", "left").withColumn("cum", F.sum("n").over(down))
        inside = F.expr("max(CASE WHEN cum >= need AND cum - n < need THEN struct(bin, cum - n AS above) END)")
        finer = math.ceil(width / BINS)
        found = found.groupBy("query_id", "lo", "width", "need").agg(inside.alias("at"))
        # a query with fewer candidates than k keeps its window's floor, below every score
        lo = F.col("lo") + F.coalesce(F.col("at.bin"), F.lit(0)) * F.col("width")
        located = found.select("query_id", lo.alias("lo"), F.col("width").alias("span"), F.lit(finer).cast("long").alias("width"), (F.col("need") - F.coalesce(F.col("at.above"), F.lit(0))).alias("need"))
        state = materialize(spark, located, "topk-state", replaces=state)
        if width == 1:
            break
        width = finer
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    won = cells(state).applyInArrow(_winners, "query_id long, vec_id long, score long")
    return won.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))
    asked = rows.where(F.col("vec_id") % QUERY_EVERY == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(spark, rows, asked.select(F.col("vec_id").alias("query_id"), "v"))


ORACLE_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT vec_id, min(v) AS v FROM ok WHERE vec_id % 50 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM asked q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
