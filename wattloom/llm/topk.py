"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks and every query meets every candidate block once per pass. A pass
counts, for each query, how many scores fall into each bin of the interval that must hold its k-th highest
score; the counts give a narrower interval for the next pass, until it is one integer wide. The last pass keeps
the scores that reach the k-th value and breaks ties by the smaller id. A block reports at most its own k
highest scores of an interval, which loses nothing: the k-th score of all is never below that of a block.

Rows with a null id, a null vector, or a vector that holds null or non-finite components take no part. Repeated
rows of one id count as one row (the smallest vector). Vectors of different length are not compared. A query
with fewer than k candidates gets them all. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import arrow_schema, columns_of
from wattloom.session import stage

BINS = 4_096
CANDIDATES, QUERIES = 1_024, 256                  # rows of a block
PARTS = 256                                       # tasks over which the candidate blocks are dealt, at most


def scaled(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and floor(factor x component) of every usable vector."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return columns_of(embeddings, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))) \
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("double")).alias("vector"))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks (dim, block, ids, vectors, lows) of (vec_id, vector, low)."""
    schema = "dim int, block bigint, ids binary, vectors binary, lows binary, longest double"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        part, seq, held = TaskContext.get().partitionId(), 0, {}

        def block(dim):
            nonlocal seq
            got = held.pop(dim)
            ids, vectors, lows = (np.array([g[i] for g in got], d) for i, d in ((0, "<i8"), (1, "<f8"), (2, "<f8")))
            seq += 1
            longest = float(np.sqrt((vectors ** 2).sum(axis=1)).max()) if dim else 0.0
            row = [[dim], [(part << 32) + seq], [ids.tobytes()], [vectors.tobytes()], [lows.tobytes()], [longest]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                got = held.setdefault(len(row[1]), [])
                got.append(row)
                if len(got) >= rows:
                    yield block(len(row[1]))
        for dim in list(held):
            yield block(dim)
    return df.select("vec_id", "vector", "low").mapInArrow(run, schema)


def _met(queries: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """Every block of queries beside every block of candidates of its dimension."""
    q = _packed(queries, QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), "lows",
                                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    c = blocks.select("dim", "ids", "vectors", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    return q.join(c, ["dim", "part"]).select("dim", "q_ids", "q", "lows", "ids", "vectors")


def _scores(b, i):
    dim = b.column(0)[i].as_py()
    q_ids, ids = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in (1, 4))
    lows = np.frombuffer(b.column(3)[i].as_py(), "<f8")
    q, c = (np.frombuffer(b.column(k)[i].as_py(), "<f8").reshape(len(n), dim) for k, n in ((2, q_ids), (5, ids)))
    s = q @ c.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    return q_ids, ids, lows, s


def _count(met: DataFrame, width: float, step: float, k: int) -> DataFrame:
    """Scores per (query_id, bin) inside the interval [low, low + width) of each query."""
    schema = "query_id bigint, bin int, n bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                q_ids, _, lows, s = _scores(b, i)
                s -= lows[:, None]
                s[(s >= width) | (s < 0)] = -np.inf
                top = np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s
                at = np.repeat(np.arange(len(q_ids)), top.shape[1])
                good = top.ravel() >= 0
                keys = at[good] * (BINS + 1) + (top.ravel()[good] // step).astype(np.int64)
                keys, n = np.unique(keys, return_counts=True)
                row = [q_ids[keys // (BINS + 1)], keys % (BINS + 1), n]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)
    return met.mapInArrow(run, schema).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def _reach(met: DataFrame, k: int) -> DataFrame:
    """Scores that reach the low of their query, at most the k first of each block."""
    schema = "query_id bigint, vec_id bigint, score bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                q_ids, ids, lows, s = _scores(b, i)
                at, of = np.nonzero((s >= lows[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[of], -s[at, of], at))
                at, of = at[order], of[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                at, of = at[rank < k], of[rank < k]
                row = [q_ids[at], ids[of], s[at, of].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)
    return met.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``vectors``: vec_id long, vector array<double> of whole numbers. For each row where ``is_query`` holds, the
    k highest inner products with other rows: query_id, rank, vec_id, score. Exact while scores stay below 2^53."""
    rows = stage(vectors.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("low", F.lit(0.0)), "vectors")
    blocks = stage(_packed(rows, CANDIDATES), "vector-blocks")
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.max("longest").alias("m")).first()
    parts = max(1, min(PARTS, size["n"]))
    bound = float(np.ceil((size["m"] or 0.0) ** 2)) + 1              # no score is larger, by Cauchy and Schwarz
    queries = rows.filter(is_query).select("vec_id", "vector")
    state = queries.select("vec_id", F.lit(-bound).alias("low"), F.lit(k).cast("bigint").alias("need"))
    width = 2 * bound + 1
    while width > 1:
        step = float(np.ceil(width / BINS))
        counts = _count(_met(queries.join(state, "vec_id"), blocks, parts), width, step, k)
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        above = counts.withColumn("upto", F.sum("n").over(down)).withColumn("before", F.col("upto") - F.col("n"))
        # the bin where the running count reaches what is needed; with too few scores, the lowest
        pick = above.join(state.withColumnRenamed("vec_id", "query_id"), "query_id").filter("before < need") \
            .groupBy("query_id").agg(F.min(F.struct("bin", "low", "need", "before")).alias("x"))
        state = stage(state.join(pick.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(
            "vec_id", (F.coalesce("x.low", "low") + F.coalesce("x.bin", F.lit(0)) * step).alias("low"),
            (F.coalesce("x.need", "need") - F.coalesce("x.before", F.lit(0))).alias("need")), "kth-scores")
        width = step
    found = _reach(_met(queries.join(state, "vec_id"), blocks, parts), k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
