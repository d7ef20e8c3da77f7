"""Hard-negative mining by Fagin's threshold algorithm.

Candidates stand in blocks. A block holds, for every dimension, the list of its rows sorted by that component. An
anchor reads each list from the end that its own sign makes the better one (sorted access), looks up every row it
meets and scores it as an integer inner product (random access). The threshold, the score of a row made of the
components last read, bounds all rows not met so far; a search ends once the threshold is strictly below the k-th
best score of each of its windows, or below the window itself. Strictly, because equal scores are ordered by id.

First each anchor finds its positives (one window without bounds, rows of its label), then its negatives (a window
of scores for each positive, rows of other labels). Every anchor meets every block; the best of the blocks are
merged by a ranked window. No result depends on how rows are dealt into blocks.

Rows with a null id, label or vector, or with null or non-finite components, take no part. Repeated rows of one id
count as one (the smallest vector, then label). Vectors of different length are not compared. An anchor without
positives, or with a window that no row falls into, has no rows for it; so has an empty table. Scores must fit a
64-bit integer. Further columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import arrow_schema, columns_of
from wattloom.session import stage

CANDIDATES, ANCHORS = 4_096, 128                  # rows of a block
PARTS, GROUPS = 256, 64                           # candidate parts and anchor groups, at most: tasks of a search
FIRST = 32                                        # rows read from each list before the threshold is looked at
EXACT = 2 ** 53
MOST = 2 ** 62                                    # stands for no bound


def usable_rows(embeddings: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id, label, vector (floor(factor x component) as whole numbers), one row per id."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = columns_of(embeddings, "vec_id", "label", "embedding") \
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    return rows.groupBy("vec_id").agg(F.min(F.struct(vector.alias("vector"), F.col("label").cast("bigint").alias("label"))).alias("r")) \
        .select("vec_id", "r.label", "r.vector")


def sorted_blocks(rows: DataFrame, size: int = CANDIDATES) -> DataFrame:
    """Blocks (dim, block, n, ids, labels, vectors, lists, top). Rows of one label stand together where they can."""
    schema = "dim int, block bigint, n int, ids binary, labels binary, vectors binary, lists binary, top bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        task, seq, held = TaskContext.get().partitionId(), 0, {}

        def block(dim):
            nonlocal seq
            got = held.pop(dim)
            v = np.array([g[2] for g in got], np.int64).reshape(len(got), dim)
            lists = np.argsort(v, axis=0, kind="stable").T.astype("<i4")          # dim x n, ascending
            seq += 1
            row = [dim, (task << 32) + seq, len(got), np.array([g[0] for g in got], "<i8").tobytes(),
                   np.array([g[1] for g in got], "<i8").tobytes(), v.astype("<i8").tobytes(), lists.tobytes(),
                   int(np.abs(v).max(initial=0))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "vector"))):
                got = held.setdefault(len(row[2]), [])
                got.append(row)
                if len(got) >= size:
                    yield block(len(row[2]))
        for dim in list(held):
            yield block(dim)
    spread = F.xxhash64("vec_id")
    ordered = rows.repartitionByRange("label", spread).sortWithinPartitions("label", spread)
    return ordered.select("vec_id", "label", "vector").mapInArrow(run, schema)


def anchor_blocks(anchors: DataFrame) -> DataFrame:
    """Blocks (dim, ids, labels, vectors, names, lows, highs) of anchors with their windows.

    ``anchors``: vec_id, label, vector, windows array<struct<name, low, high>>.
    """
    schema = "dim int, a_n int, a_ids array<bigint>, a_labels array<bigint>, a_vectors binary, windows array<array<bigint>>"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        held = {}

        def block(dim):
            got = held.pop(dim)
            row = [dim, len(got), [g[0] for g in got], [g[1] for g in got],
                   np.array([g[2] for g in got], "<i8").tobytes(),
                   [[x for w in g[3] for x in (w["name"], w["low"], w["high"])] for g in got]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "vector", "windows"))):
                got = held.setdefault(len(row[2]), [])
                got.append(row)
                if len(got) >= ANCHORS:
                    yield block(len(row[2]))
        for dim in list(held):
            yield block(dim)
    return anchors.select("vec_id", "label", "vector", "windows").mapInArrow(run, schema)


class Lists:
    """One candidate block: sorted lists per dimension and random access by row."""

    def __init__(self, dim: int, n: int, ids: bytes, labels: bytes, vectors: bytes, lists: bytes, top: int):
        self.n, self.top = n, top
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.vectors = np.frombuffer(vectors, "<i8").reshape(n, dim)
        self.order = np.frombuffer(lists, "<i4").reshape(dim, n)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.known = set(np.unique(self.labels).tolist())
        self.as_float = self.vectors.astype(np.float64)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high] the k best allowed rows: (score, row), highest first, then smaller id."""
        exact = len(anchor) * int(np.abs(anchor).max(initial=0)) * self.top < EXACT
        table, a = (self.as_float, anchor.astype(np.float64)) if exact else (self.vectors, anchor)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        unseen = allowed.copy()
        left, read, depth = int(unseen.sum()), 0, FIRST
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]     # best scores and rows so far
        opened = list(range(len(windows)))
        while opened and left:
            depth = min(depth, self.n)
            if left <= depth or depth == self.n:                       # fewer rows are left than a list would name
                met, left = np.flatnonzero(unseen), 0
            else:
                new = np.zeros(self.n, bool)
                new[self.order[up, self.n - depth:self.n - read]] = True
                new[self.order[down, read:depth]] = True
                met = np.flatnonzero(new & unseen)
                unseen[met] = False
                left -= len(met)
            scores = (table[met] @ a).astype(np.int64)
            threshold = int(self.sorted[up, self.n - depth] @ anchor[up] + self.sorted[down, depth - 1] @ anchor[down])
            still = []
            for w in opened:
                low, high = windows[w]
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                best, rows = np.concatenate([held[w][0], scores[inside]]), np.concatenate([held[w][1], met[inside]])
                if len(best) > k:                                      # ties of the k-th stay in
                    kept = best >= np.partition(best, -k)[-k]
                    best, rows = best[kept], rows[kept]
                held[w] = best, rows
                if threshold >= low and (len(best) < k or threshold >= best.min()):
                    still.append(w)
            opened, read, depth = still, depth, depth * 2
        out = []
        for best, rows in held:
            order = np.lexsort((self.ids[rows], -best))[:k]
            out.append(list(zip(best[order].tolist(), rows[order].tolist())))
        return out


def _met(anchors: DataFrame, blocks: DataFrame, parts: int, groups: int) -> DataFrame:
    """Every block of anchors beside every block of candidates of its dimension, in parts x groups tasks."""
    a = anchor_blocks(anchors)
    a = a.withColumn("grp", F.pmod(F.xxhash64(F.col("a_ids")[0]), F.lit(groups)).cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")) \
        .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return c.join(a, ["dim", "part", "grp"]).drop("part", "grp")


def _search(met: DataFrame, same_label: bool, k: int) -> DataFrame:
    """Best rows (anchor_id, window, vec_id, score) of each anchor, window and block."""
    schema = "anchor_id bigint, window bigint, vec_id bigint, score bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        block, lists = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["block"] != block:
                    block = r["block"]
                    lists = Lists(r["dim"], r["n"], r["ids"], r["labels"], r["vectors"], r["lists"], r["top"])
                vectors = np.frombuffer(r["a_vectors"], "<i8").reshape(r["a_n"], r["dim"])
                out = []
                for anchor_id, label, vector, flat in zip(r["a_ids"], r["a_labels"], vectors, r["windows"]):
                    if (label not in lists.known) if same_label else (lists.known == {label}):
                        continue
                    allowed = (lists.labels == label) == same_label
                    allowed &= lists.ids != anchor_id
                    names, bounds = flat[::3], list(zip(flat[1::3], flat[2::3]))
                    for name, best in zip(names, lists.search(vector, allowed, bounds, k)):
                        out += [(anchor_id, name, int(lists.ids[row]), score) for score, row in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[j] for o in out], f.type) for j, f in enumerate(arrow)], schema=arrow)
    return met.mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
                   least: int = 50, most: int = 95) -> DataFrame:
    """``rows``: vec_id, label, vector. For each anchor and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels whose score is ``least`` to ``most`` per cent of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = stage(rows, "vectors")
    blocks = stage(sorted_blocks(rows), "sorted-lists")
    n = blocks.count()
    parts, groups = max(1, min(PARTS, n)), max(1, min(GROUPS, n // PARTS))
    anchors = rows.filter(is_anchor)
    all_scores = F.array(F.struct(F.lit(0).cast("bigint").alias("name"), F.lit(-MOST).alias("low"), F.lit(MOST).alias("high")))
    pos = stage(_ranked(_search(_met(anchors.withColumn("windows", all_scores), blocks, parts, groups), True, positives), positives)
                .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole-number bounds of least*p <= 100*s <= most*p, from remainders instead of fractions
    low = F.expr(f"(positive_score * {least} - pmod(positive_score * {least}, 100)) div 100 + if(pmod(positive_score * {least}, 100) > 0, 1, 0)")
    high = F.expr(f"(positive_score * {most} - pmod(positive_score * {most}, 100)) div 100")
    asked = pos.withColumns({"low": low, "high": high}).filter("low <= high").groupBy(F.col("anchor_id").alias("vec_id")) \
        .agg(F.collect_list(F.struct(F.col("positive_id").alias("name"), "low", "high")).alias("windows"))
    neg = _ranked(_search(_met(anchors.join(asked, "vec_id"), blocks, parts, groups), False, negatives), negatives)
    neg = neg.select("anchor_id", F.col("window").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                     F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return neg.join(pos, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
