"""Extremely randomised regression trees, every one grown on all training rows, without bootstrap.

A node draws a share of the features and one random threshold for each, between its smallest and largest value, and takes the split
that reduces the squared error most. Where a task can hold the rows (at most ``TASK_ROWS``), each task grows a group of whole trees.
On larger tables the rows lie in stored blocks: the top of all trees is grown level by level from ranges and counts that the
blocks report, until a node has at most ``TASK_ROWS`` rows; then the rows of each such node meet in one task, which grows what
hangs below it (a *piece*). Some trees at a time are treated so, that no shuffle holds more than about ``BATCH_ROWS`` rows. So a task's memory
follows ``TASK_ROWS`` and not the table.

A forest of at most ``BROADCAST_NODES`` nodes is broadcast for scoring. The rows scored by a larger one are sent to the trees, or to
the pieces they fall into, and their means are added up per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import shared_folder, stage

TASK_ROWS = 250_000
BATCH_ROWS = 40_000_000
BROADCAST_NODES = 4_000_000
GROUP_TREES = 10
CHUNK = 16_384                                                         # rows looked at together: they stay in the processor's cache
SMALL = np.array([8, 12, 16, 24, 32, 48, 64])                          # nodes of similar size are laid side by side
SCALE = 1 << 30
WHOLE = -1                                                             # piece number of a whole tree, and of the top of a tree in pieces
SCHEMA = "tree int, piece int, feature binary, threshold binary, child binary, value binary"
FORMS = {"feature": "<i4", "threshold": "<f4", "child": "<i4", "value": "<f4"}
PACKED = "x binary, y double, h bigint, block int"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# -- one tree ------------------------------------------------------------------------------

def cuts(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Thresholds between the smallest and the largest value of each node and feature."""
    cut = (lo + (hi - lo) * at).astype(np.float32)
    return np.where(cut > lo, cut, hi)                                 # x < cut must hold for the smallest value


def best_cuts(lo, hi, n_left, s_left, sizes, s_all, drawn: int, min_leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Feature to split each node by, and whether it can be split."""
    s_all, n_right = s_all[:, None], sizes[:, None] - n_left
    with np.errstate(all="ignore"):
        gain = s_left ** 2 / n_left + (s_all - s_left) ** 2 / n_right
    allowed = np.zeros(gain.shape, bool)
    picks = np.argpartition(np.where(hi > lo, rng.random(gain.shape), 2.0), drawn - 1, axis=1)[:, :drawn]    # of those that vary
    np.put_along_axis(allowed, picks, True, axis=1)
    allowed &= (hi > lo) & (n_left >= min_leaf) & (n_right >= min_leaf)
    gain = np.where(allowed, gain, -np.inf)
    best = gain.argmax(axis=1)
    return best, np.isfinite(gain[np.arange(len(best)), best])


def stretches(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of the nodes' rows, some ``CHUNK`` of them at a time: places, start of each stretch among them, its node."""
    parts = -(-sizes // CHUNK)
    node = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(node)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = starts[node] + nth * CHUNK
    long = np.minimum(CHUNK, sizes[node] - nth * CHUNK)
    bounds = np.flatnonzero(np.diff((np.cumsum(long) - long) // CHUNK, prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        at = np.cumsum(long[a:b]) - long[a:b]
        yield np.repeat(first[a:b] - at, long[a:b]) + np.arange(at[-1] + long[b - 1]), at, node[a:b]


def ranges(x: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each node and feature; a node's rows are ``rows[start:start + size]``."""
    lo, hi = (np.full((len(sizes), x.shape[1]), v, np.float32) for v in (np.inf, -np.inf))
    for places, at, node in stretches(starts, sizes):
        cells = np.ascontiguousarray(x.take(rows.take(places), axis=0).T)
        np.minimum.at(lo, node, np.minimum.reduceat(cells, at, axis=1).T)
        np.maximum.at(hi, node, np.maximum.reduceat(cells, at, axis=1).T)
    return lo, hi


def below(x: np.ndarray, y: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the values of each node's rows below the threshold of each feature."""
    n, s = np.zeros(cut.shape, np.int64), np.zeros(cut.shape)
    for places, at, node in stretches(starts, sizes):
        mine = rows.take(places)
        left = np.ascontiguousarray(x.take(mine, axis=0).T) < np.repeat(cut[node].T, np.diff(np.append(at, len(places))), axis=1)
        np.add.at(n, node, np.add.reduceat(left, at, axis=1, dtype=np.int64).T)
        np.add.at(s, node, np.add.reduceat(left * y.take(mine), at, axis=1).T)
    return n, s


def node_stats(x, y, rows, starts, sizes, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges, thresholds and what lies below them, per node and feature; ``at``: where in its range each threshold lies."""
    lo, hi, cut = (np.empty(at.shape, np.float32) for _ in range(3))
    n, s = np.empty(at.shape, np.int64), np.empty(at.shape)
    kind = np.searchsorted([*SMALL, CHUNK], sizes)
    for k in np.unique(kind):
        of_kind = np.flatnonzero(kind == k)
        if k == len(SMALL):
            for places, first, which in stretches(starts[of_kind], sizes[of_kind]):
                here, mine = of_kind[which], rows.take(places)
                cells = np.ascontiguousarray(x.take(mine, axis=0).T)
                lo[here], hi[here] = np.minimum.reduceat(cells, first, axis=1).T, np.maximum.reduceat(cells, first, axis=1).T
                cut[here] = cuts(lo[here], hi[here], at[here])
                left = cells < np.repeat(cut[here].T, sizes[here], axis=1)
                n[here] = np.add.reduceat(left, first, axis=1, dtype=np.int64).T
                s[here] = np.add.reduceat(left * y.take(mine), first, axis=1).T
            continue
        if k > len(SMALL):                                             # too many rows to be looked at together
            lo[of_kind], hi[of_kind] = ranges(x, rows, starts[of_kind], sizes[of_kind])
            cut[of_kind] = cuts(lo[of_kind], hi[of_kind], at[of_kind])
            n[of_kind], s[of_kind] = below(x, y, rows, starts[of_kind], sizes[of_kind], cut[of_kind])
            continue
        nth = np.arange(SMALL[k])[:, None]
        for here in np.split(of_kind, range(CHUNK // SMALL[k], len(of_kind), CHUNK // SMALL[k])):
            mine = rows.take(starts[here] + np.minimum(nth, sizes[here] - 1))    # the last row again where a node has fewer
            cells = x.take(mine, axis=0)
            lo[here], hi[here] = cells.min(axis=0), cells.max(axis=0)
            cut[here] = cuts(lo[here], hi[here], at[here])
            left = cells < cut[here]
            left &= (nth < sizes[here])[:, :, None]
            n[here] = np.add.reduce(left.view(np.int8), axis=0, dtype=np.int8)
            s[here] = (left * y.take(mine)[:, :, None]).sum(axis=0)
    return lo, hi, cut, n, s


def grow(x: np.ndarray, y: np.ndarray, depth: int, min_leaf: int, share: float, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree, level by level: feature (-1 in a leaf), threshold, left child (the right one follows it), mean."""
    n, width = x.shape
    drawn = max(1, int(share * width))
    feature, threshold, child, value = ([np.full(1, -1, np.int32)], [np.zeros(1, np.float32)], [np.zeros(1, np.int32)],
                                        [np.array([y.mean()], np.float32)])
    rows, ids, sizes, total = np.arange(n), np.zeros(1, np.int64), np.array([n]), 1
    first, flat = 0, np.ascontiguousarray(x).ravel()
    for _ in range(depth):
        if not len(rows):
            break
        starts = np.cumsum(sizes) - sizes
        lo, hi, cut, n_left, s_left = node_stats(x, y, rows, starts, sizes, rng.random((len(ids), width)))
        s_all = np.add.reduceat(y.take(rows), starts)
        best, split = best_cuts(lo, hi, n_left, s_left, sizes, s_all, drawn, min_leaf, rng)
        if not split.any():
            break
        pick = np.flatnonzero(split)
        f, c = best[pick], cut[pick, best[pick]]
        here = ids[pick] - first
        kids = total + 2 * np.arange(len(pick))
        feature[-1][here], threshold[-1][here], child[-1][here] = f, c, kids
        if len(pick) < len(ids):
            rows, sizes = rows[np.repeat(split, sizes)], sizes[pick]
        right = flat.take(rows * width + np.repeat(f, sizes)) >= np.repeat(c, sizes)
        slot = 2 * np.repeat(np.arange(len(pick)), sizes) + right
        counts = np.bincount(slot, minlength=2 * len(pick))
        place = np.cumsum(counts) - counts                             # left rows of a node, then its right ones, in their order
        order = np.empty(len(rows), np.int64)
        seen = np.cumsum(right)
        begin = np.cumsum(sizes) - sizes
        before = np.repeat(seen[begin] - right[begin], sizes)
        nth_right = seen - right - before
        nth = np.where(right, nth_right, np.arange(len(rows)) - np.repeat(begin, sizes) - nth_right)
        order[place.take(slot) + nth] = rows
        rows = order
        first, total = total, total + 2 * len(pick)
        sums = np.add.reduceat(y.take(rows), place)
        feature.append(np.full(2 * len(pick), -1, np.int32))
        threshold.append(np.zeros(2 * len(pick), np.float32))
        child.append(np.zeros(2 * len(pick), np.int32))
        value.append((sums / counts).astype(np.float32))
        go_on = counts >= 2 * min_leaf                                 # the others cannot be split again
        rows = rows[np.repeat(go_on, counts)]
        ids, sizes = first + np.flatnonzero(go_on), counts[go_on]
    return tuple(map(np.concatenate, (feature, threshold, child, value)))


def walk(tree: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """A tree laid out for scoring: left child and feature in one number, threshold, mean. A leaf is its own child, and its
    threshold is NaN, so that a row stays there."""
    feature, threshold, child, value = tree
    leaf = feature < 0
    step = np.where(leaf, np.arange(len(feature)), child).astype(np.int64) << 16 | np.where(leaf, 0, feature)
    return step, np.where(leaf, np.float32(np.nan), threshold).astype(np.float32), value


def leaves(x: np.ndarray, walks: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
    """The leaf that each row falls into, tree by tree (see ``walk``); the array is used again for the next tree."""
    cells = np.ascontiguousarray(x).ravel()
    first, end = np.arange(len(x)) * x.shape[1], np.empty(len(x), np.int64)
    for step, cut, _ in walks:
        rows, node, at, level = None, np.zeros(len(x), np.int64), first, 0
        while len(node):
            here = step.take(node)
            node = (here >> 16) + (cells.take(at + (here & 0xFFFF)) >= cut.take(node))
            level += 1
            if level % 2 == 0:                                         # rows in a leaf go no further
                inner = cut.take(node)
                on = np.flatnonzero(inner == inner)
                if len(on) < len(node):
                    end[slice(None) if rows is None else rows] = node
                    rows = on if rows is None else rows[on]
                    node, at = node[on], at[on]
        yield end


def leaf_means(x: np.ndarray, walks: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Mean over the trees (see ``walk``) of the leaf that each row falls into."""
    out = np.zeros(len(x))
    for (_, _, value), end in zip(walks, leaves(x, walks)):
        out += value[end]
    return out / len(walks)


# -- rows and trees in Arrow ---------------------------------------------------------------

def flat_bytes(column: pa.ChunkedArray, dtype: str = "<f4") -> np.ndarray:
    """The numbers of a binary column, one row's after another's."""
    out = []
    for c in column.chunks:
        offsets = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset:c.offset + len(c) + 1]
        data = c.buffers()[2]
        out.append(np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(dtype) if data is not None else np.empty(0, dtype))
    return np.concatenate(out)


def as_binary(x: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    wide = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(wide)),
                                                       pa.py_buffer(np.ascontiguousarray(x))])


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Rows that follow one another with the same keys, also over several batches."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for start, end in zip([0, *new], [*new, b.num_rows]):
            key = tuple(int(c[start]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def in_hash_order(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of a run: the same however the rows arrive."""
    order = np.argsort(t["h"].to_numpy(), kind="stable")
    return flat_bytes(t["x"]).reshape(-1, width)[order], t["y"].to_numpy()[order]


def tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(tree, piece, arrays of the tree) as stored."""
    names = ("tree", "piece", *FORMS)
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    cols = zip(*[(t, p, *(a.astype(f).tobytes() for a, f in zip(tree, FORMS.values()))) for t, p, tree in rows])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], list(names))


def arrays(r) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(r[c], f) for c, f in FORMS.items())


def part_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` shuffle partitions a number that is hashed to it, so that every partition gets its share."""
    found: dict[int, int] = {}
    many = 32 * parts + 1000
    key = F.col("id").cast("int")
    for r in spark.range(many).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("p")).agg(F.min(key).alias("k")).collect():
        found[r["p"]] = r["k"]
    return [found.get(p, p) for p in range(parts)]


def dealt(sizes: list[int], keys: list[int]) -> list[int]:
    """A partition's key for each piece of work, the largest dealt out first."""
    out = [0] * len(sizes)
    for nth, i in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        out[i] = keys[nth % len(keys)]
    return out


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files are deleted as soon as a query has ended, and not when the driver next collects garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def partitions(spark: SparkSession, rows: int) -> int:
    """As many as the session works on at once, more where a partition would hold more than four tasks' rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // (4 * TASK_ROWS)))


# -- the forest ----------------------------------------------------------------------------

@dataclass
class Forest:
    """A fitted forest: the medians that replace missing inputs, and the trees as a stored table."""
    features: list[str]
    medians: list[float]
    trees: DataFrame

    def save(self, folder: str) -> None:
        self.trees.write.parquet(f"{folder}/trees")
        self.trees.sparkSession.createDataFrame([(self.features, self.medians)], "features array<string>, medians array<double>") \
            .coalesce(1).write.json(f"{folder}/inputs")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Forest:
        inputs = spark.read.schema("features array<string>, medians array<double>").json(f"{folder}/inputs").first()
        return Forest(list(inputs["features"]), list(inputs["medians"]), spark.read.schema(SCHEMA).parquet(f"{folder}/trees"))

    def inputs(self) -> list[Column]:
        """The model's inputs as it takes them; missing ones (and NaN) take the median of the training rows."""
        return [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(m)), F.lit(m)) for c, m in zip(self.features, self.medians)]

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        """``rows`` with ``out``, the mean of all trees. By a large forest the rows are scored at once, and stored."""
        piece = F.coalesce("piece", F.lit(WHOLE))
        sizes = self.trees.select("tree", piece.alias("piece"), (F.length("feature") / 4).cast("long").alias("nodes")) \
            .orderBy("tree", "piece").collect()
        if sum(r["nodes"] for r in sizes) > BROADCAST_NODES or any(r["piece"] != WHOLE for r in sizes):
            return self._predict_by_parts(rows, out, sizes)
        held = [walk(arrays(r)) for r in self.trees.orderBy("tree").collect()]
        shared = rows.sparkSession.sparkContext.broadcast(held)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(leaf_means(np.stack(x.to_list()).astype(np.float32), shared.value)) if len(x) else pd.Series([], dtype=float)
        return rows.withColumn(out, score(F.array(*self.inputs())))

    def _predict_by_parts(self, rows: DataFrame, out: str, sizes: list) -> DataFrame:
        """Every row meets each whole tree, a group of them at a time, and the one piece it falls into of each tree in pieces."""
        spark, width = rows.sparkSession, len(self.features)
        held = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "to-score")
        names = [f"_x{i}" for i in range(width)]
        asked = stage(held.select("_row", *[c.alias(n) for c, n in zip(self.inputs(), names)])
                      .mapInArrow(packer(names, "_row"), "x binary, _row bigint"), "to-score-inputs")
        in_pieces = {r["tree"] for r in sizes if r["piece"] != WHOLE}
        tops = {r["tree"]: walk(arrays(r)) for r in self.trees.filter(F.col("tree").isin(sorted(in_pieces))
                & (F.coalesce("piece", F.lit(WHOLE)) == WHOLE)).toLocalIterator()} if in_pieces else {}
        target: dict[tuple[int, int], int] = {}                        # (tree, piece) -> the number under which its rows are sent
        routes, weight, group = [], [], 0
        for r in sizes:
            if r["tree"] not in in_pieces:                             # whole trees share a number up to a bound
                if not group or not routes or routes[-1][0] is not None or group + r["nodes"] > BROADCAST_NODES // 4:
                    weight.append(0)
                    routes.append((None, len(weight) - 1))
                    group = 0
                group += r["nodes"]
            elif r["piece"] == WHOLE:
                routes.append((r["tree"], {}))
                continue
            else:
                weight.append(0)
                routes[-1][1][r["piece"]] = len(weight) - 1
            target[r["tree"], r["piece"]] = len(weight) - 1
            weight[-1] += r["nodes"]
        n, folder = held.count(), shared_folder(spark, "tree-sums")
        many = max(1, BATCH_ROWS // max(1, n))
        with tidy(spark):
            for a in range(0, len(routes), many):
                batch = routes[a:a + many]
                numbers = sorted({k for _, to in batch for k in (to.values() if isinstance(to, dict) else [to])})
                parts = partitions(spark, n * len(batch))
                keys = part_keys(spark, parts)
                key_of = dict(zip(numbers, dealt([weight[k] for k in numbers], keys)))
                trees = spark.createDataFrame([(t, p, k, key_of[k]) for (t, p), k in target.items() if k in key_of],
                                              "tree int, piece int, target int, part int")
                here = [t for (t, _), k in target.items() if k in key_of]
                stored = self.trees.filter(F.col("tree").between(min(here), max(here))).withColumn("piece", F.coalesce("piece", F.lit(WHOLE)))
                models = F.broadcast(trees).join(stored, ["tree", "piece"]).select(
                    "part", "target", F.lit(0).alias("kind"), "tree", F.lit(None).cast("long").alias("_row"), F.lit(None).cast("binary").alias("x"),
                    F.lit(0.0).alias("v"), *FORMS)
                sent = asked.mapInArrow(sender(width, batch, tops, key_of, keys), "part int, target int, _row bigint, x binary, v double").select(
                    "part", "target", F.lit(1).alias("kind"), F.lit(0).alias("tree"), "_row", "x", "v", *[F.lit(None).cast("binary").alias(c) for c in FORMS])
                models.unionByName(sent).repartition(parts, "part").sortWithinPartitions("target", "kind", "tree") \
                    .mapInArrow(scorer(width), "_row bigint, v double").groupBy("_row").agg(F.sum("v").alias("v")) \
                    .write.mode("append").parquet(folder)
        trees = len({r["tree"] for r in sizes})
        sums = spark.read.schema("_row bigint, v double").parquet(folder).groupBy("_row").agg((F.sum("v") / trees).alias(out))
        return held.drop(out).join(sums, "_row", "left").select(*[c for c in rows.columns if c != out], out)


def packer(names: list[str], *others: str):
    """Columns ``names`` become one binary value of 32-bit numbers, ``x``; ``others`` stay."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"x": as_binary(x), **{c: b.column(c) for c in others}})
    return pack


def sender(width: int, routes: list, tops: dict, key_of: dict[int, int], keys: list[int]):
    """Rows once for each group of whole trees and each tree in pieces; a row that ends in the top of a tree has its value already."""
    known = np.array([-1, *sorted(key_of)])
    part = np.array([keys[0], *(key_of[k] for k in sorted(key_of))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, packed = b.column("_row"), b.column("x")
            x, n = flat_bytes(pa.chunked_array([packed])).reshape(-1, width), b.num_rows
            for tree, to in routes:
                value = np.zeros(n)
                if tree is None:
                    number = np.full(n, to)
                else:
                    end = next(leaves(x, [tops[tree]]))
                    number = np.full(len(tops[tree][2]), -1)
                    number[list(to)] = list(to.values())
                    number = number[end]
                    value = np.where(number < 0, tops[tree][2][end].astype(float), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(part[np.searchsorted(known, number)], pa.int32()), pa.array(number, pa.int32()),
                                                  ids, packed.cast(pa.binary()), pa.array(value)], ["part", "target", "_row", "x", "v"])
    return send


def scorer(width: int):
    """Trees of a target come before its rows; gives the sum of their means for each row."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walks = None, []
        for b in batches:
            for (target, kind), t in runs(iter([b]), "target", "kind"):
                if kind == 0:
                    if target != now:
                        now, walks = target, []
                    walks += [walk(arrays(r)) for r in t.select(list(FORMS)).to_pylist()]
                    continue
                v = t["v"].to_numpy() if target < 0 else leaf_means(flat_bytes(t["x"]).reshape(-1, width), walks) * len(walks)
                yield pa.RecordBatch.from_arrays([t["_row"].combine_chunks(), pa.array(v, pa.float64())], ["_row", "v"])
    return score


# -- the fit -------------------------------------------------------------------------------

def fit(rows: DataFrame, features: list[str], label: str = "y", trees: int = 300, depth: int = 32, min_leaf: int = 3,
        share: float = 0.7, seed: int = 0, sample_rows: int | None = None, task_rows: int = TASK_ROWS) -> Forest:
    """``rows`` should be stored: they are read twice, for the medians and for the trees.

    Every tree learns from all rows. Only with ``sample_rows`` does each group of trees get a random sample of its own, of about that size.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features}
    about = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("double")).alias("_s"),
                     *[F.percentile_approx(v, 0.5, 10_000).alias(c) for c, v in value.items()]).first()
    n = about["_n"]
    medians = [0.0 if about[c] is None else float(about[c]) for c in features]
    names = [f"_x{i}" for i in range(len(features))]
    blocks = max(1, -(-n // task_rows))
    inputs = rows.select(*[F.coalesce(value[c], F.lit(m)).alias(x) for c, m, x in zip(features, medians, names)], F.col(label).cast("double").alias("y")) \
        .withColumn("h", F.xxhash64(*names, "y"))
    inputs = inputs.withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
    packed = inputs.mapInArrow(packer(names, "y", "h", "block"), PACKED)
    job = Growth(len(features), trees, depth, min_leaf, share, seed)
    if sample_rows is None and n > task_rows:
        return Forest(list(features), medians, job.in_pieces(packed, n, about["_s"], blocks, task_rows))
    return Forest(list(features), medians, job.whole(packed, 1.0 if sample_rows is None else min(1.0, sample_rows / max(1, n))))


@dataclass
class Growth:
    """Settings of a fit, and its two ways over the rows."""
    width: int
    trees: int
    depth: int
    min_leaf: int
    share: float
    seed: int

    def whole(self, packed: DataFrame, share_of_rows: float) -> DataFrame:
        """Each task grows a group of trees."""
        spark, me = packed.sparkSession, self
        groups = -(-self.trees // GROUP_TREES)
        keys = part_keys(spark, groups)
        every = F.sequence(F.lit(0), F.lit(groups - 1))
        if share_of_rows < 1:
            every = F.filter(every, lambda g: F.pmod(F.xxhash64("h", g, F.lit(me.seed)), F.lit(SCALE)) < F.lit(int(share_of_rows * SCALE)))
        sent = packed.withColumn("grp", F.explode(every)).withColumn("part", F.element_at(F.array(*map(F.lit, keys)), F.col("grp") + 1))

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (g,), t in runs(batches, "grp"):
                x, y = in_hash_order(t, me.width)
                del t
                for k in range(g * GROUP_TREES, min(me.trees, (g + 1) * GROUP_TREES)):
                    yield tree_batch([(k, WHOLE, grow(x, y, me.depth, me.min_leaf, me.share, np.random.default_rng((me.seed, k))))])
        with tidy(spark):
            return stage(sent.select("part", "grp", "x", "y", "h").repartition(groups, "part").sortWithinPartitions("grp")
                         .mapInArrow(grown, SCHEMA), "trees")

    def in_pieces(self, packed: DataFrame, n: int, total: float, blocks: int, task_rows: int) -> DataFrame:
        """The tops of all trees from what the blocks of rows report, then the pieces below them, some trees at a time."""
        spark = packed.sparkSession
        with tidy(spark):
            held = stage(packed.repartition(blocks, "block").sortWithinPartitions("block", "h"), "tree-rows")
            tops = [Top(n, total, self.width, np.random.default_rng((self.seed, k))) for k in range(self.trees)]
            while True:
                asked = {k: t.open(task_rows, self.depth) for k, t in enumerate(tops)}
                asked = {k: ids for k, ids in asked.items() if len(ids)}
                if not asked:
                    break
                found = self.report(held, {k: (tops[k].walk(), ids, None) for k, ids in asked.items()})
                cut = {}
                for k, ids in asked.items():
                    lo, hi = (a.astype(np.float32) for a in found[k])
                    cut[k] = (lo, hi, cuts(lo, hi, tops[k].rng.random(lo.shape)))
                found = self.report(held, {k: (tops[k].walk(), ids, cut[k][2]) for k, ids in asked.items()})
                for k, ids in asked.items():
                    tops[k].split(ids, *cut[k], *found[k], max(1, int(self.share * self.width)), self.min_leaf)
            folder = shared_folder(spark, "trees")
            spark.createDataFrame([(k, WHOLE, *(bytearray(a.tobytes()) for a in t.arrays())) for k, t in enumerate(tops)], SCHEMA) \
                .write.mode("append").parquet(folder)
            many = max(1, BATCH_ROWS // n)
            for a in range(0, self.trees, many):
                self.pieces(held, {k: tops[k] for k in range(a, min(self.trees, a + many))}, n, folder)
        return spark.read.schema(SCHEMA).parquet(folder)

    def report(self, held: DataFrame, asked: dict) -> dict[int, np.ndarray]:
        """Per tree and asked node, over all rows: smallest and largest values, or number and sum of the values below the thresholds."""
        spark, width = held.sparkSession, self.width
        shared = spark.sparkContext.broadcast(asked)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (block,), t in runs(batches, "block"):
                x, y = in_hash_order(t, width)
                del t
                for k, (top, ids, cut) in shared.value.items():
                    slot_of = np.full(len(top[2]), -1)
                    slot_of[ids] = np.arange(len(ids))
                    slot = slot_of[next(leaves(x, [top]))]
                    rows = np.argsort(slot, kind="stable")[np.count_nonzero(slot < 0):]
                    sizes = np.bincount(slot[rows], minlength=len(ids))
                    starts = np.cumsum(sizes) - sizes
                    out = ranges(x, rows, starts, sizes) if cut is None else below(x, y, rows, starts, sizes, cut)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "block": pa.array([block], pa.int32()),
                                                      "stats": pa.array([np.array(out, float).tobytes()], pa.binary())})

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held_stats = None, None
            for b in batches:
                for r in b.to_pylist():
                    got = np.frombuffer(r["stats"], float).reshape(2, -1, width)
                    if r["tree"] != now:
                        if now is not None:
                            yield said(now, held_stats)
                        now, held_stats = r["tree"], got.copy()
                    elif shared.value[now][2] is None:
                        held_stats[0], held_stats[1] = np.minimum(held_stats[0], got[0]), np.maximum(held_stats[1], got[1])
                    else:
                        held_stats += got
            if now is not None:
                yield said(now, held_stats)

        def said(k: int, stats: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "stats": pa.array([stats.tobytes()], pa.binary())})
        by_tree = held.mapInArrow(told, "tree int, block int, stats binary").repartition(spark.sparkContext.defaultParallelism, "tree") \
            .sortWithinPartitions("tree", "block")
        out = {r["tree"]: np.frombuffer(r["stats"], float).reshape(2, -1, width)
               for r in by_tree.mapInArrow(merged, "tree int, stats binary").collect()}
        shared.destroy()
        return out

    def pieces(self, held: DataFrame, tops: dict[int, Top], n: int, folder: str) -> None:
        """Grow what hangs below the tops: the rows of each of their ends meet in one task."""
        spark, me = held.sparkSession, self
        ends = [(k, int(i)) for k, t in tops.items() for i in t.ends(self.depth, self.min_leaf)]
        if not ends:
            return
        parts = partitions(spark, n * len(tops))
        key = dict(zip(ends, dealt([tops[k].count[i] for k, i in ends], part_keys(spark, parts))))
        part_of = {}
        for k, t in tops.items():
            part_of[k] = np.array([key.get((k, i), -1) for i in range(len(t.count))])
        shared = spark.sparkContext.broadcast({k: (t.walk(), part_of[k], np.array(t.level)) for k, t in tops.items()})

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = flat_bytes(pa.chunked_array([b.column("x")])).reshape(-1, me.width)
                for k, (top, part_of, _) in shared.value.items():
                    end = next(leaves(x, [top]))
                    part = part_of[end]
                    on = np.flatnonzero(part >= 0)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(part[on], pa.int32()), "tree": pa.array(np.full(len(on), k), pa.int32()), "piece": pa.array(end[on], pa.int32()),
                        "x": as_binary(x[on]), "y": b.column("y").take(pa.array(on)), "h": b.column("h").take(pa.array(on))})

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (k, i), t in runs(batches, "tree", "piece"):
                x, y = in_hash_order(t, me.width)
                del t
                left = me.depth - int(shared.value[k][2][i])
                yield tree_batch([(k, i, grow(x, y, left, me.min_leaf, me.share, np.random.default_rng((me.seed, k, i))))])
        held.mapInArrow(send, "part int, tree int, piece int, x binary, y double, h bigint").repartition(parts, "part") \
            .sortWithinPartitions("tree", "piece").mapInArrow(grown, SCHEMA).write.mode("append").parquet(folder)
        shared.destroy()


class Top:
    """The upper nodes of a tree that is grown from the blocks' reports."""

    def __init__(self, n: int, total: float, width: int, rng: np.random.Generator):
        self.rng, self.width = rng, width
        self.feature, self.threshold, self.child = [-1], [0.0], [0]
        self.count, self.sum, self.level, self.closed = [n], [total], [0], [False]

    def open(self, task_rows: int, depth: int) -> np.ndarray:
        """Nodes with more rows than a task may hold."""
        return np.array([i for i, f in enumerate(self.feature) if f < 0 and not self.closed[i] and self.count[i] > task_rows and self.level[i] < depth], int)

    def ends(self, depth: int, min_leaf: int) -> np.ndarray:
        """Nodes below which a piece is to be grown."""
        return np.array([i for i, f in enumerate(self.feature) if f < 0 and not self.closed[i] and self.count[i] >= 2 * min_leaf and self.level[i] < depth], int)

    def split(self, ids, lo, hi, cut, n_left, s_left, drawn: int, min_leaf: int) -> None:
        best, ok = best_cuts(lo, hi, n_left, s_left, np.array([self.count[i] for i in ids], float), np.array([self.sum[i] for i in ids]),
                             drawn, min_leaf, self.rng)
        for j, i in enumerate(ids):
            if not ok[j]:
                self.closed[i] = True
                continue
            f = int(best[j])
            self.feature[i], self.threshold[i], self.child[i] = f, float(cut[j, f]), len(self.feature)
            for n, s in ((int(n_left[j, f]), s_left[j, f]), (self.count[i] - int(n_left[j, f]), self.sum[i] - s_left[j, f])):
                self.feature.append(-1)
                self.threshold.append(0.0)
                self.child.append(0)
                self.count.append(n)
                self.sum.append(float(s))
                self.level.append(self.level[i] + 1)
                self.closed.append(False)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int32), np.array(self.threshold, np.float32), np.array(self.child, np.int32),
                (np.array(self.sum) / np.array(self.count)).astype(np.float32))

    def walk(self) -> tuple[np.ndarray, ...]:
        return walk(self.arrays())
