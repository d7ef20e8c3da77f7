"""Vector code compression: product codes whose assignment prunes Hilbert-sorted flat blocks.

Every vector is cut into equal consecutive parts. The sub-vectors of one part position are sorted along a Hilbert
curve and packed into flat blocks; a block stores its vectors, the min/max box around them, and their sum. In a
round, the distances between a block's box and the codebook entries give a shortlist: an entry whose nearest
possible distance to the box exceeds the farthest possible distance of another one can be nearest to no vector of
the block. Only shortlisted entries are compared with the vectors, in exact integers; where one entry is left,
the block's stored sum and count are its whole contribution.

Rows whose vector is null or holds null or non-finite components take no part; nor do rows whose length is not a
positive multiple of the number of parts, or not that of the kept row with the smallest vec_id (then the smallest
vector). A null vec_id sorts first. Repeated rows count and return as often as they stand there. With fewer kept
rows than entries there are as many entries as rows. Distances must fit a 64-bit integer. An empty table gives no
rows. Further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import arrow_schema, columns_of
from wattloom.session import stage

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1_024
BLOCK = 128                       # sub-vectors of a block
BITS = 4                          # Hilbert bits of a component
SALTS = 32                        # over which the rows of one label are spread
EXACT = 2 ** 53                   # whole numbers below are exact in float64


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Place of each row of small integers (n x dim, each below 2^bits) on the Hilbert curve, as sortable bytes."""
    x = cells.astype(np.int64).copy()
    dim, top = x.shape[1], 1 << (bits - 1)
    q = top
    while q > 1:                                     # undo excess rotations, from the highest bit down
        for i in range(dim):
            hit = (x[:, i] & q) > 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(hit, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dim):                          # Gray code
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), np.int64), top
    while q > 1:
        turn ^= np.where((x[:, -1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def kept_rows(embeddings: DataFrame, parts: int = PARTS, factor: int = FACTOR) -> DataFrame:
    """Stored rows that take part: row (an id of its own), vec_id, label, vector array<bigint>."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    n = F.size("embedding")
    rows = columns_of(embeddings, "vec_id", "embedding", "label") \
        .filter(F.coalesce(usable, F.lit(False)) & (n > 0) & (n % parts == 0)) \
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                F.transform("embedding", lambda x: F.floor(x.cast("double") * factor)).alias("vector"))
    rows = stage(rows, "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_first(), "vector").select(F.size("vector")).first()
    return rows.filter(F.size("vector") == (first[0] if first else 0))


def flat_blocks(rows: DataFrame, dim: int, parts: int, low: list[int], high: list[int]) -> tuple[DataFrame, np.dtype]:
    """Blocks (part, n, rows, vectors, lo, hi, total) of the sub-vectors in Hilbert order, part by part, and the
    number type of the stored vectors.

    Equal sub-vectors are told apart by their row in the range shuffle, so a frequent vector is spread, too.
    """
    width = dim // parts
    lows, spans = np.array(low, float), np.maximum(np.array(high, float) - np.array(low, float), 1.0)
    schema = "part int, key binary, row bigint, v array<bigint>"
    arrow = arrow_schema(schema)

    def keyed(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column(0).to_numpy()
            whole = b.column(1).flatten().to_numpy().reshape(-1, dim)
            cells = ((whole - lows) / spans * (2 ** BITS - 1)).astype(np.int64)
            for p in range(parts):
                cut = slice(p * width, (p + 1) * width)
                flat = pa.array(np.ascontiguousarray(whole[:, cut]).ravel())
                ends = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), p, np.int32)), pa.array(hilbert_keys(cells[:, cut]), pa.binary()),
                     pa.array(ids), pa.ListArray.from_arrays(ends, flat).cast(arrow.field("v").type)], schema=arrow)

    out = "part int, n int, rows binary, vectors binary, lo binary, hi binary, total binary"
    out_arrow = arrow_schema(out)
    small = np.dtype(next(t for t in ("<i2", "<i4", "<i8") if max(map(abs, low + high)) <= np.iinfo(t).max))

    def packed(batches):
        import pyarrow as pa
        part, ids, vectors = None, [], []

        def block():
            nonlocal ids, vectors
            v = np.array(vectors, np.int64)
            row = [[part], [len(ids)], [np.array(ids, "<i8").tobytes()], [v.astype(small).tobytes()],
                   [v.min(axis=0).tobytes()], [v.max(axis=0).tobytes()], [v.sum(axis=0).tobytes()]]
            ids, vectors = [], []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, out_arrow)], schema=out_arrow)
        for b in batches:
            flat = b.column(2).flatten().to_numpy().reshape(-1, width)
            for p, r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), flat):
                if ids and (p != part or len(ids) == BLOCK):
                    yield block()
                part = p
                ids.append(r)
                vectors.append(v)
        if ids:
            yield block()
    ordered = rows.select("row", "vector").mapInArrow(keyed, schema) \
        .repartitionByRange("part", "key", "row").sortWithinPartitions("part", "key", "row")
    return stage(ordered.select("part", "row", "v").mapInArrow(packed, out), "vector-blocks"), small


class Assigner:
    """Nearest entries of a block's vectors under given codebooks (parts x entries x width)."""

    def __init__(self, codebooks: np.ndarray, small: np.dtype, reach: int):
        self.books, self.small = codebooks, small
        # the largest product sum that the kernel forms; beyond exact floats it counts in 64-bit integers
        self.kind = np.float64 if 4 * codebooks.shape[2] * reach * reach < EXACT else np.int64

    def shortlist(self, part: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        e = self.books[part]
        gap = np.maximum(np.maximum(lo - e, e - hi), 0)
        far = np.maximum(np.abs(e - lo), np.abs(e - hi))
        near, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
        return np.flatnonzero(near <= most.min())

    def vectors(self, raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, self.small).reshape(n, -1).astype(np.int64)

    def nearest(self, part: int, v: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each vector; of equally near ones the lower index."""
        e = self.books[part][among].astype(self.kind)
        x = v.astype(self.kind)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ e.T) + (e * e).sum(axis=1)[None, :]
        at = d.argmin(axis=1)
        return among[at], d[np.arange(len(v)), at].astype(np.int64)


def _updated(blocks: DataFrame, make, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round. Each batch of blocks leaves one row per entry it met; Spark adds them up."""
    width = books.shape[2]
    schema = "part int, entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width))
    arrow = arrow_schema(schema)

    def partial(batches):
        import pyarrow as pa
        assign = make(books)
        total = defaultdict(lambda: np.zeros(width + 1, np.int64))
        for b in batches:
            for part, n, raw, lo, hi, all_of in zip(*(b.column(c).to_pylist() for c in ("part", "n", "vectors", "lo", "hi", "total"))):
                among = assign.shortlist(part, np.frombuffer(lo, "<i8"), np.frombuffer(hi, "<i8"))
                if len(among) == 1:
                    got = total[part, int(among[0])]
                    got[0] += n
                    got[1:] += np.frombuffer(all_of, "<i8")
                    continue
                v = assign.vectors(raw, n)
                entry, _ = assign.nearest(part, v, among)
                order = np.argsort(entry, kind="stable")
                found, starts = np.unique(entry[order], return_index=True)
                sums = np.add.reduceat(v[order], starts, axis=0)
                for f, s, size in zip(found.tolist(), sums, np.diff([*starts, n]).tolist()):
                    got = total[part, f]
                    got[0] += size
                    got[1:] += s
        if total:                                                   # at most parts x entries rows
            table = np.array([[*k, *v] for k, v in total.items()])
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i]).cast(f.type) for i, f in enumerate(arrow)], schema=arrow)
    sums = blocks.select("part", "n", "vectors", "lo", "hi", "total").mapInArrow(partial, schema) \
        .groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    new = books.copy()
    for r in sums.collect():                                        # one row per codebook entry
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return new


def _assigned(blocks: DataFrame, make, books: np.ndarray) -> DataFrame:
    """(row, part, entry, distance) of every sub-vector."""
    schema = "row bigint, part int, entry int, distance bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        assign = make(books)
        for b in batches:
            for part, n, ids, raw, lo, hi in zip(*(b.column(c).to_pylist() for c in ("part", "n", "rows", "vectors", "lo", "hi"))):
                among = assign.shortlist(part, np.frombuffer(lo, "<i8"), np.frombuffer(hi, "<i8"))
                entry, d = assign.nearest(part, assign.vectors(raw, n), among)
                row = [np.frombuffer(ids, "<i8"), np.full(n, part), entry, d]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(row, arrow)], schema=arrow)
    return blocks.select("part", "n", "rows", "vectors", "lo", "hi").mapInArrow(run, schema)


def label_totals(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over equal labels, nulls together.

    Labels are counted before the shuffle and met again under a salt, so a frequent label is no hot key.
    """
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    totals = coded.groupBy(*key).agg(F.sum("error").alias("label_error")) \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.select("*", *key, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("_salt"))
    return salted.join(totals, ["_none", "_label", "_salt"]).drop("_none", "_label", "_salt")


def fit_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
              factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors and the codebooks (parts x entries x width).

    The codes have row, vec_id, label, codes array<int> and error. The codebooks are bounded by entries x dimension.
    """
    rows = kept_rows(embeddings, parts, factor)
    first = rows.orderBy(F.col("vec_id").asc_nulls_first(), "vector").limit(entries).collect()
    if not first:
        empty = rows.select("row", "vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0]["vector"])
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    at: list[Column] = [F.col("vector")[i] for i in range(dim)]
    span = rows.agg(F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")).first()
    blocks, small = flat_blocks(rows, dim, parts, span["low"], span["high"])
    reach = max(map(abs, span["low"] + span["high"]))

    def make(b):
        return Assigner(b, small, reach)
    for _ in range(rounds):
        books = _updated(blocks, make, books)
    found = _assigned(blocks, make, books).groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda s: s["entry"]).alias("codes"),
        F.sum("distance").alias("error"))
    return rows.select("row", "vec_id", "label").join(found, "row"), books


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error, codebooks_sha256."""
    coded, books = fit_codes(embeddings)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = stage(coded.select("row", "vec_id", "label", code.alias("code"), "error"), "vector-codes")
    return label_totals(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
