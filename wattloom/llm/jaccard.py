"""Near-duplicate documents: Jaccard join of word shingles with filters under several global token orders.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Equal sets form one *node*.
2. All shingles are counted in a table of fixed size (2^20 counters, so 4 MB at any input size). An order over
   shingles is "count, then a hash"; any function of the shingle is a valid order, and rare ones come first.
   Three orders are used. Two sets with Jaccard >= 0.8 share a token in the first n - ceil(0.8 n) + 1 of each
   order, for every order.
3. The prefixes of the first order are shuffled by token. Tokens of one node vanish there. A frequent token
   (known from the table) is cut into blocks, and pairs of blocks are groups of their own, so no group grows
   with the input.
4. Inside a group, pairs must also pass the prefixes of the other orders (bit masks, lossless), the length
   filter and a parity mask: two sets differ in at least as many shingles as their masks differ in bits.
   Pairs found so must pass a second parity mask, whose size follows that of the set (lossless as well, a
   sixteenth of the set); what is left is verified on the full sets. A pair stands in a group for each shared token, but
   leaves only the first of them: a row carries the node's ``HEADS`` smallest shared tokens, and a pair is passed over where a
   smaller token than the group's own is in both lists. At its smallest common token no pair is passed over.
5. Only links between nodes that are not connected yet matter. One round looks at a few tokens of each node and
   takes a spanning forest of their candidates; the second takes every candidate between different components
   over all tokens, so no link that would join two components is missed.

A null, empty or blank text has an empty set and links with nothing; its component is its own doc_id. Rows
with a null doc_id take part, but a component's id is the smallest id that is not null. Rows with one doc_id
and different texts are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import arrow_schema, columns_of, drop_large_caches, free_name
from wattloom.session import stage

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5           # similarity 4/5
COUNTERS, SLICE = 1 << 20, 1 << 12
BLOCK = 1_500                                     # nodes of a frequent token in one block
FEW_TOKENS = 6                                    # tokens of a node in the first round
HEADS = 16                                        # smallest shared tokens of a node that its rows carry
NO_TOKEN = (1 << 63) - 1                          # stands after all tokens, so it passes over no pair
MASK_WORDS, ORDER_WORDS = 8, 4                    # 64-bit words of the parity mask and of those of the orders
SCHEMA = "doc_id bigint, n_shingles bigint, component_id bigint"

# odd multipliers of the positions in a shingle and of the two further orders
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                   0x85EBCA77C2B2AE63], np.uint64)
_ORDERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9FB21C651E98DF25
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
PIECE = 1 << 19                                   # bytes of text hashed at a time
PIECE_ROWS = 500                                  # texts whose sets are held at a time
LONG_WORD = 1 << 16                               # bytes from which a word is hashed on its own


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for one piece."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(PIECE + LONG_WORD + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: sums of byte values times powers of a base, moved to the start of the word.

    Pieces end where a word ends, so memory does not grow with the text; words of more than ``LONG_WORD`` bytes have a
    hash of another kind.
    """
    import xxhash
    x = np.frombuffer(raw, np.uint8)
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(x):
        end = min(len(x), at + PIECE)
        while end < len(x) and not _BREAK[x[end]]:                 # on to the end of the word
            ahead = np.flatnonzero(_BREAK[x[end:end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(x), end + PIECE)
        part = x[at:end]
        inside = ~_BREAK[part]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = np.flatnonzero(last - first > LONG_WORD)
        if len(long) == 0:
            h = _short(part, first, last)
        else:
            h = np.empty(len(first), np.uint64)
            cuts = [0, *(c for w in long.tolist() for c in (w, w + 1)), len(first)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo == 1 and last[lo] - first[lo] > LONG_WORD:
                    h[lo] = xxhash.xxh3_64_intdigest(raw[at + first[lo]:at + last[lo]])
                elif hi > lo:
                    h[lo:hi] = _short(part[first[lo]:last[hi - 1]], first[lo:hi] - first[lo], last[lo:hi] - first[lo])
        starts.append(first + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def _short(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[x] * up[:len(x)])))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text."""
    raws = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        end, size = at, 0
        while end < len(raws) and (end == at or size + len(raws[end]) < PIECE):
            size += len(raws[end]) + 1
            end += 1
        starts, h = word_hashes(b" ".join(raws[at:end]))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[at:end])])).tolist()
        grams = h[:max(0, len(h) - WORDS + 1)] * _STEPS[0]
        for k in range(1, WORDS):
            grams += h[k:len(grams) + k] * _STEPS[k]
        grams = mix(grams)
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo >= WORDS:
                s = np.sort(grams[lo:hi - WORDS + 1])
                out.append(s[np.concatenate((_TRUE, s[1:] != s[:-1]))])
            else:
                n = hi - lo
                out.append(mix((h[lo:hi] * _STEPS[:n]).sum(keepdims=True) + np.uint64(n)) if n else np.empty(0, np.uint64))
        at = end
    return out


_TRUE = np.ones(1, bool)


def node_of(s: np.ndarray) -> int | None:
    """Id of a set: a hash of its members."""
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def prefix_size(n: int) -> int:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def _batches(df: DataFrame, schema: str, run) -> DataFrame:
    arrow = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_large_caches()
        for cols in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return df.mapInArrow(each, schema)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of ``PIECE_ROWS`` rows: the sets of a whole Arrow batch would be held at once."""
    for b in batches:
        for at in range(0, b.num_rows, PIECE_ROWS):
            yield b.slice(at, PIECE_ROWS)


def sets_and_counts(documents: DataFrame) -> DataFrame:
    """One pass: a row (doc_id, node, n) for each document and, per task, its counters in slices."""
    def run(batches):
        counters, any_row = np.zeros(COUNTERS, np.uint32), False
        for b in pieces(batches):
            sets = shingle_sets(b.column(1).to_pylist())
            if sets:
                places = (np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64)
                np.add.at(counters, places, np.uint32(1))
            any_row = any_row or b.num_rows > 0
            k = b.num_rows
            yield b.column(0), list(map(node_of, sets)), list(map(len, sets)), [None] * k, [None] * k, b.column(2)
        if any_row:
            for at in range(0, COUNTERS, SLICE):
                part = counters[at:at + SLICE]
                if top := int(part.max()):
                    raw = part.astype("u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()
                    yield [None], [None], [None], [at // SLICE], [raw], [None]
    return _batches(columns_of(documents, "doc_id", "text").withColumn("text_hash", F.xxhash64("text")),
                    "doc_id bigint, node bigint, n int, slice int, counts binary, text_hash bigint", run)


def counter_table(counts: DataFrame) -> bytes:
    """Sums of all counters: a fixed 4 MB whatever the input, so it may go to the driver and be broadcast."""
    def run(batches):
        held, total = None, None
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(raw, {SLICE: "u1", 2 * SLICE: "<u2"}.get(len(raw), "<u4"))
                if at != held:
                    if held is not None:
                        yield [held], [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]
                    held, total = at, np.zeros(SLICE, np.uint64)
                total += part
        if held is not None:
            yield [held], [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]
    parts = counts.select("slice", "counts").repartition("slice").sortWithinPartitions("slice")
    table = np.zeros(COUNTERS, "<u4")
    for r in _batches(parts, "slice int, counts binary", run).collect():
        table[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<u4")
    return table.tobytes()


def mask_of(tokens: np.ndarray, words: int, parity: bool) -> bytes:
    """Bit mask over hashed places: set where any token falls, or where an odd number does."""
    places = (tokens >> np.uint64(17)) & np.uint64(64 * words - 1)
    hits = np.bincount(places.astype(np.intp), minlength=64 * words)
    return np.packbits(hits & 1 if parity else hits > 0).tobytes()


def wide_mask(tokens: np.ndarray) -> bytes:
    """Parity mask of 4 to 8 bits for each member, 512 at least; its number of bits is a power of two."""
    bits = max(512, 1 << (4 * len(tokens) - 1).bit_length())
    places = ((tokens >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.intp)
    return np.packbits(np.bincount(places, minlength=bits) & 1).tobytes()


def wide_difference(x: bytes, y: bytes) -> int:
    """Bits in which two wide masks differ; halves of the longer one are folded until both have one length."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(s: np.ndarray, counts: np.ndarray, multiplier: np.uint64, k: int) -> np.ndarray:
    """Places of the first k tokens in the order (count, hash times multiplier); all that tie with the k-th."""
    key = (np.minimum(counts, np.uint64((1 << 24) - 1)) << np.uint64(40)) | ((s * multiplier) >> np.uint64(24))
    return np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])


def index_rows(representatives: DataFrame, counters) -> DataFrame:
    """For each node a row with its masks, and a row for each token of its prefix (first order)."""
    def run(batches):
        table = np.frombuffer(counters.value, "<u4").astype(np.uint64)
        for b in pieces(batches):
            sets = [s for s in shingle_sets(b.column(0).to_pylist()) if len(s)]
            if not sets:
                continue
            nodes, sizes, tokens, seen, masks = [node_of(s) for s in sets], [len(s) for s in sets], [], [], []
            for s in sets:
                counts, k = table[(s & np.uint64(COUNTERS - 1)).astype(np.intp)], prefix_size(len(s))
                head = prefix(s, counts, np.uint64(1), k)
                tokens.append(s[head].view(np.int64))
                seen.append(counts[head])
                others = (s[prefix(s, counts >> np.uint64(j), m, k)] for j, m in enumerate(_ORDERS, 1))
                masks.append(b"".join([mask_of(s, MASK_WORDS, True), *(mask_of(o, ORDER_WORDS, False) for o in others)]))
            n = len(sets)
            yield pa.nulls(n, pa.int64()), nodes, sizes, pa.nulls(n, pa.int32()), masks, list(map(wide_mask, sets))
            lengths = [len(t) for t in tokens]
            n = sum(lengths)
            yield (np.concatenate(tokens), np.repeat(np.array(nodes), lengths), np.repeat(np.array(sizes, np.int32), lengths),
                   np.minimum(np.concatenate(seen), 2**31 - 1).astype(np.int32), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))
    return _batches(representatives.select("text"), "token bigint, node bigint, n int, seen int, masks binary, wide binary", run)


def shared_tokens(index: DataFrame) -> DataFrame:
    """Index rows of tokens that two nodes have. Frequent tokens are known to be shared and stay unshuffled."""
    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols = cols if rest is None else [np.concatenate(p) for p in zip(rest, cols)]
            token = cols[0]
            if not len(token):
                continue
            tail = int(np.searchsorted(token, token[-1]))       # the last token may go on in the next batch
            rest = [c[tail:] for c in cols]
            yield from several([c[:tail] for c in cols])
        if rest is not None:
            yield from several(rest)

    def several(cols):
        token, node = cols[0], cols[1]
        if len(token):
            first = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
            cols = [c[first] for c in cols]
            token = cols[0]
            same = token[1:] == token[:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield tuple(c[keep] for c in cols)
    few = index.filter((F.col("seen") > 1) & (F.col("seen") <= BLOCK)).select("token", "node", "n", "seen")
    few = few.repartition("token").sortWithinPartitions("token", "node")
    many = index.filter(F.col("seen") > BLOCK).select("token", "node", "n", "seen")
    return _batches(few, "token bigint, node bigint, n int, seen int", run).unionByName(many)


def head_tokens(shared: DataFrame) -> DataFrame:
    """(node, heads): the smallest shared tokens of each node, filled up with the largest possible number."""
    few = F.slice(F.array_sort(F.collect_set("token")), 1, HEADS)
    return shared.groupBy("node").agg(few.alias("_h")).select(
        "node", F.slice(F.concat("_h", F.array_repeat(F.lit(NO_TOKEN).cast("bigint"), HEADS)), 1, HEADS).alias("heads"))


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds the groups (token, i, j) of a row: one for a usual token, pairs of blocks for a frequent one."""
    blocks = F.ceil(F.col("seen") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(
        F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    return rows.withColumn("_pair", F.explode(pairs)).select("*", "_pair.i", "_pair.j").drop("_pair")


def candidates(rows: DataFrame, every: bool) -> DataFrame:
    """Pairs of nodes in different components that pass all filters; ``every`` one, or a forest of them.

    ``rows``: token, node, n, seen, label, masks, heads.
    """
    def run(batches):
        held = None
        for b in batches:
            cols = [np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1),
                    *(b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)),
                    np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(b.num_rows, -1),
                    b.column(7).flatten().to_numpy().reshape(b.num_rows, -1)]
            cols = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]).all(axis=1)             # the last group may go on in the next batch
            tail = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = [c[tail:] for c in cols]
            yield from groups([c[:tail] for c in cols])
        if held is not None:
            yield from groups(held)

    def groups(cols):
        key, node, n, label, masks, heads = cols
        if not len(key):
            return
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        lows, highs = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        two = lows[highs - lows == 2]                               # most groups are pairs: all of them at once
        good = two[(label[two] != label[two + 1]) & similar(n[two], n[two + 1], masks[two], masks[two + 1])]
        if every:
            good = good[first_common(key[good, 0], heads[good], heads[good + 1])]
        out = [np.stack([node[good], node[good + 1]], axis=1)]
        for lo, hi in zip(lows[highs - lows > 2].tolist(), highs[highs - lows > 2].tolist()):
            if (label[lo:hi] != label[lo]).any() and (found := group_pairs(
                    key[lo, 0], node[lo:hi], n[lo:hi], label[lo:hi], masks[lo:hi], heads[lo:hi], every)):
                out.append(np.array(found))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        if len(pairs):
            yield pairs[:, 0], pairs[:, 1]
    grouped = _blocks(rows).select("token", "i", "j", "node", "n", "label", "masks", "heads") \
        .repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return _batches(grouped, "a bigint, b bigint", run).filter("a <> b").distinct()


def similar(n, m, x, y) -> np.ndarray:
    """Whether sets of sizes n and m with masks x and y may reach the similarity (lossless filters)."""
    n, m, both, w = n.astype(np.int64), np.asarray(m, np.int64), x & y, MASK_WORDS
    differ = np.bitwise_count(x[:, :w] ^ y[..., :w]).sum(axis=1).astype(np.int64)
    return ((NUMERATOR * n <= DENOMINATOR * m) & (NUMERATOR * m <= DENOMINATOR * n)
            & both[:, w:w + ORDER_WORDS].any(axis=1) & both[:, w + ORDER_WORDS:w + 2 * ORDER_WORDS].any(axis=1)
            & ((NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n + m)))


def first_common(token, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether no token smaller than ``token`` is in both lists of heads (one row of x for each pair; y the same, or one row for all)."""
    earlier = x < (token[:, None] if np.ndim(token) else token)
    y = y if y.ndim == 2 else y[None, :]
    return ~((x[:, :, None] == y[:, None, :]).any(axis=2) & earlier).any(axis=1)


def group_pairs(token, node, n, label, masks, heads, every: bool) -> list[tuple[int, int]]:
    """Candidate pairs of one group (at most two blocks of nodes), by rows of a matrix."""
    _, first = np.unique(node, return_index=True)
    node, n, label, masks, heads = node[first], n[first].astype(np.int64), label[first], masks[first], heads[first]
    roots, out = {}, []

    def root(x):
        while roots.get(x, x) != x:
            x = roots[x]
        return x
    if len(node) < 2 or (label == label[0]).all():
        return out
    for i in range(1, len(node)):
        js = np.flatnonzero((label[:i] != label[i]) & (NUMERATOR * n[i] <= DENOMINATOR * n[:i]) & (NUMERATOR * n[:i] <= DENOMINATOR * n[i]))
        if len(js):
            js = js[similar(n[js], n[i], masks[js], masks[i])]
        if not len(js):
            continue
        if every:
            js = js[first_common(token, heads[js], heads[i])]
            out += [(int(node[j]), int(node[i])) for j in js]
            continue
        for j in js[np.unique(label[js], return_index=True)[1]]:     # one node of each component
            a, b = root(int(label[j])), root(int(label[i]))
            if a != b:
                roots[max(a, b)] = min(a, b)
                out.append((int(node[j]), int(node[i])))
    return [(min(p), max(p)) for p in out]


def close_by_masks(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs whose wide masks allow the similarity. ``wide``: node, n, wide; a node may stand in it repeatedly."""
    nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "candidate-nodes")
    some = wide.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            x, y, n, m, u, v = (b.column(i).to_pylist() for i in range(6))
            good = [(DENOMINATOR + NUMERATOR) * wide_difference(p, q) <= (DENOMINATOR - NUMERATOR) * (k + l)
                    for k, l, p, q in zip(n, m, u, v)]
            yield [i for i, g in zip(x, good) if g], [i for i, g in zip(y, good) if g]
    both = pairs.join(some.toDF("a", "_n", "_u"), "a").join(some.toDF("b", "_m", "_v"), "b")
    return _batches(both.select("a", "b", "_n", "_m", "_u", "_v"), "a bigint, b bigint", run)


def verified(pairs: DataFrame, sets) -> DataFrame:
    """Pairs whose full sets have at least the similarity asked for."""
    full = sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    left, right = full.toDF("a", "_sa"), full.toDF("b", "_sb")
    common = F.size(F.array_intersect("_sa", "_sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(DENOMINATOR * common >= NUMERATOR * (F.size("_sa") + F.size("_sb") - common)).select("a", "b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of a link; label is the smallest node that it reaches.

    Labels spread along links and then jump to the label of their label, so the number of rounds grows with
    the logarithm of the longest path. Every round is a written table.
    """
    both = stage(links.union(links.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("label").alias("_near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        new = stage(spread.join(jump, "_new", "left").select(
            "node", F.col("label").alias("_old"), F.least("_new", F.coalesce("_jump", "_new")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> _old").isEmpty():
            return labels


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: size of its set and smallest doc_id reachable by links (itself included)."""
    each, final = _components(documents)
    return each.join(final, "node", "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest doc_id, and of several rows with it the one whose text has
    the smallest hash. Rows without words stay. Groups whose rows all lack a doc_id keep one row as well."""
    each, final = _components(documents)
    # the row to keep of each component, by (doc_id, hash of the text); partial minima before the shuffle
    d, t = free_name(documents, "_kept_doc"), free_name(documents, "_kept_text")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = each.filter("node is not null").join(final, "node").groupBy("label").agg(F.min(rank).alias("k")) \
        .select(F.col("k.doc_id").alias(d), F.col("k.text_hash").alias(t))
    kept = kept.unionByName(each.filter("node is null").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))) \
        .distinct()
    key = F.xxhash64("text")
    found = documents.join(kept.hint("shuffle_hash"), (key == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_semi")
    if not each.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        # repeated rows: one of each
        found = found.withColumn(t, key).dropDuplicates(["doc_id", t]).drop(t)
    return found


def _components(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, node, n) of each row; (node, label, component_id) of each node."""
    docs = columns_of(documents, "doc_id", "text")
    spark = docs.sparkSession
    first = stage(sets_and_counts(docs), "shingle-sets")
    each = first.filter("slice is null").select("doc_id", "text_hash", "node", "n")
    counters = spark.sparkContext.broadcast(counter_table(first.filter("slice is not null")))
    nodes = stage(each.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    # one text of each node, by its smallest doc_id; texts without an id are few or one node, and all come along
    texts = docs.join(nodes.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi") \
        .unionByName(docs.filter("doc_id is null"))
    index = stage(index_rows(texts, counters), "shingle-index")
    masks = index.filter("token is null").select("node", "masks").dropDuplicates(["node"])
    wide = index.filter("token is null").select("node", "n", "wide")
    shared = stage(shared_tokens(index.filter("token is not null")), "shared-tokens")
    looks = stage(masks.join(head_tokens(shared), "node"), "node-looks")

    def sets(wanted: DataFrame) -> DataFrame:
        # written first, so that Spark knows its size: a small list is broadcast, a long one joined by shuffle
        ids = stage(wanted.join(nodes, "node").filter("doc_id is not null").select("doc_id").distinct(), "wanted")
        some = docs.join(ids, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))

        def run(batches):
            for b in pieces(batches):
                made = [s for s in shingle_sets(b.column(0).to_pylist()) if len(s)]
                yield list(map(node_of, made)), [s.view(np.int64) for s in made]
        return stage(_batches(some.select("text"), "node bigint, tokens array<bigint>", run), "full-sets")

    links, labels = None, None
    for turn in ("few", "every"):
        rows = shared
        if turn != "every":
            rank = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("token", F.lit(turn)), "token"))
            rows = rows.filter(F.col("seen") > 1).withColumn("_k", rank).filter(F.col("_k") <= FEW_TOKENS).drop("_k")
        if labels is None:
            rows = rows.withColumn("label", F.col("node"))
        else:
            rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            open_ = rows.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")) \
                .filter("_lo <> _hi").select("token")
            rows = rows.join(open_, "token", "left_semi")
        pairs = stage(candidates(rows.join(looks, "node"), turn == "every"), "candidates")
        if pairs.isEmpty():
            continue
        close = stage(close_by_masks(pairs, wide), "close-pairs")
        if close.isEmpty():
            continue
        found = stage(verified(close, sets), "verified")
        links = found if links is None else links.unionByName(found)
        labels = connected(links)

    members = nodes.withColumn("label", F.col("node")) if labels is None else \
        nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = members.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return each, members.join(smallest, "label").select("node", "label", "component_id")
