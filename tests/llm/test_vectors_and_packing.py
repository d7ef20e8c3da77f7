"""Packing, hard negatives and vector codes against plain Python forms."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import codes, negatives, packing
from wattloom.llm.common import tokenizer_path

R = random.Random(11)
DIM = 8


def vector(i, dim=DIM):
    r = random.Random(i)
    centre = [random.Random(1000 + i % 7).uniform(-1, 1) for _ in range(dim)]
    return [c * 0.8 + r.uniform(-0.3, 0.3) for c in centre]


VECTORS = [(i, vector(i), i % 4) for i in range(400)]
VECTORS += [(400 + i, vector(3), 3) for i in range(60)]                          # copies of one vector
VECTORS += [(500, None, 1), (501, [0.1] * 7 + [float("nan")], 1), (502, [None] + [0.1] * 7, 2), (503, [float("inf")] * 8, 2),
            (504, vector(9), None), (506, vector(10), None), (550, [0.0] * DIM, 0), (600, [0.0] * DIM, 1), (601, [-0.4] * DIM, 1)]
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def floats(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("row", "part", "error", "block", "score", "n", "windows")}) if clash else df


def kept(rows, factor, dims=(DIM,)):
    out = []
    for i, v, label in rows:
        v = None if v is None else [None if x is None else np.float32(x) for x in v]
        if v is not None and len(v) in dims and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(factor * float(x)) for x in v], label))
    return out


# hard negatives -----------------------------------------------------------------------------------
def mined(rows, positives=5, most=3):
    rows = [r for r in kept(rows, 256, (DIM, 4)) if r[2] is not None]
    out = []
    for a, va, la in rows:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, v, label in rows if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [(n, -t) for t, n, label in scored if label != la and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, rank + 1, n, -s, t) for rank, (n, t) in enumerate(fit[:most])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("size", [64, 4_096])
def test_hard_negatives(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "CANDIDATES", size)
    made = negatives.hard_negatives(negatives.usable_rows(floats(spark, VECTORS, True)), F.col("vec_id") % 50 == 0)
    assert made.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(made) == mined(VECTORS)


def test_hard_negatives_of_small_tables(spark):
    few = [(0, [0.5] * 4, 1), (50, [0.5] * 4, 1), (1, [0.3] * 4, 2), (2, [0.3] * DIM, 2), (3, [0.4] * 4, 2), (4, [0.35] * 4, 1)]
    for rows in ([], few, few + few, few[:1], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        once = {r[0]: r for r in rows}.values()
        made = negatives.hard_negatives(negatives.usable_rows(floats(spark, rows)), F.col("vec_id") % 50 == 0)
        want = mined(once) if rows and rows[0][1] else ([(0, 1, 1, 2, 0, 0)] if rows else [])
        assert found(made) == want


def test_the_threshold_ends_a_search_early():
    n, dim = 2_000, 2
    v = np.array([[i, i % 3] for i in range(n)], np.int64)
    lists = np.argsort(v, axis=0, kind="stable").T.astype("<i4")
    block = negatives.Lists(dim, n, np.arange(n).astype("<i8").tobytes(), np.zeros(n, "<i8").tobytes(), v.astype("<i8").tobytes(),
                            lists.tobytes(), int(v.max()))
    looked = []
    table = block.as_float
    class Counting:
        def __getitem__(self, at):
            looked.append(len(at))
            return table[at]
    block.as_float = Counting()
    best = block.search(np.array([5, -1]), np.ones(n, bool), [(-2 ** 62, 2 ** 62)], 3)[0]
    assert [s for s, _ in best] == sorted((5 * i - i % 3 for i in range(n)), reverse=True)[:3]
    assert sum(looked) < n / 10
    # beyond exact floats the scores are counted in whole numbers
    big = negatives.Lists(1, 2, np.arange(2).astype("<i8").tobytes(), np.zeros(2, "<i8").tobytes(),
                          np.array([[2 ** 31], [2 ** 31 + 1]], "<i8").tobytes(), np.array([[0, 1]], "<i4").tobytes(), 2 ** 31 + 1)
    assert big.search(np.array([2 ** 30 + 1]), np.ones(2, bool), [(0, 2 ** 62)], 1)[0] == [((2 ** 31 + 1) * (2 ** 30 + 1), 1)]


# vector codes -------------------------------------------------------------------------------------
def compressed(rows, entries=256, parts=4, rounds=4):
    rows = sorted(kept(rows, 1024), key=lambda r: (r[0], r[1]))
    if not rows:
        return []
    w = DIM // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            at = collections.defaultdict(list)
            for c in cut:
                at[nearest(p, c[p])[1]].append(c[p])
            for k, xs in at.items():
                books[p][k] = [sum(x) // len(xs) for x in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors, by_label = [sum(d for d, _ in x) for x in done], collections.Counter()
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    return sorted((i, "".join(f"{k:02x}" for _, k in x), e, by_label[label], digest) for (i, _, label), x, e in zip(rows, done, errors))


@pytest.mark.parametrize("rows", [VECTORS, VECTORS[:90] + VECTORS[395:470] + VECTORS[:3], VECTORS[:1], VECTORS[460:464], []])
def test_vector_codes(spark, rows):
    made = codes.compress(floats(spark, rows, True))
    assert made.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, made.collect())) == compressed(rows)


def test_vectors_of_other_lengths_take_no_part(spark):
    odd = [(1000, [0.1] * 4, 0), (1001, [0.1] * 9, 0), (1002, [], 0)]
    made = codes.compress(floats(spark, VECTORS[:300] + odd))
    assert sorted(map(tuple, made.collect())) == compressed(VECTORS[:300])


def test_shortlists_lose_no_nearest_entry():
    r = np.random.default_rng(3)
    books = r.integers(-1000, 1000, (1, 64, 4))
    assign = codes.Assigner(books, np.dtype("<i2"), 1000)
    shorter = 0
    for _ in range(200):
        v = r.integers(-1000, 1000, 4) + r.integers(-80, 80, (20, 4))
        among = assign.shortlist(0, v.min(axis=0), v.max(axis=0))
        shorter += len(among) < 64
        entry, d = assign.nearest(0, v, among)
        full = ((v[:, None] - books[0][None]) ** 2).sum(axis=2)
        assert entry.tolist() == full.argmin(axis=1).tolist() and d.tolist() == full.min(axis=1).tolist()
    assert shorter > 150


def test_hilbert_keys_are_a_walk_without_jumps():
    side = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = sorted(zip(codes.hilbert_keys(side, 3), side.tolist()))
    assert len({k for k, _ in order}) == 512
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(order, order[1:]))


# packing ------------------------------------------------------------------------------------------
WORDS = ["alpha", "bet", "gamma", "Δelta", "eps", "zeta.", "eta,", "theta\n", "iota", "12", "👍"]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


DOCS = [(i, text(R.randint(0, 120), i), f"s{i % 3}" if i % 5 else "hot", 1) for i in range(300)]
DOCS += [(300, None, "s1", 1), (301, "", None, 1), (302, text(9_000, 7), None, 1), (303, "a" * 20_000, "hot", 1), (303, "a" * 20_000, "hot", 1),
         (303, "b", "hot", 1), (None, "no id", "s2", 1), (304, "x <|endoftext|> y", "s2", 1), (305, " " * 5_000 + "é\x00", "s0", 1)]
DOC_SCHEMA = "doc_id bigint, text string, source string, queue int"


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]


def check_packed(docs, sequences, tokens, sequence=1024):
    """Every id in one piece, sequences without gaps, all but the last full."""
    pieces = [r.asDict() for r in packing.piece_digests(sequences).collect()]
    assert len(pieces) == sequences.select(F.explode("pieces")).count()
    want = collections.Counter()
    for d, t, *_ in docs:
        want[d, len(tokens(t))] += 1
    ids_of = collections.defaultdict(list)
    for d, t, *_ in docs:
        ids_of[d, len(tokens(t))].append(tokens(t))
    at = collections.defaultdict(list)
    for p in pieces:
        assert any(zlib.crc32(np.array(ids[p["start"]:p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
                   for ids in ids_of[p["doc_id"], p["doc_tokens"]])
        at[p["doc_id"], p["doc_tokens"]] += range(p["start"], p["start"] + p["length"])
    assert {k: sorted(v) for k, v in at.items()} == {k: sorted(list(range(k[1])) * n) for k, n in want.items()}
    lengths = collections.defaultdict(list)
    for p in pieces:
        lengths[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(lengths) == list(range(len(lengths)))
    full = []
    for s in sorted(lengths):
        end = 0
        for o, n in sorted(lengths[s]):
            assert o == end and n > 0
            end += n
        full.append(end)
    assert all(n == sequence for n in full[:-1]) and 0 < full[-1] <= sequence
    return pieces


@pytest.mark.parametrize("window", [1, 4])
def test_packing(spark, tokens, window):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).repartition(5)
    made = packing.pack(docs, window=window)
    pieces = check_packed(DOCS, made, tokens)
    # every full window holds each source in the corpus's share, to less than a token or two
    source = {d: s for d, _, s, _ in DOCS}
    total, by_source, at = 0, collections.Counter(), collections.defaultdict(collections.Counter)
    for p in pieces:
        s = source[p["doc_id"]]
        total += p["length"]
        by_source[s] += p["length"]
        at[p["sequence_id"] // window][s] += p["length"]
    for w in sorted(at)[:-1]:
        assert all(abs(at[w][s] - n * 1024 * window / total) < 2 for s, n in by_source.items())
    check_packed(DOCS, packing.pack(docs.repartition(2), window=window), tokens)


def test_packing_to_a_given_mixture(spark, tokens):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA)
    made = packing.pack(docs, mixture={"s0": 0.25, "hot": 0.5, None: 0.25}, window=1)
    pieces = check_packed(DOCS, made, tokens)
    source = {d: s for d, _, s, _ in DOCS}
    first = collections.Counter()
    for p in pieces:
        if p["sequence_id"] < 8:
            first[source[p["doc_id"]]] += p["length"]
    assert abs(first["hot"] - 4096) <= 2 and abs(first["s0"] - 2048) <= 2 and abs(first[None] - 2048) <= 2 and not first["s1"]


def test_padding_and_small_tables(spark, tokens):
    for rows in ([], DOCS[:1], [(1, "word " * 300, "a", 0), (2, None, None, 0)]):
        made = packing.pack(spark.createDataFrame(rows, DOC_SCHEMA))
        check_packed(rows, made, tokens) if rows else None
        for r in made.collect():
            assert len(r["ids"]) == 4 * (r["n"] if r["n"] & (r["n"] - 1) == 0 else 1024)
    assert made.count() == 1


def test_more_sources_than_queues(spark, tokens, monkeypatch):
    monkeypatch.setattr(packing.queue_names, "__defaults__", (3,))
    check_packed(DOCS, packing.pack(spark.createDataFrame(DOCS, DOC_SCHEMA)), tokens)


def test_schedules_serve_every_queue_whole():
    r = random.Random(5)
    for trial in range(60):
        n = r.randint(1, 12)
        left = [r.choice([0, 1, r.randint(0, 50), r.randint(0, 30_000)]) for _ in range(n)]
        mixture = None if trial % 2 else [r.choice([0.0, r.random()]) for _ in range(n)]
        phases = packing.schedule(left, 64, mixture, 16)
        served = [sum(p.quanta[q] * p.rounds for p in phases) for q in range(n)]
        assert served == left and len(phases) <= 40 * n + 5
        at = 0
        for i, p in enumerate(phases):
            assert p.first == at
            at += p.windows * p.rounds
            quotas = packing.round_quotas(p.quanta, p.windows, 64)
            assert quotas.min(initial=0) >= 0 and quotas.sum(axis=0).tolist() == p.quanta
            assert i == len(phases) - 1 or (quotas.sum(axis=1) == 64).all()


def test_deficits_carry_over_windows():
    quotas = packing.round_quotas([10, 53, 1], 16, 4)
    target = np.outer(np.arange(1, 17), np.array([10, 53, 1]) / 16)
    assert np.abs(np.cumsum(quotas, axis=0) - target).max() < 1


def test_fast_ids_equal_the_librarys(tokens):
    odd = ["", "a" * 9_000, "  x\n\n \ty ", "it's I'LL 'Ve", "<|endoftext|>", "a<|endoftext|>\x1cb", "ﬁ½²Ⅷ​﻿", "е́ ÅÅ 你好。", " " * 3000]
    # every single character, beside letters, digits, blanks and itself
    odd += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}a  {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c <= 0xDFFF)
            for start in range(0, 0x30000, 64)]
    assert all([*packing.encode(t).tolist(), 0] == tokens(t) for t in odd)
