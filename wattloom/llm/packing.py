"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens: its documents in the order in which the table is read, each closed by an end id. A window is a stretch of
sequences (``window``, 32 by default; 1 gives every single sequence the mixture, at the price of many short pieces) filled by
visiting all queues: a queue's credit grows by its target share of the window, it serves the whole tokens of its
credit, and what it could not serve (or served beyond it, when the window's rest was dealt out) stays as its deficit
for the next window. A *round* of up to 1,024 windows hands every queue a whole number of tokens, its quantum, so all
deficits inside a round are back at zero where it ends and every round of a phase looks alike. That makes the schedule a
closed form: the place of any token of any queue follows from its position alone, and a task that packs some documents
needs no state of the tasks before it. What quanta round away is carried into the next phase; a phase ends when a queue
runs short.

Targets are the corpus's own shares (then all queues last to the end), or a mixture given by the caller: an empty queue's
share falls to the others in proportion. The queues are the sources with most documents, at most ``QUEUES`` of them, the last
one for all the rest; null is a source like any other. Every window but the last is full, so only the last sequence may
need padding.

Ids cross one shuffle, the one that brings the pieces of neighbouring sequences together. The place of a document in its queue is the
sum of two numbers: the tokens of the queue before it in its own part of the table, counted where the part is encoded, and the tokens of
earlier parts, a table of at most ``PARTS`` x ``QUEUES`` rows.

A null text is an empty one: its document is the end id alone. Repeated rows and repeated ids are documents of their own.
Texts of any length are cut freely. An empty table has no sequences. Further columns of any name are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import arrow_schema, columns_of, tokenizer_path
from wattloom.session import shared_folder, stage

SEQUENCE = 1_024
WINDOW = 32                       # sequences of a window
ROUND = 1_024                     # windows of a round, at most
QUEUES = 64
PARTS = 32_768                    # parts of the encoded table, at most; with QUEUES it bounds what is broadcast
END_ID = 0
FILE = "byte_bpe_50k"
PIECES = "array<struct<doc_id: bigint, start: bigint, length: bigint, doc_tokens: bigint, offset: bigint>>"


# the schedule -------------------------------------------------------------------------------------
@dataclass
class Phase:
    """``rounds`` equal rounds of ``windows`` windows from window ``first`` on."""
    first: int
    windows: int
    rounds: int
    quanta: list[int]             # tokens of each queue in a round
    starts: list[int]             # place in each queue at which the phase begins
    _tables: tuple | None = field(default=None, repr=False)

    def tables(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Per queue and window: tokens of the queue before the window (with the end), and its place inside."""
        if self._tables is None:
            served = round_quotas(self.quanta, self.windows, size)
            before = np.zeros((len(self.quanta), self.windows + 1), np.int64)
            np.cumsum(served.T, axis=1, out=before[:, 1:])
            self._tables = before, (np.cumsum(served, axis=1) - served).T
        return self._tables


def round_quotas(quanta: list[int], windows: int, size: int) -> np.ndarray:
    """Tokens that each window takes of each queue (windows x queues); the last window may be short."""
    q, total = np.array(quanta, np.int64), sum(quanta)
    out = np.zeros((windows, len(q)), np.int64)
    done = np.zeros(len(q), np.int64)
    for w in range(windows):
        upto = min((w + 1) * size, total)
        credit = q * upto - done * total                      # deficits, in parts of a token (1/total)
        take = np.minimum(np.maximum(credit // total, 0), q - done)
        rest = upto - int(done.sum()) - int(take.sum())
        while rest:                                           # one token each: to the deepest deficits, or from the shallowest
            left = credit - take * total
            can = np.flatnonzero(done + take < q) if rest > 0 else np.flatnonzero(take > 0)
            best = can[np.argsort(-left[can] if rest > 0 else left[can], kind="stable")[:abs(rest)]]
            take[best] += 1 if rest > 0 else -1
            rest += -len(best) if rest > 0 else len(best)
        out[w] = take
        done += take
    return out


def whole_shares(weights: list[float | int], of: int, cap: list[int]) -> list[int]:
    """Whole numbers that add up to ``of`` in proportion to the weights, none above its cap (largest remainders).
    ``of`` is at most the sum of the caps; queues without weight are served last."""
    out, open_ = [0] * len(weights), [i for i, c in enumerate(cap) if c]
    while of and open_:
        total = sum(weights[i] for i in open_)
        part = {i: (weights[i] / total if total else 1 / len(open_)) * of for i in open_}
        if all(isinstance(weights[i], int) for i in open_) and total:
            part_floor = {i: weights[i] * of // total for i in open_}
            rest = {i: weights[i] * of % total for i in open_}
        else:
            part_floor = {i: int(part[i]) for i in open_}
            rest = {i: part[i] - part_floor[i] for i in open_}
        give = {i: min(part_floor[i], cap[i] - out[i]) for i in open_}
        lack = of - sum(give.values())
        for i in sorted(open_, key=lambda i: (-rest[i], i)):
            if lack > 0 and give[i] == part_floor[i] and out[i] + give[i] < cap[i] and rest[i] > 0:
                give[i] += 1
                lack -= 1
        if not any(give.values()):
            give[max(open_, key=lambda i: (rest[i], -i))] = 1
        for i, g in give.items():
            out[i] += g
            of -= g
        open_ = [i for i in open_ if out[i] < cap[i]]
    return out


def schedule(tokens: list[int], size: int, mixture: list[float] | None = None, windows: int = ROUND) -> list[Phase]:
    """Phases that pack all tokens of all queues into windows of ``size``. At most some ten phases per queue."""
    left, at, first, k, out = list(tokens), [0] * len(tokens), 0, windows, []
    due = [0.0] * len(tokens)                                 # what quanta have rounded away so far
    while sum(left):
        total = sum(left)
        if total <= size * (windows if mixture is None else 1):
            k, quanta, rounds = -(-total // size), list(left), 1
        else:
            k = min(k, total // size)
            share = [m * k * size for m in _shares(mixture, left)] if mixture is not None else left
            weights = left if mixture is None else [max(0.0, x + d) for x, d in zip(share, due)]
            quanta = whole_shares(weights, k * size, [k * size if n else 0 for n in left] if k > 1 else left)
            rounds = min(n // q for n, q in zip(left, quanta) if q)
            if rounds == 0:
                k = max(1, k // 2)
                continue
            if mixture is not None:
                rounds = 1 if any(abs(d) >= 1 for d in due) else rounds          # pay once, then go on
                due = [d + rounds * (x - q) for d, x, q in zip(due, share, quanta)]
        out.append(Phase(first, k, rounds, quanta, list(at)))
        first += k * rounds
        at = [a + q * rounds for a, q in zip(at, quanta)]
        left = [n - q * rounds for n, q in zip(left, quanta)]
        if any(q and not n for n, q in zip(left, quanta)):
            k, due = windows, [0.0] * len(left)
    return out


def _shares(mixture: list[float], left: list[int]) -> list[float]:
    """Targets of the queues that are not empty; where none of these has a target, by what is left."""
    total = sum(m for m, n in zip(mixture, left) if n)
    return [m / total if n else 0.0 for m, n in zip(mixture, left)] if total else [n / sum(left) for n in left]


class Placer:
    """Pieces of a stretch of a queue."""

    def __init__(self, phases: list[Phase], size: int, sequence: int):
        self.phases, self.size, self.sequence = phases, size, sequence
        self.starts = list(zip(*(p.starts for p in phases)))

    def pieces(self, queue: int, position: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, place in it, place in the stretch, and length of each piece of tokens [position, position + n)."""
        seqs, offs, begins, lens = [], [], [], []
        a, end, i = position, position + n, bisect_right(self.starts[queue], position) - 1
        while a < end:
            phase = self.phases[i]
            q = phase.quanta[queue]
            stop = min(end, phase.starts[queue] + q * phase.rounds)
            before, inside = (t[queue] for t in phase.tables(self.size))
            while a < stop:
                r, k = divmod(a - phase.starts[queue], q)
                upto = min(q, k + stop - a)
                w0, w1 = np.searchsorted(before, k, "right") - 1, np.searchsorted(before, upto, "left")
                lo, hi = np.maximum(before[w0:w1], k), np.minimum(before[w0 + 1:w1 + 1], upto)
                place = (phase.first + r * phase.windows + np.arange(w0, w1)) * self.size + inside[w0:w1] + lo - before[w0:w1]
                full = hi > lo
                lo, hi, place = lo[full], hi[full], place[full]
                # a window of several sequences is cut at their borders, too
                cuts = (place + (hi - lo) - 1) // self.sequence - place // self.sequence + 1
                if cuts.max() > 1:
                    rep = np.repeat(np.arange(len(cuts)), cuts)
                    nth = np.arange(len(rep)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                    border = (place[rep] // self.sequence + nth) * self.sequence
                    s, e = np.maximum(border, place[rep]), np.minimum(border + self.sequence, (place + hi - lo)[rep])
                    lo, hi, place = lo[rep] + s - place[rep], lo[rep] + e - place[rep], s
                seqs.append(place // self.sequence)
                offs.append(place % self.sequence)
                begins.append(lo - k + a - position)
                lens.append(hi - lo)
                a += upto - k
            i += 1
        return tuple(map(np.concatenate, (seqs, offs, begins, lens)))


# tokens -------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _encoders(name: str):
    """Fast encoder over the ranks form of the vocabulary, and the library's own over its JSON form; a test holds them
    equal, also for every single character."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path(f"{name}.json"))
    with open(tokenizer_path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, library


def encode(text: str | None, name: str = FILE) -> np.ndarray:
    """Ids of a text as unsigned 32-bit numbers."""
    fast, library = _encoders(name)
    try:
        return fast.encode_to_numpy(text or "", allowed_special="all")
    except BaseException as e:        # its pattern engine gives up on extremely long runs of one kind of character
        if not type(e).__name__ == "PanicException" and not isinstance(e, ValueError):
            raise
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


def queue_names(documents: DataFrame, mixture: dict[str | None, float] | None, queues: int = QUEUES) -> list[str | None]:
    """Sources that have a queue of their own; all others share one more. Reads the source column only."""
    rows = columns_of(documents, "source").select(F.col("source").cast("string").alias("source"))
    if mixture is not None:
        listed = [m for m in mixture if m is not None]
        rows = rows.filter(F.col("source").isin(listed) | (F.col("source").isNull() if None in mixture else F.lit(False)))
    top = rows.groupBy("source").count().orderBy(F.desc("count"), F.col("source").asc_nulls_first()).limit(queues - 1)
    return [r["source"] for r in top.collect()]


def encoded(documents: DataFrame, names: list[str | None], name: str = FILE, end_id: int = END_ID) -> DataFrame:
    """Stored (part, queue, before, doc_id, n, ids): ``before`` counts the tokens of the queue earlier in the part. Ids are
    little-endian 16-bit numbers where the vocabulary allows, else 32, packed by zstd."""
    schema = "part int, queue int, before bigint, doc_id bigint, n bigint, ids binary"
    arrow = arrow_schema(schema)
    number = {s: i for i, s in enumerate(names)}

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        form, small, part = id_form(name), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        done = [0] * (len(names) + 1)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                few = b.slice(at, 1_000)
                raw, n, queue, before = [], [], [], []
                for text, source in zip(few.column("text").to_pylist(), few.column("source").to_pylist()):
                    ids = np.append(encode(text, name), end_id).astype(form)
                    q = number.get(source, len(names))
                    queue.append(q)
                    before.append(done[q])
                    n.append(len(ids))
                    raw.append(small.compress(ids))
                    done[q] += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(queue, pa.int32()), pa.array(before, pa.int64()),
                     few.column("doc_id"), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], schema=arrow)
    docs = columns_of(documents, "doc_id", "source", "text")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    return stage(docs.coalesce(PARTS).mapInArrow(run, schema), "encoded")


def id_form(name: str) -> str:
    return "<u2" if _encoders(name)[0].max_token_value < 2 ** 16 else "<u4"


# packing ------------------------------------------------------------------------------------------
def earlier_parts(docs: DataFrame) -> DataFrame:
    """(part, queue, sum, earlier): tokens of a queue in a part and in all parts before."""
    sums = docs.groupBy("part", "queue").agg(F.sum("n").alias("sum"))
    return sums.withColumn("earlier", F.sum("sum").over(W.partitionBy("queue").orderBy("part")) - F.col("sum"))


def pack(documents: DataFrame, mixture: dict[str | None, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW,
         name: str = FILE, end_id: int = END_ID) -> DataFrame:
    """Stored sequences: sequence_id, n, ids (little-endian unsigned 32-bit, padded with the end id to ``sequence`` unless n is
    a power of two), pieces. A window is ``window`` sequences; ``mixture`` names target shares by source."""
    names = queue_names(documents, mixture)
    docs = encoded(documents, names, name, end_id)
    parts = stage(earlier_parts(docs), "queue-parts")
    tokens = [0] * (len(names) + 1)
    for r in parts.groupBy("queue").agg(F.sum("sum").alias("n")).collect():
        tokens[r["queue"]] = r["n"]
    shares = None if mixture is None else [*(float(mixture[s]) for s in names), 0.0]
    size = window * sequence
    phases = schedule(tokens, size, shares)
    cut = "sequence_id bigint, offset bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
    cut_arrow, form = arrow_schema(cut), id_form(name)
    width = np.dtype(form).itemsize

    def pieces(batches):
        import pyarrow as pa
        place, large = Placer(phases, size, sequence), zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                got: list[list] = [[] for _ in cut_arrow]
                for doc_id, n, raw, queue, position in zip(*(b.slice(at, 500).column(c).to_pylist()
                                                             for c in ("doc_id", "n", "ids", "queue", "position"))):
                    s, o, begin, length = (x.tolist() for x in place.pieces(queue, position, n))
                    raw = large.decompress(raw, n * width)
                    for column, values in zip(got, (s, o, [doc_id] * len(s), begin, length, [n] * len(s),
                                                    [raw[i * width:(i + m) * width] for i, m in zip(begin, length)])):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(got, cut_arrow)], schema=cut_arrow)

    out = f"sequence_id bigint, n int, ids binary, pieces {PIECES}"
    out_arrow = arrow_schema(out)

    def filled(batches):
        import pyarrow as pa
        now, raws, held, rows = None, [], [], []

        def close():
            ids = np.frombuffer(b"".join(raws), form).astype("<u4")
            n = len(ids)
            short = 0 if n & (n - 1) == 0 else sequence - n
            rows.append((now, n, np.append(ids, np.full(short, end_id, "<u4")).astype("<u4").tobytes(), held))
        for b in batches:
            for s, offset, doc_id, start, length, n, raw in zip(*(b.column(f.name).to_pylist() for f in cut_arrow)):
                if s != now:
                    if raws:
                        close()
                    now, raws, held = s, [], []
                raws.append(raw)
                held.append({"doc_id": doc_id, "start": start, "length": length, "doc_tokens": n, "offset": offset})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out_arrow)], schema=out_arrow)
                rows = []
        if raws:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out_arrow)], schema=out_arrow)

    near = F.expr("sequence_id div 64")
    before = F.broadcast(parts.select("part", "queue", "earlier"))                # at most PARTS x QUEUES rows
    placed = docs.join(before, ["part", "queue"]).select("doc_id", "n", "ids", "queue", (F.col("before") + F.col("earlier")).alias("position")) \
        .mapInArrow(pieces, cut).repartition(near).sortWithinPartitions("sequence_id", "offset")
    folder = shared_folder(documents.sparkSession, "sequences")
    placed.mapInArrow(filled, out).write.option("compression", "zstd").parquet(folder)
    return documents.sparkSession.read.schema(out).parquet(folder)


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, read from the sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    raw = F.substring(F.col("ids"), (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(raw).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
