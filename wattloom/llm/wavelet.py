"""Token ids of a corpus as wavelet-matrix files.

One file holds the ids of consecutive documents as succinct bit-planes: plane after plane the ids are split
stably by one bit, highest bit first. With ranks over the planes a file answers, without being unpacked: the id
at a place, how often an id occurs before a place, and where its k-th occurrence stands.

File layout: magic, length of a JSON head, the head, then the zstd-compressed sections it lists.

A null or empty text has the end id alone. Null doc_ids come first. Repeated rows are all kept, next to each
other; other columns are ignored. An empty table gives no file and no row.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.bpe import spaced
from wattloom.llm.common import (
    TOKENIZER,
    arrow_schema,
    columns_of,
    drop_large_caches,
    large_cache,
    map_batches,
    tokenizer_path,
)
from wattloom.session import shared_folder, stage

MAGIC = b"WVMX0001"
IDS_PER_FILE = 4_000_000
END_ID = 1
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
KNOWN = 450_000                   # stretches that a worker keeps, in each of two generations: some 160 bytes each
SLICE = 2 << 20                   # bytes of text that are encoded together; long texts one by one
MARK, SHORT, TOGETHER = "\x02", 64, 200             # what stands between short stretches that the library gets as one text


class WaveletMatrix:
    """Bit-planes of a sequence of ids, highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes            # planes: packed bits, uint8
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        planes, a = [], ids
        for shift in range(bits - 1, -1, -1):
            ones = (a & ids.dtype.type(1 << shift)) != 0
            planes.append(np.packbits(ones))
            a = np.concatenate((a.compress(~ones), a.compress(ones)))      # a mask as index takes three times as long
        return cls(len(ids), planes)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def all(self, dtype=np.uint32) -> np.ndarray:
        """Every id, rebuilt from the lowest plane up."""
        a = np.zeros(self.n, dtype)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = self.bits(level)
            places = np.flatnonzero(ones)                  # a mask as index takes three times as long
            zeros, out = self.n - len(places), np.empty_like(a)
            out[places] = a[zeros:] | dtype(1 << (len(self.planes) - 1 - level))
            out[np.flatnonzero(~ones)] = a[:zeros]
            a = out
        return a

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before place i: stored per byte block, the rest counted."""
        if self._ranks[level] is None:
            counts = np.bitwise_count(self.planes[level]).astype(np.int64)
            self._ranks[level] = np.concatenate(([0], np.cumsum(counts)))
        whole, rest = divmod(i, 8)
        extra = int(self.planes[level][whole] >> (8 - rest)).bit_count() if rest else 0
        return int(self._ranks[level][whole]) + extra

    def _zeros(self, level: int) -> int:
        return self.n - self._ones(level, self.n)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            one = self.planes[level][i // 8] >> (7 - i % 8) & 1
            value = value * 2 + int(one)
            i = self._zeros(level) + self._ones(level, i) if one else i - self._ones(level, i)
        return value

    def _interval(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(len(self.planes)):
            if token >> (len(self.planes) - 1 - level) & 1:
                zeros = self._zeros(level)
                lo, hi = zeros + self._ones(level, lo), zeros + self._ones(level, hi)
            else:
                lo, hi = lo - self._ones(level, lo), hi - self._ones(level, hi)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before ``end`` (in all, if not given)."""
        if token < 0 or token >> len(self.planes):
            return 0
        lo, hi = self._interval(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._interval(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            at = self._place(level, at - self._zeros(level) if one else at, one)
        return at

    def _place(self, level: int, k: int, one: int) -> int:
        """Place of the k-th bit that is ``one``, by bisection over the ranks."""
        lo, hi = 0, self.n - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            lo, hi = (lo, mid) if (ones if one else mid + 1 - ones) > k else (mid + 1, hi)
        return lo

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]


def pack(doc_ids: list[int | None], lengths: list[int], matrix: WaveletMatrix) -> bytes:
    import zstandard
    press = zstandard.ZstdCompressor(level=1).compress
    sections = [press(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()),
                press(np.packbits([d is None for d in doc_ids]).tobytes()),
                press(np.array(lengths, "<i8").tobytes()), *(press(p.tobytes()) for p in matrix.planes)]
    head = json.dumps({"ids": matrix.n, "documents": len(doc_ids), "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    import zstandard
    if content[:8] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    size = struct.unpack_from("<I", content, 8)[0]
    head, at, parts = json.loads(content[12:12 + size]), 12 + size, []
    for n in head["sections"]:
        parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(content[at:at + n]), np.uint8))
        at += n
    missing = np.unpackbits(parts[1], count=head["documents"])
    doc_ids = [None if m else d for d, m in zip(parts[0].view("<i8").tolist(), missing.tolist())]
    return doc_ids, parts[2].view("<i8"), WaveletMatrix(head["ids"], parts[3:])


class IdTable:
    """Ids of numbered stretches in one array, with the place and the number of the ids of each."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.size = dtype, 0
        self.starts, self.lengths, self.ids = bytearray(), bytearray(), bytearray()

    def append(self, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The next numbers; ``starts`` count from the first of ``ids``."""
        self.starts += (starts + len(self.ids) // self.dtype.itemsize).astype(np.int64).tobytes()
        self.lengths += lengths.astype(np.int64).tobytes()
        self.ids += ids.astype(self.dtype).tobytes()
        self.size += len(starts)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each, and the ids of all in a row."""
        starts, lengths = (np.frombuffer(b, np.int64) for b in (self.starts, self.lengths))
        n = lengths[numbers]
        ends = np.cumsum(n)
        small = max(len(self.ids), ends[-1] if len(n) else 0) < 1 << 31            # half the memory for the places
        places = np.repeat((starts[numbers] - (ends - n)).astype(np.int32 if small else np.int64), n)
        places += np.arange(len(places), dtype=places.dtype)
        return n, np.frombuffer(self.ids, self.dtype)[places]


class Numbers(dict):
    """stretch -> its number in a table of ids. New stretches get the next numbers and wait in ``new`` until ``settle``
    has their ids. Two generations of ``limit`` short stretches are kept; the older one goes when the younger is full."""

    def __init__(self, dtype: np.dtype, limit: int = KNOWN):
        super().__init__()
        self.limit, self.new = limit, []
        self.table, self.old, self.old_table = IdTable(dtype), {}, IdTable(dtype)

    def __missing__(self, stretch: str) -> int:
        number = self[stretch] = self.table.size + len(self.new)
        self.new.append(stretch)
        return number

    def settle(self, make) -> None:
        """Ids of the new stretches: from the older generation, else by ``make`` (stretches to lengths and ids). Should that
        fail, they are new again."""
        new, self.new = self.new, []
        try:
            self._settle(new, make)
        except BaseException:
            for c in new:
                del self[c]
            raise
        for c in new:
            if len(c) > SHORT:
                del self[c]

    def _settle(self, new: list[str], make) -> None:
        before = np.fromiter((self.old.get(c, -1) for c in new), np.int64, len(new))
        unknown = np.flatnonzero(before < 0)
        made, ids = make([new[k] for k in unknown.tolist()])
        again = np.flatnonzero(before >= 0)
        kept, kept_ids = self.old_table.gather(before[again])
        starts, lengths = np.empty((2, len(new)), np.int64)
        for which, n, at in ((unknown, made, 0), (again, kept, len(ids))):
            lengths[which], starts[which] = n, at + np.cumsum(n) - n
        self.table.append(starts, lengths, np.concatenate((ids, kept_ids)))

    def trim(self) -> None:
        if self.table.size >= self.limit or len(self.table.ids) >= 64 * self.limit:
            self.old, self.old_table = dict(self), self.table
            self.clear()
            self.table = IdTable(self.table.dtype)


def _one_line(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


class LibraryEncoder:
    """Ids by the tokenizers library. It sees every distinct stretch between blanks, tabs and line ends once: no token
    crosses white space, so the ids of a text are those of its stretches in a row. New stretches go to it many at a time
    as one text, as a call for each takes twice the time. Where tokens that end a word differ from others, words of letters
    stand next to each other and such tokens show where one ends; other short stretches have a mark between them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the worker has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = "Lowercase" in str(self.library.normalizer)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.mark, self.ends = self._mark(), self._ends()
        self.known = Numbers(self.dtype)

    def raw(self, ids) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _mark(self) -> int | None:
        """Id of the mark, if it is one token that leaves its neighbours as they are."""
        word, mark, both = (self.library.encode(t, add_special_tokens=False).ids for t in ("a", MARK, f"a {MARK} a"))
        return mark[0] if len(mark) == 1 and both == word + mark + word and mark != word else None

    def _ends(self) -> np.ndarray | None:
        """For each id whether its token ends a word, if the tokens say so."""
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocab = self.library.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.frombuffer(self.raw(e.ids), self.dtype) for e in found]

    def _words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Lengths and ids of words of letters, nothing if one is not a single word to the library: each has at least one
        end, so as many ends as words are one end each."""
        ids = self._ids([" ".join(some)])[0]
        ends = np.flatnonzero(self.ends[ids])
        return (np.diff(ends, prepend=-1), ids) if len(ends) == len(some) and ends[-1] == len(ids) - 1 else None

    def _marked(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of stretches without the mark's character: only one with it can have the mark's id."""
        ids = self._ids([f" {MARK} ".join(some)])[0]
        is_mark = ids == self.mark
        lengths = np.diff(np.flatnonzero(is_mark), prepend=-1, append=len(ids)) - 1
        if len(lengths) != len(some):
            raise RuntimeError("the tokenizer does not keep stretches apart")
        return lengths, ids[~is_mark]

    def _alone(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(some)
        return np.array([len(i) for i in ids], np.int64), np.concatenate(ids)

    def stretches(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of stretches, in their order."""
        words, marked, alone = [], [], []
        for k, c in enumerate(new):
            if len(c) > SHORT or MARK in c or self.mark is None:
                alone.append(k)
            else:
                (words if self.ends is not None and c.isalpha() else marked).append(k)
        table, order = IdTable(self.dtype), []
        for group, way in ((words, self._words), (marked, self._marked), (alone, self._alone)):
            for at in range(0, len(group), TOGETHER):
                few = group[at:at + TOGETHER]
                some = [new[k] for k in few]
                lengths, ids = way(some) or self._marked(some)
                table.append(np.cumsum(lengths) - lengths, lengths, ids)
                order += few
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        return table.gather(place)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        known = self.known
        known.trim()
        cut = pc.split_pattern(pa.array([_one_line(spaced(t, self.lower)) for t in texts], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        places = cut.flatten().dictionary_encode()         # fewer look-ups: a stretch once for all these texts
        distinct = places.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        known.settle(self.stretches)
        lengths, ids = known.table.gather(numbers[places.indices.to_numpy()])
        bounds = np.concatenate(([0], np.cumsum(lengths)))[ends] * self.dtype.itemsize
        raw, bounds = ids.tobytes(), bounds.tolist()
        return [raw[lo:hi] for lo, hi in zip(bounds, bounds[1:])]


@large_cache
@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) in their order, at most ``most`` bytes of text or a single row at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1).cast(pa.large_string())), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_ids(documents: DataFrame, folder: str, file: str = TOKENIZER, end_id: int = END_ID,
              ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write the files below ``folder`` (a URI that all executors reach) in ascending doc_id order.

    Returns the manifest (part, file, name, documents, ids). One range shuffle; a task writes as many files as
    its ids need, so memory is bounded. Names follow partition and place, content is deterministic, and each
    file is moved into place when whole: a repeated task leaves the same files.
    """
    schema = "part int, file int, name string, documents bigint, ids bigint"
    arrow = arrow_schema(schema)
    docs = columns_of(documents, "doc_id", "text")
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = library_encoder(tokenizer_path(file))
        end, width = encoder.raw([end_id]), encoder.dtype.itemsize
        ids, lengths, raws, total, number = [], [], [], 0, 0

        def flush():
            nonlocal ids, lengths, raws, total, number
            name = f"part-{part:07d}-{number:05d}.wm"
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(raws), encoder.dtype))
            with store.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                out.write(pack(ids, lengths, matrix))
            store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            row = [[part], [number], [name], [len(ids)], [matrix.n]]
            ids, lengths, raws, total, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        store.create_dir(base, recursive=True)
        for b in batches:
            for few in slices(b):
                for d, raw in zip(few.column(0).to_pylist(), encoder.encode(few.column(1).to_pylist())):
                    ids.append(d)
                    raws.append(raw + end)
                    lengths.append(len(raw) // width + 1)
                    total += lengths[-1]
                    if total >= ids_per_file:
                        yield flush()
        if ids:
            yield flush()
    return stage(ordered.mapInArrow(run, schema), "id-manifest")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, place of its first id in the corpus, number of ids, their crc32."""
    before = manifest.select("name", (F.sum("ids").over(W.orderBy("part", "file")) - F.col("ids")).alias("before"))
    if not manifest.take(1):
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def rows(cols):
        drop_large_caches()                                # the encoder has done its work
        out = {"name": [], "doc_id": [], "at": [], "n_tokens": [], "ids_crc32": []}
        for name, content in zip(cols["name"], cols["content"]):
            doc_ids, lengths, matrix = unpack(content)
            ids = matrix.all(np.uint16 if len(matrix.planes) <= 16 else np.uint32).astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            out["name"] += [name] * len(doc_ids)
            out["doc_id"] += doc_ids
            out["at"] += starts.tolist()
            out["n_tokens"] += lengths.tolist()
            out["ids_crc32"] += [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
        return out
    read = map_batches(files, "name string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint", rows)
    return read.join(before, "name").select("doc_id", (F.col("before") + F.col("at")).alias("start"),
                                            "n_tokens", "ids_crc32")


def token_id_files(documents: DataFrame, file: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write a corpus as files in the cluster's shared folder and report its documents as the files hold them."""
    spark = documents.sparkSession
    folder = shared_folder(spark, "token-ids")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_ids(spark, folder, write_ids(documents, folder, file, end_id))
