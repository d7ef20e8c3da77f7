"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOKENIZER = "word_bpe_49k.json"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that separate words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower case.
_WORD_BREAKS = bytes(32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))


_CACHES: list = []                # of this Python process: functions whose lru_cache holds an operator's large tables


def large_cache(make):
    """Mark a function with an lru_cache as the holder of large tables that an operator keeps in a worker."""
    _CACHES.append(make)
    return make


def drop_large_caches() -> None:
    """Let go of the tables that operators before this one have left in the worker. A worker serves one stage after another,
    so they would lie beside what the next one needs."""
    full = [c for c in _CACHES if c.cache_info().currsize]
    for c in full:
        c.cache_clear()
    if full:
        gc.collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on this machine (each executor has the package)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def map_batches(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Apply ``rows`` (columns as lists in, columns as lists out) to every Arrow batch."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = rows({n: b.column(n).to_pylist() for n in b.schema.names})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(StructType.fromDDL(ddl))


def ascii_lower(c):
    """A-Z to a-z; other letters stay as they are (``lower`` would change them)."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().translate(_WORD_BREAKS).split() if text else []


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; a missing one is null. Further columns of any name are left behind."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])


def let(value, body):
    """``body`` of a value that is computed once, also where the body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
