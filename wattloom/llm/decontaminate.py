"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed in runs of ``K``; the fingerprint of a window of ``WINDOW`` words is the smallest of its
``WINDOW - K + 1`` hashes. It depends on the window alone, so a window that a document shares with an item has
the same fingerprint in both, and every shared span of ``WINDOW`` words is found. Neighbouring windows mostly
share their fingerprint and travel as one row. Fingerprints that meet are extended to the words themselves:
the windows of a hit are compared word by word. Items of 1 to 9 words are one window of their own length.

Documents are scanned twice: once for fingerprints, once for the texts that have a hit. The benchmark's
fingerprints are a written table, so Spark broadcasts them only if their size allows, else both sides are
shuffled by fingerprint.

A null or empty text has no words, is never hit and hits nothing. An empty benchmark hits nothing. Items without
an id count as hits but are not listed. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import ascii_lower, columns_of, free_name, let
from wattloom.session import stage

WINDOW, K = 10, 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _minima(w: Column) -> Column:
    """Fingerprint of every window of the words; null for fewer than WINDOW words."""
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, K)))
    return F.when(n >= WINDOW, let(grams, lambda g: F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda j: F.array_min(F.slice(g, j, WINDOW - K + 1)))))


_RUN = "array<struct<size:int,lo:int,hi:int,h:bigint>>"


def _runs(w: Column, lengths: list[int]) -> Column:
    """Runs of windows with one fingerprint: (size of the window, first, last, fingerprint)."""
    n = F.size(w)

    def runs(m):
        first = F.filter(F.sequence(F.lit(1), F.size(m)), lambda j: (j == 1) | (
            F.element_at(m, j) != F.element_at(m, F.greatest(j - 1, F.lit(1)))))
        return let(first, lambda s: F.transform(s, lambda j, i: F.struct(
            F.lit(WINDOW).alias("size"), j.alias("lo"), (F.coalesce(F.get(s, i + 1), F.size(m) + 1) - 1).alias("hi"),
            F.element_at(m, j).alias("h"))))
    parts = [F.when(n >= WINDOW, let(_minima(w), runs))]

    def whole(size):
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda j: F.struct(
            F.lit(size).alias("size"), j.alias("lo"), j.alias("hi"), F.xxhash64(F.slice(w, j, size)).alias("h"))))
    parts += map(whole, lengths)
    return F.concat(*[F.coalesce(p, F.array().cast(_RUN)) for p in parts])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Each distinct window: its words as text, size, fingerprint, and the items that hold it."""
    def windows(w):
        n = F.size(w)
        long = let(_minima(w), lambda m: F.transform(m, lambda h, i: F.struct(
            F.lit(WINDOW).alias("size"), F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("window"), h.alias("h"))))
        short = F.array(F.struct(n.alias("size"), F.array_join(w, " ").alias("window"), F.xxhash64(w).alias("h")))
        return F.when(n >= WINDOW, long).when(n > 0, short)
    each = columns_of(benchmark, "item_id", "text").select("item_id", F.explode(let(words(F.col("text")), windows)).alias("x"))
    return each.groupBy("x.window", "x.size", "x.h").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, _text (hash of the text), n_words, n_hit, items (sorted list)."""
    docs = columns_of(documents, "doc_id", "text")
    windows = stage(benchmark_windows(benchmark), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("size").distinct().collect() if r[0] < WINDOW)  # 9 at most
    marks = stage(windows.select("size", "h").distinct(), "benchmark-marks").withColumn("_hit", F.lit(True))

    # each document also sends one row of size -1 that carries its number of words
    def sent(w):
        own = F.struct(F.lit(-1).alias("size"), F.size(w).alias("lo"), F.size(w).alias("hi"), F.xxhash64("text").alias("h"))
        return F.concat(F.array(own), _runs(w, lengths))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.explode(let(words(F.col("text")), sent)).alias("x")) \
        .select("doc_id", "_text", "x.*")
    met = rows.join(marks, ["size", "h"], "left").filter("size = -1 or _hit")
    run = F.when(F.col("size") > 0, F.struct("size", "lo", "hi"))
    base = stage(met.groupBy("doc_id", "_text").agg(
        F.max(F.when(F.col("size") == -1, F.col("lo"))).alias("n_words"),
        F.sum((F.col("size") == -1).cast("int")).alias("_copies"), F.collect_set(run).alias("_runs")), "met")

    # words of the documents that have a hit, window by window
    again = docs.withColumn("_text", F.xxhash64("text")).join(base.filter(F.size("_runs") > 0).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "_runs"),
                      (F.col("_text") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    places = let(words(F.col("text")), lambda w: F.flatten(F.transform("_runs", lambda r: F.transform(
        F.sequence(r["lo"], r["hi"]), lambda p: F.struct(
            p.alias("at"), r["size"].alias("size"), F.array_join(F.slice(w, p, r["size"]), " ").alias("window"))))))
    found = again.select("doc_id", "_text", F.explode(places).alias("x")).select("doc_id", "_text", "x.*") \
        .join(windows.select("window", "items"), "window")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort("_at"), start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(a["end"], x["at"]))).alias("n"),
        F.greatest(a["end"], x["at"] + x["size"]).alias("end")), lambda a: a["n"])
    hits = found.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")) \
        .agg(F.collect_set("items").alias("_items"), F.collect_set(F.struct("at", "size")).alias("_at")) \
        .select("_d", "_t", covered.alias("_hit"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("_items"))
    out = base.drop("_runs").join(hits, (F.col("_text") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return out.select("doc_id", "_text", F.col("n_words").cast("bigint").alias("n_words"),
                      F.coalesce("_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
                      F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``documents`` without a hit, with all their columns. A row goes by its doc_id and the hash of its text, so equal
    hashes of different documents take nothing along."""
    d, t = free_name(documents, "_bad_doc"), free_name(documents, "_bad_text")
    bad = contamination(documents, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias(d), F.col("_text").alias(t)).distinct()
    return documents.join(bad, (F.xxhash64("text") == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_anti")
