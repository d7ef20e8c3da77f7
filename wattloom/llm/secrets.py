"""Secrets in texts: patterns, and a battery of randomness tests, in DataFrame functions only.

Patterns (assign, access, hex) find the usual forms. For every other long run of code characters an encoding is
inferred (hex, base32, base64), and the run is tested as a sample of that alphabet:

* chi-squared test of uniform use of the alphabet,
* runs test of the two halves of the alphabet,
* serial correlation of neighbouring characters.

A run that no test rejects may be random, but a short one passes easily. So each also gets the probability that
ordinary text of its encoding repeats its characters as rarely, and the false discovery rate (``RATE``) is
controlled over all runs of the corpus within a class of encoding and length: the counts of p values per class
(a table of fixed size) give the step-up threshold of Benjamini and Hochberg.

Spans count code points, end exclusive. A null text counts as empty and has no spans. Repeated rows give
repeated results; other columns are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import columns_of, free_name, let

RATE = 0.01
KINDS = ("assign", "access", "hex", "random")
# The patterns of the three plain kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"                 # of AKIA[A-Z0-9]+ those with 20 characters or more
HEX = r"[0-9a-f]{24,}"                        # of [0-9a-f]+ those with 24 characters or more
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: alphabet, and the share of equal pairs of characters in ordinary text of the encoding (numbers, capitals, names)
ENCODINGS = {"hex": (HEX_DIGITS, 0.10), "base32": (BASE32, 0.065), "base64": (BASE64, 0.045)}
LIMIT = 2.6                                   # of the normal scores of the three tests
BINS, PER_TEN = 80, 4                         # classes of -log10 p

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _may_hold(text: Column, pattern: str) -> Column:
    """Whether a pattern matches at all; a plain search for a part that it cannot do without comes first."""
    sign = {ASSIGN: text.contains("=") | text.contains(":"), ACCESS: text.contains("AKIA"), RUN: text.rlike("[0-9]")}
    return (sign[pattern] if pattern in sign else F.lit(True)) & text.rlike(pattern)


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of all matches: what lies between them and their own lengths add up to their places. Matches
    whose second group is shorter than ``least`` are passed over."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    matches = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                           F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if least else 0)).alias("value"),
                           F.split(text, pattern, -1).alias("before"))

    def step(a, m):
        lo = a["at"] + F.length(m["before"])
        hi = lo + F.length(m["found"])
        one = F.array(F.struct(lo.alias("start"), F.lit(kind).alias("kind"), hi.alias("end")))
        keep = F.length(m["value"]) >= least            # the piece after the last match has none
        return F.struct(hi.alias("at"), F.when(keep, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))
    return F.when(_may_hold(text, pattern), F.aggregate(matches, start, step, lambda a: a["out"]))


def base_spans(text: Column) -> list[Column]:
    none = F.array().cast(_SPAN)
    return [F.coalesce(c, none) for c in (_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))]


def _normal(z: Column) -> Column:
    """Distribution function of the normal law, by its logistic approximation."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), 1.5976 * z + 0.070565 * z * z * z))))


def _tested(run: Column) -> Column:
    """Encoding, length class, class of the p value, and whether no test rejects; null where none fits."""
    bare = F.rtrim(run, F.lit("="))
    encoding = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$") & bare.rlike("[0-9]") & bare.rlike("[A-Fa-f]"), "hex") \
        .when(bare.rlike("^[A-Z2-7]+$") & bare.rlike("[2-7]") & bare.rlike("[A-Z]"), "base32") \
        .when(bare.rlike("[0-9]") & bare.rlike("[a-z]") & bare.rlike("[A-Z]"), "base64")
    plain = F.when(encoding == "hex", F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))

    def battery(name: str) -> Column:
        alphabet, repeats = ENCODINGS[name]
        size = len(alphabet)

        def sums(plain):
            """Length, sum of squared counts, second half's characters, changes of half, codes."""
            counts = F.transform(F.lit(list(alphabet)), lambda c: F.length(plain) - F.length(F.replace(plain, c, F.lit(""))))
            halves = F.translate(plain, alphabet, "a" * (size // 2) + "b" * (size // 2))
            return F.struct(
                F.length(plain).cast("double").alias("n"),
                F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c).alias("squares"),
                F.length(F.replace(halves, F.lit("a"), F.lit(""))).cast("double").alias("ones"),
                F.length(F.regexp_replace(halves, "a+|b+", "x")).cast("double").alias("runs"),
                F.transform(F.split(plain, "(?!^)"), lambda c: F.instr(F.lit(alphabet), c).cast("double")).alias("codes"))

        def centred(s):
            mean = F.aggregate(s["codes"], F.lit(0.0), lambda a, x: a + x) / s["n"]
            return F.struct(s.alias("s"), let(mean, lambda m: F.transform(s["codes"], lambda x: x - m)).alias("x"))

        def verdict(t):
            s, x = t["s"], t["x"]
            n = s["n"]
            chi = (s["squares"] * size / n - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
            pairs = 2 * s["ones"] * (n - s["ones"])
            spread = pairs * (pairs - n) / (n * n * (n - 1))
            runs = F.when(spread > 0, F.abs(s["runs"] - 1 - pairs / n) / F.sqrt(spread)).otherwise(F.lit(99.0))
            power = F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
            along = F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda y, z: y * F.coalesce(z, F.lit(0.0))),
                                F.lit(0.0), lambda a, y: a + y)
            serial = F.when(power > 0, F.abs(along / power + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
            equal = (s["squares"] - n) / (n * (n - 1))
            p = _normal((equal - repeats) / F.sqrt(2 * repeats * (1 - repeats) / (n * (n - 1))))
            return F.struct(
                F.concat(F.lit(name + ":"), F.floor(F.log2(n)).cast("string")).alias("group"),
                F.least(F.lit(BINS), F.floor(-F.log10(p) * PER_TEN)).cast("int").alias("bin"),
                ((chi <= LIMIT) & (runs <= LIMIT) & (serial <= LIMIT)).alias("random"))
        return let(let(let(plain, sums), centred), verdict)
    out = F.when(encoding == "hex", battery("hex")).when(encoding == "base32", battery("base32"))
    return out.when(encoding == "base64", battery("base64"))


def _candidates(text: Column) -> Column:
    """Long runs with their tests: array of (start, kind, end, test)."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    spans = _spans(text, RUN, 3)
    each = F.zip_with(spans, runs, lambda s, r: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), let(r, _tested).alias("test")))
    return F.filter(each, lambda x: x["test"].isNotNull())


def thresholds(documents: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Smallest class of p values that the step-up rule accepts, per class of encoding and length.

    The table has a row per class (3 encodings, lengths by powers of two) at most, whatever the corpus.
    """
    text = F.coalesce("text", F.lit(""))
    tests = columns_of(documents, "doc_id", "text").select(text.alias("text")).filter(_may_hold(F.col("text"), RUN)) \
        .select(F.explode(_candidates(F.col("text"))).alias("x")).select("x.test.*")
    counts = tests.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("random").cast("long")).alias("found"))
    held: dict[str, dict[int, int]] = {}
    total: dict[str, int] = {}
    for r in counts.collect():                                     # at most 3 x 20 x 81 rows
        held.setdefault(r["group"], {})[r["bin"]] = r["found"]
        total[r["group"]] = total.get(r["group"], 0) + r["n"]
    out = {}
    for group, found in held.items():
        good = [b for b in range(BINS + 1)
                if total[group] * 10 ** (-b / PER_TEN) <= rate * sum(n for at, n in found.items() if at >= b)]
        out[group] = min(good, default=BINS + 1)
    return out


def with_spans(documents: DataFrame, accept: dict[str, int], _base: str = "_base", _all: str = "_all") -> DataFrame:
    """Adds two sorted arrays of (start, kind, end): the base spans, and all spans."""
    _more = free_name(documents, "_more")
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(_SPAN)
    table = F.create_map(*[F.lit(x) for kv in accept.items() for x in kv]) if accept else None
    df = documents.withColumn(_base, F.array_sort(F.concat(*base_spans(text))))
    if table is None:
        return df.withColumn(_all, F.col(_base))
    chosen = F.filter(_candidates(text), lambda x: x["test"]["random"] & (
        x["test"]["bin"] >= F.coalesce(F.element_at(table, x["test"]["group"]), F.lit(BINS + 1))))
    more = F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = df.withColumn(_more, F.coalesce(more, none))
    apart = F.filter(_more, lambda x: ~F.exists(_base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return df.withColumn(_all, F.when(F.size(_more) > 0, F.array_sort(F.concat(_base, apart))).otherwise(F.col(_base))) \
        .drop(_more)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.lit(list(KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(documents: DataFrame, rate: float = RATE) -> DataFrame:
    docs = columns_of(documents, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    found = with_spans(docs, thresholds(docs, rate)).select("doc_id", "_base", "_all")
    def count(k):
        return F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"),
                        _joined("_all").alias("spans"))


def redact(documents: DataFrame, mask: str = "[secret]", rate: float = RATE) -> DataFrame:
    """Replaces every span by ``mask`` and brings n_chars up to date; all rows and columns stay."""
    spans = free_name(documents, "_spans")
    found = with_spans(documents, thresholds(documents, rate), free_name(documents, "_found"), spans)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(F.lit(0), x["start"] - a["at"]))
        more = F.when(x["start"] >= a["at"], F.array(gap, F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], more).alias("out"))
    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col("text"))
    out = found.withColumn("text", clean)
    if "n_chars" in documents.columns:
        n = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
