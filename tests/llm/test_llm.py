import itertools
import random
import re
import sys
import zlib
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from wattloom.llm import bpe, decontaminate, html, jaccard, licenses, quality, secrets, sharding, topk, wavelet  # noqa: E402
from wattloom.llm.common import tokenizer_path  # noqa: E402

R = random.Random(4)
VOCABULARY = ["".join(R.choice("bdfgklmnprst") + R.choice("aeiouáü") for _ in range(R.randint(1, 4))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def edited(text, edits, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


BASE = prose(200, 1)
ITEM = prose(30, 2)
KEY = "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
TEXTS = [
    None, "", "   \n\t", "One", "one two three", "ONE two three", BASE, BASE, BASE.upper(), edited(BASE, 3, 1), edited(BASE, 5, 2),
    edited(BASE, 9, 3), *(edited(BASE, k % 6, 50 + k) for k in range(30)), prose(300, 9) + " " + ITEM + " " + prose(20, 10),
    ITEM, " ".join(ITEM.split()[4:14]), " ".join(ITEM.split()[4:13]), "zu short item here", prose(9, 30), "the " * 4000,
    prose(30000, 11), "a" * 50_000, "é" * 3000, "ab" * 9000, "tOkEn = 'abc' token=token:abcdefg password: \"s3cr3t_value\"",
    "AKIA" + "Z9" * 9 + " x AKIA123 " + "0af" * 9, f"é😀 {KEY} mixed {KEY[::-1]}", "api_key=" + "f" * 40,
    "Licensed under the Apache License, Version 2.0", "GNU General Public License. CC BY-NC 4.0; MIT License mit license",
    "It's I'LL <|endoftext|> ΑΣ İx ﬁ ½ a\x1cb x..., y!. z.", "\x00\x7f�"]
ROWS = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS)] + [(6, BASE, "x", "y", 1), (None, prose(50, 70), None, None, None)]
COLUMNS = "doc_id bigint, text string, lang string, node string, label int"       # two names that the operators use inside
ITEMS = [(1, ITEM), (2, ITEM), (10, "zu short item"), (3, None), (4, ""), (5, prose(9, 30)), (None, prose(12, 77)), (1, ITEM)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(extra=()):
    return [(r[0], r[1]) for r in ROWS] + list(extra)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_near_duplicates(docs, empty):
    assert rows(jaccard.near_duplicates(docs)) == sorted(brute.components(plain()), key=repr)
    assert rows(jaccard.near_duplicates(empty)) == []


def test_wide_masks_lose_no_pair():
    """Masks differ in no more places than the sets do and, at sizes that may be similar, in most of them."""
    rng = np.random.default_rng(3)
    for n, m, common in ((1, 1, 1), (1, 1, 0), (100, 120, 90), (128, 129, 128), (900, 1100, 880), (5, 40_000, 5), (3000, 3000, 0)):
        pool = rng.integers(0, 1 << 64, n + m - common, np.uint64)
        x, y = pool[:n], pool[n - common:]
        differ = n + m - 2 * common
        found = jaccard.wide_difference(jaccard.wide_mask(x), jaccard.wide_mask(y))
        assert found <= differ and found % 2 == differ % 2
        assert found >= differ * 0.5 or max(n, m) > 2 * min(n, m)
        assert jaccard.wide_difference(jaccard.wide_mask(x), jaccard.wide_mask(x)) == 0


def test_near_duplicates_keep_one_of_each_group(docs):
    kept = rows(jaccard.drop_near_duplicates(docs).select("doc_id", "node"))
    full = brute.components(plain())
    assert [k[0] for k in kept] == [r[0] for r in sorted({r for r in full if r[0] == r[2] or r[1] == 0}, key=repr)]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id bigint, text string, h int")
    expected = brute.contamination(plain(), ITEMS)
    assert rows(decontaminate.report(docs, items)) == sorted(expected, key=repr)
    assert rows(decontaminate.report(empty, items)) == []
    assert not any(r[5] for r in rows(decontaminate.report(docs, items.limit(0))))
    clean = [r[0] for r in rows(decontaminate.drop_contaminated(docs, items).select("doc_id"))]
    assert clean == sorted((r[0] for r in expected if not r[5]), key=repr)


def test_secrets(docs, empty):
    got = rows(secrets.report(docs))
    assert [r[:5] for r in got] == sorted(brute.base_secrets(plain()), key=repr)
    text = next(t for t in TEXTS if t and KEY in t)
    spans = next(r[5] for r in got if r[0] == TEXTS.index(text))
    assert f"random:{text.index(KEY)}:{text.index(KEY) + len(KEY)}" in spans
    assert not any("random" in r[5] for r in got if r[0] in (6, TEXTS.index("a" * 50_000), TEXTS.index("ab" * 9000)))
    assert rows(secrets.report(empty)) == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[TEXTS.index(text)] == "é😀 [secret] mixed [secret]" and clean[6] == BASE and clean[0] is None


def test_bpe_equals_the_library(docs, empty, library):
    expected = []
    for d, t in plain():
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    assert rows(bpe.bpe_round_trip(docs)) == sorted(expected, key=repr)
    assert rows(bpe.bpe_round_trip(empty)) == []


def test_transducer_is_stable_over_its_lookahead(library):
    model, r = bpe.load(tokenizer_path()), random.Random(8)
    for n in (1, 700, 3000):
        for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "é"):
            word = "".join(r.choice(letters) for _ in range(n))
            want = library.encode(word, add_special_tokens=False).ids
            assert model.encode(word) == want
            assert list(model.stream(word.encode(), model.lookahead + 20)) == want
    assert model.text(model.encode("Éa b 😀")) == "éa b 😀 "


def test_encoded_ids_round_trip(docs):
    back = bpe.decode_ids(bpe.encode_ids(docs.filter("doc_id in (0, 3, 4)")))
    assert rows(back) == [(0, ""), (3, "one "), (4, "one two three ")]


def test_token_files(docs, empty, library, spark, tmp_path):
    at, expected = 0, []
    for d, t in sorted(plain(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows(wavelet.token_id_files(docs)) == sorted(expected, key=repr)
    folder = f"file://{tmp_path}/ids"
    manifest = wavelet.write_ids(docs, folder, ids_per_file=5000)          # many files
    assert manifest.count() > 5 and rows(wavelet.read_ids(spark, folder, manifest)) == sorted(expected, key=repr)
    assert rows(wavelet.token_id_files(empty)) == []


def test_wavelet_matrix():
    for n, top in ((0, 1), (1, 1), (999, 7), (3000, 60_000)):
        a = np.random.default_rng(n).integers(0, top, n).astype("<u4")
        m = wavelet.WaveletMatrix.of(a)
        _, _, m = wavelet.unpack(wavelet.pack([None], [n], m))
        assert (m.all() == a).all()
        for i in range(0, n, 97):
            t = int(a[i])
            assert m.access(i) == t and m.rank(t, i) == (a[:i] == t).sum() and m.occurrences(t) == np.flatnonzero(a == t).tolist()
        assert m.rank(1 << 30) == 0


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.integers(-3, 4, 6) / 256], 7) for i in range(230)]
    vectors += [(1000, None, 7), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 7), (1100, [float("nan")] * 6, 7),
                (1150, [float("inf")] * 6, 7), (None, [1.0] * 6, 7), (1200, [0.5, 0.25], 7), (3, vectors[3][1], 7), (1250, [], 7)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, low int").repartition(6)
    got = rows(topk.top_k(topk.scaled(df), F.col("vec_id") % 50 == 0, 5))
    whole = {i: np.floor(np.array(v) * 256) for i, v, _ in vectors[:230]}
    expected = []
    for q in range(0, 230, 50):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert got == sorted(expected, key=repr)
    few = df.filter("vec_id < 3")
    assert len(rows(topk.top_k(topk.scaled(few), F.col("vec_id") == 0, 5))) == 2
    assert rows(topk.top_k(topk.scaled(df.limit(0)), F.col("vec_id") == 0, 5)) == []


def test_licenses(docs, empty):
    got = {r[0]: r for r in rows(licenses.scan(docs)) if r[0] is not None}
    for d, t in plain():
        if d is None:
            continue
        w = brute.WORD.findall(brute.low(t))
        places = [p for phrase in licenses.PHRASES for p in range(len(w)) if w[p:p + len(phrase.split())] == phrase.split()]
        assert got[d][1:5] == (len(w), len(places), min(places, default=None), max(places, default=None))
    apache = got[TEXTS.index("Licensed under the Apache License, Version 2.0")]
    assert apache[5:] == ("apache", "apache,apache-2.0,apache-notice", 1.0)
    assert rows(licenses.scan(empty)) == []


def test_license_templates():
    text = licenses.TEMPLATES["mit-text"].replace("[including the next paragraph]", "").replace("{12}", "the authors or copyright holders")
    assert licenses.scan_text("x " + text + " y")[5] == "mit-text"
    assert licenses.scan_text(text.replace("noninfringement", "infringement"))[5] == ""      # mandatory wording
    bsd = licenses.TEMPLATES["bsd-3-clause"].replace("[1]", "1").replace("[2]", "").replace("[3]", "3").replace("{12}", "acme")
    assert licenses.scan_text(bsd)[5] == "bsd-2-clause,bsd-3-clause"
    a = licenses.Automaton("a [b c] {2} d")
    assert [a.match([*map(str.encode, t.split())], 0) == 1.0 for t in ("a d", "a b c d", "a x y d", "a b c x y d", "a x y z d", "b d")] \
        == [True, True, True, True, False, False]


def test_quality(spark, docs):
    r = random.Random(2)
    good = [(i, prose(r.randint(5, 200), 1000 + i), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + r.choice(["###", "$$$"]) for w in prose(60, 5000 + i).split()), 0) for i in range(120)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    net = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    got = {x["doc_id"]: x for x in quality.quality_scores(table, net).collect()}
    for d, t, q in good + bad:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
    held = [(got[d]["predicted"], q) for d, _, q in good + bad if got[d]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    whole = quality.quality_scores(docs, net).collect()
    assert len(whole) == len(ROWS) and all(0 <= x["score"] <= 1 for x in whole)
    assert quality.keep_good(docs, net).columns == docs.columns
    nothing = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality").limit(0))
    assert {x["score"] for x in quality.quality_scores(docs, nothing).collect()} == {0.5}


def test_quality_reads_the_whole_text():
    net = quality.Network()
    a, b = b"x" * 5000, b"x" * 4990 + b"#$#$#$#$#$"
    s = net.score([a, b, b""], net.pairs())
    assert s[0] != s[1] and s == pytest.approx([net.score([t], net.pairs())[0] for t in (a, b, b"")])


def test_shards(docs, empty):
    table = sharding.lookup_table()
    sizes = np.bincount(table)
    assert len(table) == sharding.SLOTS and sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert (fewer != table).mean() < 0.06                       # about 1 of 64 must move
    names = ["b", "a", "c"]
    brute, taken = [None] * 7, 0
    prefer = {n: [(o + k * s) % 7 for k in range(7)] for n in names for o, s in [sharding.preferences(n, 7)]}
    while taken < 7:
        for n in sorted(names):
            if taken < 7:
                brute[next(p for p in prefer[n] if brute[p] is None)] = n
                taken += 1
    assert [names[i] for i in sharding.lookup_table(names, 7)] == brute
    got = sharding.place(docs).select("doc_id", "slot", "shard").collect()
    assert len(got) == len(ROWS) and all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in got)
    assert sharding.place(empty).count() == 0


def test_main_text(spark):
    page = ('<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home'
            '</a></li><li><a href="/b">More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div><article><h1>The '
            '&amp; title</h1><p>First <b>bold</b>\n text &lt;x&gt; of the article, long enough to be read as prose.<br>next<p>Second one, '
            'also a full sentence of the article.</p></article><section class="comments"><h3>Comments</h3><div class="comment"><p>Nice '
            'text</p></div></section><form><input><button>Send</button></form><footer>&copy; x</footer></body></html>')
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (1, "u", page, 1), (None, "u", "<p", 1),
                                (5, "u", page[:page.index("also")], 1)], "page_id bigint, url string, html string, text int")
    text = "The & title\nFirst bold text <x> of the article, long enough to be read as prose. next\nSecond one, also a full sentence of the article."
    got = rows(html.main_text(df))
    assert got == sorted([(1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (1, "u", text, len(text)), (None, "u", "", 0),
                          (5, "u", text[:text.index(" also")], len(text[:text.index(" also")]))], key=repr)


def test_main_text_of_the_pages_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")

    def plain_text(page):
        x = page.split("<article>")[1].split("</article>")[0].replace("\n", " ")
        x = re.sub("<[^>]*>", "", re.sub("<br>", " ", re.sub("</?(p|h1)>", "\n", x)))
        return "\n".join(b for b in (" ".join(unescape(y).split()) for y in x.split("\n")) if b)
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got == {r["page_id"]: plain_text(r["html"]) for r in pages.collect()}


def test_shard_files_hold_whole_rows(spark, docs, tmp_path, monkeypatch, small_dir):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = docs.withColumn("k", F.lit("one"))
        sharding.write_shards(hot, str(tmp_path / "hot"), "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert rows(spark.read.parquet(str(tmp_path / "hot")).select(hot.columns)) == rows(hot)
    assert len(list((tmp_path / "hot").glob("shard=*"))) == 1
    assert len(list((tmp_path / "hot").glob("shard=*/*.parquet"))) > 1

    from wattloom.llm import queries
    monkeypatch.setattr(queries, "shared_folder", lambda *_: str(tmp_path / "op9"))
    given = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert rows(queries.op9_shards(spark, small_dir)) == rows(sharding.place(given).select("doc_id", "slot", "shard"))
    assert rows(spark.read.parquet(str(tmp_path / "op9")).select(given.columns)) == rows(given)


LONG = "A sentence of the article that is long enough to be read as prose by the model."


@pytest.mark.parametrize("start", [
    "<html><head><title>t</title><meta charset='utf-8'>", "<head><title>t</title><style>p{}</style><link rel='x'>", "<head><title>t",
    "<html><head><title>t</title></head><body><noscript>", "<body><svg>", "<body><object>", "<body><select>", "<body><iframe src='x'>"])
def test_text_after_an_unclosed_element_is_kept(start):
    assert html.trained().text(f"{start}<article><h1>Name</h1><p>{LONG}</p></article>") == f"Name\n{LONG}"


def test_an_unclosed_script_or_style_takes_the_rest():
    page = f"<body><article><h1>Name</h1><p>{LONG}</p>%s</article>"
    assert html.trained().text(page % "<script>var a; <p>no text") == f"Name\n{LONG}"
    assert html.trained().text(page % "<style>p{} <p>no text") == f"Name\n{LONG}"


def test_a_line_feed_between_elements_is_one_space():
    assert html.trained().text(f"<article><h1>Name</h1><p><b>{LONG}</b>\n<i>{LONG}</i></p></article>") == f"Name\n{LONG} {LONG}"


def test_formulas_are_text():
    page = f"<article><h1>Name</h1><p>{LONG} <math><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow></math> holds.</p></article>"
    assert html.trained().text(page) == f"Name\n{LONG} E=m holds."


def test_messages_give_exact_marginals():
    import itertools
    import math
    model = html.trained()
    nodes, pieces = html.parse("<body><div class=ad>x</div><article><p>some words here</p><p>y</p></article></body>")
    html.describe(nodes, pieces)
    weights = {}
    for s in itertools.product((0, 1), repeat=len(nodes)):
        w = sum(sum(model.vote.get(f, 0) for f in n.features) * t for n, t in zip(nodes, s))
        w += sum(model.pair[s[nodes.index(n.parent)], t] for n, t in zip(nodes, s) if n.parent)
        weights[s] = math.exp(w)
    total = sum(weights.values())
    exact = [sum(w for s, w in weights.items() if s[i]) / total for i in range(len(nodes))]
    assert model.marginals(nodes)[0] == pytest.approx(exact, rel=1e-6)


def test_queries_against_sql(spark, small_dir):
    from oracle import check, connect

    from wattloom.llm.queries import QUERIES, SQL
    con = connect(small_dir)
    for name, sql in SQL.items():
        assert check(spark, con, name, QUERIES[name], sql, small_dir)[1] == ""


def test_pipeline(spark, small_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination([(r["doc_id"], r["text"]) for r in docs.collect()], items) if r[5]}
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, small_dir).collect()]
    assert len(out) == len(set(out)) and not bad & set(out) and len(out) > docs.count() * 0.5


def test_new_stretches_go_to_the_library_together():
    """Ids are those of each stretch alone, also with the mark's character, special tokens and characters with rules of their own."""
    encoder = wavelet.LibraryEncoder(tokenizer_path())
    library, calls = encoder.library, []

    class Counting:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)
    encoder.library = Counting()
    words = [f"w{k}é,x" for k in range(5000)] + ["a\x02b", "\x02", "<|endoftext|>", "x<|startoftext|>y", "́a", "İ", "Σς", "\x1cq", "\x00", "ﬁ!‍", "y" * 300]
    texts = [" ".join(words), "\n".join(words[::-1]), None, "", "\x02 \x02"]
    got = encoder.encode(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert sum(calls) < 100


def test_words_of_letters_go_to_the_library_without_marks():
    """every word and mark costs the library time. Words that it takes apart are met as well."""
    encoder = wavelet.LibraryEncoder(tokenizer_path())
    library, seen = encoder.library, []

    class Watching:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **options)
    encoder.library = Watching()
    words = ["".join(p) for p in itertools.product("kélŝ", "aeiou", "rstn", "aouö")]
    texts = [" ".join(words), " ".join(words[::-1] + ["x1", "y-z", "\"q\""])]
    odd = ["क़लम", "İİ", "ŉa", "Σας", "ﬁn", "Åa", "한글", "ㅤ", "ʼn", "</w>", "w</w>", "<|endoftext|>"]
    for few in (texts, [f"{o} and {o}x" for o in odd], [None, ""], ["the " * 500, " ".join(odd)], []):
        for text, raw in zip(few, encoder.encode(few), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids
        if few is texts:
            sent = " ".join(seen).split()
            assert sorted(w for w in sent if w.isalpha()) == sorted(words) and sent.count(wavelet.MARK) == 2


def test_texts_are_encoded_by_size():
    import pyarrow as pa
    for texts in ([], [None] * 3, ["é" * 5, "abc", "", None, "a" * 30, "b", "c" * 11]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
        got = list(wavelet.slices(batch, 13))
        assert [t for few in got for t in few.column(1).to_pylist()] == texts
        assert all(few.num_rows == 1 or sum(len((t or "").encode()) for t in few.column(1).to_pylist()) <= 13 for few in got)
        assert len(got) == {0: 0, 3: 1, 7: 3}[len(texts)]


def test_known_stretches_are_bounded_and_a_failure_leaves_none_behind():
    encoder, r = wavelet.LibraryEncoder(tokenizer_path()), random.Random(5)
    library, known = encoder.library, wavelet.Numbers(encoder.dtype, 100)
    encoder.known = known
    words = [f"{a}{b}{c}" for a in ("ka", "é", "7", "x\x02") for b in ("lu", "-", "mo" * 40) for c in range(30)] + ["the", "lu", "mo"]
    for _ in range(40):
        texts = [" ".join(r.choices(words, k=r.randrange(30))) for _ in range(3)]
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(known) < 200 and len(known.old) < 200 and max(map(len, known), default=0) <= wavelet.SHORT

    class Failing:
        def __getattr__(self, name):
            raise MemoryError
    encoder.library = Failing()
    with pytest.raises(MemoryError):
        encoder.encode(["quite new words"])
    encoder.library = library
    got = encoder.encode(["words quite new the"])[0]
    assert np.frombuffer(got, encoder.dtype).tolist() == library.encode("words quite new the", add_special_tokens=False).ids


def test_a_worker_lets_go_of_earlier_operators_tables():
    from wattloom.llm import common
    bpe.round_trips(tokenizer_path())["word"]
    wavelet.library_encoder(tokenizer_path())
    common.drop_large_caches()
    assert not any(f.cache_info().currsize for f in (bpe.round_trips, bpe.load, wavelet.library_encoder))


def test_sets_of_few_texts_are_held_at_a_time(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hash("id", F.lit(k)).cast("string") for k in range(8)]).alias("text"))

    def largest(batches):
        import pyarrow as pa
        whole = [b.num_rows for b in batches for _ in (0,)]
        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64())], ["n"])
    assert max(r.n for r in rows.coalesce(1).mapInArrow(largest, "n bigint").collect()) == 3000
    got = rows.coalesce(1).mapInArrow(lambda batches: largest(jaccard.pieces(batches)), "n bigint").collect()
    assert max(r.n for r in got) <= 500 and sum(r.n for r in got) == 3000
