"""Input columns with the names that operators use inside stay as they are."""

import random

import pytest
from pyspark.sql import functions as F

from wattloom.llm import decontaminate, jaccard, licenses, quality, secrets, sharding

NAMES = ["_base", "_all", "_more", "_bad", "_bad_doc", "_bad_text", "_t", "_d", "_kept_doc", "_kept_text", "_spans", "_found", "slot", "shard", "_salt"]
TEXT = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(1, TEXT), (2, TEXT), (3, "password=abcdefgh1 and " + TEXT[::-1]), (4, None), (5, "nothing here at all")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def kept(df, rows):
    for r in df.select("doc_id", *NAMES).collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
    assert sorted(r.doc_id for r in df.collect()) == rows


def test_redacted_rows(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    kept(out, [1, 2, 3, 4, 5])
    assert "[secret]" in out.filter("doc_id = 3").first().text


def test_decontaminated_rows(spark, docs):
    item = spark.createDataFrame([(1, TEXT)], "item_id bigint, text string")
    kept(decontaminate.drop_contaminated(docs, item), [3, 4, 5])


def test_rows_without_near_duplicates(docs):
    kept(jaccard.drop_near_duplicates(docs), [1, 3, 4, 5])


def test_placed_rows(spark, docs, tmp_path):
    out = sharding.place(docs)
    assert {r.doc_id: (r.input_slot, r.input_shard) for r in out.collect()} == {i: (f"slot{i}", f"shard{i}") for i in range(1, 6)}
    sharding.write_shards(docs, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 5 and {"input_slot", "input_shard", "slot", "shard", "_salt"} <= set(back.columns)


def test_part_of_a_license_header_scores_without_a_sign_word():
    words = "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    assert licenses.scan_text(words)[-1] > 0
    assert licenses.scan_text("nothing of that kind")[-1] == 0


def test_training_reads_whole_texts():
    assert len(quality._sample("x" * 10_000)) == len(range(0, 10_000 - quality.BLOCK, 3 * quality.BLOCK))
    assert len(quality._sample(None)) == 1


def test_tiles_change_nothing(monkeypatch):
    r = random.Random(1)
    chunks = [c for i in range(12) for c in quality._sample("".join(r.choice("abc" if i % 2 else "xyz") for _ in range(900)))]
    import numpy as np
    x = np.array([np.frombuffer(c, np.uint8) for c in chunks])
    of, y = np.repeat(np.arange(12), len(x) // 12), np.array([i % 2 for i in range(12)], np.float32)
    one = quality.Network().fit(x, of, y, 0.0, 1)
    monkeypatch.setattr(quality, "TILE", 7)
    two = quality.Network().fit(x, of, y, 0.0, 1)
    assert np.allclose(one.w, two.w, atol=1e-5)


def test_a_pair_leaves_its_smallest_common_token_only():
    import numpy as np
    heads = np.array([[1, 5, 9, jaccard.NO_TOKEN], [2, 5, 9, jaccard.NO_TOKEN]])
    for token, first in ((5, True), (9, False), (12, False), (3, True)):
        assert jaccard.first_common(np.array([token]), heads[:1], heads[1:]).tolist() == [first]


def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch):
    import numpy as np
    raw = ("ab " * 500 + "x" * 70_000 + " yz " + "w" * 66_000 + "  q" * 40).encode()
    whole = jaccard.word_hashes(raw)
    monkeypatch.setattr(jaccard, "PIECE", 1000)
    jaccard._powers.cache_clear()
    parts = jaccard.word_hashes(raw)
    jaccard._powers.cache_clear()
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(set(whole[1].tolist())) == 5
