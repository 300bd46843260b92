"""Null ids, repeated rows, empty tables, clashing columns and long texts for every operator."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

pytest.importorskip("adtflow.llm")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

from adtflow.llm import bpe, classifier, decontamination, jaccard, licenses, media, sharding, warc  # noqa: E402
from adtflow.llm.queries import tokenizer_path  # noqa: E402
from tests_llm_helpers import words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w string, t int"
NOTICE = licenses.NOTICES["ISC"]


def rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, None, "s", len(t or ""), i, "w", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, null and empty texts, and one of two million characters, beside columns with names the operators use."""
    r = random.Random(1)
    t, long = words(r, 60), words(r, 300_000)
    texts = [t, t, t + " " + NOTICE, t + " " + NOTICE, None, "", None, long, long]
    return spark.createDataFrame(rows(texts, [None, None, 2, 2, 3, 3, None, 7, 7]), SCHEMA)


def ids(df):
    return sorted(str(x["doc_id"]) for x in df.select("doc_id").collect())


def test_operators_on_odd_rows(spark, odd):
    every = ids(odd)
    benchmark = spark.createDataFrame([(1, NOTICE, "x"), (None, NOTICE, "x"), (1, NOTICE, "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, doc_id string")
    assert ids(sharding.shard_by_bytes(odd, 40)) == every
    assert ids(classifier.score(odd, classifier.train([], []))) == every
    assert ids(bpe.bpe_round_trip(odd, tokenizer_path())) == every
    assert ids(media.media_round_trip(odd)) == every
    links = jaccard.link_components(odd, 4, 85).collect()
    assert sorted(str(x["doc_id"]) for x in links) == every and {x["component_id"] for x in links if x["doc_id"] == 7} == {7}
    assert {str(x["doc_id"]) for x in licenses.license_matches(odd).collect()} == {"2"}
    found = decontamination.contaminated(odd, benchmark).collect()
    assert sorted((x["doc_id"], str(x["item_id"])) for x in found) == [(2, "1"), (2, "None")]
    left = decontamination.without_contaminated(odd, benchmark)
    assert left.columns == odd.columns and ids(left) == [x for x in every if x != "2"]
    kept = classifier.keep_scored(odd, classifier.train([], []), 0.3)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    assert jaccard.keep_one(odd).columns == odd.columns


def test_operators_on_empty_tables(spark, odd):
    none = odd.limit(0)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (sharding.shard_by_bytes(none, 40), bpe.bpe_round_trip(none, tokenizer_path()), media.media_round_trip(none), licenses.license_matches(none), jaccard.keep_one(none), warc.warc_round_trip(pages)):
        assert out.count() == 0
    assert decontamination.contaminated(none, benchmark).count() == decontamination.contaminated(odd, benchmark).count() == 0
    assert decontamination.without_contaminated(odd, benchmark).count() == odd.count()


def test_pipeline_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (7, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, NOTICE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} == {None, 3, 7}


@pytest.mark.parametrize("n", range(1, 31))
def test_masks_reach_every_allowed_substitution(n):
    """Whatever words an overlap of a window may have replaced, some mask finds it: items of any length, all cases counted."""
    window = min(n, decontamination.WINDOW)
    allowed = decontamination.substitutions(window)
    masks = decontamination.short_masks(n) if n < decontamination.WINDOW else decontamination.MASKS
    for gone in combinations(range(window), allowed):
        hit = any(all(at + k not in gone for k, c in enumerate(m) if c == "1") for m in masks for at in range(window - len(m) + 1))
        assert hit, (n, gone)


def test_short_items_with_substitutions_equal_brute_force(spark):
    """Items of 1 to 12 words, each in documents with up to as many words replaced as may be, and with one more."""
    r = random.Random(3)
    items = [[f"i{n}w{k}" for k in range(n)] for n in range(1, 13)]
    docs, want = [], set()
    for n, item in enumerate(items):
        for extra in (0, 1):
            for _ in range(4):
                gone = r.sample(range(len(item)), min(len(item), decontamination.substitutions(len(item)) + extra))
                text = ["pad"] * r.randint(0, 3) + [f"x{r.random()}" if k in gone else w for k, w in enumerate(item)] + ["end"] * r.randint(0, 3)
                if not extra:
                    want.add((len(docs), n))
                docs.append(" ".join(text).replace(".", ""))
    d = spark.createDataFrame(rows(docs), SCHEMA)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(d, b).collect()} == want


def test_archives_beyond_the_broadcast_bound(spark, monkeypatch):
    r = random.Random(4)
    big = [words(r, 300) for _ in range(3)]
    pages = spark.createDataFrame([(i, "u", big[i % 3] if i % 4 else "small") for i in range(20)] + [(None, None, big[0]), (5, "u", big[1])], "page_id long, url string, html string")
    near = sorted(map(str, warc.warc_round_trip(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.warc_round_trip(pages).collect())) == near and len(near) == 22
