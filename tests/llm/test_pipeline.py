"""The pipeline's stages, each against brute force on what the stage before it kept."""

from __future__ import annotations

import random
import re

import pytest

pytest.importorskip("adtflow.llm")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

from adtflow.llm import bpe, pii  # noqa: E402
from adtflow.llm.pii_model import trained  # noqa: E402
from adtflow.llm.queries import tokenizer_path  # noqa: E402
from tests_llm_helpers import components_of, edited, words  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus on disk: good texts, junk, near copies, benchmark passages, personal data, nulls."""
    d, r = tmp_path_factory.mktemp("corpus"), random.Random(21)
    item = words(r, 30)
    good = [words(r, r.randint(60, 120)) for _ in range(80)]
    texts = good + [edited(r, t, 1) for t in good[:10]] + good[:5] + [words(r, 40) + " " + item + " " + words(r, 40) for _ in range(4)]
    texts += [words(r, 50) + " ab.12@mail.example.com " + words(r, 50), None]
    junk = [" ".join(w.upper() + "!!" for w in words(r, 60).split()) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(rows)) if rows[i][1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, words(r, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), item


def test_stages(spark, corpus):
    d, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.schema, [{x["doc_id"]: x for x in docs.collect()}]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if i < 4:
            assert docs.schema.names == columns.names
        rows = docs.collect()
        seen.append({x["doc_id"]: x for x in rows})
        assert len(seen[-1]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    whole, good, one, clean, private, tokens = seen
    junk = {i for i, x in whole.items() if "!!" in (x["text"] or "")}
    assert junk and not junk & set(good) and len(set(whole) - junk - set(good)) <= 1
    root = components_of([(i, x["text"]) for i, x in good.items()], 5, 80)
    assert set(one) == {i for i, (_, c) in root.items() if i == c}
    leaks = {i for i, x in one.items() if item in (x["text"] or "")}
    assert leaks and set(clean) == set(one) - leaks
    assert set(private) == set(clean)
    for (i, x), (base, every) in zip(clean.items(), pii.find([x["text"] or "" for x in clean.values()], trained())):
        want = x["text"] if not every else pii.redact(x["text"], every)
        assert private[i]["text"] == want and private[i]["n_chars"] == len(want or "")
    assert any("<email>" in (x["text"] or "") for x in private.values())
    codec = bpe.codec(open(tokenizer_path(), encoding="utf-8").read())
    assert {i: x["n_tokens"] for i, x in tokens.items()} == {i: len(codec.encode(x["text"] or "")) for i, x in private.items()}


def test_run_and_stage_names(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50
    assert [re.sub(r"\W+", "_", n) for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "n_gram_Jaccard_join", "benchmark_decontamination", "PII", "BPE_encoding_and_decoding"]
