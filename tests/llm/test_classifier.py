"""Features, scores and the fitted layers against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

pytest.importorskip("adtflow.llm")

import numpy as np  # noqa: E402

from adtflow.llm import classifier  # noqa: E402
from tests_llm_helpers import words  # noqa: E402

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
P = 0x9E3779B97F4A7C15
SPACE = b"\t\n\x0b\x0c\r "


def bucket(h, salt):
    return (((h ^ salt) * 0xD6E8FEB86659FD93) & M64) >> (64 - classifier.BUCKETS.bit_length() + 1)


def plain_features(text):
    """Every word, pair and n-gram one by one."""
    b = bytes(32 if c in SPACE else c for c in (" " + (text or "") + " ").encode("utf-8", "replace"))
    out, last = Counter(), None
    for w in b.split():
        h = sum((c + 1) * pow(P, k, 1 << 64) for k, c in enumerate(w)) & M64
        out[bucket(h, 1)] += 1
        if last is not None:
            out[bucket(1 if h == last else (last * 31 + h) & M64, 2)] += 1
        last = h
    for size in classifier.NGRAMS:
        for i in range(len(b) - size + 1):
            gram = b[i : i + size]
            if 32 not in gram[1:-1]:
                h = gram[0]
                for c in gram[1:]:
                    h = (h * 0x01000193 + c) & M32
                out[bucket(h, 2 + size)] += 1
    return out


TEXTS = ["", None, " ", "a", "a a a b", "Éa\tñ  über\n", "x" * 50, " lead and trail "]


def test_features_equal_plain_ones():
    r = random.Random(1)
    for t in TEXTS + ["".join(r.choice("ab é\n") for _ in range(r.randint(0, 60))) for _ in range(100)]:
        ids, counts = classifier.features(t)
        assert dict(zip(ids.tolist(), counts.tolist())) == plain_features(t)


def test_long_texts_have_the_features_of_their_parts(monkeypatch):
    """A text that is hashed in segments has the same features."""
    t = words(random.Random(2), 3000)
    whole = plain_features(t)
    monkeypatch.setattr(classifier, "CHUNK", 700)
    ids, counts = classifier.features(t)
    assert dict(zip(ids.tolist(), counts.tolist())) == whole


def test_scores_equal_the_definition():
    rng = np.random.default_rng(3)
    m = classifier.Model(rng.normal(0, 30, classifier.BUCKETS), 0.25)
    for t, s in zip(TEXTS, m.score(TEXTS)):
        f = plain_features(t)
        z = m.bias + (sum(m.weight[k] * n for k, n in f.items()) / sum(f.values()) if f else 0)
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


def test_first_steps_equal_plain_gradient_steps(monkeypatch):
    """One epoch of the fit against loops over every feature, with the vectors and layers kept apart."""
    r = random.Random(4)
    texts, labels = [words(r, 5) for _ in range(6)], [0, 1, 1, 0, 1, 0]
    monkeypatch.setattr(classifier, "EPOCHS", 1)
    m = classifier.train(texts, labels)
    rng = np.random.default_rng(7)
    v = rng.uniform(-1 / classifier.WIDTH, 1 / classifier.WIDTH, (classifier.BUCKETS, classifier.WIDTH)).astype(np.float32).astype(np.float64)
    up = rng.uniform(0.5, 1, classifier.WIDTH).astype(np.float32).astype(np.float64)
    layer, bias = [-up, up.copy()], [0.0, 0.0]
    for step, i in enumerate(rng.permutation(6)):
        rate = classifier.RATE * (1 - step / 6)
        f = plain_features(texts[i])
        n = sum(f.values())
        mean = sum(v[k] * (c / n) for k, c in f.items())
        z = [layer[c] @ mean + bias[c] for c in (0, 1)]
        e = [math.exp(x - max(z)) for x in z]
        slope = [x / sum(e) - (labels[i] == c) for c, x in enumerate(e)]  # of the cross entropy by each class's z
        down = slope[0] * layer[0] + slope[1] * layer[1]
        for k, c in f.items():
            v[k] -= c / n * min(len(f), 200) ** 0.5 * rate * 4 * down
        for c in (0, 1):
            layer[c] = layer[c] - rate * slope[c] * mean
            bias[c] -= rate * 0.1 * slope[c]
    assert np.allclose(m.weight, v @ (layer[1] - layer[0]), atol=1e-4) and abs(m.bias - (bias[1] - bias[0])) < 1e-5


def test_held_out_rows_and_nulls(spark):
    import zlib

    from pyspark.sql import functions as F

    ids = [*range(200), None]
    got = {x["i"]: x["h"] for x in spark.createDataFrame([(i,) for i in ids], "i long").select("i", classifier.held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i in ids}
    docs = spark.createDataFrame([(1, "good words"), (None, "bad"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (9, 0)], "doc_id long, quality int")
    m = classifier.fit(docs, labels, "quality")
    assert not m.weight.any() and classifier.score(docs, m).count() == 3
