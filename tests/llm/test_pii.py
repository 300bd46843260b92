"""The tagger against enumeration, finite differences and texts that it wasn't generated for."""

from __future__ import annotations

import itertools
import random

import pytest

pytest.importorskip("adtflow.llm")

import numpy as np  # noqa: E402

from adtflow.llm import pii  # noqa: E402
from adtflow.llm.pii_model import _ALLOWED, _START, LENGTH, TAGS, Tagger, labelled_text, symbols, tag_spans, train, trained  # noqa: E402

PROSE = (
    "The committee met on Tuesday to review the budget for 2024 and agreed that the new bridge should open in spring. Several members asked "
    "why the cost had risen from $1,200 to $3,450 since March. Dr. Hale noted 17 complaints, 3 of them about noise at night; version 2.10 of "
    "the plan answers most. See section 4.2, page 118, or call the office (room 12) before 10:30. Key results: growth of 5.5 percent."
)


def test_viterbi_equals_enumeration():
    m, rng = trained(), np.random.default_rng(1)
    scores = rng.normal(0, 3, (4, 3, TAGS)).astype(np.float32)
    lengths = np.array([4, 2, 3])
    got = m.viterbi(scores, lengths)
    trans = m.p["t"] + _ALLOWED
    for row, n in enumerate(lengths):
        best = max(itertools.product(range(TAGS), repeat=int(n)), key=lambda y: _START[y[0]] + sum(scores[t, row, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
        assert tuple(got[row, :n]) == best


def test_gradient_equals_finite_differences():
    r = random.Random(2)
    m = Tagger.new(np.random.default_rng(2))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    batch = [labelled_text(r, 18) for _ in range(3)]
    ids, tags = np.stack([symbols(t) for t, _ in batch]), np.array([y for _, y in batch])
    _, g = m.loss_and_gradient(ids, tags)
    rng = np.random.default_rng(3)
    for name, v in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape) if name != "e" else (int(rng.choice(ids.ravel())), int(rng.integers(0, v.shape[1])))
            if name == "t" and _ALLOWED[at] != 0:
                continue
            keep, step = v[at], 1e-3
            v[at] = keep + step
            up = m.loss_and_gradient(ids, tags)[0]
            v[at] = keep - step
            down = m.loss_and_gradient(ids, tags)[0]
            v[at] = keep
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_training_lowers_the_loss():
    r = random.Random(4)
    batch = [labelled_text(r) for _ in range(32)]
    loss = lambda m: m.loss_and_gradient(np.stack([symbols(t) for t, _ in batch]), np.array([y for _, y in batch]))[0]
    assert loss(train(seed=3, steps=40)) < 0.6 * loss(train(seed=3, steps=1)) and loss(trained()) < 5


def test_recall_and_precision_on_prose():
    """English sentences with data in forms that the patterns miss too; all of it is found, and of the prose nothing."""
    r, m = random.Random(5), trained()
    words = PROSE.split()
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = [
        lambda: (0, "", f"{r.choice(('maria', 'j.doe', 'info', 'tom_b'))}@{r.choice(('acme', 'northwind', 'uni-bonn'))}.{r.choice(('com', 'org', 'de'))}", ""),
        lambda: (0, "", f"{r.choice(('maria', 'jdoe', 'sales'))} (at) {r.choice(('acme', 'northwind'))} (dot) {r.choice(('com', 'org'))}", ""),
        lambda: (1, "", ".".join(str(r.randrange(256)) for _ in range(4)), ""),
        lambda: (3, "", f"({digits(3)}) {digits(3)}-{digits(4)}", ""),
        lambda: (3, "", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", ""),
        lambda: (4, "password=", "".join(r.choice("0123456789abcdef") for _ in range(20)) + "7", ""),
        lambda: (4, 'token = "', "7" + "".join(r.choice("0123456789abcdef") for _ in range(39)), '"'),
    ]
    hit = wrong = missed = plain = 0
    for _ in range(150):
        kind, head, data, tail = r.choice(made)()
        at = r.choice([i for i in range(3, len(words) - 3) if not any(c.isdigit() for c in words[i] + words[i - 1])])
        start = " ".join(words[:at]) + " " + head
        text = start + data + tail + " " + " ".join(words[at:])
        base, every = pii.find([text], m)[0]
        hit += (gold := (kind, len(start), len(start) + len(data))) in every
        missed += gold not in every
        wrong += len(set(every) - {gold})
        plain += gold in base
    assert hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.95, (hit, missed, wrong)
    assert plain < hit  # the tagger has added spans
    assert pii.find([PROSE], m) == [([], [])]


def test_spans_longer_than_a_window_and_texts_longer_than_any():
    """Scores of overlapping windows are joined, so that a long address is one span wherever it stands."""
    m, r = trained(), random.Random(6)
    for n in (20, 60, 88, 150):
        user = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        for lead in (0, 17, 36, 71, 200):
            text = ("word " * 50)[:lead].rstrip() + " " + user + "@mail.example.com and more"
            assert (0, len(text) - len(user) - 26, len(text) - 9) in pii.find([text], m)[0][1]
    text = (PROSE + " ") * 3000 + "ask (826) 555-4081 now " + "x" * 200_000
    assert [s[0] for s in pii.find([text], m)[0][1]] == [3]


def test_decoding_near_signs_alone_changes_nothing():
    r, m = random.Random(7), trained()
    texts = [labelled_text(r, n)[0] for n in (1, 30, 72, 73, 400, 3000) * 3] + ["", PROSE, PROSE.replace(".", " maria (at) acme (dot) com."), "plain words " * 40]
    assert pii.tagged_spans(texts, m) == pii.tagged_spans(texts, m, everywhere=True)


@pytest.mark.parametrize("text", ["0" * 5000 + "1.1.1.1", "1." * 5000, "9" * 30000, "+" * 5000, "@" * 5000, "a@" * 3000 + "b.c", "+1(" * 3000, "퟿\U0010ffff" * 300 + "1"])
def test_odd_texts_end(text):
    (base, every), = pii.find([text], trained())
    assert set(base) <= set(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_leading_zeros_of_addresses():
    text = "0" * 5000 + "1.1.1.1 and 000.0.0.0255 and 0.0.0.256"
    assert [(a, b) for k, a, b in pii.base_spans(text) if k == 1] == [(0, 5007), (5012, 5024)]


def test_query_of_nulls_repeated_rows_and_other_columns(spark):
    rows = [(None, "a@b.cd", 1), (1, None, 2), (1, "", 3), (2, "token = \"7abc9abc1abc2abc\"", 4), (2, "token = \"7abc9abc1abc2abc\"", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_spans int")
    got = sorted((str(x["doc_id"]), x["n_email"], x["n_spans"], x["spans"]) for x in pii.private_spans(d).collect())
    assert got == sorted([("None", 1, 1, "email:0:6"), ("1", 0, 0, ""), ("1", 0, 0, ""), ("2", 0, 1, "secret:9:25"), ("2", 0, 1, "secret:9:25")])
    assert sorted((x["text"] or "-", x["n_spans"]) for x in pii.redacted(d).collect()) == sorted([("<email>", 1), ("-", 2), ("-", 3), ('token = "<secret>"', 4), ('token = "<secret>"', 5)])
    assert pii.private_spans(d.limit(0)).count() == 0


def test_windows_cover_every_character_that_is_decoded():
    for n in (1, LENGTH // 2, LENGTH, LENGTH + 1, 500):
        text = "7" * n
        assert pii.stretches(text) == [(0, n)]
        (x,) = pii._scores([text], [(0, 0, n)], trained())
        assert x.shape == (n, TAGS) and np.isfinite(x).all()
    assert tag_spans(np.array([0, 1, 2, 0])) == [(0, 1, 3)]
