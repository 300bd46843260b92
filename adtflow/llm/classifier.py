"""Operator 3: a supervised classifier on averaged subword embeddings.

Each word, each character n-gram of a word (with marks for the word's ends) and each pair of neighbouring words is hashed to a
learned vector; a document is the mean of its features' vectors, and a softmax layer gives the class. Vectors and output layer are
trained together by stochastic gradient descent in numpy. A word that repeats the one before it counts as one fixed pair, a
back reference, so that repetition is seen whatever the word is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtflow.llm.shared import map_arrow, text_or_empty

#: Buckets of hashed features.
BUCKETS = 1 << 17
#: Length of a feature's vector.
WIDTH = 10
#: Lengths of character n-grams, in bytes.
NGRAMS = (3, 4, 5)
#: The classifier is fitted on at most this many labelled rows, those whose ids have the smallest hashes.
SAMPLE_ROWS = 3000
EPOCHS = 6
RATE = 0.5
#: Bytes that are hashed at a time; a longer text is cut at white space, over which no n-gram reaches.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, CHUNK * 2 + 16), _powers(_P_INVERSE, CHUNK * 2 + 16)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def _segment_features(b: np.ndarray, last: int) -> tuple[np.ndarray, int]:
    """Buckets of a segment that starts and ends with a space; last: hash of the word before it, 0 for none."""
    space = _SPACE[b]
    b = np.where(space, np.uint8(32), b)
    n = len(b)
    edges = np.flatnonzero(space)
    starts, ends = edges[:-1] + 1, edges[1:]
    some = ends > starts
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return np.empty(0, np.int32), last
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_P, n + 1), _powers(_P_INVERSE, n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    words = (total[ends] - total[starts]) * down[starts]
    before = np.concatenate([np.array([last], np.uint64), words[:-1]])
    pairs = np.where(before == words, np.uint64(1), before * np.uint64(31) + words)
    out = [_bucket(words, 1), _bucket(pairs, 2)[0 if last else 1 :]]
    inside = np.cumsum(space, dtype=np.int32)
    h = b.astype(np.uint32)
    for size in range(2, max(NGRAMS) + 1):
        if n < size:
            break
        h = h[: n - size + 1] * np.uint32(0x01000193) + b[size - 1 :]
        if size in NGRAMS:
            kept = inside[size - 2 : n - 1] == inside[: n - size + 1]  # no space between the first and the last byte
            out.append(_bucket(h[kept].astype(np.uint64), 2 + size))
    return np.concatenate(out), int(words[-1])


def segments(text: str | None) -> list[np.ndarray]:
    raw = (" " + (text or "") + " ").encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= CHUNK:
        return [b]
    spaces, out, at = np.flatnonzero(_SPACE[b]), [], 0
    while at < len(b) - 1:
        i = np.searchsorted(spaces, at + CHUNK, "right") - 1
        end = int(spaces[i]) if spaces[i] > at else int(spaces[i + 1])
        out.append(b[at : end + 1])
        at = end
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    last, counts = 0, None
    for s in segments(text):
        ids, last = _segment_features(s, last)
        c = np.bincount(ids, minlength=BUCKETS) if counts is None and len(ids) > BUCKETS // 4 else None
        if counts is None:
            if c is None:
                u, k = np.unique(ids, return_counts=True)
                counts = np.zeros(BUCKETS, np.int64) if len(ids) > BUCKETS // 4 else (u, k)
            else:
                counts = c
        else:
            if isinstance(counts, tuple):
                full = np.zeros(BUCKETS, np.int64)
                full[counts[0]] = counts[1]
                counts = full
            counts = counts + np.bincount(ids, minlength=BUCKETS)
    if isinstance(counts, tuple):
        return counts
    u = np.flatnonzero(counts)
    return u.astype(np.int32), counts[u]


@dataclass
class Model:
    """What scoring needs: each bucket's vector times the difference of the output layer's two rows, and that of the biases."""

    weight: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Softmax probability of class 1; a text without features has the biases' one."""
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            total, n, last = 0.0, 0, 0
            for s in segments(t):
                ids, last = _segment_features(s, last)
                total += float(self.weight[ids].sum())
                n += len(ids)
            if n:
                out[i] += total / n
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fits vectors and output layer; without rows of both classes the model gives the labels' mean, or 0.5 for none."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        mean = min(max(float(y.mean()) if len(y) else 0.5, 0.001), 0.999)
        return Model(np.zeros(BUCKETS), float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    # kept in three long arrays, not in thousands of short ones
    parts = [(ids, (counts / max(1, counts.sum())).astype(np.float32)) for ids, counts in map(features, texts)]
    ends = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    all_ids, all_shares = np.concatenate([ids for ids, _ in parts]), np.concatenate([share for _, share in parts])
    del parts
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    layer[1] = rng.uniform(0.5, 1, WIDTH)
    layer[0] = -layer[1]
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = all_ids[ends[i] : ends[i + 1]], all_shares[ends[i] : ends[i + 1]]
            if not len(ids):
                continue
            mean = share @ vectors[ids]
            z = layer @ mean + bias
            e = np.exp(z - z.max())
            slope = e / e.sum()
            slope[y[i]] -= 1
            vectors[ids] -= np.outer(share * min(len(ids), 200) ** 0.5, rate * 4 * (slope @ layer))
            layer -= rate * np.outer(slope, mean)
            bias -= rate * 0.1 * slope
    return Model(vectors.astype(np.float64) @ (layer[1] - layer[0]).astype(np.float64), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from rows of labels that aren't held out; at most sample_rows of them are taken and reach the driver.

    The rows are chosen among the labels alone, so that only the chosen documents' texts move. Null ids and labels are left out,
    as are labels without a document; an id that occurs several times counts once for each row.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(sample_rows)
    )
    # safe to broadcast: sample_rows rows at most
    known = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id").toArrow()
    known = known.sort_by([("id", "ascending"), ("y", "ascending")])
    return train(known["text"].to_pylist(), known["y"].to_pylist())


def held_out(id_column: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns of keep. Null texts count as empty; repeated rows are scored alike; empty tables give no rows."""
    # the model has a fixed size, BUCKETS numbers
    sent = documents.sparkSession.sparkContext.broadcast(model)
    slim = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_arrow(slim, each, "doc_id long, score double")


def keep_scored(documents: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns, whatever their names.

    Null texts count as empty, ties with the threshold stay, rows with equal texts stay or go together; an empty table stays so.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.score(batch.column(at).to_pylist()) >= threshold))

    return map_arrow(documents, each, documents.schema)
