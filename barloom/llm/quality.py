"""Quality classifier by compression: one zstandard dictionary of good and one of bad text.

A text is compressed in blocks of ``BLOCK`` bytes with either dictionary. The difference of
the two sizes, over the text's bytes, says which kind of text it resembles; the ratio of
the smaller size to the bytes says how repetitive it is. A logistic curve over these,
fitted on labelled texts that are in neither dictionary and weighted to the labels' true
shares, turns them into a probability.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled texts of either label,
in the order of a hash of doc_id, none above ``SAMPLE_BYTES`` bytes, and one (the smallest) of rows that repeat a doc_id. Every text is scored whole.

Defined results: null and empty texts score 0; labels other than 0 and 1, and doc_ids with
two different labels, teach nothing; a null doc_id is never held out; if a label has fewer
than ``LEAST`` texts in the sample, every text scores the share of label 1 (0.5 without
labels); rows that repeat a doc_id are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import map_batches

SAMPLE, SAMPLE_BYTES, LEAST = 2000, 32_768, 8
BLOCK, LEVEL, DICTIONARY = 1024, 3, 112_640

SCORES = "doc_id long, held_out boolean, score double"


def fold(parts: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: list[float], constant: float | None = None):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def open(self) -> None:
        self.c = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.c.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        blocks = _blocks(text)
        a, b = (sum(len(c.compress(x)) - 6 for x in blocks) for c in self.c)
        n = len(text)
        d, r = (a - b) / n, min(a, b) / n
        return [1.0, d, r, min(r, 0.3), d * min(1.0, n / 256), np.log(n)]

    def score(self, text: bytes | None) -> float:
        if not text:
            return 0.0
        if self.constant is not None:
            return self.constant
        z = float(np.dot(self.features(text), self.weights))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method, on scaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, beta = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(beta)) * 1e-1
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - ridge * len(y) * 1e-1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    beta = beta / scale
    beta[0] -= (beta[1:] * mean[1:]).sum()
    return beta


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"))
    one = one.filter(F.col("q").isin(0, 1)).filter(fold(parts) != held)
    one = one.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("q").alias("high")).filter("q = high").select("doc_id", "q")
    shares = dict(one.groupBy("q").count().collect())
    total = sum(shares.values())
    order = [F.xxhash64(F.col("doc_id"), F.lit(3)), F.col("doc_id")]
    picks = [one.filter(F.col("q") == q).orderBy(*order).limit(SAMPLE) for q in (0, 1)]
    picked = picks[0].unionByName(picks[1]).select(F.col("doc_id").alias("id"), "q")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "q", "text").groupBy("doc_id", "q").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "q", F.encode("text", "UTF-8").alias("t")).collect()  # one text of each picked doc_id
    rows.sort(key=lambda r: (hash((r["doc_id"] * 0x9E3779B97F4A7C15) % 2**61), r["doc_id"], bytes(r["t"])))
    texts_of = {q: [bytes(r["t"]) for r in rows if r["q"] == q] for q in (0, 1)}
    if min(map(len, texts_of.values())) < LEAST:
        return Model(b"", b"", [], shares.get(1, 0) / total if total else 0.5)
    learn = {q: t[: len(t) // 2] for q, t in texts_of.items()}
    raw = {}
    for q, t in learn.items():
        pieces = [x for s in t for x in _blocks(s)]
        raw[q] = _dictionary(pieces)
    model = Model(raw[1], raw[0], [])
    model.open()
    check = [(s, q) for q, t in texts_of.items() for s in t[len(t) // 2 :]]
    x = np.array([model.features(s) for s, _ in check])
    y = np.array([q for _, q in check], float)
    w = np.where(y == 1, shares[1] / total / y.sum(), shares[0] / total / (1 - y).sum()) * len(y)
    model.weights = _logistic(x, y, w).tolist()
    return Model(model.good, model.bad, model.weights)


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 4)), pieces, threads=0).as_bytes()
    except zstandard.ZstdError:  # too few or too short pieces to train on: the pieces are the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def _scores(model: Model, batches):
    opened = False
    for batch in batches:
        if not opened and model.constant is None:
            model.open()
            opened = True
        score = [model.score(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, parts, held))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(parts) == held, F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, lambda b, m=model: _scores(m.value, b), SCORES)


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return map_batches(docs, lambda b, m=model: _kept(m.value, b, least), docs.schema)


def _kept(model: Model, batches, least: float):
    opened = False
    for batch in batches:
        if not opened and model.constant is None:
            model.open()
            opened = True
        text = batch.column(batch.schema.get_field_index("text"))
        yield batch.filter(pa.array([model.score(t.as_buffer().to_pybytes() if t.is_valid else None) >= least for t in text], pa.bool_()))
