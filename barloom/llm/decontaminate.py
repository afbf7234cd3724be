"""Benchmark decontamination: prefix-filtered set join with exact verification.

An item is cut into windows of ``window`` consecutive words (an item of fewer words is one
window). A window occurs in a document only if all of its shingles (pairs of neighbouring
words) do, so the necessary prefix of the window, ordered by rarity in the corpus, is its
one rarest shingle. Document shingles are joined with those prefix tokens only. The offset
of the shingle in its window gives the positional bound, the window's length the length
bound, and what passes is compared word by word.

The benchmark is read in blocks of at most ``block_bytes`` of text; each block is broadcast
(that bounds its size) and costs one pass over the documents.

Defined results: null text is the empty text and has no words; null or empty items have no
windows; every document row gives one row, also where a doc_id is null or repeated, with any
number of blocks; equal windows of several items count for each item; rows that
repeat an item_id are parts of one item; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import map_batches, numbered, stash, without
from .textvec import ALNUM, gram_hashes, slices

BLOCK_BYTES = 2 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lowered

HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Windows:
    """The windows of one block of items, by length of window."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids = ids
        rows: dict[int, dict[tuple, list[int]]] = {}
        for s in slices(pa.array(texts, pa.string()), ALNUM):
            h = s.hashes()
            for i in range(s.n):
                w = h[s.word_at[i] : s.word_at[i + 1]]
                k = min(window, len(w))
                for j in range(len(w) - k + 1 if k else 0):
                    items = rows.setdefault(k, {}).setdefault(tuple(w[j : j + k].tolist()), [])
                    if s.first + i not in items:
                        items.append(s.first + i)
        self.words = {k: np.array(list(v), np.uint64) for k, v in rows.items()}
        self.items = {k: list(v.values()) for k, v in rows.items()}
        self.vocab = {g: np.unique(np.concatenate([x.ravel() for x in self._grams(g)] or [np.zeros(0, np.uint64)])) for g in (1, 2)}

    def _grams(self, width: int) -> list[np.ndarray]:
        """Shingles of the windows that use shingles of that width: pairs, or the word of a one-word window."""
        return [np.stack([gram_hashes(r, width) for r in w]) for k, w in self.words.items() if min(k, 2) == width]

    def order(self, rarity: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle (the first, where several are) as its prefix token."""
        self.probe = {}
        for k, w in self.words.items():
            g = min(k, 2)
            grams = np.stack([gram_hashes(r, g) for r in w])
            at = np.argmin(rarity[g][np.searchsorted(self.vocab[g], grams)], axis=1)
            token = grams[np.arange(len(w)), at]
            by = np.argsort(token, kind="stable")
            self.probe[k] = (token[by], at[by], by)


def _counts(windows: Windows, batches):
    """How many documents each shingle of the windows occurs in."""
    totals = {g: np.zeros(len(v), np.int64) for g, v in windows.vocab.items()}
    for batch in batches:
        for s in slices(batch.column(0), ALNUM):
            h, text = s.hashes(), s.text_of_word()
            for g, v in windows.vocab.items():
                if not len(v) or len(h) < g:
                    continue
                grams = gram_hashes(h, g)
                at = np.minimum(np.searchsorted(v, grams), len(v) - 1)
                ok = np.flatnonzero((v[at] == grams) & (text[: len(grams)] == text[g - 1 :]))
                seen = np.unique(text[ok].astype(np.int64) * len(v) + at[ok])
                totals[g] += np.bincount(seen % len(v), minlength=len(v))
    for g, t in totals.items():
        some = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), g, np.int32)), pa.array(some.astype(np.int64)), pa.array(t[some])], ["g", "at", "n"])


def _find(windows: Windows, batches):
    for batch in batches:
        doc_ids = batch.column(0)
        for s in slices(batch.column(1), ALNUM):
            h, text, counts = s.hashes(), s.text_of_word(), s.counts()
            marks: dict[int, tuple[list, set]] = {}
            grams = {g: gram_hashes(h, g) for g in (1, 2)}
            for k, (token, at, row) in windows.probe.items():
                g = grams[min(k, 2)]
                if not len(g):
                    continue
                lo = np.searchsorted(token, g, "left")
                where = np.flatnonzero(token[np.minimum(lo, len(token) - 1)] == g)
                if not len(where):
                    continue
                hi = np.searchsorted(token, g[where], "right")
                n = hi - lo[where]
                pos = np.repeat(where, n)
                probe = np.repeat(lo[where], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = pos - at[probe]
                fit = (begin >= 0) & (begin + k <= len(h))
                pos, probe, begin = pos[fit], probe[fit], begin[fit]
                fit = (text[begin] == text[pos]) & (text[begin + k - 1] == text[pos])
                probe, begin = probe[fit], begin[fit]
                fit = np.ones(len(begin), bool)
                for j in range(k):
                    fit &= h[begin + j] == windows.words[k][row[probe], j]
                for b, r in zip(begin[fit].tolist(), row[probe[fit]].tolist()):
                    d = int(text[b])
                    spans, items = marks.setdefault(d, ([], set()))
                    first = int(s.word_at[d])
                    spans.append((b - first, b - first + k))
                    items.update(windows.items[k][r])
            spans_out, items_out = [], []
            for i in range(s.n):
                spans, items = marks.get(i, ([], ()))
                spans_out.append(merge_spans(spans))
                items_out.append(sorted(windows.ids[x] for x in items))
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(s.first, s.n),
                    pa.array(counts.astype(np.int64)),
                    pa.array(spans_out, pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(set(x)) for x in items_out], pa.list_(pa.string())),
                ],
                HITS.names,
            )


def merge_spans(spans: list) -> list:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def _merged(batches):
    for batch in batches:
        rows = batch.to_pydict()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([merge_spans([tuple(y) for x in s for y in x]) for s in rows["spans"]], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted({y for x in s for y in x}) for s in rows["items"]], pa.list_(pa.string())),
            ],
            HITS.names,
        )


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, spans of words inside any occurring window, and ids of the items with one."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.length("text") * 4 + 32), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    found, every = None, docs
    if n_blocks > 1:  # blocks are merged by the number of the row in a written table
        every, row = numbered(docs)
        docs = every.select(F.col(row).alias("doc_id"), "text")
    for k in range(n_blocks):
        block = bench if n_blocks == 1 else bench.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k)
        rows = block.collect()  # a block's size is bounded
        ids = sorted({r["id"] for r in rows if r["id"] is not None})
        at = {x: i for i, x in enumerate(ids)}
        w = _windows(ids, at, rows, window)
        sent = spark.sparkContext.broadcast(w)
        schema = "g int, at long, n long"
        counts = map_batches(docs.select("text"), lambda b, v=sent: _counts(v.value, b), schema)
        rarity = {g: np.zeros(max(1, len(v)), np.int64) for g, v in w.vocab.items()}
        for g, x, n in counts.groupBy("g", "at").agg(F.sum("n").alias("n")).collect():  # one row for each shingle of the block
            rarity[g][x] = n
        w.order(rarity)
        ordered = spark.sparkContext.broadcast(w)
        part = map_batches(docs, lambda b, v=ordered: _find(v.value, b), HITS)
        if n_blocks == 1:
            return part
        part = stash(part.filter("size(items) > 0").select(F.col("doc_id").alias("of"), "spans", "items"), "items")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("of").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
    both = every.select(row, "doc_id", n_words).join(merged, F.col(row) == F.col("of"), "left")
    none = F.array().cast("array<array<array<bigint>>>"), F.array().cast("array<array<string>>")
    both = both.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    return map_batches(both, _merged, HITS)


def _windows(ids: list[str], at: dict, rows: list, window: int) -> Windows:
    """Rows that repeat an item_id give windows to that one item; they are not joined to each other."""
    order = [(at[r["id"]], r["text"]) for r in rows if r["id"] is not None]
    order.sort()
    w = Windows([ids[i] for i, _ in order], [t for _, t in order], window)
    return w


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **options) -> DataFrame:
    """The digest of ``find_items``: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_items(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 1, **options) -> DataFrame:
    """The documents in which fewer than ``min_items`` items occur, with all their columns; rows go by themselves, whatever their doc_id."""
    rows, row = numbered(docs)
    bad = contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, min_items, **options).filter("contaminated")
    return without(rows, row, bad.select("doc_id"))
