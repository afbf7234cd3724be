"""Chroma audio fingerprints: alignment of recordings in a media column.

1. A recording (16-bit PCM in a WAV container, or samples made by ``decode``) is brought to
   ``RATE`` and cut into overlapping frames; a frame's spectrum is folded into twelve pitch
   classes, smoothed over time and scaled to unit length.
2. Filters compare sums over rectangles of that image, taken from its integral image; each
   filter's value is put in one of four classes, Gray-coded in two bits. Sixteen filters make
   a packed 32-bit integer for each place of a window of ``WINDOW`` frames.
3. Recordings with the same fingerprint form a class with its smallest id as representative.
4. Queries are taken in blocks of about ``BLOCK_BYTES`` of fingerprints (a bound on what reaches the
   driver and is broadcast), each of which is one pass over all classes. The upper, middle and lower
   ``KEY_BITS`` bits of the integers, but for that of silence, are looked up in the block; what they
   hit votes for (query, offset) in a histogram, ``CHUNK`` hits at a time. Places with ``VOTES`` votes are compared over
   the whole overlap, which must be ``OVERLAP`` of the shorter recording, and at most ``ERRORS``
   of the bits may differ. A hot value costs votes in
   a worker, never rows.

``render`` makes the test recordings: a vector's numbers as notes of a melody.

Defined results: null, empty, unreadable (broken headers too) or too short media have no fingerprint, are a class of
their own each and match nothing; silent recordings have a fingerprint and a class, but no votes, so they match nothing; a null rec_id is no representative and stays without a class; rows that
repeat a rec_id are members of each of their classes; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import map_batches, stash

RATE, FRAME, HOP, WINDOW = 4000, 1024, 256, 12
VOTES, OVERLAP, ERRORS, BLOCK_BYTES, CHUNK = 3, 0.5, 0.25, 4 << 20, 1 << 22
KEY_BITS, SHIFTS = 20, (12, 6, 0)

_FREQ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = np.flatnonzero((_FREQ >= 100) & (_FREQ <= 1900))
_CLASS = np.round(12 * np.log2(_FREQ[_USED] / 440)).astype(int) % 12
_FOLD = (np.arange(12)[:, None] == _CLASS[None, :]).astype(np.float32)
_HANN = np.hanning(FRAME).astype(np.float32)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest class, height, width) by a rule: kinds in turn, heights and widths falling."""
    out = []
    for i in range(16):
        height = (12, 6, 4, 3)[i % 4]
        out.append((i % 3, (5 * i) % (13 - height), height, (12, 8, 6, 4)[(i // 4) % 4]))
    return out


FILTERS = _filters()
LIMITS = (-0.2, 0.0, 0.2)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def read_wav(data: bytes | None) -> np.ndarray | None:
    """Mono samples at ``RATE`` of a 16-bit WAV file, or None."""
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32)
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(axis=1)
            n = int(len(x) * RATE / w.getframerate())
            return np.interp(np.arange(n) * w.getframerate() / RATE, np.arange(len(x)), x).astype(np.float32) if n else None
    except (wave.Error, EOFError, ValueError, ArithmeticError, struct.error):
        return None


def render(vector: list | None) -> np.ndarray | None:
    """A melody with a note for each number of a vector: pitch by its rank in a fixed range, over the note before."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float32))
    return _NOTES[np.clip(np.round(v * 40) + 18, 0, 36).astype(int)].ravel()


def _notes() -> np.ndarray:
    """37 half tones from 220 Hz, each with its octave."""
    phase = 2 * np.pi * 220 * 2 ** (np.arange(37)[:, None] / 12) * np.arange(2 * HOP)[None, :] / RATE
    return (np.sin(phase) + 0.5 * np.sin(2 * phase)).astype(np.float32)


_NOTES = _notes()


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch classes, of unit length."""
    n = 1 + (len(x) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.as_strided(x, (n, FRAME), (x.strides[0] * HOP, x.strides[0])) * _HANN
    spectrum = np.fft.rfft(frames, axis=1)[:, _USED]
    power = spectrum.real**2 + spectrum.imag**2
    c = power @ _FOLD.T
    wide = np.pad(c, ((2, 2), (0, 0)), mode="edge")
    c = sum(w * wide[k : k + n] for k, w in enumerate(_SMOOTH))
    norm = np.sqrt((c**2).sum(axis=1, keepdims=True))
    return np.divide(c, norm, out=np.zeros_like(c), where=norm > 1e-3)


def fingerprint(x: np.ndarray | None) -> np.ndarray:
    """Packed integers, one for each window of frames."""
    c = chroma(np.ascontiguousarray(x)) if x is not None else np.zeros((0, 12))
    n = len(c) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    table = np.zeros((len(c) + 1, 13))
    table[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return table[at + t1, y1] - table[at + t0, y1] - table[at + t1, y0] + table[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # lower against upper classes
            a, b = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        elif kind == 1:  # earlier against later frames
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        else:  # a checkerboard
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = area(0, w // 2, y + h // 2, y + h) + area(w // 2, w, y, y + h // 2)
        value = np.log((1 + a) / (1 + b))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(LIMITS, value)]
    return out


def _prints(batches, decode):
    for batch in batches:
        media = batch.column(1).to_pylist()
        out = [fingerprint(decode(m)) for m in media]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.astype("<u4").tobytes() if len(f) else None for f in out], pa.binary())], ["rec_id", "print"])


#: what a window without energy gives
SILENT = fingerprint(np.zeros(FRAME + (WINDOW - 1) * HOP, np.float32))[0]


def lookup_keys(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of packed integers, marked by which part they are, and their places; silence has none."""
    at = np.flatnonzero(p != SILENT)
    part = [((p[at] >> np.uint32(s)) & np.uint32((1 << KEY_BITS) - 1)) | np.uint32(i << KEY_BITS) for i, s in enumerate(SHIFTS)]
    return np.concatenate(part), np.tile(at, len(SHIFTS))


class Block:
    """Fingerprints of some queries with an index over parts of their integers."""

    def __init__(self, ids: list[int], prints: list[bytes]):
        self.ids = ids
        self.prints = [np.frombuffer(p, "<u4") for p in prints]
        self.length = np.array([len(p) for p in self.prints])
        keys, places = zip(*map(lookup_keys, self.prints))
        self.keys, place = np.concatenate(keys), np.concatenate(places)
        which = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        by = np.argsort(self.keys, kind="stable")
        self.keys, self.which, self.place = self.keys[by], which[by].astype(np.int64), place[by].astype(np.int64)

    def votes(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits by (query, offset), packed; they are spread out at most ``CHUNK`` (or those of one place) at a time."""
        keys, places = lookup_keys(p)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = hi - lo
        upto = np.cumsum(n)
        pairs, votes, i = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
            m = n[i:j]
            at = np.repeat(lo[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            offset = np.repeat(places[i:j], m) - self.place[at]
            more, k = np.unique((self.which[at] << np.int64(32)) + offset + (1 << 31), return_counts=True)
            if len(pairs):
                more, back = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                k = np.bincount(back, np.concatenate([votes, k])).astype(np.int64)
            pairs, votes, i = more, k, j
        return pairs, votes

    def matches(self, p: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, votes, share of different bits) of the best offset of each query that aligns."""
        pairs, votes = self.votes(p)
        pairs, votes = pairs[votes >= VOTES], votes[votes >= VOTES]
        which, off = pairs >> 32, (pairs & 0xFFFFFFFF) - (1 << 31)
        own_n = self.length[which]
        common = np.minimum(len(p), own_n + off) - np.maximum(0, off)
        fit = common >= OVERLAP * np.minimum(own_n, len(p))
        best: dict[int, tuple] = {}
        for q, off, v in zip(which[fit].tolist(), off[fit].tolist(), votes[fit].tolist()):
            own = self.prints[q]
            a, b = max(0, off), min(len(p), len(own) + off)
            errors = int(np.bitwise_count(p[a:b] ^ own[a - off : b - off]).sum()) / (32 * (b - a))
            if errors <= ERRORS and (q not in best or (errors, -v, off) < best[q]):
                best[q] = (errors, -v, off)
        return [(q, off, -v, e) for q, (e, v, off) in best.items()]


def _align(batches, block: Block):
    for batch in batches:
        rows = []
        for i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(i, block.ids[q], off, v, e) for q, off, v, e in block.matches(np.frombuffer(p, "<u4"))]
        cols = list(zip(*rows)) if rows else [[], [], [], [], []]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["class_id", "query_class", "offset", "votes", "bit_error"])


def align_recordings(media: DataFrame, is_query: Column, decode=read_wav, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``member`` (rec_id and its class_id) and rows ``pair`` (a class and a query's class that align).

    ``media`` has rec_id and media; ``is_query`` says which rows are queries. ``offset`` is the
    frame of the recording at which the query begins.
    """
    spark = media.sparkSession
    rows = media.select(F.col("rec_id").cast("long").alias("rec_id"), "media", is_query.alias("q"))
    prints = map_batches(rows.select("rec_id", "media"), lambda b: _prints(b, decode), "rec_id long, print binary")
    prints = stash(prints.withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("key", F.sha2("print", 256)), "prints")
    known = prints.filter("print is not null and rec_id is not null")
    classes = stash(known.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max("q").alias("q"), F.first("print").alias("print")), "classes")
    size = classes.filter("q").agg(F.coalesce(F.sum(F.octet_length("print")), F.lit(0))).first()[0]
    parts = -(-size // block_bytes)
    pairs = None
    for k in range(parts):
        own = classes.filter(F.col("q") & (F.pmod(F.xxhash64("key"), F.lit(parts)) == k))
        rows = sorted((r["class_id"], bytes(r["print"])) for r in own.select("class_id", "print").collect())  # about one block
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Block([i for i, _ in rows], [p for _, p in rows]))
        found = map_batches(classes.select("class_id", "print"), lambda b, s=sent: _align(b, s.value), "class_id long, query_class long, offset long, votes long, bit_error double")
        found = found if parts == 1 else stash(found, "aligned")
        pairs = found if pairs is None else pairs.unionByName(found)
    of = prints.join(classes.select("key", "class_id"), "key", "left")
    member = of.select(F.lit("member").alias("row"), "rec_id", F.coalesce("class_id", "rec_id").alias("class_id"))
    if pairs is None:
        pairs = spark.createDataFrame([], "class_id long, query_class long, offset long, votes long, bit_error double")
    return member.unionByName(pairs.withColumn("row", F.lit("pair")), allowMissingColumns=True)
