import io
import wave

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import chroma
from barloom.llm.chroma import ERRORS, OVERLAP, RATE, SILENT, Block, align_recordings, fingerprint, read_wav, render


def wav(x, rate=RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.repeat(x[:, None], channels, 1) * 8000, -32000, 32000).astype("<i2").tobytes())
    return out.getvalue()


def _melody(seed, n=80):
    return render(np.random.default_rng(seed).normal(0, 0.2, n).tolist())


def ber(a, b):
    n = min(len(a), len(b))
    return np.bitwise_count(a[:n] ^ b[:n]).sum() / (32 * n)


def test_fingerprints_are_robust():
    x = _melody(1)
    noisy = x + np.random.default_rng(0).normal(0, 0.1, len(x)).astype(np.float32)
    assert ber(fingerprint(x), fingerprint(noisy)) < 0.12 < 0.25 < ber(fingerprint(x), fingerprint(_melody(2)))
    back = read_wav(wav(np.interp(np.arange(0, len(x), 0.5), np.arange(len(x)), x), rate=2 * RATE, channels=2))
    assert ber(fingerprint(x), fingerprint(back)) < 0.12
    assert len(fingerprint(None)) == len(fingerprint(np.zeros(10, np.float32))) == 0
    assert read_wav(b"junk") is None and read_wav(b"") is None and read_wav(None) is None


def test_alignment(spark):
    x = _melody(1)
    noise = lambda s: np.random.default_rng(s).normal(0, 0.1, len(x)).astype(np.float32)
    cut = x[256 * 30 :]
    rows = [(0, wav(x)), (1, wav(x)), (2, wav(x + noise(1))), (3, wav(cut)), (4, wav(_melody(9))), (5, b"junk"), (6, None), (50, wav(cut)), (None, wav(x))]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "rec_id long, media binary").withColumn("class_id", F.lit("clash"))
    for block in (1 << 22, 100):
        out = align_recordings(df, F.col("rec_id") % 50 == 0, block_bytes=block).collect()
        member = {r.rec_id: r.class_id for r in out if r.row == "member" and r.rec_id is not None}
        assert member == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 50: 3}
        pair = {(r.class_id, r.query_class): r.offset for r in out if r.row == "pair"}
        assert pair == {(0, 0): 0, (2, 0): 0, (3, 0): -30, (0, 3): 30, (2, 3): 30, (3, 3): 0}
    assert align_recordings(df.limit(0), F.col("rec_id") % 50 == 0).collect() == []


def test_broken_silent_and_long_media(spark):
    zero = bytearray(wav(_melody(1)))
    zero[24:28] = b"\0" * 4  # a frame rate of 0
    none = bytearray(wav(_melody(1)))
    none[22:24] = b"\0" * 2  # no channels
    assert read_wav(bytes(zero)) is None and read_wav(bytes(none)) is None and all(read_wav(wav(_melody(1))[:k]) is None for k in (3, 20, 43))
    hush, tone = np.zeros(RATE * 60, np.float32), np.sin(np.arange(RATE * 60) * 0.7).astype(np.float32)
    assert set(fingerprint(hush).tolist()) == {int(SILENT)}
    long = np.concatenate([_melody(3, 900), _melody(1)])
    rows = [(0, wav(hush)), (1, wav(hush[: RATE * 30])), (50, wav(tone)), (2, wav(tone)), (100, wav(long)), (3, wav(_melody(1))), (100, wav(long)), (4, bytes(zero))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "rec_id long, media binary")
    out = align_recordings(df, F.col("rec_id") % 50 == 0).collect()
    pair = {(r.class_id, r.query_class): r.offset for r in out if r.row == "pair"}
    assert pair == {(2, 2): 0, (100, 100): 0, (3, 100): len(fingerprint(_melody(1))) - len(fingerprint(long))}
    assert sorted((r.rec_id, r.class_id) for r in out if r.row == "member") == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (50, 2), (100, 100), (100, 100)]


def test_votes_in_chunks(monkeypatch):
    r = np.random.default_rng(3)
    prints = [r.choice(np.array([1, 2, 77 << 20, 5], np.uint32), 60).astype("<u4").tobytes() for _ in range(5)]
    block = Block(list(range(5)), prints)
    p = np.frombuffer(prints[2], "<u4")
    whole = block.votes(p)
    monkeypatch.setattr(chroma, "CHUNK", 50)
    assert all((a == b).all() for a, b in zip(whole, block.votes(p)))


def test_recall_against_all_offsets():
    """Noisy, cut and plain recordings: what a comparison at every offset aligns, by share of different bits."""
    r = np.random.default_rng(11)
    queries = [_melody(k) for k in range(12)]
    prints = [fingerprint(x) for x in queries]
    block = Block(list(range(12)), [p.astype("<u4").tobytes() for p in prints])
    true, found = ({0.15: 0, 0.2: 0, ERRORS: 0} for _ in range(2))
    for k in range(600):
        x = queries[k % 12]
        x = x[256 * int(r.integers(0, 40)) :]
        p = fingerprint((x + r.normal(0, r.uniform(0.5, 3), len(x))).astype(np.float32))
        got = {q for q, *_ in block.matches(p)}
        for q, own in enumerate(prints):
            best = 1.0
            for off in range(-len(own) + 1, len(p)):
                a, b = max(0, off), min(len(p), len(own) + off)
                if b - a >= OVERLAP * min(len(own), len(p)):
                    best = min(best, np.bitwise_count(p[a:b] ^ own[a - off : b - off]).sum() / (32 * (b - a)))
            for band in true:
                if best <= band:
                    true[band] += 1
                    found[band] += q in got
    assert true[ERRORS] > 150 and found[0.15] == true[0.15] and found[ERRORS] >= 0.9 * true[ERRORS]
