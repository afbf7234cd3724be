import math
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from barloom.llm import mix as module
from barloom.llm.mix import BUCKETS, ROUNDS, mix, mixed_blocks, permuted, slots


def water(sizes, weights, share, limit):
    """Excess shared anew by weight until no target is above its limit."""
    total, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    rest = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = limit * sizes[i]
            free.discard(i)
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def test_targets_and_taken(docs):
    names = ["b", None, "a", "c", "é"]
    texts, source = [], []
    for k, n in enumerate((40, 7, 300, 11, 90)):
        for j in range(n):
            texts.append("w " * (1 + (k * j) % 37))
            source.append(names[k])
    df = docs(texts, source)
    rows = mix(df, block=16).collect()
    assert len(rows) == len(texts)
    order = ["a", "b", "c", "é", None]
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in order]
    want = dict(zip(order, water(sizes, [3, 1, 2, 3, 1], 1.5, 2)))
    for s, n in zip(order, sizes):
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == n and r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(df.repartition(3), block=16).collect()))


def test_slots_fill_the_quota(docs):
    df = docs(["x " * 50] * 60, ["a"] * 30 + ["b"] * 30)
    drawn, pieces, sources, _ = mixed_blocks(df, block=16)
    got = {(r["source"], r["k"]) for r in drawn.collect()}
    need = {r["source"]: r["need"] for r in sources.collect()}
    assert got == {(s, k) for s, n in need.items() for k in range(n)}
    per = drawn.groupBy("source", "epoch", "block").count().filter("count > 1")
    assert per.count() == 0
    assert pieces.count() >= 60 and slots(sources, 1).count() == slots(sources, 2).count()


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_odd(odd, docs):
    rows = mix(odd, block=8).collect()
    assert len(rows) == 9 and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mix(docs([])).collect() == []
    assert [r["taken"] for r in mix(docs([None, ""])).collect()] == [0, 0]


# ---- the whole mix over Python's integers


def h(*parts, seed=42):
    """xxhash64 of columns: strings as they are, (value, 4) as an int, others as longs."""
    for x in parts:
        data = x.encode() if isinstance(x, str) else struct.pack("<i", x[0]) if isinstance(x, tuple) else struct.pack("<q", x)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def shuffled(v, n, key):
    for r in range(1, ROUNDS + 1):
        other = (h(key, (r, 4)) % n - v) % n
        if h(key, (r, 4), max(v, other)) & 1:
            v = other
    return v


def brute(rows, block, shard_size, seed=17):
    """Words taken of each doc_id, from (doc_id, source, size): streams, draws along shards, what is over to what lacks, permuted blocks."""
    streams = defaultdict(list)
    for i, s, n in rows:
        streams[s].append((h(i, (5, 4)) % BUCKETS, i, n))
    names = sorted(streams)
    sizes = [sum(n for *_, n in streams[s]) for s in names]
    quota = [math.floor(t + 1e-6) for t in water(sizes, [[3, 1, 2][k % 3] for k in range(len(names))], 1.5, 2)]
    blocks, need = [], []
    for n, t in zip(sizes, quota):
        blocks.append(-(-n // block))
        need.append(t // n * blocks[-1] + -(-(t % n) // block) if n else 0)
    total = sum(need)
    upto = [sum(need[: k + 1]) / total for k in range(len(need))]
    drawn = Counter()
    for i in range(total):
        u = ((h(i, (seed, 4)) % (1 << 64)) >> 11) / 2**53
        drawn[i // shard_size, next(k for k, e in enumerate(upto) if e > u)] += 1
    have = [0] * len(names)
    for (_, k), n in sorted(drawn.items()):
        have[k] = min(need[k], have[k] + n)
    assert any(a < b for a, b in zip(have, need)), "the fixture has nothing to fill"
    taken = Counter()
    for k, s in enumerate(names):  # which shard a slot is in does not change what it takes
        pieces, first = [], 0
        for _, i, n in sorted(streams[s]):
            pieces.append((first, first + n, i))
            first += n
        full = sizes[k] // block
        for slot in range(need[k]):
            epoch, at = divmod(slot, blocks[k])
            b = shuffled(at, full, h((seed, 4), s, epoch)) if at < full else at
            tokens = min(block, sizes[k] - b * block)
            if slot == need[k] - 1 and (quota[k] % sizes[k]) % block:
                tokens = (quota[k] % sizes[k]) % block
            for lo, hi, i in pieces:
                taken[i] += max(0, min(hi, b * block + tokens) - max(lo, b * block))
    return taken


def test_taken_against_brute_force(docs, monkeypatch):
    """Small shards, cells and spans: many windows, the same words."""
    for name, value in (("SHARD", 16), ("CELL", 32), ("SPAN", 4), ("TASK", 50)):
        monkeypatch.setattr(module, name, value)
    sizes = [(k * 7919) % 41 for k in range(300)]
    source = ["hot" if k % 3 else f"s{k % 7}" for k in range(300)]
    rows = mix(docs(["w " * n for n in sizes], source), block=8).collect()
    want = brute(list(zip(range(300), source, sizes)), 8, 16)
    assert {r["doc_id"]: r["taken"] for r in rows} == {i: want[i] for i in range(300)}


def test_shards_are_full(docs, monkeypatch):
    """Every shard but the last has its number of slots, and shards and sources fit the draws as far as needs allow."""
    for name, value in (("SHARD", 16), ("CELL", 32), ("SPAN", 4)):
        monkeypatch.setattr(module, name, value)
    drawn, _, sources, _ = mixed_blocks(docs(["x " * (20 + k % 9) for k in range(200)], [f"s{k % 5}" for k in range(200)]), block=8)
    per = Counter(r["shard"] for r in drawn.collect())
    total = sum(r["need"] for r in sources.collect())
    assert sorted(per) == list(range(-(-total // 16))) and all(n == 16 for s, n in per.items() if s < total // 16)
