import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm.kneser import add_up, add_up_pairs, discounts, language_model_scores, pack, pack_pairs, pair_keys, pair_words, train, unpack, unpack_pairs

low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    """Modified Kneser-Ney over words in dicts."""
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"] for i, t in rows}
    train = [w for i, w in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    pairs = Counter(p for w in train for p in zip(["<s>", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    follows, after = Counter(w for _, w in pairs), defaultdict(Counter)
    for (h, w), k in pairs.items():
        after[h][w] = k
    cc = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d2, d1 = [0, *discounts(cc(pairs.values()))], [0, *discounts(cc(follows.values()))]
    rest = sum(d1[min(x, 3)] for x in follows.values()) / len(pairs)
    out = {}
    for i, w in tok.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip(["<s>", *w[:-1]], w):
            f = follows[x]
            p = (f - d1[min(f, 3)]) / len(pairs) + rest / (v + 1)
            if h in after:
                total = sum(after[h].values())
                gamma = sum(d2[min(k, 3)] for k in after[h].values()) / total
                k = after[h][x]
                p = (k - d2[min(k, 3)]) / total + gamma * p
            score += math.log10(p)
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, base, score)
    return out


def _texts(n=120):
    r = random.Random(4)
    vocab = ["the", "of", "And", "to", *["w%d" % k for k in range(300)]]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    return [" ".join(r.choices(vocab, weights, k=r.randint(0, 80))) for _ in range(n)]


def test_against_brute_force(docs):
    texts = [*_texts(), None, "", "new words only"]
    rows = {r.doc_id: r for r in language_model_scores(docs(texts)).collect()}
    for i, (n, known, total, base, score) in brute(list(enumerate(texts))).items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)


def test_blocks():
    r = np.random.default_rng(0)
    k = np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))
    n = r.integers(1, 9, len(k), dtype=np.uint64)
    a, (b,) = unpack(pack(k, n))
    assert (a == k).all() and (b == n).all()
    a, (b,) = add_up(np.array([3, 1, 3], np.uint64), [np.array([1, 1, 4], np.uint64)])
    assert a.tolist() == [1, 3] and b.tolist() == [1, 5]


def test_pairs_by_both_words_whole():
    """Words that share their upper halves stay apart, in any order of arrival."""
    r = np.random.default_rng(1)
    words = np.concatenate([r.integers(0, 2**64, 20, dtype=np.uint64), (np.uint64(7) << np.uint64(32)) + np.arange(20, dtype=np.uint64)])
    ctx, tok = r.choice(words, 30_000), r.choice(words, 30_000)
    assert all((x == y).all() for x, y in zip(pair_words(*pair_keys(ctx, tok)), (ctx, tok)))
    keys, rest, n = add_up_pairs(*pair_keys(ctx, tok), np.ones(len(ctx), np.uint64))
    got = dict(zip(zip(*(x.tolist() for x in pair_words(keys, rest))), n.tolist()))
    assert got == Counter(zip(ctx.tolist(), tok.tolist())) and len(got) == len(n)
    again, (more, m) = unpack_pairs(pack_pairs(keys, rest, n))
    assert (again == keys).all() and (more == rest).all() and (m == n).all()


def test_counts_beyond_two_bytes(docs):
    texts = ["a b " * 70_000, "a c a b", "b a c"]
    rows = {r.doc_id: r for r in language_model_scores(docs(texts)).collect()}
    for i, (_, _, total, base, score) in brute(list(enumerate(texts))).items():
        assert rows[i].train_tokens == total and rows[i].score == pytest.approx(score, rel=1e-9) and rows[i].base_score == pytest.approx(base, rel=1e-9)


def test_probabilities_sum_to_one(docs):
    import pyarrow as pa

    from barloom.llm.kneser import END
    from barloom.llm.textvec import SPACED, slices

    texts = _texts()
    model = train(docs(texts).select("text"))
    words = sorted({w for t in texts for w in low(t).split()})
    print_of = np.concatenate([s.hashes() for s in slices(pa.array(words), SPACED)])
    every = np.concatenate([print_of, [END, np.uint64(12345)]])  # all words, the end, and one unknown
    assert len(every) == model.distinct + 1
    for h in (print_of[0], print_of[7], np.uint64(999)):
        _, p = model.log10(every, np.full(len(every), h))
        assert (10**p).sum() == pytest.approx(1)


def test_held_out_perplexity(spark):
    """Lower than that of the base on held-out documents of the tables."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = [r for r in language_model_scores(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(r[c] for r in rows) / n) for c in ("score", "base_score"))
    assert len(rows) > 10 and model < 0.8 * base, (model, base)


def test_odd(odd, docs):
    rows = language_model_scores(odd).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert language_model_scores(docs([])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = language_model_scores(docs([(held, "a b")])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0
