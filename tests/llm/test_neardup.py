import random

import numpy as np
import pytest

from barloom.llm import neardup
from barloom.llm.components import components
from barloom.llm.neardup import REGISTERS, drop_near_duplicates, likelihood, likely, near_duplicates, registers


def brute(rows, width, percent=80):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])

    sets = [(i, shingles(t)) for i, t in rows]
    par = {i: i for i, _ in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def _texts(seed, families=12, size=14):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    out = []
    for _ in range(families):
        base = [word() for _ in range(r.randint(3, 160))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = word()
            base = t if r.random() < 0.5 else base  # chains drift away from their start
            out.append(" ".join(t))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 2), (3, 5)])
def test_against_brute_force(docs, seed, width):
    texts = [*_texts(seed), None, "", "one", "ONE", "a b", "a  b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), width=width).collect()}
    assert got == brute(rows, width)


def test_stragglers_in_blocks(docs, monkeypatch):
    """A large drifting family: small blocks and chunks lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    texts = _texts(7, families=2, size=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(texts), width=2).collect()}
    assert got == brute(list(enumerate(texts)), 2)


def test_registers_merge_and_estimate():
    r = np.random.default_rng(0)
    u = r.integers(0, 2**63, 3000, dtype=np.uint64)
    assert (np.maximum(registers(u[:2000]), registers(u[1000:])) == registers(u)).all()
    for j in (0.3, 0.6, 0.8, 0.95):
        both = int(2000 * j / (1 + j) * 2 / 2)
        x = r.integers(0, 2**63, 4000 - both, dtype=np.uint64)
        a, b = x[:2000], x[2000 - both :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ka, kb = registers(a), registers(b)
        est = likelihood(np.array([2000.0]), np.array([float(len(b))]), np.array([(ka > kb).sum()]), np.array([(ka < kb).sum()]))[0]
        assert abs(est - true) < 0.12


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 150), (150, 100)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd(odd, docs):
    rows = near_duplicates(odd, width=2).collect()
    assert len(rows) == 9
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[5, 3].component_id == 5 and by[6, 3].component_id == 5 and not by[6, 3].kept
    assert all(r.kept for r in rows if r.doc_id != 6)
    kept = drop_near_duplicates(odd, width=2)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7"])
    assert near_duplicates(docs([])).collect() == []


def test_repeated_id_is_one_node(docs):
    a, b = "one two three four five six", "red green blue black white grey"
    rows = near_duplicates(docs([(3, a), (3, b), (7, a), (9, b)]), width=2).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(3, 3), (7, 3), (9, 3)}


def test_one_row_of_a_group_stays(docs):
    """Also where rows repeat a doc_id or have none."""
    text = " ".join(f"w{i}" for i in range(40))
    df = docs([(None, text), (9, text), (3, text), (3, text), (None, "apart"), (9, "other"), (8, None), (8, None)])
    got = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(df).collect())
    assert got == sorted([("3", text), ("None", "apart"), ("9", "other"), ("8", None), ("8", None)], key=lambda x: (x[0], str(x[1])))


def test_slope_tells_what_the_estimate_tells():
    r = np.random.default_rng(1)
    a = r.integers(1, 3000, 20000).astype(float)
    b = np.maximum(1, np.round(a * r.uniform(0.5, 1.6, len(a))))
    same = r.integers(100, REGISTERS + 1, len(a))
    more = ((REGISTERS - same) * r.uniform(0, 1, len(a))).astype(int)
    less = REGISTERS - same - more
    est = likelihood(a, b, more, less)
    clear = np.abs(est - 0.68) > 1e-3  # the estimate itself is a place on a grid
    assert ((est >= 0.68) == likely(a, b, more, less, 0.68))[clear].all()
    assert 0.1 < (est >= 0.68).mean() < 0.9


@pytest.mark.parametrize("table", [16 << 20, 1])
def test_sets_of_a_block_are_met_in_tables_of_any_size(table, monkeypatch):
    """Families around the threshold: the links of ``_meet`` join what links between all pairs join."""
    import pyarrow as pa

    r = random.Random(5)
    monkeypatch.setattr(neardup, "TABLE", table)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if r.random() > 0.04 else f"x{r.randrange(99999)}" for w in base) for _ in range(30)] + ["", "one"]
    ids, n = list(range(len(texts))), len(texts)
    cols = [[1] * 2 * n, [0] * 2 * n, [0] * 2 * n, [0] * n + [1] * n, ids * 2, ids * 2, texts * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["band", "l_part", "r_part", "side", "doc_id", "comp", "text"])
    got = {(x["a"], x["b"]) for out in neardup._meet(iter(batch[k : k + 7] for k in range(0, 2 * n, 7)), 2, 80) for x in out.to_pylist()}
    sets = [set(zip(t.split(), t.split()[1:])) or ({(t,)} if t else set()) for t in texts]
    want = {(i, j) for i in ids for j in ids[i + 1 :] if 100 * len(sets[i] & sets[j]) >= 80 * max(1, len(sets[i] | sets[j]))}
    assert want and got == want
