import hashlib
import random
import re

import pytest

from barloom.llm.decontaminate import contamination, decontaminate, find_items

low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def brute(docs, items, k=8):
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for j, u in items:
            u = words(u)
            n = min(k, len(u))
            for a in range(len(u) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == u[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(j))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def _case():
    r = random.Random(3)
    word = lambda: r.choice(["aa", "B", "cé", "d1", "ee", "the", "of"])
    items = [(j, " ".join(word() for _ in range(r.choice([1, 3, 8, 9, 20])))) for j in range(12)] + [(50, None), (51, ""), (52, "!!")]
    texts = []
    for i in range(60):
        t = [word() for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            u = (items[r.randrange(12)][1]).split()
            a = r.randrange(max(1, len(u) - 8 + 1))
            t[len(t) // 2 : len(t) // 2] = u[a : a + r.choice([7, 8, 12])]
        texts.append(", ".join(t).upper())
    return list(enumerate(texts)) + [(90, None), (91, "")], items


@pytest.mark.parametrize("block_bytes", [8 << 20, 120])
def test_against_brute_force(docs, spark, block_bytes):
    texts, items = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs(texts), bench, block_bytes=block_bytes).collect()}
    assert got == brute(texts, items)


def test_filter_and_spans(docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    df = docs(["clean text with alpha beta gamma", "say Alpha beta-gamma delta epsilon zeta eta theta now", f"{item} kappa"])
    assert [r.doc_id for r in decontaminate(df, bench).collect()] == [0] and decontaminate(df, bench).columns == df.columns
    rows = {r.doc_id: r for r in find_items(df, bench).collect()}
    assert rows[1].spans == [[1, 9]] and rows[1]["items"] == ["1", "2"] and rows[2].spans == [[0, 9]]


def test_odd(odd, docs, spark):
    bench = spark.createDataFrame([(1, "same text here now"), (None, "no id at all")], "item_id long, text string")
    rows = contamination(odd, bench).collect()
    assert len(rows) == 9 and {r.n_items for r in rows if r.doc_id in (5, 6)} == {1} and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert decontaminate(odd, bench).columns == odd.columns and decontaminate(odd, bench).count() == 6
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, empty).filter("n_items > 0").count() == 0 and contamination(docs([]), bench).collect() == []


def test_rows_stay_rows_with_many_blocks(docs, spark):
    texts, items = _case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in texts])
    one, many = (sorted(map(str, contamination(df, bench, block_bytes=n).collect())) for n in (8 << 20, 120))
    assert len(one) == len(texts) and one == many


def test_rows_go_by_themselves(docs, spark):
    """Contaminated rows without a doc_id go, and clean rows that share a contaminated row's doc_id stay."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = docs([(None, f"one {item}"), (None, f"{item} two"), (None, "clean"), (4, item), (4, "clean too"), (5, "")])
    for n in (8 << 20, 40):
        assert sorted((str(r.doc_id), r.text) for r in decontaminate(df, bench, block_bytes=n).collect()) == [("4", "clean too"), ("5", ""), ("None", "clean")]
