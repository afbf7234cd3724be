import hashlib
import random
from collections import Counter, defaultdict

import pytest

from barloom.llm.linededup import AGREE, DEPTH, DOCS, LONG, MINIMA, OWN, SPREAD, drop_recurring_lines

DIGITS = set("0123456789")


def mask(line):
    """The tokens of a line; variable fields are None where enough tokens are constant."""
    words = line.split()
    constant = sum(not DIGITS & set(w) for w in words)
    return tuple(None if DIGITS & set(w) and constant >= DEPTH else w for w in words)


def low(tokens, starts, seed):
    """The smallest fingerprint of the word pairs that start at some places: any hash function shows the same."""
    pairs = [repr((seed, *tokens[i : i + 2])).encode() for i in starts if i + 1 < len(tokens)]
    return min((hashlib.blake2b(p, digest_size=8).digest() for p in pairs), default=b"none")


def agree(a, b):
    same = [x for x, y in zip(a, b) if x == y]
    return 100 * len(same) >= AGREE * len(a) and sum(x is not None for x in same) >= DEPTH


def brute(texts):
    """The module's rule over strings, with nothing of the module's own."""
    parsed = [[mask(x) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(m for ms in parsed for m in set(ms) if m)
    leaves = defaultdict(list)
    for m in seen:
        leaves[len(m), m[:DEPTH]].append(m)
    template = {}
    for ms in leaves.values():
        tops = []
        for m in sorted(ms, key=lambda m: -seen[m]):
            of = next((t for t in tops if agree(m, t)), None)
            if of is None:
                tops.append(m)
            template[m] = m if of is None else of
    size = Counter()
    for m, n in seen.items():
        size[template[m]] += n
    members = defaultdict(Counter)
    for ms in parsed:
        tokens, starts = [], []
        for m in ms:
            starts.append(range(len(tokens), len(tokens) + len(m)))
            tokens += m
        n = [size[template[m]] if m else 1 for m in ms]
        for i, m in enumerate(ms):
            if not m or m in ms[:i] or n[i] < 2:
                continue
            rarer = [j for j in range(len(ms)) if ms[j] and 2 * n[j] <= n[i]]
            fewer = [j for j in range(len(ms)) if ms[j] and n[j] < n[i]]
            words = lambda js: sum(len(ms[j]) for j in js)
            use = rarer if rarer and OWN * words(rarer) >= len(tokens) - len(m) else [j for j in range(len(ms)) if j != i]
            ctx = tuple(low(tokens, [p for j in use for p in starts[j]], k) for k in range(MINIMA))
            members[template[m], len(m)][bool(fewer) and OWN * words(fewer) >= len(tokens), ctx] += 1
    bad = set()
    for (t, k), groups in members.items():
        shared = [Counter() for _ in range(MINIMA)]
        for (_, ctx), n in groups.items():
            for c, x in zip(shared, ctx):
                c[x] += n
        part = {g: n / max(c[x] for c, x in zip(shared, g[1])) for g, n in groups.items()}
        if sum(groups.values()) >= DOCS and sum(part.values()) >= SPREAD or k >= LONG and sum(v for g, v in part.items() if g[0]) > 1.99:
            bad.add(t)
    return [None if t is None else "\n".join(x for x, m in zip(t.split("\n"), ms) if template.get(m) not in bad) for t, ms in zip(texts, parsed)]


def _texts():
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = prose(60)
    texts = []
    for k in range(40):
        lines = [prose(r.randint(4, 20)) for _ in range(4)]
        if k % 2:
            lines.insert(r.randint(0, 4), f"Released on day {k} of the year 20{k:02d} by the team")
        if k % 5 == 0:
            lines.insert(2, passage)
        if k % 7 == 0:
            lines.append("All rights are reserved by " + ("Acme Widgets" if k else "Other Widgets") + " and friends of it")
        if k % 3 == 0:
            lines.insert(1, "Read more")
        if k % 4 == 0:
            lines.insert(1, f"{10 + k} {90 - k} {13 * k % 100}")
        texts.append("\n".join(lines))
    return [*texts, *[texts[3]] * 20, None, "", "one two", "\n\n"]


def test_against_brute_force(docs):
    texts = _texts()
    rows = {r.doc_id: r for r in drop_recurring_lines(docs(texts), digest=True).collect()}
    want = brute(texts)
    assert [rows[i].text for i in range(len(texts))] == want
    assert sum(w != t for w, t in zip(want, texts)) > 20
    assert rows[3].text.count("\n") == 3  # copies of a document stay whole but for the boilerplate lines
    assert not any("Read more" in (r.text or "") for r in rows.values()) and "10 90 0" in rows[0].text


def test_join_path_is_the_same(docs):
    df = docs(_texts())
    a = sorted(map(str, drop_recurring_lines(df, digest=True).collect()))
    assert a == sorted(map(str, drop_recurring_lines(df, digest=True, sent=0).collect()))
    b = sorted(map(str, drop_recurring_lines(df).collect()))
    assert b == sorted(map(str, drop_recurring_lines(df, sent=0).collect()))


def test_keeps_columns_and_lengths(odd, docs):
    out = drop_recurring_lines(odd)
    assert out.columns == odd.columns and out.count() == 9
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert drop_recurring_lines(docs([]), digest=True).collect() == []


def _words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_copies_do_not_outvote_other_documents(docs):
    r = random.Random(11)
    passage = _words(r, 30)
    others = [f"{_words(r, 40)}\n{passage}\n{_words(r, 20)}" for _ in range(20)]
    for copies in ([200], [200, 150]):  # one and two groups of copies
        texts = others + [t for n in copies for t in [f"{_words(r, 40)}\n{passage}\n{_words(r, 20)}"] * n]
        rows = drop_recurring_lines(docs(texts), digest=True).collect()
        assert {(x.n_lines, x.n_dropped) for x in rows} == {(3, 1)} and not any(passage in x.text for x in rows)


def test_near_copies_stay(docs):
    r = random.Random(12)
    lines = [_words(r, 12) for _ in range(20)]
    texts = []
    for _ in range(300):  # one word in 240 is another
        own = [x.split() for x in lines]
        own[r.randrange(20)][r.randrange(12)] = _words(r, 1)
        texts.append("\n".join(map(" ".join, own)))
    assert sum(x.n_dropped for x in drop_recurring_lines(docs(texts), digest=True).collect()) == 0


def test_shared_lines_are_no_context_of_each_other(docs):
    r = random.Random(21)
    texts = []
    for _ in range(6):  # 120 shared words and 30 of their own
        shared = [_words(r, 12) for _ in range(10)]
        texts += ["\n".join([_words(r, 15), *shared[:5], _words(r, 15), *shared[5:]]) for _ in range(30)]
    for df in (docs(texts), docs([t for t in texts for _ in range(3)])):  # copies of all of them change nothing
        assert {(x.n_lines, x.n_dropped) for x in drop_recurring_lines(df, digest=True).collect()} == {(12, 10)}


def test_long_passage_of_two_documents(docs):
    r = random.Random(31)
    passage, brief = _words(r, 60), _words(r, 40)
    a, b = f"{_words(r, 40)}\n{passage}", f"{passage}\n{_words(r, 50)}"
    rest = [f"{_words(r, 40)}\n{brief}", f"{brief}\n{_words(r, 50)}"]  # under 50 words: kept
    whole = [f"{_words(r, 60)}\n{_words(r, 30)}"] * 2  # copies
    near = _words(r, 80)
    near = [f"{_words(r, 4)}\n{near}", f"{_words(r, 4)}\n{near}"]  # the same text under two titles
    for first in ([a], [a] * 5):  # copies of one of them change nothing
        texts = [*first, b, *rest, *whole, *near]
        got = {x.doc_id: x.n_dropped for x in drop_recurring_lines(docs(texts), digest=True).collect()}
        assert [got[i] for i in range(len(texts))] == [1] * (len(first) + 1) + [0] * 6
        assert sorted(map(str, drop_recurring_lines(docs(texts), digest=True, sent=0).collect())) == sorted(map(str, drop_recurring_lines(docs(texts), digest=True).collect()))


def test_a_leaf_has_many_templates(docs):
    r = random.Random(41)
    forms = [lambda w: f"user {w} logged in from HOME", lambda w: f"disk {w} is full on NODE", lambda w: f"job {w} has ended with SUCCESS"]
    texts = [f"{_words(r, 30)}\n2024-01-{k:03d} 10:{k:02d} {k} {forms[k % 3](_words(r, 1))}\n{_words(r, 10)}" for k in range(45)]
    texts += [f"{_words(r, 30)}\n2024-01-{k:03d} 10:{k:02d} {k} {_words(r, 6)}" for k in range(10)]  # templates of their own
    got = {x.doc_id: x.n_dropped for x in drop_recurring_lines(docs(texts), digest=True).collect()}
    assert [got[i] for i in range(55)] == [1] * 45 + [0] * 10


def test_more_copies_never_bring_a_line_back(docs):
    """A footer of eleven documents, with more and more copies of one of them."""
    r = random.Random(51)
    texts = [f"{_words(r, 40)}\nAll of this is free for you\n{_words(r, 20)}" for _ in range(11)]
    for copies in (0, 1, 10, 90, 400):
        rows = drop_recurring_lines(docs(texts + texts[:1] * copies), digest=True).collect()
        assert {(x.n_lines, x.n_dropped) for x in rows} == {(3, 1)}


@pytest.mark.parametrize("lines", [[f"{k} {k + 7} {3 * k}" for k in range(12)], [f"Total {k} {k + 7} {3 * k}" for k in range(12)], [f"{k}" for k in range(12)]])
def test_different_rows_of_numbers_stay(docs, lines):
    r = random.Random(61)
    texts = [f"{_words(r, 30)}\n{x}\n{_words(r, 30)}" for x in lines]
    assert sum(x.n_dropped for x in drop_recurring_lines(docs(texts), digest=True).collect()) == 0
    same = [f"{_words(r, 30)}\n{lines[5]}\n{_words(r, 30)}" for _ in range(6)]
    assert [x.n_dropped for x in drop_recurring_lines(docs(same), digest=True).collect()] == [1] * 6
