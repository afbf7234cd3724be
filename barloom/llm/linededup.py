"""Line dedup by a log-template tree of fixed depth.

Every line of a text is parsed as a log line is: the tree's first level is its number of
tokens, the next ``DEPTH`` levels are its leading tokens; a token with a digit is a variable
field and parses as one wildcard, if ``DEPTH`` tokens or more of the line have none (rows of
numbers and lines of one or two words stand for themselves alone). A leaf holds a list of templates: its masked lines are taken from
the one in most documents on, and a line that agrees with a template in at least ``AGREE`` percent
of its tokens (compared by place, by one byte of each token's fingerprint), ``DEPTH`` of them no
wildcards, belongs to the first
such: what differs is a variable field too. A line that agrees with none is the next template. The
different masked lines of one leaf are read in one task, which keeps its templates.

A template recurs if it stands in at least ``DOCS`` documents and ``SPREAD`` contexts. A line's
contexts in a document are the smallest fingerprints, by ``MINIMA`` functions, of word pairs that
start outside the line: in the document's own lines, which are those whose template stands in at
most half as many documents, if they have at least one in ``OWN`` of the words outside the line
(documents that have fewer can be near copies of 0.8, (1 - 1/9) / (1 + 1/9)), and else in all
lines. So other shared lines do not make contexts equal. A document and its exact copies give the
same ones however many they are, and near copies mostly share one at least. A document counts as one over the documents of the template
that share a context with it (by the function where they are most), so a group of copies counts
about once and takes nothing from the other documents: copies of documents are left to
near-duplicate removal, while passages and boilerplate that different documents share are
dropped, in every document.

A template of ``LONG`` tokens or more recurs from two documents of two contexts on, if each has
lines that stand in fewer documents with at least one in ``OWN`` of all its words: two documents
that are this passage and little else are near copies.

Each document counts a line once. Lines travel as fingerprints; the same line in many documents
is one row for each task. Recurring lines reach the workers by broadcast up to ``SENT`` of them
and by a join on the line beyond.

Defined results: a null text stays null and an empty text empty; lines without tokens are kept
and have no template; only ``\\n`` parts lines; rows that repeat a doc_id are documents of their
own; other columns, of any name, are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import fresh, map_batches, numbered, stash
from .textvec import SPACED, Slice, gram_hashes, mix, slices

DEPTH, AGREE, DOCS, SPREAD, SENT, MINIMA, OWN, LONG = 3, 70, 3, 2.5, 1_000_000, 4, 9, 50

STAR = 0x2A
_WILD = np.uint64(STAR << 56)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class Lines:
    """The lines of a slice: byte ranges, text, tokens, leaf and masked fingerprint."""

    def __init__(self, s: Slice):
        data, bounds = s.data, s.bounds
        cut = np.flatnonzero(data == 10)
        # an empty text shares its bound with the next one: one line for each text and each break
        starts_of = np.bincount(np.searchsorted(bounds[1:], cut, "right"), minlength=s.n) + 1
        self.text = np.repeat(np.arange(s.n), starts_of)
        self.first_line = np.concatenate([[0], np.cumsum(starts_of)])
        order = np.empty(len(self.text), np.int64)
        heads = self.first_line[:-1]
        order[heads] = bounds[:-1]
        rest = np.ones(len(order), bool)
        rest[heads] = False
        order[rest] = cut + 1
        self.start = order
        self.end = np.append(self.start[1:] - 1, len(data))
        self.end[self.first_line[1:] - 1] = bounds[1:]
        # tokens
        self.tokens = s.hashes()
        self.at = np.searchsorted(s.start, self.start)
        self.upto = np.searchsorted(s.start, self.end)
        self.n = self.upto - self.at
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        varies = digit[s.end] > digit[s.start]
        constant = np.concatenate([[0], np.cumsum(~varies)])
        varies &= np.repeat(constant[self.upto] - constant[self.at] >= DEPTH, self.n)
        self.tokens[varies] = _WILD
        # a fingerprint of the masked line: a sum over tokens and places
        place = np.arange(len(self.tokens)) - np.repeat(self.at, self.n)
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.tokens + place.astype(np.uint64) * _FOLD), dtype=np.uint64)])
        self.mask = mix(run[self.upto] - run[self.at] + self.n.astype(np.uint64))
        leaf = self.n.astype(np.uint64)
        for d in range(DEPTH):
            have = np.flatnonzero(self.n > d)
            step = np.full(len(leaf), np.uint64(0))
            step[have] = self.tokens[self.at[have] + d]
            leaf = mix(leaf * _FOLD + step)
        self.leaf = leaf
        self.byte = (self.tokens >> np.uint64(56)).astype(np.uint8)
        self.byte[(self.byte == STAR) & ~varies] ^= 1  # the wildcard's byte is its own

    def lows(self, seed: int = 0) -> np.ndarray:
        """The smallest fingerprint of the word pairs that start in each line, by one of several functions."""
        top = np.uint64(2**64 - 1)
        low = np.full(len(self.start), top)
        pairs = gram_hashes(self.tokens, 2)
        if len(pairs):
            if seed:
                pairs = mix(pairs ^ np.uint64(seed) * _FOLD)
            last_of_text = self.upto[self.first_line[1:] - 1] - 1
            pairs[last_of_text[(last_of_text >= 0) & (last_of_text < len(pairs))]] = top  # pairs across texts
            some = np.flatnonzero((self.n > 0) & (self.at < len(pairs)))
            if len(some):
                low[some] = np.minimum.reduceat(pairs, self.at[some])
        return low

    def contexts(self, seed: int = 0) -> np.ndarray:
        """The smallest word-pair fingerprint of each line's text that starts outside the line."""
        return self._others(self.lows(seed))

    def _others(self, low: np.ndarray) -> np.ndarray:
        """The smallest value of the text's other lines."""
        heads = self.first_line[:-1]
        if not len(heads):
            return low.copy()
        out = np.minimum.reduceat(low, heads)[self.text]
        is_least = np.flatnonzero(low == out)
        _, first = np.unique(self.text[is_least], return_index=True)
        least = is_least[first]
        rest = low.copy()
        rest[least] = np.uint64(2**64 - 1)
        out[least] = np.minimum.reduceat(rest, heads)
        return out


def _lines(batches):
    for batch in batches:
        for s in slices(batch.column(0), SPACED, lower=False):
            x = Lines(s)
            once = _once(x)
            sig = [x.byte[a:b].tobytes() for a, b in zip(x.at[once].tolist(), x.upto[once].tolist())]
            cols = [pa.array(v[once].view(np.int64)) for v in (x.leaf, x.mask)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sig, pa.binary())], ["leaf", "mask", "sig"])


def _once(x: Lines) -> np.ndarray:
    """The first of a text's lines of each mask, without lines that have no template."""
    _, once = np.unique(np.stack([x.text.astype(np.uint64), x.mask], axis=1), axis=0, return_index=True)
    return np.sort(once[x.n[once] > 0])


CTX = [f"ctx{k}" for k in range(MINIMA)]


def _contexts(x: Lines, docs_of: np.ndarray) -> pa.RecordBatch:
    """(mask, far, contexts) of the lines that stand in several documents (``docs_of`` by line, 1 for others), once for each text."""
    some = _once(x)
    some = some[docs_of[some] > 1]
    lows = np.stack([x.lows(k) for k in range(MINIMA)], axis=1)
    out = np.stack([x._others(lows[:, k]) for k in range(MINIMA)], axis=1)
    far = np.zeros(len(x.mask), bool)
    cuts = np.searchsorted(x.text[some], np.arange(len(x.first_line)))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = x.first_line[i], x.first_line[i + 1]
        known = a + np.flatnonzero(x.n[a:b])
        known = known[np.argsort(docs_of[known], kind="stable")]
        least = np.minimum.accumulate(lows[known], axis=0)
        words = np.cumsum(x.n[known])
        mine = some[cuts[i] : cuts[i + 1]]
        rarer = np.searchsorted(2 * docs_of[known], docs_of[mine], "right")
        outside = x.n[a:b].sum() - x.n[mine]
        use = np.flatnonzero((rarer > 0) & (OWN * words[np.maximum(rarer, 1) - 1] >= outside))
        out[mine[use]] = least[rarer[use] - 1]
        rarer = np.searchsorted(docs_of[known], docs_of[mine], "left")
        far[mine] = (rarer > 0) & (OWN * words[np.maximum(rarer, 1) - 1] >= x.n[a:b].sum())
    cols = [pa.array(v[some].view(np.int64)) for v in (x.mask, *(np.ascontiguousarray(v) for v in out.T))]
    return pa.RecordBatch.from_arrays([cols[0], pa.array(far[some]), *cols[1:]], ["mask", "far", *CTX])


def _find_contexts(batches, masks: np.ndarray, counts: np.ndarray):
    for batch in batches:
        for s in slices(batch.column(0), SPACED, lower=False):
            x = Lines(s)
            n = np.ones(len(x.mask), np.int64)
            if len(masks):
                at = np.minimum(np.searchsorted(masks, x.mask), len(masks) - 1)
                hit = (masks[at] == x.mask) & (x.n > 0)
                n[hit] = counts[at[hit]]
            yield _contexts(x, n)


def _find_marked(batches):
    """As ``_find_contexts``, of texts with a list of their lines that stand in several documents."""
    for batch in batches:
        marks = batch.column(1).to_pylist()
        for s in slices(batch.column(0), SPACED, lower=False):
            x = Lines(s)
            n = np.ones(len(x.mask), np.int64)
            for i in range(s.n):
                for m in marks[s.first + i] or []:
                    n[x.first_line[i] + m["line"]] = m["n"]
            yield _contexts(x, n)


def _templates(batches):
    """The masks that belong to a template of their leaf, of (leaf, mask, sig) by leaf and falling number of documents.

    Lines that agree in AGREE percent differ in so few places that one of as many pieces and one is equal in both:
    templates are looked up by pieces, so a leaf of many templates is not compared with each of them.
    """
    leaf, kept, by_piece = None, [], {}
    for batch in batches:
        found = []
        for at, mask, sig in zip(*(batch.column(k).to_pylist() for k in ("leaf", "mask", "sig"))):
            if at != leaf:
                leaf, kept, by_piece = at, [], {}
            parts = len(sig) * (100 - AGREE) // 100 + 1
            rest = len(sig) - DEPTH
            cut = [DEPTH + rest * k // parts for k in range(parts + 1)]
            keys = [(k, sig[cut[k] : cut[k + 1]]) for k in range(parts)]
            near = sorted({t for key in keys for t in by_piece.get(key, ())})
            of = next((t for t in near if _agree(sig, kept[t][1])), None)
            if of is not None:
                found.append((at, mask, kept[of][0]))
                continue
            for key in keys:
                by_piece.setdefault(key, []).append(len(kept))
            kept.append((mask, sig))
        cols = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["leaf", "mask", "template"])


def _agree(a: bytes, b: bytes) -> bool:
    if len(a) != len(b):
        return False
    same = [x for x, y in zip(a, b) if x == y]
    return 100 * len(same) >= AGREE * len(a) and len(same) - same.count(STAR) >= DEPTH


def _arrays(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Columns of at most ``SENT`` rows, by the first of them (as unsigned)."""
    rows = df.select(*columns).collect()
    out = [np.array([r[k] for r in rows], np.int64) for k in range(len(columns))]
    out[0] = out[0].view(np.uint64)
    by = np.argsort(out[0])
    return [v[by] for v in out]


def recurring_lines(docs: DataFrame, least: int = DOCS, sent: int = SENT) -> DataFrame:
    """(mask, template, n_docs, n_ctx) of the masked lines whose template recurs."""
    spark = docs.sparkSession
    lines = map_batches(docs.select("text"), _lines, "leaf long, mask long, sig binary")
    # a line's bytes are the same in all rows of a mask: the smallest stands for them
    masks = stash(lines.groupBy("leaf", "mask").agg(F.count("*").alias("n_docs"), F.min("sig").alias("sig")), "masks")
    crowded = masks.groupBy("leaf").agg(F.count("*").alias("masks")).filter("masks > 1").select("leaf")
    in_order = masks.join(crowded, "leaf", "left_semi").repartition("leaf").sortWithinPartitions("leaf", F.desc("n_docs"), F.desc("mask"))
    merged = stash(map_batches(in_order.select("leaf", "mask", "sig"), _templates, "leaf long, mask long, template long"), "merged")
    placed = masks.join(merged, ["leaf", "mask"], "left").select("leaf", "mask", "n_docs", F.octet_length("sig").alias("words"), F.coalesce("template", "mask").alias("template"))
    sizes = placed.groupBy("leaf", "template").agg(F.sum("n_docs").alias("n")).filter(F.col("n") > 1)
    some = stash(placed.join(sizes, ["leaf", "template"]).select("mask", "template", "n", "words"), "candidates")
    # contexts, in a second pass over the texts
    schema = "mask long, far boolean, " + ", ".join(f"{c} long" for c in CTX)
    if some.count() <= sent:
        held = spark.sparkContext.broadcast(_arrays(some, ["mask", "n"]))
        found = map_batches(docs.select("text"), lambda b, h=held: _find_contexts(b, *h.value), schema)
    else:
        rows, _ = numbered(docs.select("text"))
        marks = map_batches(rows.select("row", "text"), _marks, "of long, line long, mask long")
        marks = marks.join(some.select("mask", "n"), "mask").groupBy("of").agg(F.collect_list(F.struct("line", "n")).alias("marks"))
        found = map_batches(rows.join(marks, rows["row"] == marks["of"]).select("text", "marks"), _find_marked, schema)
    by_ctx = found.groupBy("mask", "far", *CTX).agg(F.count("*").alias("n"))
    each = stash(by_ctx.join(some.select("mask", "template", "words"), "mask").groupBy("template", "words", "far", *CTX).agg(F.sum("n").alias("n")), "contexts")
    one = each.select("template", "words", "far", "n", F.xxhash64("far", *CTX).alias("one"), F.posexplode(F.array(*CTX)).alias("k", "ctx"))
    same = one.groupBy("template", "k", "ctx").agg(F.sum("n").alias("same"))
    share = one.join(same, ["template", "k", "ctx"]).groupBy("template", "words", "far", "one").agg(F.first("n").alias("n"), F.max("same").alias("same"))
    each_as = F.col("n") / F.col("same")
    sums = share.groupBy("template", "words").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_ctx"), F.sum(each_as).alias("spread"), F.sum(F.when(F.col("far"), each_as).otherwise(0)).alias("apart"))
    wide = (F.col("n_docs") >= least) & (F.col("spread") >= SPREAD)
    sums = sums.filter(wide | ((F.col("words") >= LONG) & (F.col("apart") > 1.99)))
    return stash(some.select("mask", "template").join(sums.select("template", "n_docs", "n_ctx"), "template").select("mask", "template", "n_docs", "n_ctx"), "recurring")


def _cut(text: str | None, gone: np.ndarray) -> str | None:
    if text is None or not gone.any():
        return text
    return "\n".join(x for x, g in zip(text.split("\n"), gone.tolist()) if not g)


def _drop(batches, masks: np.ndarray, digest: bool):
    """Texts without the lines of which the masked fingerprints are in ``masks`` (sorted)."""
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts, out, total, gone = batch.column(k), [], [], []
        plain = texts.to_pylist()
        for s in slices(texts, SPACED, lower=False):
            x = Lines(s)
            at = np.minimum(np.searchsorted(masks, x.mask), max(len(masks) - 1, 0))
            hit = (masks[at] == x.mask) & (x.n > 0) if len(masks) else np.zeros(len(x.mask), bool)
            for i in range(s.n):
                part = hit[x.first_line[i] : x.first_line[i + 1]]
                out.append(_cut(plain[s.first + i], part))
                total.append(len(part) if plain[s.first + i] is not None else 0)
                gone.append(int(part.sum()))
        text = pa.array(out, texts.type)
        if digest:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "text"])
        else:
            columns = list(batch.columns)
            columns[k] = text
            if "n_chars" in batch.schema.names:
                j = batch.schema.get_field_index("n_chars")
                columns[j] = pc.cast(pc.utf8_length(text), columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _marks(batches):
    """(of, line, mask) of every line; row (of) and line name its place."""
    for batch in batches:
        rows = np.asarray(batch.column(0))
        for s in slices(batch.column(1), SPACED, lower=False):
            x = Lines(s)
            some = np.flatnonzero(x.n)
            line = np.arange(len(x.text)) - np.repeat(x.first_line[:-1], np.diff(x.first_line))
            yield pa.RecordBatch.from_arrays([pa.array(rows[s.first + x.text[some]]), pa.array(line[some]), pa.array(x.mask[some].view(np.int64))], ["of", "line", "mask"])


def _drop_marked(batches, digest: bool):
    """The last column lists the lines that go."""
    for batch in batches:
        gone = batch.column(batch.num_columns - 1).to_pylist()
        k = batch.schema.get_field_index("text")
        plain = batch.column(k).to_pylist()
        out, total = [], []
        for t, g in zip(plain, gone):
            lines = [] if t is None else t.split("\n")
            flag = np.zeros(len(lines), bool)
            flag[np.array(g or [], int)] = True
            out.append(_cut(t, flag))
            total.append(len(lines))
        text = pa.array(out, batch.column(k).type)
        if digest:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array([len(g or []) for g in gone], pa.int64()), text], ["doc_id", "n_lines", "n_dropped", "text"])
        else:
            names = batch.schema.names[:-1]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"text": text}
            if "n_chars" in columns:
                columns["n_chars"] = pc.cast(pc.utf8_length(text), columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)


DIGEST = "doc_id long, n_lines long, n_dropped long, text string"


def drop_recurring_lines(docs: DataFrame, least: int = DOCS, digest: bool = False, sent: int = SENT) -> DataFrame:
    """The documents without recurring lines; ``digest``: doc_id, n_lines, n_dropped and the text only."""
    spark = docs.sparkSession
    if digest:
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = recurring_lines(docs, least, sent)
    schema = DIGEST if digest else docs.schema
    n = found.count()
    if n <= sent:
        masks = np.sort(np.array([r[0] for r in found.select("mask").collect()], np.int64).view(np.uint64))  # at most ``sent``
        masks = spark.sparkContext.broadcast(masks)
        return map_batches(docs, lambda b, m=masks: _drop(b, m.value, digest), schema)
    rows, row = numbered(docs)
    of, lines = fresh(rows, "of"), fresh(rows, "gone")
    marks = map_batches(rows.select(row, "text"), _marks, "of long, line long, mask long")
    gone = marks.join(found.select("mask").distinct(), "mask").groupBy(F.col("of").alias(of)).agg(F.collect_list("line").alias(lines))
    both = rows.join(gone, rows[row] == gone[of], "left").drop(of, row)
    return map_batches(both, lambda b: _drop_marked(b, digest), schema)
