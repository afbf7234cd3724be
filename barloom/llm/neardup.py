"""Near-duplicates of word-shingle sets: SetSketch registers, bands, joint likelihood, exact check.

1. Each document's set of shingle fingerprints gets ``REGISTERS`` SetSketch registers: the
   minimum of exponential variates, truncated on a scale of powers of ``BASE``. Registers
   merge by maximum and are equal with a probability near the Jaccard similarity.
2. Documents with equal sets form a class; its smallest doc_id stands for it from here on.
3. Runs of ``BAND`` registers make ``BANDS`` keys. In a bucket every member is compared with
   the smallest member (a star). Two sets at the threshold of 0.8 miss every bucket with a
   probability of (1 - 0.8**6)**42 = 3e-6.
4. A pair's similarity is estimated by maximum likelihood from how many registers are
   greater, smaller and equal, jointly with both set sizes. Pairs estimated ``MARGIN``
   below the threshold (4.8 standard errors) go.
5. What is left is confirmed on the full sets of shingles of the whole texts.
6. Components of the confirmed links follow, first from ``FIRST`` bands, then from all of
   them for pairs that still lie in different components.
7. In a bucket whose members lie in several components, blocks of members meet by their
   registers: two members of different components are estimated in the first band that they
   share. Only members with such a partner that passes come back with texts, which stream past
   the sets of the other block's; of two components one confirmed link for each pair of blocks
   is enough. So no link that changes a component is lost, no list of pairs of documents is
   made, and a text travels once for each block that it may be linked with.

Defined results: null text or a text without words has an empty set and is linked with
nothing; a null doc_id is linked with nothing and kept; rows that repeat a doc_id are one
node of the graph, and each of them is returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stash import map_batches, numbered, stash, without
from .textvec import SPACED, gram_hashes, mix, slices

REGISTERS, BAND, BANDS, FIRST = 256, 6, 42, 8
BASE, RATE, TOP = 1.001, 20.0, 65535
MARGIN = 0.12
BLOCK, CHUNK = 256, 64
ROWS, TABLE = 16, 16 << 20
BLOOM_WORDS = 1 << 18

_MULT = (np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (REGISTERS, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

SKETCH = "doc_id long, n_shingles long, key_a long, key_b long, registers binary"


def shingle_sets(column: pa.Array, width: int):
    """(index, sorted distinct fingerprints) of every text of a column."""
    for s in slices(column, SPACED):
        h = s.hashes()
        grams = gram_hashes(h, width)
        for i in range(s.n):
            a, b = int(s.word_at[i]), int(s.word_at[i + 1])
            if b - a >= width:
                yield s.first + i, np.unique(grams[a : b - width + 1])
            else:
                yield s.first + i, gram_hashes(h[a:b], b - a) if b > a else h[:0]


def registers(u: np.ndarray) -> np.ndarray:
    low = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for c in range(0, len(u), 512):
        np.minimum(low, (_MULT * u[None, c : c + 512]).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sketches(batches, width: int):
    for batch in batches:
        n, key_a, key_b, reg = [], [], [], []
        for _, u in shingle_sets(batch.column(1), width):
            n.append(len(u))
            key_a.append(int(np.add.reduce(mix(u), dtype=np.uint64)))
            key_b.append(int(np.bitwise_xor.reduce(mix(u ^ np.uint64(0x5851F42D4C957F2D)))) if len(u) else 0)
            reg.append(registers(u).tobytes() if len(u) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(key_a, np.uint64).view(np.int64)),
                pa.array(np.array(key_b, np.uint64).view(np.int64)),
                pa.array(reg, pa.binary()),
            ],
            ["doc_id", "n_shingles", "key_a", "key_b", "registers"],
        )


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        k = _unpack(batch.column(1)).astype(np.uint64)
        keys = []
        for b in range(BANDS):
            h = np.full(len(k), b + 1, np.uint64)
            for c in range(b * BAND, (b + 1) * BAND):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + k[:, c])
            keys.append(h)
        place = np.repeat(np.arange(BANDS, dtype=np.int8), len(k))
        ids = np.tile(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(place), pa.array(ids)], ["band", "place", "doc_id"])


def likelihood(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from set sizes and counts of greater and smaller registers."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE

    def prob(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
    lo, hi = np.zeros(len(u)), top
    for _ in range(3):  # a grid, made finer around the best point
        width = hi - lo
        for t in np.linspace(0, 1, 17):
            j = lo + t * width
            p, q = prob(u - v * j), prob(v - u * j)
            e = np.maximum(1 - p - q, 1e-300)
            ll = more * np.log(np.maximum(p, 1e-300)) + less * np.log(np.maximum(q, 1e-300)) + (REGISTERS - more - less) * np.log(e)
            up = ll > value
            best, value = np.where(up, j, best), np.where(up, ll, value)
        lo, hi = np.maximum(best - width / 12, 0), np.minimum(best + width / 12, top)
    return best


def likely(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, low: float) -> np.ndarray:
    """Whether ``likelihood`` is ``low`` or more: the logarithm is concave, so its slope at ``low`` tells on which side the maximum lies."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    s = (BASE - 1) / BASE
    slope = np.zeros(len(u))
    rest = np.ones(len(u))
    fall = np.zeros(len(u))
    with np.errstate(divide="ignore", invalid="ignore"):
        for count, x, by in ((more, u - v * low, v), (less, v - u * low, u)):
            p = -np.log1p(-np.clip(x, 0, 1) * s) / np.log(BASE)
            step = by * s / (1 - np.clip(x, 0, 1) * s) / np.log(BASE)
            slope -= np.where(count > 0, count * step / p, 0)
            rest -= p
            fall += step
        slope += (REGISTERS - more - less) * fall / np.maximum(rest, 1e-300)
    return (slope >= 0) & (np.minimum(n_a, n_b) >= low * np.maximum(n_a, n_b))


def _estimate(batches, low: float):
    """Rows of a star in order: the hub first, then members. Passes (hub, member) on."""
    star, of = None, []
    for batch in batches:
        hubs, member = np.asarray(batch.column("hub")), np.asarray(batch.column("doc_id"))
        chunks = np.asarray(batch.column("chunk"))
        n = np.asarray(batch.column("n_shingles")).astype(float)
        k = _unpack(batch.column("registers")) if batch.num_rows else np.zeros((0, REGISTERS), np.uint16)
        a, b = [], []
        cuts = [0, *(np.flatnonzero((hubs[1:] != hubs[:-1]) | (chunks[1:] != chunks[:-1])) + 1).tolist(), len(hubs)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if star != (hubs[x], chunks[x]):
                star, of = (hubs[x], chunks[x]), []
            hub = int(hubs[x])
            own = member[x:y] == hub
            of += [(n[i], k[i]) for i in (x + np.flatnonzero(own)).tolist()]
            rest = x + np.flatnonzero(~own)
            if not len(rest):
                continue
            ok = np.zeros(len(rest), bool)
            for n_h, k_h in of:
                more, less = (k_h > k[rest]).sum(axis=1), (k_h < k[rest]).sum(axis=1)
                ok |= likely(np.full(len(rest), n_h), n[rest], more, less, low)
            a += [hub] * int(ok.sum())
            b += member[rest[ok]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirm(batches, width: int, percent: int):
    """Like ``_estimate``, over texts: the exact share of common shingles decides."""
    star, of = None, []
    for batch in batches:
        hubs, chunks, member = (batch.column(c).to_pylist() for c in ("hub", "chunk", "doc_id"))
        a, b = [], []
        for i, u in shingle_sets(batch.column("text"), width):
            hub = hubs[i]
            if star != (hub, chunks[i]):
                star, of = (hub, chunks[i]), []
            if member[i] == hub:
                of.append(u)
                continue
            for h in of:
                if len(h) and len(u):
                    both = int((h[np.minimum(np.searchsorted(h, u), len(h) - 1)] == u).sum())
                    if 100 * both >= percent * (len(h) + len(u) - both):
                        a.append(hub)
                        b.append(member[i])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


MEET = "band long, l_part long, r_part long, side byte, doc_id long, comp long"


def _passing(left: tuple, right: tuple, place: int, low: float) -> np.ndarray:
    """Which sets of two blocks (sizes, components, registers) may be as similar as ``low``, differ in component and share no band before ``place``."""
    (n_l, c_l, k_l), (n_r, c_r, k_r) = left, right
    out = (c_l[:, None] != c_r) & (np.minimum(n_l[:, None], n_r) >= low * np.maximum(n_l[:, None], n_r))
    for at in range(0, len(n_l), ROWS):
        rows = slice(at, at + ROWS)
        same = k_l[rows, None] == k_r
        out[rows] &= same.sum(axis=2, dtype=np.int16) >= (low - 0.1) * REGISTERS  # what an estimate of ``low`` needs at least
        x, y = np.nonzero(out[rows])
        ok = ~same[x, y, : BAND * place].reshape(len(x), place, BAND).all(axis=2).any(axis=1)
        a, b = k_l[at + x], k_r[y]
        ok &= likely(n_l[at + x], n_r[y], (a > b).sum(axis=1), (a < b).sum(axis=1), low)
        out[at + x, y] = ok
    return out


def _across(batches, low: float):
    """Of pairs of blocks of a bucket: the members that pass the likelihood with one of another component, left ones on side 0."""
    for batch in batches:
        at, side, ids, comps = [], [], [], []
        for i in range(batch.num_rows):  # row by row: a block is large
            blocks = [batch.column(c)[i].values for c in ("left", "right")]
            facts = [(np.asarray(x.field("n_shingles")).astype(float), np.asarray(x.field("comp")), _unpack(x.field("registers"))) for x in blocks]
            passing = _passing(*facts, batch.column("place")[i].as_py(), low)
            for k, block in enumerate(blocks):
                on = passing.any(axis=1 - k)
                at.append(np.full(int(on.sum()), i))
                side.append(np.full(int(on.sum()), k, np.int8))
                ids.append(np.asarray(block.field("doc_id"))[on])
                comps.append(facts[k][1][on])
        if at:
            of = pa.array(np.concatenate(at))
            cols = [*(batch.column(c).take(of) for c in ("band", "l_part", "r_part")), *(pa.array(np.concatenate(c)) for c in (side, ids, comps))]
            yield pa.RecordBatch.from_arrays(cols, ["band", "l_part", "r_part", "side", "doc_id", "comp"])


def _tables(sets: list[np.ndarray]):
    """(places, sorted fingerprints, which set has which) of runs of sets, each table of at most about ``TABLE`` bytes."""
    first = 0
    while first < len(sets):
        last, size = first + 1, len(sets[first])
        while last < len(sets) and (size + len(sets[last])) * (last + 1 - first) <= TABLE:
            size += len(sets[last])
            last += 1
        vocab = np.unique(np.concatenate(sets[first:last]))
        has = np.zeros((len(vocab), last - first), bool)
        for i, u in enumerate(sets[first:last]):
            has[np.searchsorted(vocab, u), i] = True
        yield slice(first, last), vocab, has
        first = last


def _meet(batches, width: int, percent: int):
    """Rows of a pair of blocks in order: left members, then right ones. Passes on one confirmed link for two components."""
    pair, left, tables, done = None, [], None, set()
    for batch in batches:
        a, b = [], []
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "l_part", "r_part", "side", "doc_id", "comp"))))
        for i, u in shingle_sets(batch.column("text"), width):
            band, l_part, r_part, side, doc_id, comp = keys[i]
            if pair != (band, l_part, r_part):
                pair, left, tables, done = (band, l_part, r_part), [], None, set()
            if side == 0:
                left.append((doc_id, comp, u))
                continue
            if tables is None:
                tables = list(_tables([x[2] for x in left]))
                size = np.array([len(x[2]) for x in left], np.int64)
            for run, vocab, has in tables:
                if not len(vocab):
                    continue
                at = np.searchsorted(vocab, u)
                both = has[at[vocab[np.minimum(at, len(vocab) - 1)] == u]].sum(axis=0)
                for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size[run] + len(u) - both))).tolist():
                    other, c, _ = left[run.start + j]
                    if c != comp and other != doc_id and (c, comp) not in done:
                        done |= {(c, comp), (comp, c)}
                        a.append(min(other, doc_id))
                        b.append(max(other, doc_id))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _stars(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Every pair (a, b) as rows of b's facts under hub a, behind one row of a's own; large stars in chunks."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rows = pairs.join(size, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("doc_id"))
    hubs = size.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("doc_id"))
    out = rows.unionByName(hubs).join(facts, "doc_id")
    out = out.withColumn("own", F.col("doc_id") == F.col("hub"))
    return out.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.desc("own"))


def _with_bloom(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id may be in ``ids``: a Bloom filter of a fixed size spares the rest a shuffle."""
    h = F.xxhash64(F.col("doc_id"), F.lit(11))
    word = F.pmod(h, F.lit(BLOOM_WORDS)).alias("word")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(doc_id, 11), 24), 64) as int))").alias("bit")
    bloom = ids.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = docs.select("doc_id", "text", word, bit).join(F.broadcast(bloom), "word")
    return rows.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("doc_id", "text")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (see the module's text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low = percent / 100 - MARGIN
    sketch = stash(map_batches(docs, lambda b: _sketches(b, width), SKETCH), "sketch")
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    keys = ["key_a", "key_b", "n_shingles"]
    classes = stash(known.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")), "classes")  # written, so that Spark can split joins on the hot ones
    reps = facts = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "registers")
    bands = map_batches(reps.select("doc_id", "registers"), _bands, "band long, place byte, doc_id long")
    stars = bands.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    full = stash(bands.join(stars, "band"), "bands")
    pair = full.filter("doc_id <> hub").select("place", F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    # rows that repeat a doc_id may lie in several classes: the id is one node
    of_doc = known.select("doc_id", *keys).join(classes.drop("registers"), keys).select("doc_id", "rep")
    ties = stash(of_doc.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("high"), F.count("*").alias("n")), "reps")
    twice = ties.filter("rep <> high").select("doc_id", F.col("rep").alias("a"))
    links = of_doc.join(twice, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    texts = _with_bloom(docs, full.select("doc_id").distinct())
    texts = stash(texts if ties.filter("n > 1").isEmpty() else texts.distinct(), "texts")
    links = links.unionByName(_confirmed(pair.filter(F.col("place") < FIRST).select("a", "b").distinct(), facts, texts, low, width, percent))
    label = components(links)
    left, right = (label.select(F.col("id").alias(x), F.col("comp").alias("c" + x)) for x in "ab")
    rest = pair.filter(F.col("place") >= FIRST).select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.unionByName(_confirmed(rest, facts, texts, low, width, percent))
    label = components(links)
    links = links.unionByName(_between(full, label, facts, texts, low, width, percent))
    label = components(links)
    comp = ties.join(label, ties["rep"] == label["id"], "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    out = sketch.select("doc_id", "n_shingles").join(comp, "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _confirmed(pairs: DataFrame, facts: DataFrame, texts: DataFrame, low: float, width: int, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b): by likelihood, then on the full sets."""
    maybe = map_batches(_stars(stash(pairs, "pairs"), facts), lambda b: _estimate(b, low), "a long, b long")
    maybe = stash(maybe.distinct(), "maybe")
    return stash(map_batches(_stars(maybe, texts), lambda b: _confirm(b, width, percent), "a long, b long").distinct(), "links")


def _between(full: DataFrame, label: DataFrame, facts: DataFrame, texts: DataFrame, low: float, width: int, percent: int) -> DataFrame:
    """Links between components that share a bucket (step 7)."""
    placed = full.join(label, full["doc_id"] == label["id"], "left").select("band", "place", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("size")).filter("comps > 1")
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK)).alias("part")
    detail = stash(placed.join(mixed, "band").join(facts, "doc_id").select("band", "place", part, "doc_id", "comp", "n_shingles", "registers", (F.col("comp") != F.col("main")).alias("apart")), "mixed")
    block = detail.groupBy("band", "place", "part").agg(F.collect_list(F.struct("doc_id", "comp", "n_shingles", "registers")).alias("items"), F.max("apart").alias("open"))
    left = block.select("band", "place", F.col("part").alias("l_part"), F.col("items").alias("left"), F.col("open").alias("l_open"))
    right = block.select("band", F.col("part").alias("r_part"), F.col("items").alias("right"), F.col("open").alias("r_open"))
    both = left.join(right, "band").filter("l_part <= r_part and (l_open or r_open)").select("band", "place", "l_part", "r_part", "left", "right")
    tries = stash(map_batches(both, lambda b: _across(b, low), MEET), "tries")
    if tries.isEmpty():
        return tries.select(F.col("band").alias("a"), F.col("l_part").alias("b"))
    rows = tries.join(texts, "doc_id").select("band", "l_part", "r_part", "side", "doc_id", "comp", "text")
    rows = rows.repartition("band", "l_part", "r_part").sortWithinPartitions("band", "l_part", "r_part", "side")
    return stash(map_batches(rows, lambda b: _meet(b, width, percent), "a long, b long").distinct(), "links")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id (null last), also where rows repeat a doc_id or have none."""
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **options).select("doc_id", "component_id")
    placed = rows.select(F.col(row).alias("of"), F.col("doc_id").alias("own")).join(found, F.col("of") == F.col("doc_id"))
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "of"))["of"].alias("first"), F.count("*").alias("n")).filter("n > 1")
    return without(rows, row, placed.join(first, "component_id").filter("of <> first").select("of"))
