"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, in the order of (bucket of doc_id, doc_id, size), are its token stream;
it is cut into blocks of ``block`` tokens (the last one may be shorter). The mix consists of
slots, one block each, in shards of ``SHARD`` slots.

1. Targets: sources ordered by code point, null last, get the weights in turn; the total is
   ``share`` of all tokens. What exceeds ``limit`` times a source's own size is shared anew by
   weight among the others until none exceeds it. Sorted by size over weight this is one
   running sum.
2. A source needs as many slots as its target has tokens: whole passes (epochs) over its
   blocks, a rest of whole blocks, and a cut of one block for what is left to the token.
3. Every shard draws its slots from a multinomial with the targets' shares. Counts are summed
   up along the shards; draws of a source beyond its need go, in order, to the sources that
   still lack slots, so that the totals are exact.
4. Slot k of a source is in epoch k div n, at place k mod n. A swap-or-not permutation of the
   full blocks, keyed by seed, source and epoch, maps the place to a block; the short last
   block stays last.
5. Slots join the blocks' fragments of documents by (source, block).

Draws find their source, and what is over finds what lacks, by sorting both into cells of one line:
each cell is one running window, so nothing is paired and no list of sources is sent. Running sums along
shards have two levels. The table of sources itself (one row for each) is summed up in one task and is
broadcast up to ``SENT`` rows. All draws are hashes of the seed and of places, so reruns agree.

Defined results: null text has no words; a null source is a source of its own, ordered last;
null doc_ids and rows that repeat a doc_id are documents of their own (equal rows are ordered
by size, and share what they take evenly only by chance); sources without words take nothing;
an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stash import stash

WORD = r"[^\x20\x09-\x0D]+"
SHARD, ROUNDS, BUCKETS, SENT, CELL, SPAN, TASK = 1024, 24, 4096, 10_000, 1 << 18, 4096, 1 << 14


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """source, source_size and target, from (source, source_size)."""
    every = Window.partitionBy(F.lit(0))  # one row for each source
    place = F.row_number().over(every.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("place", place).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    before = every.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, by ratio, that its share leaves below its cap sets the level of all behind it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    rows = rows.withColumn("level", level["level"])
    return rows.select("source", "source_size", "w", "place", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _sent(sources: DataFrame) -> DataFrame:
    """The table of sources, broadcast up to ``SENT`` rows and joined by a shuffle beyond."""
    return F.broadcast(sources) if sources.limit(SENT + 1).count() <= SENT else sources


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Swap-or-not: a keyed permutation of 0 .. n-1, for any n, of which each round is its own inverse."""

    def turn(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - v, n)
        return F.when(F.xxhash64(key, r, F.greatest(v, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def _streams(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their first token's place in their source's stream; sources with sizes."""
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(BUCKETS)).alias("bucket")
    rows = stash(sized(docs).select("doc_id", "source", "size", bucket), "sizes")
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = stash(parts.withColumn("before", F.coalesce(F.sum("part").over(along), F.lit(0))), "parts")
    sources = parts.groupBy("source").agg(F.sum("part").alias("source_size"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = own.alias("o").join(parts.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.bucket") == F.col("p.bucket")))
    return joined.select("o.doc_id", "o.source", "o.size", (F.col("before") + F.col("inner")).alias("first")), sources


def plan(sources: DataFrame, weights: list[float], share: float, limit: float, block: int) -> DataFrame:
    """Sources with targets, their blocks, and the slots that they need."""
    rows = targets(sources, weights, share, limit)
    take = F.floor(F.col("target") + 1e-6)
    rows = rows.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("tail", F.col("source_size") - F.col("full") * block)
    rows = rows.withColumn("blocks", F.col("full") + F.when(F.col("tail") > 0, 1).otherwise(0)).withColumn("take", take)
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0))
    rows = rows.withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
    rows = rows.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    return rows.withColumn("last", F.col("rest") - F.floor(F.col("rest") / block) * block)


def _running(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows ahead in ``order``, inside spans of it and over the spans."""
    rows = rows.withColumn("span", F.floor(F.col(order) / SPAN))
    spans = rows.groupBy(*keys, "span").agg(F.sum(value).alias("part"))
    ahead = lambda *by: Window.partitionBy(*(by or [F.lit(0)]))
    total = F.sum("part").over(ahead(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(*keys, "span", F.coalesce(total, F.lit(0)).alias("base"))
    inner = F.sum(value).over(ahead(*keys, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(0))).join(spans, [*keys, "span"])
    return rows.withColumn("before", F.col("base") + F.col("inner")).drop("span", "inner", "base")


def _cells(rows: DataFrame, lo: str, width: Column | int, last: Column) -> DataFrame:
    """A row for each cell that an interval from ``lo`` up to the cell ``last`` meets: cell, and ``at``, where the interval begins in it."""
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / width), last)))
    return rows.withColumn("at", F.greatest(F.col(lo), F.col("cell") * width))


def _drawn(sources: DataFrame, total: int, seed: int) -> DataFrame:
    """shard, place, n: the multinomial counts of sources in each shard."""
    spark = sources.sparkSession
    n_cells = -(-total // CELL)
    width = 1.0 / n_cells
    every = Window.partitionBy(F.lit(0)).orderBy("place")  # one row for each source
    upto = F.sum("need").over(every.rowsBetween(Window.unboundedPreceding, 0))
    edges = sources.filter("need > 0").withColumns({"lo": (upto - F.col("need")) / F.lit(float(total)), "hi": upto / F.lit(float(total))})
    edges = _cells(edges.select("place", "lo", "hi"), "lo", F.lit(width), F.floor(F.col("hi") / width))
    edges = edges.select("cell", "at", F.lit(0).alias("draw"), "place", F.lit(None).cast("long").alias("shard"))
    draws = spark.range(total).select(_uniform(F.col("id"), F.lit(seed)).alias("at"), F.floor(F.col("id") / SHARD).alias("shard"))
    draws = draws.select(F.floor(F.col("at") / width).alias("cell"), "at", F.lit(1).alias("draw"), F.lit(None).cast("int").alias("place"), "shard")
    line = Window.partitionBy("cell").orderBy("at", "draw", "place").rowsBetween(Window.unboundedPreceding, 0)
    pick = edges.unionByName(draws).select("shard", "draw", F.last("place", ignorenulls=True).over(line).alias("place")).filter("draw = 1")
    return pick.groupBy("shard", "place").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """One row for each slot of the mix: shard, source, epoch, block and tokens taken from the block's start."""
    total = sources.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    drawn = _drawn(sources, max(total, 1), seed)
    facts = _sent(sources)
    drawn = stash(_running(stash(drawn, "counts"), ["place"], "shard", "n").join(facts.select("place", "need"), "place"), "draws")
    fit = F.greatest(F.least("n", F.col("need") - F.col("before")), F.lit(0))
    drawn = drawn.withColumn("fit", fit)
    own = drawn.filter("fit > 0").select("shard", "place", F.col("before").alias("from"), F.col("fit").alias("n"))
    # what is over, in order of shards, against what lacks, in order of sources: two tilings of one line
    by_shard = stash(drawn.groupBy("shard").agg(F.sum(F.col("n") - F.col("fit")).alias("over")).filter("over > 0"), "over")
    over = _running(by_shard, [], "shard", "over").select("shard", F.col("before").alias("lo"), (F.col("before") + F.col("over")).alias("hi"))
    got = drawn.groupBy("place").agg(F.sum("fit").alias("got"))
    lack = sources.join(got, "place", "left").select("place", F.coalesce("got", F.lit(0)).alias("got"), (F.col("need") - F.coalesce("got", F.lit(0))).alias("lack")).filter("lack > 0")
    upto = F.sum("lack").over(Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))  # one row for each source
    lack = lack.select("place", "got", (upto - F.col("lack")).alias("lo"), upto.alias("hi"))
    goal = F.struct("place", "got", "lo").alias("goal")
    met = lambda rows: _cells(rows, "lo", CELL, F.floor((F.col("hi") - 1) / CELL)).withColumn("stop", F.least("hi", (F.col("cell") + 1) * CELL))
    cuts = met(over).select("cell", "at", "stop", "shard", F.lit(None).cast("struct<place:int,got:bigint,lo:bigint>").alias("goal"))
    cuts = cuts.unionByName(met(lack).select("cell", "at", "stop", F.lit(None).cast("long").alias("shard"), goal))
    line = Window.partitionBy("cell").orderBy("at", F.col("shard").isNull())
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce(F.lead("at").over(line), F.max("stop").over(Window.partitionBy("cell")))
    cuts = cuts.select("at", end.alias("end"), F.last("shard", ignorenulls=True).over(so_far).alias("shard"), F.last("goal", ignorenulls=True).over(so_far).alias("goal"))
    filled = cuts.filter("end > at").select("shard", F.col("goal.place").alias("place"), (F.col("goal.got") + F.col("at") - F.col("goal.lo")).alias("from"), (F.col("end") - F.col("at")).alias("n"))
    runs = own.unionByName(filled).join(facts, "place")
    runs = runs.repartition(max(1, min(100_000, -(-total // TASK))), "shard")  # a row becomes up to a shard of slots
    out = runs.withColumn("k", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)))
    out = out.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("at", F.col("k") - F.col("epoch") * F.col("blocks"))
    key = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), F.col("epoch"))
    out = out.withColumn("block", F.when(F.col("at") < F.col("full"), permuted(F.col("at"), F.col("full"), key)).otherwise(F.col("at")))
    return out


def mixed_blocks(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0, block: int = 1024, seed: int = 17):
    """(slots, fragments, sources, streams): slots of the mix, and each document's pieces of its source's blocks."""
    streams, sources = _streams(docs, block)
    planned = stash(plan(sources, list(weights), share, limit, block), "sources")
    lengths = F.when(F.col("at") < F.col("full"), F.lit(block)).otherwise(F.col("tail")).cast("long")
    used = F.when(F.col("k") == F.col("need") - 1, F.when(F.col("last") > 0, F.col("last")).otherwise(lengths)).otherwise(lengths)
    drawn = slots(planned, seed).select("shard", "place", "source", "k", "epoch", "block", used.alias("tokens"))
    pieces = streams.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    lo, hi = F.greatest("first", F.col("block") * block), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("doc_id", "source", "size", "first", "block", (lo - F.col("block") * block).alias("lo"), (hi - F.col("block") * block).alias("hi"))
    return drawn, pieces, planned, streams


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    drawn, pieces, sources, streams = mixed_blocks(docs, **options)
    # how often a block is taken whole or cut: at most a few different lengths
    uses = drawn.groupBy("source", "block").agg(F.collect_list("tokens").alias("uses"))
    part = F.aggregate("uses", F.lit(0).cast("long"), lambda s, t: s + F.greatest(F.least(F.col("hi"), t) - F.col("lo"), F.lit(0)))
    got = pieces.alias("p").join(uses.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")))
    got = got.select("p.source", "first", "size", part.alias("part")).groupBy("source", "first").agg(F.sum("part").alias("taken"))
    # a non-empty document is known by its source and first place: ids may be null or repeat
    out = streams.alias("s").join(got.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.first") == F.col("g.first")) & (F.col("s.size") > 0), "left")
    out = out.select("s.doc_id", "s.source", "s.size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    facts = _sent(sources.select(F.col("source").alias("of"), "source_size", "target"))
    return out.join(facts, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", "taken", "source")
