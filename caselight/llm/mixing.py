"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket where a source's budget ends is split into finer buckets until it
holds one hash, so a source has a threshold and its documents below it are taken. Nothing is sorted. The document at the
threshold is too long for what is left; as long as more than ``NEAR`` of the target is open, a further pass goes on
behind it among the documents that fit, all sources at once, until none does. Thresholds of the first pass are nested:
what a smaller budget takes there, a larger one takes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, discard, materialize

#: Bits of the hash that one refinement looks at.
LEVEL_BITS = 10
MOST_REPEATS = 3
#: The share of a target that is near enough.
NEAR = 0.01
END = 1 << 60


def word_count(text: str = "text") -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    Sources in code-point order (null last) get ``weights`` in turn. A target stops at ``most`` times the
    source's size; the excess goes to the others by weight until none is above. All state is one row per source;
    only scalars reach the driver.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranged = materialize(per.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source")).withColumn("mid", F.monotonically_increasing_id()), "mix-ranked")
    ranged = ranged.withColumn("pid", F.shiftright("mid", 33)).withColumn("idx", F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["pid"], r["n"]) for r in ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())  # one number per partition
    offsets, done = [], 0
    for pid, n in counts:
        offsets.append((pid, done))
        done += n
    off = ranged.sparkSession.createDataFrame(offsets, "pid long, before long")
    ranked = ranged.join(F.broadcast(off), "pid").withColumn("rank", F.col("before") + F.col("idx"))
    ranked = materialize(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")), "mix-weights")
    lift, seen = None, None
    while True:  # at each step more sources are full, or none and it ends
        full = (F.col("weight") * F.lit(lift) > most * F.col("source_size")) if lift is not None else F.lit(False)
        a = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, most * F.col("source_size")).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(full).alias("n"),
        ).first()
        if not a["open"] or a["n"] == seen:
            break
        seen, lift = a["n"], (a["all"] - a["capped"]) / a["open"]
    target = F.least(F.col("weight") * F.lit(lift if lift is not None else 0.0), (most * F.col("source_size")).cast("double"))
    return materialize(ranked.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target")), "mix-targets")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, times, passes): every document ``times`` times, once more if a pass takes it.

    A pass (from, below, most) takes documents with a hash from ``from`` on and under ``below`` whose size is at most
    ``most``. Each pass ends behind the first hash that does not fit what is left; what is left shrinks below that
    document's size, so the passes of a source shorten quickly, and they end when none fits or little is open. If then
    the smallest document that is left would miss the target by less than stopping short of it, it is taken.
    """
    spark = sizes.sparkSession
    t = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    left = F.col("target") - F.col("times") * F.col("source_size")
    none = F.array().cast("array<struct<from:bigint,below:bigint,most:bigint>>")
    state = materialize(t.select("source", "source_size", "target", "times", left.alias("left"), F.lit(0).cast("long").alias("from"), none.alias("passes")), "mix-state")
    short = (F.col("left") > NEAR * F.col("target")) & (F.col("left") >= 1)
    while state.where(short & (F.col("from") < END)).limit(1).count():
        old, state = state, _one_pass(sizes, state, short & (F.col("from") < END))
        discard(spark, old)
    rest = sizes.where("size > 0").join(state.where(short).select(F.col("source").alias("s"), "left", "passes"), F.col("source").eqNullSafe(F.col("s")))
    rest = rest.where(~taken(F.col("h"), F.col("size"), F.col("passes"))).groupBy("s", "h").agg(F.sum("size").alias("w"), F.max("size").alias("most"))
    over = rest.groupBy("s").agg(F.min(F.struct("w", "h", "most")).alias("x"))
    out = state.join(over, F.col("source").eqNullSafe(F.col("s")) & short, "left")
    nearer = F.coalesce(F.col("x.w") - F.col("left") < F.col("left"), F.lit(False))
    last = F.struct(F.col("x.h").alias("from"), (F.col("x.h") + 1).alias("below"), F.col("x.most").alias("most"))
    out = materialize(out.select("source", "source_size", "target", "times", F.when(nearer, F.concat("passes", F.array(last))).otherwise(F.col("passes")).alias("passes")), "mix-passes")
    discard(spark, state)
    return out


def taken(h: Column, size: Column, passes: Column) -> Column:
    return F.exists(passes, lambda p: (h >= p["from"]) & (h < p["below"]) & (size <= p["most"]))


def _one_pass(sizes: DataFrame, state: DataFrame, wanted: Column) -> DataFrame:
    """The state after one more pass of the sources that are ``wanted``: level by level into the bucket that overflows."""
    spark = sizes.sparkSession
    at = state.where(wanted).select(F.col("source").alias("s"), "left", "from", F.floor("left").cast("long").alias("most"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"))
    at = materialize(at, "mix-pass")
    for level in range(60 // LEVEL_BITS):
        old, at = at, materialize(_refine(sizes, at, level), "mix-pass")
        discard(spark, old)
        if not at.where("open").limit(1).count():
            break
    done = at.select("s", F.col("left").alias("l"), "below", F.struct("from", "below", "most").alias("pass"))
    out = state.join(done, F.col("source").eqNullSafe(F.col("s")) & wanted, "left")
    behind = F.when(F.col("below") < END, F.col("below") + 1).otherwise(F.coalesce("below", "from"))
    out = out.select(
        "source", "source_size", "target", "times", F.coalesce("l", "left").alias("left"), behind.alias("from"),
        F.when(F.col("pass").isNotNull(), F.concat("passes", F.array("pass"))).otherwise(F.col("passes")).alias("passes"),
    )
    out = materialize(out, "mix-state")
    discard(spark, at)
    return out


def _refine(sizes: DataFrame, at: DataFrame, level: int) -> DataFrame:
    """One level of a pass: of each open source the bucket in which its budget ends; partial sums keep hot sources small."""
    shift = 60 - LEVEL_BITS * (level + 1)
    open_ = at.where("open").select(F.col("s").alias("o"), "left", "below", "from", "most")
    inside = sizes.join(open_, F.col("source").eqNullSafe(F.col("o")))
    inside = inside.where((F.col("size") > 0) & (F.col("size") <= F.col("most")) & (F.col("h") >= F.col("from")) & (F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("below", shift + LEVEL_BITS)))
    hist = inside.groupBy("o", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("w"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    w = W.partitionBy("o", "left").orderBy("b")  # at most 2**LEVEL_BITS rows
    cum = hist.withColumn("before", F.coalesce(F.sum("w").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = F.min(F.when(F.col("before") + F.col("w") > F.col("left"), F.struct("b", "before", "lo", "hi"))).alias("edge")
    found = cum.groupBy("o").agg(edge, F.sum("w").alias("all"))
    single = F.col("edge.lo") == F.col("edge.hi")
    below = F.when(F.col("edge").isNull(), F.lit(END)).when(single, F.col("edge.hi")).otherwise(F.shiftleft("edge.b", shift))
    left = F.col("left") - F.coalesce("edge.before", "all", F.lit(0))  # no edge: all that is there fits
    return at.join(found, F.col("s").eqNullSafe(F.col("o")) & F.col("open"), "left").select(
        "s", left.alias("left"), "from", "most", F.when(F.col("open"), below).otherwise(F.col("below")).alias("below"), F.coalesce(~single, F.lit(False)).alias("open"),
    )


def mix_hash() -> Column:
    """60 bits that depend on the id alone, of rows without one on the text."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit("mix"), F.when(F.col("doc_id").isNull(), F.col("text"))), 4)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h), written once: the only pass over the texts."""
    cols = (F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), mix_hash().alias("h"))
    return materialize(docs.select(*cols), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of ``docs``.

    Defined results: null text has size 0; null source is a source of its own, last in order; rows that share a
    ``doc_id`` share a hash and are taken or passed over as one where they fit; rows without an id go by their text; a
    source without words has target 0; reruns agree, as the hash has no other input. An empty table gives an empty table.
    """
    sizes = sized(docs)
    state = thresholds(sizes, source_targets(sizes, weights, most)).select(F.col("source").alias("s"), "source_size", "target", "times", "passes")
    more = taken(F.col("h"), F.col("size"), F.col("passes"))
    copies = F.least(F.col("times") + F.when(more, 1).otherwise(0), F.lit(most))
    return sizes.join(state, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, with ``copies``, the times each is to be read, and its source's ``target``.

    Copies follow from the id's hash, the size and the source's passes, so no text is shuffled for them. Documents
    without words weigh nothing and are taken if the source is repeated. Columns of ``docs`` with these two names are
    replaced.
    """
    sizes = sized(docs)
    state = thresholds(sizes, source_targets(sizes, weights, most)).select(F.col("source").alias("__mix_s"), F.col("times").alias("__mix_times"), F.col("passes").alias("__mix_passes"), F.col("target").alias("__mix_target"))
    more = taken(F.col("__mix_h"), F.col("__mix_size"), F.col("__mix_passes"))
    copies = F.least(F.col("__mix_times") + F.when(more, 1).otherwise(0), F.lit(most))
    keep = [c for c in docs.columns if c not in ("copies", "target")]
    rows = docs.select(*keep, mix_hash().alias("__mix_h"), word_count().alias("__mix_size"))
    joined = rows.join(state, F.col("source").cast("string").eqNullSafe(F.col("__mix_s")))
    return joined.select(*keep, copies.alias("copies"), F.col("__mix_target").alias("target")).where(F.col("copies") > 0)
