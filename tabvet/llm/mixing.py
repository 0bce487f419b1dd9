"""Mixing sources to target weights by entropy balancing (operator 9).

Targets: the sources share all words by weight (5, 2, 1, repeating, in code
point order, null last); no target exceeds three times its source's words, and
what a capped source cannot take goes to the others by weight.  That is one
water level L with ``target = min(cap, weight * L)``.

Rates: of all document rates that take each source's target, those nearest to
1 in relative entropy are exponentially tilted, ``rate = min(cap, exp(lam *
size / scale))``.  The convex dual has one multiplier ``lam`` per source;
safeguarded Newton steps (a step that leaves the bracket of the root becomes
its middle) move all sources in one aggregate per round.  A rate depends only
on (source, size), so all rounds run over counts of these classes.

Copies: every document takes the whole part of its rate.  The fractions become
extra copies class by class, large sizes first, by cumulative rounding; Abel
summation bounds what is then missing by the largest size, and one class per
eighth of a power of two of the size fills it up.  Within a class the documents with
the smallest hash get the extra copy.  Classes of many documents are ranked in
slices of the hash, so no task sorts a hot class.

Defined results: a null text has size 0 and is never taken; null sources are
one source, ordered last; a source without words has target 0; repeated rows
are documents of their own, ordered by text and id; extra columns are kept; an
empty table gives an empty result.  Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import stored, words

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: No document and no source is taken more often than this.
MAX_RATE = 3
#: Newton rounds at most, and the relative error at which a source is settled.
ROUNDS, TOLERANCE = 60, 1e-10
#: Documents of a class that one slice holds on average.
SLICE_ROWS = 500
#: Offsets of the cumulative rounding that are tried; the one that ends nearest to the target is kept.
PHASES = 8
#: Classes per power of two of the size that fill up what the rounding leaves.
OCTAVE_PARTS = 8

#: Internal columns; the prefix keeps them apart from a caller's.
KEY, SIZE = "_mix_key", "_mix_size"


def source_key(source: Column) -> Column:
    """A key that is never null: equal for equal sources, one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_RATE) -> DataFrame:
    """(_mix_key, source, source_size) -> with ``target``; one row per source in, one out."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = per_source.withColumns({"weight": weight, "limit": F.lit(float(cap)) * F.col("source_size")})
    # Sources fill up in the order of limit / weight: those before are full, the rest share by weight.
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source that stays below its limit at its own level has the true one; later ones give lower levels.
    true_level = F.max(F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.col("level"))).over(whole)
    share = F.least(F.col("limit"), F.col("weight") * F.coalesce(true_level, F.col("level")))
    return ranked.select(KEY, "source_size", share.alias("target"))


def multipliers(classes: DataFrame, wanted: DataFrame, cap: int = MAX_RATE) -> DataFrame:
    """Newton on the dual.  ``classes``: (_mix_key, _mix_size, n); returns (_mix_key, scale, lam).

    Sources whose target is 0 or all they have ``cap`` times get no row's worth
    of search: their rate is 0 or ``cap`` everywhere."""
    scale = classes.groupBy(KEY).agg((F.sum(F.col(SIZE) * F.col("n")) / F.sum("n")).alias("scale"))
    state = stored(
        wanted.join(scale, KEY).where(F.col("target") > 0)
        .select(KEY, "target", "scale", F.lit(0.0).alias("lam"), F.lit(-1e300).alias("low"), F.lit(1e300).alias("high"),
                (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))).alias("done")),
        "mix-dual")
    state = state.withColumn("lam", F.when(F.col("done"), F.lit(1e9)).otherwise(F.col("lam")))
    x, lam = F.col(SIZE) / F.col("scale"), F.col("lam")
    free = lam * x < F.log(F.lit(float(cap)))
    rate = F.when(free, F.exp(lam * x)).otherwise(F.lit(float(cap)))
    for _ in range(ROUNDS):
        sums = (
            classes.join(state.where(~F.col("done")), KEY)
            .groupBy(KEY, "target", "scale", "lam", "low", "high")
            .agg((F.sum(F.col("n") * F.col(SIZE) * rate) - F.col("target")).alias("gap"),
                 F.sum(F.when(free, F.col("n") * F.col(SIZE) * x * rate).otherwise(0.0)).alias("slope"))
        )
        bracket = sums.withColumns({
            "low": F.when(F.col("gap") <= 0, lam).otherwise(F.col("low")),
            "high": F.when(F.col("gap") >= 0, lam).otherwise(F.col("high")),
            "newton": F.when(F.col("slope") > 0, lam - F.col("gap") / F.col("slope")),
            "reach": 4 * (1 + F.abs(lam)),
        })
        inside = ((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
                  & (F.abs(F.col("newton") - lam) <= F.col("reach")))
        middle = (F.greatest(F.col("low"), lam - F.col("reach")) + F.least(F.col("high"), lam + F.col("reach"))) / 2
        settled = F.abs(F.col("gap")) <= F.lit(TOLERANCE) * F.col("target")
        step = bracket.select(
            KEY, "target", "scale",
            F.when(settled, lam).when(inside, F.col("newton")).otherwise(middle).alias("lam"),
            "low", "high", settled.alias("done"))
        state = stored(state.where("done").unionByName(step), "mix-dual")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select(KEY, "scale", F.round("lam", 9).alias("lam"))


def class_copies(classes: DataFrame, wanted: DataFrame, cap: int = MAX_RATE) -> DataFrame:
    """(_mix_key, _mix_size, n, source_size, target, base, extra): of the n documents of a class,
    ``extra`` take one copy more than ``base``."""
    dual = multipliers(classes, wanted, cap)
    rate = F.when(F.col("lam").isNull() | (F.col(SIZE) == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col(SIZE) / F.col("scale"), F.lit(50.0)))))
    rated = (
        classes.join(wanted, KEY).join(dual, KEY, "left").withColumn("rate", F.round(rate, 9))
        .withColumn("base", F.floor("rate").cast("long"))
    )
    # Classes are at most as many as different sizes; the longest text bounds them, not the corpus.
    down = Window.partitionBy(KEY, "phase").orderBy(F.col(SIZE).desc())
    wished = F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(down)
    rated = stored(rated.select(KEY, SIZE, "n", "source_size", "target", "rate", "base"), "mix-rated")
    phases = rated.withColumn("phase", F.explode(F.array(*[F.lit(p / PHASES) for p in range(PHASES)])))
    phases = phases.withColumn("upto", F.floor(F.round(wished, 6) + F.col("phase")).cast("long"))
    phases = phases.withColumn("extra", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    phases = stored(phases.withColumn("extra", F.least("extra", "n")).drop("upto"), "mix-phases")

    spare = F.when(F.col("base") < cap, F.col("n") - F.col("extra")).otherwise(F.lit(0))
    octave = F.floor(F.log2(F.col(SIZE).cast("double")) * OCTAVE_PARTS).cast("int")
    rest = phases.groupBy(KEY, "phase").agg(
        (F.floor(F.first("target") + 0.5) - F.sum(F.col(SIZE) * (F.col("n") * F.col("base") + F.col("extra")))).alias("left"))
    # One class per part of an octave of sizes: some hundred entries per source, whatever the corpus.
    steps = (
        phases.where((F.col(SIZE) > 0) & (spare > 0)).groupBy(KEY, "phase", octave.alias("octave"))
        .agg(F.max(F.struct(F.col(SIZE).alias("size"), spare.alias("spare"))).alias("c"))
        .groupBy(KEY, "phase").agg(F.sort_array(F.collect_list("c"), asc=False).alias("steps"))
    )
    nothing = F.expr("cast(array() as array<struct<size: bigint, spare: bigint>>)")
    filled = rest.join(steps, [KEY, "phase"], "left").select(
        KEY, "phase",
        F.aggregate(
            F.coalesce("steps", nothing),
            F.struct(F.col("left").cast("long").alias("left"), F.expr("cast(array() as array<struct<size: bigint, more: bigint>>)").alias("got")),
            lambda acc, c: F.struct(
                (acc["left"] - c["size"] * _fitting(acc, c)).alias("left"),
                F.concat(acc["got"], F.array(F.struct(c["size"].alias("size"), _fitting(acc, c).alias("more")))).alias("got")),
        ).alias("f"))
    best = filled.groupBy(KEY).agg(
        F.min(F.struct(F.abs("f.left").alias("off"), "phase", F.col("f.got").alias("got"))).alias("b")
    ).select(KEY, F.col("b.phase").alias("phase"), F.col("b.got").alias("got"))
    best = stored(best, "mix-best")
    more = best.select(KEY, F.inline("got")).select(KEY, F.col("size").alias(SIZE), "more")
    return (
        phases.join(best.select(KEY, "phase"), [KEY, "phase"]).join(more, [KEY, SIZE], "left")
        .withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0))).drop("more", "phase")
    )


def _fitting(acc: Column, c: Column) -> Column:
    return F.least(c["spare"], F.greatest(F.floor(acc["left"] / c["size"]).cast("long"), F.lit(0).cast("long")))


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_RATE) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies of every row
    in columns ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``."""
    sized = docs.withColumns({KEY: source_key(F.col("source")), SIZE: F.size(words(F.col("text"))).cast("long")})
    counts = stored(sized.groupBy(KEY, "source", SIZE).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    wanted = stored(
        targets(counts.groupBy(KEY, "source").agg(F.sum(F.col(SIZE) * F.col("n")).alias("source_size")), weights, cap),
        "mix-targets")
    classes = stored(class_copies(counts.select(KEY, SIZE, "n"), wanted, cap), "mix-copies")
    classes = classes.withColumnsRenamed({c: f"_mix_{c}" for c in ("n", "source_size", "target", "base", "extra")})

    share = (F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    slices = F.ceil(F.col("_mix_n") / SLICE_ROWS)
    sliced = (
        sized.withColumn("_mix_u", share).join(classes, [KEY, SIZE])
        .withColumn("_mix_slice", F.floor(F.col("_mix_u") * slices).cast("int"))
    )
    held = (
        sized.select(KEY, SIZE, share.alias("_mix_u")).join(classes.where(F.col("_mix_n") > SLICE_ROWS), [KEY, SIZE])
        .groupBy(KEY, SIZE, F.floor(F.col("_mix_u") * slices).cast("int").alias("_mix_slice")).agg(F.count(F.lit(1)).alias("_mix_rows"))
    )
    before = Window.partitionBy(KEY, SIZE).orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(KEY, SIZE, "_mix_slice", F.coalesce(F.sum("_mix_rows").over(before), F.lit(0)).alias("_mix_before"))
    rank = F.row_number().over(Window.partitionBy(KEY, SIZE, "_mix_slice").orderBy("_mix_u", "doc_id", "text"))
    ranked = sliced.withColumn("_mix_rank", rank).join(held, [KEY, SIZE, "_mix_slice"], "left")
    extra = (F.col("_mix_rank") + F.coalesce("_mix_before", F.lit(0)) <= F.col("_mix_extra")).cast("long")
    return ranked.select(
        *[F.col(c) for c in docs.columns], F.col(SIZE).alias("mix_size"), F.col("_mix_source_size").alias("mix_source_size"),
        F.col("_mix_target").alias("mix_target"), (F.col("_mix_base") + extra).alias("mix_copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_RATE) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, its columns unchanged."""
    taken = allocate(docs, weights, cap).where(F.col("mix_copies") > 0)
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)
