"""Mixing sources to target weights by pivotal dependent rounding.

Every source ``s`` with ``S`` words and target ``T`` asks for ``T / S`` copies of
each of its documents: the whole part is given to all, the fraction ``p`` is
rounded by the pivotal method.  Two documents with masses ``a`` (words) and
fractions ``p`` meet; words of expected mass move from one to the other, in a
random direction that keeps every expectation, until one fraction is 0 or 1.
The sum of ``a * p`` never changes, so a source's taken words miss its target by
less than one document, repeated rows included.  Pairs meet inside small hash buckets; each bucket
leaves one residual document, residuals meet in buckets of the next level, and
so on: a reduction tree of ``log(n) / log(fan_in)`` levels whose first level does
nearly all the work.  A hot source only has more buckets.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

#: a source table of at most so many rows is broadcast; a longer one is joined by shuffles
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(col):
    """Runs of characters other than space, tab and U+000A..U+000D; null gives 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` of all words; no target exceeds ``cap`` times its source's size and
    the excess is shared again by weight.  The fixed point is a water level:
    with sources ordered by cap / weight, level k is what is left after the k
    smallest caps, over the weights left.  One row per source meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("limit", F.col("source_size") * F.lit(cap))
    fill = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    # the first source that its level does not fill up to its cap sets the level of all after it
    settled = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("level")))).over(everything)
    return levels.withColumn("settled", settled["level"]).select(
        "source",
        "source_size",
        F.least(F.col("limit"), F.coalesce(F.col("settled") * F.col("w"), F.col("limit"))).alias("target"),
    )


def _fold(seed: int) -> str:
    """SQL that folds a bucket's array ``items`` into one residual and its decided rows."""
    up = "least(cur.a * (1D - cur.p), x.a * x.p)"
    down = "least(cur.a * cur.p, x.a * (1D - x.p))"
    dice = f"(pmod(xxhash64(cur.k, x.k, {seed}L), 4503599627370496L) + 0.5D) / 4503599627370496D"
    item = "named_struct('k', {0}.k, 'doc_id', {0}.doc_id, 'size', {0}.size, 'c', {0}.c, 'sure', {0}.sure, 'a', {0}.a, 'p', {1})"
    done = "array(named_struct('doc_id', {0}.doc_id, 'size', {0}.size, 'c', {0}.c, 'sure', {0}.sure, 'extra', {1}))"
    pair = "named_struct('cur', {0}, 'out', {1})"
    raised = (
        f"if(m.up = cur.a * (1D - cur.p), {pair.format(item.format('x', 'x.p - m.up / x.a'), done.format('cur', '1'))}, "
        f"{pair.format(item.format('cur', 'cur.p + m.up / cur.a'), done.format('x', '0'))})"
    )
    lowered = (
        f"if(m.down = cur.a * cur.p, {pair.format(item.format('x', 'x.p + m.down / x.a'), done.format('cur', '0'))}, "
        f"{pair.format(item.format('cur', 'cur.p - m.down / cur.a'), done.format('x', '1'))})"
    )
    # transform over a one-element array binds names to values that are used again
    moves = f"array(named_struct('up', {up}, 'down', {down}, 'dice', {dice}))"
    step = f"transform({moves}, m -> if(coalesce(m.dice < m.down / nullif(m.up + m.down, 0D), true), {raised}, {lowered}))[0]"
    step = f"transform(array(s.cur), cur -> {step})[0]"
    merged = f"transform(array({step}), t -> named_struct('cur', t.cur, 'done', concat(s.done, t.out)))[0]"
    none = "filter(array(named_struct('doc_id', items[0].doc_id, 'size', items[0].size, 'c', items[0].c, 'sure', items[0].sure, 'extra', 0)), y -> false)"
    return f"aggregate(slice(items, 2, size(items)), named_struct('cur', items[0], 'done', {none}), (s, x) -> {merged})"


def mix_sources(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, fan_in: int = 64, seed: int = 20240229
) -> DataFrame:
    """Decide how often each document of ``docs(doc_id, source, text)`` is taken.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    copies, taken``.  Null and empty texts have size 0 and are taken 0 times; null
    sources form one source, the last; null doc_ids are rows like others; of rows equal
    in doc_id, source and size as many get the extra copy as their fraction says, and one
    more by the draw, so repeated rows miss a target by no more than others.  Decisions depend on doc_id,
    size, source and ``seed`` alone, so reruns agree.  An empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    small = F.broadcast if targets.count() <= FEW_SOURCES else (lambda df: df)
    items = (
        sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("c"))
        .join(small(targets.withColumnRenamed("source", "src")), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    )
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a ratio within rounding of a whole number is that number
    near = F.abs(ratio - F.round(ratio)) < 1e-12
    whole = F.when(near, F.round(ratio)).otherwise(F.floor(ratio)).cast("int")
    # of c equal rows floor(c * fraction) take the extra copy for sure; what is left is the fraction of one row
    items = items.withColumn("base", whole).withColumn("_fraction", F.when(near, F.lit(0.0)).otherwise(ratio - whole) * F.col("c"))
    sure = F.floor(F.col("_fraction") + 1e-9)
    items = items.withColumn("sure", sure).withColumn("p", F.greatest(F.lit(0.0), F.col("_fraction") - sure)).drop("_fraction")
    items = items.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    open_ = items.where("p > 0 and size > 0")
    counts = open_.groupBy("source").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    tops = counts.select(F.col("source").alias("src"), F.ceil(F.col("n") / F.lit(fan_in)).alias("buckets"))
    key = F.xxhash64("doc_id", "source", "size", F.lit(seed))
    level = (
        open_.join(small(tops), F.col("source").eqNullSafe(F.col("src"))).drop("src")
        .select(
            "source",
            F.pmod(F.xxhash64(key), F.col("buckets")).alias("bucket"),
            F.struct(key.alias("k"), "doc_id", "size", "c", "sure", F.col("size").cast("double").alias("a"), "p").alias("item"),
        )
    )
    decided = []
    for _ in range(max(1, math.ceil(math.log(max(most, 2), fan_in)) + 1)):
        folded = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = materialize(folded.select("source", "bucket", F.expr(_fold(seed)).alias("r")), "mix-level")
        decided.append(folded.select("source", F.explode("r.done").alias("d")).select("source", "d.*"))
        level = folded.select("source", F.floor(F.col("bucket") / F.lit(fan_in)).alias("bucket"), F.col("r.cur").alias("item"))
    dice = (F.pmod(F.xxhash64(F.col("item.k"), F.lit(seed + 1)), F.lit(2**52)) + 0.5) / float(2**52)
    decided.append(
        level.select("source", "item.doc_id", "item.size", "item.c", "item.sure", F.when(dice < F.col("item.p"), 1).otherwise(0).alias("extra"))
    )
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    rest = items.where("not (p > 0 and size > 0)").select("source", "doc_id", "size", "c", "sure", F.lit(0).alias("extra"))
    bases = items.groupBy("source").agg(F.max("base").alias("base"))
    per_source = targets.join(bases.withColumnRenamed("source", "b_source"), F.col("source").eqNullSafe(F.col("b_source")), "left").select(
        F.col("source").alias("src"), "source_size", "target", F.coalesce("base", F.lit(0)).alias("base")
    )
    out = extra.unionByName(rest).join(small(per_source), F.col("source").eqNullSafe(F.col("src"))).drop("src")
    more = (F.col("_each") <= F.col("sure") + F.col("extra")).cast("int")
    copies = F.when(F.col("size") > 0, F.col("base") + more).otherwise(0).cast("int")
    return (
        out.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


#: parts in which equal rows are counted off
SALTS = 64


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as :func:`mix_sources` takes it.

    Rows that it takes no time go.  All columns of ``docs`` are kept.  Of rows equal in
    doc_id, source and size of which some are taken once more than others, any may be.
    """
    mixed = mix_sources(docs.select("doc_id", "source", "text"), **options)
    taken = mixed.groupBy(F.col("doc_id").alias("_mix_doc"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size")).agg(
        F.max("copies").alias("_mix_copies"), F.min("copies").alias("_mix_least"), F.count("*").alias("_mix_rows"), F.sum("copies").alias("_mix_all")
    ).where("_mix_copies > 0")
    taken = materialize(taken, "mix-taken")
    sized = docs.withColumn("_mix_words", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_mix_doc")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_words") == F.col("_mix_size"))
    )
    plain = sized.join(taken.where("_mix_copies = _mix_least"), same)
    uneven = taken.where("_mix_copies > _mix_least")
    if uneven.limit(1).count():  # only repeated rows
        plain = plain.select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_copies").unionByName(_counted_off(sized.join(uneven, same), docs.columns))
    return plain.withColumn("_mix_each", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _counted_off(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``_mix_copies`` of rows whose group takes some of them once more; groups are counted off in ``SALTS`` parts."""
    kept = materialize(rows.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-uneven")
    kept = kept.withColumn("_mix_salt", F.pmod(F.xxhash64("_mix_row"), F.lit(SALTS)))
    group = ["_mix_doc", "_mix_source", "_mix_size"]
    sizes = kept.groupBy(*group, "_mix_salt").agg(F.count("*").alias("_mix_n"))
    upto = Window.partitionBy(*group).orderBy("_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(upto), F.lit(0))).select(*[F.col(c).alias(f"{c}_") for c in group], F.col("_mix_salt").alias("_mix_salt_"), "_mix_before")
    met = kept.join(before, [*[F.col(c).eqNullSafe(F.col(f"{c}_")) for c in group], F.col("_mix_salt") == F.col("_mix_salt_")])
    place = F.col("_mix_before") + F.row_number().over(Window.partitionBy(*group, "_mix_salt").orderBy("_mix_row"))
    extra = F.col("_mix_all") - F.col("_mix_least") * F.col("_mix_rows")
    placed = met.withColumn("_mix_copies", F.col("_mix_least") + (place <= extra).cast("int"))
    return placed.where("_mix_copies > 0").select(*[F.col(f"`{c}`") for c in columns], "_mix_copies")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
