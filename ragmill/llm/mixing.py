"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, stored


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_ratio: float) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources take `weights` in code-point order (null last), repeating, and share `share` of all sizes. A target stops
    at `max_ratio` times its source; what it can't use is shared again by weight. Sorted by cap per weight, the capped
    sources are a prefix, so one running sum over the sources (not the documents) settles it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_ratio)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.col("level") * F.col("w") <= F.col("cap")
    per = per.withColumn("nth", F.row_number().over(order)).withColumn("level", F.min(F.when(free, F.struct("nth", "level"))).over(whole))
    target = F.when(F.col("level").isNull() | (F.col("nth") < F.col("level.nth")), F.col("cap")).otherwise(F.least(F.col("level.level") * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def expectations(sized: DataFrame, targets: DataFrame, max_ratio: float) -> DataFrame:
    """source, weight, source_size, target, expected: the copies that a document of a source and weight expects.

    That is min(max_ratio, c * weight), with c such that the sizes of a source's documents times their expectations add
    up to its target. The greatest weights meet the cap first, so c follows from a running sum over a source's
    weights. Documents without a weight above 0 expect none.
    """
    groups = sized.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    named = targets.withColumnRenamed("source", "_source").hint("merge")
    groups = groups.join(named, groups["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("w", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)))
    order = Window.partitionBy("source").orderBy(F.desc("w"), F.desc_nulls_last("weight"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(float(max_ratio))
    level = F.when(F.sum(F.col("w") * F.col("words")).over(after) > 0, (F.col("target") - capped) / F.sum(F.col("w") * F.col("words")).over(after))
    groups = groups.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    free = F.when(F.col("level") * F.col("w") <= max_ratio, F.struct("nth", "level"))
    groups = groups.withColumn("first", F.min(free).over(Window.partitionBy("source")))
    over = F.when(F.col("w") > 0, F.lit(float(max_ratio))).otherwise(0.0)
    expected = F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), over).otherwise(F.least(F.greatest(F.col("first.level") * F.col("w"), F.lit(0.0)), over))
    return groups.select("source", "weight", "source_size", "target", expected.alias("expected"))


def joined(rows: DataFrame, per: DataFrame, *keys: str) -> DataFrame:
    """Rows with the columns of their keys' row in `per`, if there is one; null is a key as any other."""
    named = few(per.withColumnsRenamed({k: f"_{k}" for k in keys}))
    on = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, on, "left").drop(*[f"_{k}" for k in keys])


def pareto_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_ratio: float = 2.0,
    seed: str = "mix",
    doc_weight: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bins: int = 65536,
) -> DataFrame:
    """Draw a fixed-size mix of whole documents whose words come near each source's target.

    A document expects lambda copies in proportion to doc_weight (a whole number, of which there are few different
    ones), at most `max_ratio`; what that cuts off goes to the others (see expectations()). floor(lambda) copies are certain; the fraction pi is the inclusion probability of one more. Documents are ranked by
    u/(1-u) divided by pi/(1-pi), u from an MD5 of seed and id, and taken in that order while the middle of the next
    one is still within the words its source lacks. Returns doc_id, source, size, source_size, target, copies, taken.

    No group meets in one task: documents aren't shuffled by source, as sources and weights are few rows; ranks fall into `bins` bins, the bins' sums (at most sources * bins rows) find the
    bin where a source's mix ends, and only that bin's documents are put in order.

    Null texts have size 0 and take 0. A null source is a source of its own, a null id is hashed as 'null'. Repeated
    rows are documents of their own (equal rank, so either may be taken at the boundary). An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    doc_weight = F.lit(1) if doc_weight is None else doc_weight
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))
    sized = stored(sized.withColumn("weight", doc_weight.cast("long")), "mix-sizes")
    targets = stored(source_targets(sized, weights, share, max_ratio), "mix-targets")
    drawn = joined(sized, stored(expectations(sized, targets, max_ratio), "mix-expected"), "source", "weight")
    drawn = drawn.withColumn("certain", F.floor("expected")).withColumn("pi", F.col("expected") - F.col("certain"))
    odds = F.when((F.col("pi") > 0) & (F.col("certain") + 1 <= max_ratio), F.col("u") / (1 - F.col("u")) / (F.col("pi") / (1 - F.col("pi"))))
    drawn = drawn.withColumn("odds", odds).withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * bins))
    drawn = stored(drawn.select("doc_id", "source", "size", "source_size", "target", "certain", "odds", "bin"), "mix-drawn")

    certain = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("lacking"))
    sums = drawn.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = sums.hint("merge").join(certain.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
        F.max(F.when(F.col("before") <= F.col("lacking"), F.struct("bin", "before", "lacking"))).alias("end")
    )
    ends = stored(ends.select("source", F.col("end.bin").alias("end_bin"), (F.col("end.lacking") - F.col("end.before")).alias("room")), "mix-ends")
    placed = joined(drawn, ends, "source")
    at_end = F.col("bin").eqNullSafe(F.col("end_bin")) & F.col("bin").isNotNull()
    edge = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.where(at_end).withColumn("more", (F.coalesce(F.sum("size").over(edge), F.lit(0)) + F.col("size") / 2 <= F.col("room")).cast("int"))
    rest = placed.where(~at_end).withColumn("more", F.coalesce((F.col("bin") < F.col("end_bin")).cast("int"), F.lit(0)))
    out = inner.unionByName(rest).withColumn("copies", F.col("certain") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
