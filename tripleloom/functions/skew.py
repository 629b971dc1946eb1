"""Building blocks that stay whole when one key holds a large share of the rows.

Every helper is lazy and exact.  Side tables that are broadcast have a bound that
follows from how they are made; the bound is stated where the broadcast is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.session import staged

HOT_SHARE = 256      # a key is hot when it holds more than 1/HOT_SHARE of the rows
SAMPLE_PER_SPLIT = 20
RANGE_ROWS = 10_000_000   # a range holds about so many rows at most; more rows make more ranges


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame, as a scalar subquery."""
    return df.scalar()


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order``.

    ``min_by`` combines on the map side, so a hot key costs one row per task in
    the shuffle; a ranking window would move and sort all of its rows.  The first order column, the other order columns and the
    rest are worked out apart, and what the caller does not select is not moved: with the first order
    column alone, if that is a number, rows are hashed and nothing is sorted.
    """
    lead, also, rest = order[0], [c for c in order[1:] if c not in keys], [c for c in df.columns if c not in [*keys, *order]]
    least, at = F.min(lead), F.struct(*order)
    found = [F.when(F.count_if(F.col(lead).isNull()) == 0, least).alias("_lead")]      # nulls come first
    found += [F.min(at).alias("_at")] if also else []
    found += [F.min_by(F.struct(*rest), at).alias("_rest")] if rest else []
    named = {c: F.col(c) for c in keys} | {lead: F.col("_lead")} | {c: F.col(f"_at.{c}") for c in also} | {c: F.col(f"_rest.{c}") for c in rest}
    return df.groupBy(*keys).agg(*found).select(*[named[c].alias(c) for c in df.columns])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  Spark prunes to ``k`` rows per task before the
    shuffle (WindowGroupLimit), so hot groups do not travel whole.  Groups are sorted by a hash first, for names
    that begin alike are slow to compare."""
    w = Window.partitionBy(F.xxhash64(*by), *by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def hot_hashes(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> Column:
    """Hashes of the keys that hold more than about 1/share of all rows, fewer than 2 * share, as an array from a scalar subquery.

    They come from a frequency sketch of bounded size that tasks build and merge: no key count is shuffled.  Its counts err by less
    than a tenth of the share; a key taken for hot or not by mistake costs time only.
    """
    sketch = df.select(F.xxhash64(*keys).alias("h")).agg(F.expr(f"approx_top_k(h, {2 * share}, {32 * share})").alias("top"), F.count(F.lit(1)).alias("n"))
    return scalar(sketch.select(F.transform(F.filter("top", lambda x: x["count"] * share > F.col("n")), lambda x: x["item"]).alias("hot")))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                salts: int = 64, share: int = HOT_SHARE) -> DataFrame:
    """Equi-join whose left side may have hot keys (inner, left, left_semi, left_anti).

    Left rows of hot keys, null ones too, are spread over ``salts`` tasks and only the right rows of those keys are copied.
    The left side is read once more for its keys, and not shuffled for it.
    """
    hot = F.coalesce(F.array_contains(hot_hashes(left, keys, share), F.xxhash64(*keys)), F.lit(False))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    lhs = left.withColumn("_hot", hot).withColumn("_salt", spread.cast("int")).drop("_hot")
    rhs = right.withColumn("_hot", hot).withColumn("_salt", F.explode(copies)).drop("_hot")
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")


def range_bucket(df: DataFrame, cols: Sequence[str], buckets: int) -> tuple[Column, Column, Column]:
    """Split points, key, and number of the range a row falls in, by a hash sample.

    There are ``buckets`` ranges, or as many as RANGE_ROWS asks for if that is more.  The sample has
    about SAMPLE_PER_SPLIT rows a range and depends on values only, so a task that is run again gives
    the same answer.
    """
    key = F.struct(*cols)
    total = scalar(df.agg(F.count(F.lit(1)).alias("n")))
    want = F.greatest(F.lit(float(buckets)), total / float(RANGE_ROWS)) * float(SAMPLE_PER_SPLIT)
    at = F.pmod(F.xxhash64("k"), F.lit(1 << 40)).cast("double") / float(1 << 40)      # doubles: no product of longs
    drawn = df.select(key.alias("k")).where(at * total <= want)
    points = scalar(drawn.agg(F.filter(
        F.sort_array(F.collect_list("k")),
        lambda _, i: (i + 1) % F.lit(SAMPLE_PER_SPLIT) == 0).alias("points")))
    top = F.floor(F.log2(F.size(F.col("_ps_points")) + 1.0)).cast("int")
    steps = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def halve(at: Column, step: Column) -> Column:
        inside = at + step <= F.size(F.col("_ps_points"))
        return F.when(inside & (F.get(F.col("_ps_points"), at + step - 1) < F.col("_ps_key")), at + step).otherwise(at)

    search = F.aggregate(steps, F.lit(0), halve)
    return points, key, search


def _bucketed(df: DataFrame, cols: Sequence[str], buckets: int | None) -> DataFrame:
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points, key, search = range_bucket(df, cols, n)
    return (df.withColumn("_ps_points", points).withColumn("_ps_key", key)
              .withColumn("_ps_bucket", search).drop("_ps_points", "_ps_key"))


def prefix_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str,
               buckets: int | None = None, stage: bool = False) -> DataFrame:
    """Inclusive running sum of ``value`` per ``by`` in ``order`` (which must be unique).

    Rows are cut into ranges of (by, order); each range is summed by itself and the
    sums of earlier ranges of the same key are added.  A range can begin inside at
    most one key, so the offset table has at most one row per range and is broadcast.
    Only those keys need offsets, so no key and no global order lands in one task.

    The input is read four times (count, sample, sums, rows); ``stage`` writes it to the
    shared folder first, which pays when it comes from more than a scan.
    """
    rows = df.withColumn("_ps_value", value)
    cut = _bucketed(staged(rows) if stage else rows, [*by, *order], buckets)
    sums = cut.groupBy(*by, "_ps_bucket").agg(F.sum("_ps_value").alias("_ps_sum"))
    before = Window.partitionBy(*by).orderBy("_ps_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_ps_before", F.sum("_ps_sum").over(before)).where(F.col("_ps_before").isNotNull())
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in by],
                             F.col("_ps_bucket").alias("_ps_o_bucket"), "_ps_before")
    same = F.col("_ps_bucket") == F.col("_ps_o_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = (Window.partitionBy(*by, "_ps_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = cut.join(F.broadcast(offsets), same, "left")
    total = F.sum("_ps_value").over(inside) + F.coalesce(F.col("_ps_before"), F.lit(0))
    return out.withColumn(name, total).select(*df.columns, name)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank",
           buckets: int | None = None, stage: bool = False) -> DataFrame:
    """Exact 1-based position per ``by`` in a unique ``order``; global when ``by`` is empty."""
    return prefix_sum(df, by, order, F.lit(1).cast("long"), name, buckets, stage)


def group_ranked(df: DataFrame, by: str, order: Sequence[str], group: str, name: str, buckets: int | None = None) -> DataFrame:
    """Exact 1-based position of each value of ``by`` among all its values, and of each row per ``by`` in a unique ``order``.

    Rows are cut into ranges of (by, order) and sorted once in each.  A value goes on into a range only as its first one, so what
    is added to the ranks of a range is one row a range, which is broadcast.  ``by`` is not null.
    """
    cut = _bucketed(df, [by, *order], buckets)
    sizes = cut.groupBy("_ps_bucket", by).agg(F.count(F.lit(1)).alias("_ps_n"))
    ends = sizes.groupBy("_ps_bucket").agg(F.count(F.lit(1)).alias("_ps_values"), F.min(by).alias("_ps_first"), F.max(F.struct(by, "_ps_n")).alias("_ps_last"))
    before = Window.orderBy("_ps_bucket")      # one row a range
    goes_on = F.coalesce(F.lag(f"_ps_last.{by}").over(before) == F.col("_ps_first"), F.lit(False)).cast("long")
    known = ends.withColumn("_ps_goes_on", goes_on)
    # rows of the first value in the ranges before it: all since the range where it began, whose last value it is
    run = F.sum(F.when((F.col("_ps_goes_on") == 1) & (F.col("_ps_values") == 1), 0).otherwise(1)).over(before)
    known = known.withColumn("_ps_run", run).withColumn("_ps_upto", F.sum("_ps_last._ps_n").over(Window.partitionBy("_ps_run").orderBy("_ps_bucket")))
    offsets = known.select(
        F.col("_ps_bucket").alias("_ps_o_bucket"), F.col("_ps_first").alias("_ps_o_first"),
        (F.sum(F.col("_ps_values") - F.col("_ps_goes_on")).over(before) - F.col("_ps_values")).alias("_ps_values_before"),
        F.when(F.col("_ps_goes_on") == 1, F.lag("_ps_upto").over(before)).otherwise(0).alias("_ps_rows_before"))
    row = F.row_number().over(Window.partitionBy("_ps_bucket", by).orderBy(*order))
    value = F.dense_rank().over(Window.partitionBy("_ps_bucket").orderBy(by))
    out = cut.withColumn("_ps_row", row.cast("long")).withColumn("_ps_value", value.cast("long")).join(F.broadcast(offsets), F.col("_ps_bucket") == F.col("_ps_o_bucket"))
    first = F.when(F.col(by) == F.col("_ps_o_first"), F.col("_ps_rows_before")).otherwise(0)
    return out.withColumns({group: F.col("_ps_value") + F.col("_ps_values_before"), name: F.col("_ps_row") + first}).select(*df.columns, group, name)
