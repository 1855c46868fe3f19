"""Mixing sources to target weights with hash-threshold histograms, in DataFrame expressions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; what a source's target would exceed three times
its size is shared among the others by weight (``targets``, a closed form over the sorted ratios). A target is a number
of whole repeats plus a rest. For the rest, each document has a 48-bit hash; sizes are summed by source and the first 12
bits, the bucket in which the running sum passes the rest is refined by the next 12 bits, and so on: four histograms of
at most 4096 rows a source instead of a sort. Documents below the threshold are taken once more. A smaller budget has a
smaller threshold, so mixes are nested.

Edge cases: a null text has size 0 and takes 0; a null source is a source; rows equal in id and text share a hash: of those at
the threshold as many are taken once more as bring the sum nearest to the target (numbered by partition, so that no task
meets all of them); no row is taken more than three times, empty ones included; very long texts count whole; an empty table
gives an empty result; other columns, whatever their names, are passed through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, maybe_broadcast, table

LEVELS, BITS = 4, 12
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def digest() -> Column:
    """The 48-bit hash of id and text."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the 48-bit hash ``h`` of id and text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest().alias("h"))


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target, ``times`` (whole repeats) and ``rest``; one row a source."""
    # windows over one row a source
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("pos", F.row_number().over(order)).withColumn("weight", ((F.col("pos") - 1) % 3 + 1).cast("long")).withColumn("cap", CAP * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    free = (
        weighed.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("heavy"))
        .withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    )
    # the water level is that of the first source below its cap
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "pos", F.col("level").alias("level")))).over(Window.partitionBy(F.lit(1)))["level"]
    aimed = free.withColumn("target", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return aimed.select("source", "source_size", "target", times.alias("times")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with ``upto`` and ``some``: documents with a hash below it are taken once more, and so many of those with it."""
    state = aims.withColumn("left", F.col("rest")).withColumn("path", F.lit(0).cast("long"))
    for level in range(LEVELS):
        below = (LEVELS - 1 - level) * BITS
        own = maybe_broadcast(state.select(F.col("source").alias("_s"), "path"))
        inside = rows.join(own, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("h", below + BITS) == F.col("path"))
        histogram = inside.groupBy("source", F.shiftright("h", below).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("through", F.sum("n").over(upto)).join(maybe_broadcast(state.select(F.col("source").alias("_s"), "left")), F.col("source").eqNullSafe(F.col("_s")))
        # the first bucket that isn't taken whole: the one to refine, or at the last level the rows of one hash
        first = F.min(F.struct("bucket", (F.col("through") - F.col("n")).alias("spent"), "n", "m")).alias("cut")
        cut = summed.where(F.col("through") > F.col("left")).groupBy(F.col("source").alias("_c")).agg(first)
        left = F.col("left") - F.coalesce("cut.spent", F.lit(0))
        state = state.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").select(
            "source", "source_size", "target", "times", "rest", left.alias("left"),
            F.coalesce("cut.bucket", F.shiftleft(F.col("path") + 1, BITS)).alias("path"),
            F.coalesce(F.floor(left * F.col("cut.m") / F.col("cut.n") + 0.5), F.lit(0)).cast("long").alias("some"),
        )
        state = materialise(state, "mix-level")
    return state.select("source", "source_size", "target", "times", F.col("path").alias("upto"), "some")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the number of the row (from 1) among those of its ``by``, in the order of partitions."""
    inner = [f"{name}{x}" for x in ("_id", "_part", "_n", "_by", "_at", "_before")]
    row, part, n, own, at, before = inner
    held = materialise(rows.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33)), "mix-boundary")
    # one row for each partition and source
    counts = held.groupBy(F.col(by).alias(own), F.col(part).alias(at)).agg(F.count("*").alias(n))
    sums = counts.select(own, at, F.coalesce(F.sum(n).over(Window.partitionBy(own).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    joined = held.join(maybe_broadcast(materialise(sums, "mix-parts")), F.col(by).eqNullSafe(F.col(own)) & (F.col(part) == F.col(at)))
    return joined.withColumn(name, F.col(before) + F.row_number().over(Window.partitionBy(by, part).orderBy(row))).drop(*inner)


def taken(rows: DataFrame, mark: str) -> DataFrame:
    """``rows`` with ``{mark}copies``; they have {mark}s (source), {mark}h, {mark}times, {mark}upto and {mark}some."""
    c = lambda x: F.col(f"{mark}{x}")
    base = F.least(c("times") + (c("h") < c("upto")).cast("long"), F.lit(CAP))
    edge = (c("h") == c("upto")) & (c("some") > 0)
    others = rows.where(~edge).withColumn(f"{mark}copies", base)
    at = numbered(rows.where(edge), f"{mark}s", f"{mark}number")
    return others.unionByName(at.withColumn(f"{mark}copies", F.least(c("times") + (c("number") <= c("some")).cast("long"), F.lit(CAP))).drop(f"{mark}number"))


def cuts_of(rows: DataFrame, mark: str) -> DataFrame:
    """One row a source: {mark}s, {mark}times, {mark}upto, {mark}some, {mark}size and {mark}target."""
    cuts = thresholds(rows, materialise(targets(rows), "mix-targets"))
    return cuts.select(*(F.col(a).alias(f"{mark}{b}") for a, b in (("source", "s"), ("times", "times"), ("upto", "upto"), ("some", "some"), ("source_size", "size"), ("target", "target"))))


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, source_size, target and ``copies``, the times that each row is taken."""
    rows = materialise(sized(docs), "mix-sizes")
    joined = rows.join(maybe_broadcast(cuts_of(rows, "_mix_")), F.col("source").eqNullSafe(F.col("_mix_s"))).withColumn("_mix_h", F.col("h"))
    return taken(joined, "_mix_").select("doc_id", "source", "size", "h", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    mark = "quern_mix_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    rows = materialise(sized(docs).select("source", "size", "h"), "mix-sizes")
    # the hash is computed anew, so no join on ids
    joined = docs.join(maybe_broadcast(cuts_of(rows, mark)), F.col("source").eqNullSafe(F.col(f"{mark}s"))).withColumn(f"{mark}h", digest())
    return taken(joined, mark).withColumn(f"{mark}copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{mark}copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    done = plan(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same mix from a full sort by source and hash.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
v AS (SELECT *, (pos - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM w),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM v),
l AS (SELECT *, (CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
   / CAST(sum(weight) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN (SELECT arg_min(level, (ratio, pos)) FROM l WHERE ratio > level) * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l),
a AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS n, count(*) AS m FROM d GROUP BY source, h),
c AS (SELECT g.source, h, n, m, sum(n) OVER (PARTITION BY g.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS through FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS k FROM d)
SELECT r.doc_id, r.size, a.source_size, a.target,
  r.size * (a.times + CASE WHEN c.through <= a.target - a.times * a.source_size OR k <= floor((a.target - a.times * a.source_size - c.through + c.n) * c.m / nullif(c.n, 0) + 0.5) THEN 1 ELSE 0 END) AS taken
FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.h = r.h
"""
