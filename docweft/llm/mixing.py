"""Mixing sources to target weights along a curriculum whose weights change over training.

Each source has a weight schedule, linear between knots. Its target is fixed by the schedule's integral; its words are
laid end to end in hash order, repeated as often as the target asks. The demand that a source has met by time t is its
target times the integral up to t, so inverting that integral gives the time, from 0 to 1, at which each document is
trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import WORD, copied, numbered_columns, saved

#: Weights of the sources in order, repeating, and a schedule for each: (time, factor) knots with a mean factor of 1.
WEIGHTS = (5, 2, 1)
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
def area(knots: tuple[tuple[float, float], ...]) -> float:
    """The integral of a schedule."""
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which `share` (0 to 1) of a schedule's integral has passed."""
    total, passed, out = area(knots), 0.0, F.lit(knots[-1][0])
    steps = []
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        v = F.greatest(share * total - passed, F.lit(0.0))
        steps.append((passed, t0 + 2 * v / F.greatest(a + F.sqrt(F.greatest(F.lit(a * a) + v * (2 * (b - a) / (t1 - t0)), F.lit(0.0))), F.lit(1e-300))))
        passed += (t1 - t0) * (a + b) / 2
    for begins, when in steps:
        out = F.when(share * total >= begins, when).otherwise(out) if begins else when
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    Sources in code-point order, null last, take the weights in turn and share `total` times all sizes by them. A target
    stops at `most` times its source's size, and what it leaves is shared again, until none is above: the level at which
    the least full of the others stand is found in one pass over the sources by size for weight. One row a source: the
    windows hold as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most)
    by_fill = Window.orderBy(cap / F.col("weight"), "rank")
    every, before = Window.partitionBy(F.lit(1)), by_fill.rowsBetween(Window.unboundedPreceding, -1)
    open_ = (
        weighed.withColumn("cap", cap)
        .withColumn("asked", F.sum("source_size").over(every) * F.lit(total))
        .withColumn("above", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("asked") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("above"))
    )
    fits = open_.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every))
    level = F.col("first.level")
    target = F.when(level.isNull() | (level * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(level * F.col("weight"))
    return fits.select("source", "source_size", "rank", "weight", target.alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    total: float = 1.5, most: float = 2.0, curriculum=CURRICULUM,
) -> DataFrame:
    """(key, source, size, source_size, target, taken, first_at, position) for every row, sorted by position.

    first_at: words of its source before the document; taken: words that the mix takes of it, repeats counted; position:
    time of its first copy, null if nothing is taken. Documents of a source come in the order of a hash of their key, so
    reruns agree. Rows equal in key, source and size are counted, not compared: they lie side by side, and so many rows
    come out. Positions within a source are sums over 4096 ranges of the hash, then sums within a range. A null text has
    size 0; a null source is a source, the last; a null key hashes as an empty one. An empty table gives no rows.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    groups = sized.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    groups = saved(groups.withColumn("hash", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))))
    words = F.col("size") * F.col("n")
    ranges = groups.groupBy("source", F.substring("hash", 1, 3).alias("part")).agg(F.sum(words).alias("words"))
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select("source", "part", F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("begin"))
    sums = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = targets(sums, weights, total, most)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    starts = begins.join(aims, same(begins, aims), "left").drop(aims["source"])
    within = Window.partitionBy("source", "part").orderBy("hash", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("part", F.substring("hash", 1, 3)).withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0)))
    joined = placed.join(starts, same(placed, starts) & (placed["part"] == starts["part"])).drop(starts["source"]).drop(starts["part"])
    rows = copied(joined, "n", "copy")
    at = F.col("begin") + F.col("before") + F.col("copy") * F.col("size")
    whole = F.floor("target").cast("long")
    part = lambda lap: F.greatest(F.lit(0), F.least(F.col("size"), whole - lap * F.col("source_size") - at))
    laps = int(-(-most // 1))
    taken = sum((part(lap) for lap in range(1, laps)), part(0))
    when = position_of(F.lit(0), at, curriculum)
    out = rows.select("key", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), at.alias("first_at"), "rank", when.alias("time"))
    out = out.select("key", "source", "size", "source_size", "target", "taken", "first_at", "rank", F.when(F.col("taken") > 0, F.col("time")).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "rank", "first_at").withColumnRenamed("key", key)


def position_of(lap: Column, at: Column, curriculum=CURRICULUM) -> Column:
    """The time of the copy of a document that is taken in a lap: that of the middle of its words."""
    middle = lap * F.col("source_size") + at + F.col("size") / F.lit(2.0)
    share = F.least(middle / F.col("target"), F.lit(1.0))
    out = time_of(share, curriculum[0])
    for i, knots in list(enumerate(curriculum))[1:]:
        out = F.when(F.col("rank") % len(curriculum) == i, time_of(share, knots)).otherwise(out)
    return F.when(F.col("target") > 0, out)


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    total: float = 1.5, most: float = 2.0, curriculum=CURRICULUM,
) -> DataFrame:
    """The rows of docs in training order: each whole document once for every lap in which the mix takes words of it.

    Documents of which nothing is taken go. Rows equal in key, source and size share their number of laps, that of the
    first of them. Columns stay; of columns of one name the first counts; see mix() for nulls.
    """
    rows, names = numbered_columns(docs)
    plan = mix(rows, names[key], names[text], names[source], weights, total, most, curriculum)
    first = plan.groupBy(F.col(names[key]).alias("key"), "source", "size").agg(F.min_by(F.struct("source_size", "target", "rank", "first_at"), "first_at").alias("at"))
    first = first.select("key", F.col("source").alias("of"), F.col("size").alias("words"), "at.*")
    matched = (
        F.col(names[key]).eqNullSafe(first["key"]) & F.col(names[source]).eqNullSafe(first["of"]) & (word_count(F.col(names[text])) == first["words"])
    )
    laps = int(-(-most // 1))
    each = rows.join(first, matched).select("*", F.explode(F.array(*[F.lit(i) for i in range(laps)])).alias("lap"))
    each = each.withColumn("size", F.col("words")).where(
        (F.col("size") > 0) & (F.col("lap") * F.col("source_size") + F.col("first_at") < F.floor("target"))
    )
    ordered = each.withColumn("position", position_of(F.col("lap"), F.col("first_at"), curriculum)).orderBy("position", "rank", "lap", "first_at")
    return ordered.select(*[F.col(new).alias(old) for old, new in names])


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sums),
weighed AS (
  SELECT *, ([5, 2, 1])[(rank % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS asked FROM ranked),
levels AS (
  SELECT *, cap / weight AS fill,
    (asked - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fits AS (SELECT level AS l FROM levels WHERE level * weight <= cap ORDER BY fill, rank LIMIT 1),
aims AS (
  SELECT source, source_size, rank,
    CASE WHEN l IS NULL OR l * weight > cap THEN cap ELSE l * weight END AS target
  FROM levels LEFT JOIN fits ON true),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.rank, a.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.size, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_at
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
mixed AS (
  SELECT doc_id, size, source_size, target, rank,
    (greatest(0, least(size, floor(target)::BIGINT - first_at))
     + greatest(0, least(size, floor(target)::BIGINT - source_size - first_at)))::BIGINT AS taken,
    least((first_at + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS share
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
  round(CASE WHEN taken > 0 AND target > 0 THEN CASE rank % 3
    WHEN 0 THEN 2.0 * share / (1.5 + sqrt(2.25 - 2.0 * share))
    WHEN 1 THEN share
    ELSE 2.0 * share / (0.5 + sqrt(0.25 + 2.0 * share)) END END, 9) AS position
FROM mixed
"""
