"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order that depends on their id alone,
each up to three times over.  A copy's virtual finish time is the number of its
source's tokens queued up to its end, divided by the source's target.  All copies of
all sources are put in ranges of finish time; ranges are summed, and copies are taken
in that order until the budget, all tokens, is used up.  The range in which that
happens is sorted; a copy that straddles the end stays when half of it lies before.

Running sums are taken in two levels, over hash buckets or ranges and then inside one,
so that a source with a third of all rows is spread over thousands of groups; the more
rows there are, the more groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baseloom.llm._scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows in a bucket of a source's queue, or in a range of finish times, on average; there are 4096 of either at least.
GROUP_ROWS = 5_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets share all sizes by weight; one that would pass ``most`` times its source's
    size stops there and the rest is shared again.  In the order of (limit / weight)
    the stopped ones come first, so running sums give the level in one pass.  There is
    a row for each source, so the windows without partitions stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size", F.row_number().over(by_name).alias("rank"), F.element_at(F.array(*map(F.lit, weights)), turn).cast("bigint").alias("weight")
    )
    every = Window.partitionBy()
    order = Window.orderBy((F.col("source_size").cast("double") / F.col("weight")), "rank")
    src = src.withColumns({
        "total": F.sum("source_size").over(every),
        "stopped": F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "place": F.row_number().over(order),
    })
    # limit / weight <= (total - stopped) / rest, in whole numbers
    src = src.withColumn("full", most * F.col("source_size") * F.col("rest") <= (F.col("total") - F.col("stopped")) * F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct("place", "stopped", "rest"))).over(every)
    src = src.withColumn("level", first)
    shared = (F.col("total") - F.col("level.stopped")).cast("double") * F.col("weight") / F.col("level.rest")
    return src.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), (most * F.col("source_size")).cast("double")).otherwise(shared).alias("target"))


def _groups(rows: int) -> int:
    """A power of 16, 4096 at least, with GROUP_ROWS in a group."""
    digits = 3
    while 16**digits * GROUP_ROWS < rows:
        digits += 1
    return digits


def queue(rows: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """rows: a written table of doc_id, source, size and whatever else.

    Adds source_size, target, and copies: how many of its ``most`` copies the mix takes.
    Rows that differ in nothing stand in any order.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = _groups(n)
    keyed = rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("key", 1, digits))
    goal = targets(rows.select("source", "size"), weights, most)
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    g, o = goal.alias("g"), offsets.alias("o")
    placed = o.join(F.broadcast(g), F.expr("o.source <=> g.source")).select(F.col("o.source").alias("osource"), F.col("o.bucket").alias("obucket"), "offset", "source_size", "target")
    joined = keyed.join(placed, F.expr("source <=> osource AND bucket = obucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *[c for c in rows.columns if c not in ("doc_id", "source", "size")])
    begun = F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    scratch = Scratch(rows.sparkSession)
    queued = scratch.write(joined.withColumns({"begun": begun, "place": F.row_number().over(inside)}).drop("osource", "obucket", "offset"))

    # all copies by virtual finish time, in ranges
    finish = F.coalesce((F.col("turn") * F.col("source_size") + F.col("begun") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))
    copies = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish)
    ranges = 16**digits
    copies = copies.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)))
    sums = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    up_to = F.sum("range_size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    last = sums.withColumn("up_to", up_to).filter(F.col("up_to") > total).orderBy("range").select("range", (F.col("up_to") - F.col("range_size")).alias("spent")).limit(1).collect()
    at, spent = last[0] if last else (2 * ranges + 1, total)
    order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "key", "doc_id", "place", "turn").rowsBetween(Window.unboundedPreceding, -1)
    cut = copies.filter(F.col("range") == at).withColumn("before", spent + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.filter(2 * F.col("before") + F.col("size") <= 2 * total).groupBy("source", "key", "place").agg(F.count("*").alias("more"))
    sure = sum((F.least(F.floor(c * ranges), F.lit(2 * ranges)) < at).cast("int") for c in (F.coalesce((e * F.col("source_size") + F.col("begun") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)) for e in range(most)))
    c = cut.select(F.col("source").alias("csource"), F.col("key").alias("ckey"), F.col("place").alias("cplace"), "more")
    out = queued.join(c, F.expr("source <=> csource AND key = ckey AND place = cplace"), "left")
    return out.withColumn("copies", sure + F.coalesce("more", F.lit(0)).cast("int")).drop("key", "bucket", "csource", "ckey", "cplace", "more", "place")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of the input, repeated or left out, in order of virtual finish time.

    Null texts and texts without words have no size; each comes in as often as its
    place in its source's queue says.  Null sources form one source.  Ids are of any type
    that has a text; rows with equal ids are queued next to each other, and equal rows
    are taken as often as all of them are in the queue.  All columns of the input are
    returned, whatever their names; their types must be comparable.  An empty table gives an empty
    table.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(*columns).alias("rk"))
    thin = Scratch(docs.sparkSession).write(rows.select("doc_id", "source", "size", "rk"))
    chosen = Scratch(docs.sparkSession).write(queue(thin, most, weights).groupBy("doc_id", "source", "size", "rk").agg(F.count("*").alias("same"), F.sort_array(F.collect_list(F.struct("begun", "copies"))).alias("stood"), F.max("source_size").alias("source_size"), F.max("target").alias("target")))
    chosen = chosen.filter(F.exists("stood", lambda x: x["copies"] > 0))
    t = chosen.select(*(F.col(c).alias(f"t_{c}") for c in ("doc_id", "source", "size", "rk")), "same", "stood", "source_size", "target")
    met = rows.join(t, F.expr("doc_id <=> t_doc_id AND source <=> t_source AND size = t_size AND rk = t_rk"))
    met = met.select("row", "doc_id", "size", "rk", "same", "stood", "source_size", "target")
    one = met.filter("same = 1").withColumn("mine", F.col("stood")[0])
    if not chosen.filter("same > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("doc_id", "size", "rk").orderBy("rk"))
        one = one.unionByName(met.filter("same > 1").withColumn("mine", F.element_at("stood", turn)))
    out = one.filter("mine.copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("mine.copies") - 1)))
    finish = F.coalesce((F.col("turn") * F.col("source_size") + F.col("mine.begun") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("finish", finish).orderBy("finish", "doc_id").select("row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = Scratch(spark).write(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    out = queue(sizes)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
    (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest,
    row_number() OVER (ORDER BY source_size::DOUBLE / weight, rank) AS place
  FROM w),
l AS (SELECT min_by(stopped, place) AS stopped, min_by(rest, place) AS rest, min(place) AS place FROM o WHERE 3 * source_size * rest > (total - stopped) * weight),
t AS (
  SELECT o.source, o.source_size,
    CASE WHEN l.place IS NULL OR o.place < l.place THEN (3 * o.source_size)::DOUBLE ELSE (o.total - l.stopped)::DOUBLE * o.weight / l.rest END AS target
  FROM o CROSS JOIN l),
q AS (SELECT *, sum(size) OVER w::BIGINT - size AS begun, row_number() OVER w AS place FROM d WINDOW w AS (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (
  SELECT q.*, t.source_size, t.target, turn, coalesce((turn * t.source_size + begun + size)::DOUBLE / nullif(t.target, 0), 0) AS finish
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source CROSS JOIN range(3) AS r(turn)),
b AS (SELECT *, (sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, place, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS before FROM c)
SELECT doc_id, size, source_size, target, (size * count(*) FILTER (2 * before + size <= 2 * (SELECT sum(size) FROM d)))::BIGINT AS taken
FROM b GROUP BY source, key, place, doc_id, size, source_size, target
"""
