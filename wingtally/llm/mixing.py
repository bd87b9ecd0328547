"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions alone.

Each source's documents, in the order of a hash, form one stream of words that
is cut into blocks of equal size. Slot i of the mix belongs to the point
frac((i + 1) / golden ratio), mapped through the cumulative shares of the
sources; the r-th slot of a source takes the r-th block of its stream, and
starts again after the last. So the sources alternate evenly in any stretch of
the mix, and each reaches its target.

Nothing ranks a whole source in one task: positions in a stream are sums inside
4,096 shards of a hash plus the shards' offsets, and slots are ranked inside
runs of slots plus the runs' offsets. Tables of one row a source are the only
ones that a window takes whole.

Defined cases: a null or empty text has size 0 and is never taken; the null
source is a source of its own, last in order; a null doc_id is mixed like any
other. Repeated rows are mixed each. Sources of size 0 get target 0. An empty
table gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
_BINS, _RUN = 1024, 1 << 16


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source: sid (rank by code point, null last), source_size, weight and target.

    Targets share all sizes by weight; one above `most` times its source's size
    stops there, and the rest is shared again. With sources in order of
    size / weight, those that stop come first, so one pass finds the level.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(one).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "sid").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(after))
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole)
    return s.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(level * F.col("weight"), most * F.col("source_size")))).drop("ratio", "level")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """The mix: slot, sid, rank (among the source's slots), pass_no, block and take (words of the block's start)."""
    spark = sources.sparkSession
    s = sources.where("floor(target) > 0").select("sid", "source_size", F.floor("target").alias("goal"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.floor(F.col("goal") / F.col("source_size")))
    s = s.withColumn("need", (F.col("passes") * F.col("blocks") + F.ceil((F.col("goal") - F.col("passes") * F.col("source_size")) / block)).cast("long"))
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("high", F.sum("need").over(w)).withColumn("low", F.col("high") - F.col("need")).withColumn("all", F.sum("need").over(Window.partitionBy()))
    n, k = s.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    slots = spark.range(n + n // 20 + 16 * k).withColumnRenamed("id", "slot")  # some over, for each source to fill up
    slots = slots.withColumn("x", (F.col("slot") + 1) * GOLDEN).withColumn("x", F.col("x") - F.floor("x")).withColumn("bin", F.floor(F.col("x") * _BINS))
    binned = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * _BINS / F.col("all")), F.least(F.floor(F.col("high") * _BINS / F.col("all")), F.lit(_BINS - 1).cast("long")))))
    at = F.col("x") * F.col("all")
    out = slots.join(binned, "bin").where((at >= F.col("low")) & (at < F.col("high"))).withColumn("run", F.floor(F.col("slot") / _RUN))
    runs = out.groupBy("sid", "run").agg(F.count("*").alias("n"))
    base = runs.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = out.withColumn("r", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot"))).join(base, ["sid", "run"])
    names = ["slot", "sid", "rank", "need", "blocks", "source_size", "goal"]
    placed = out.withColumn("rank", F.col("base") + F.col("r") - 1).where(F.col("rank") < F.col("need")).select(names)
    # a source that has fewer slots than it needs takes the rest after the last one
    have = runs.groupBy(F.col("sid").alias("_sid")).agg(F.sum(F.col("n")).alias("have"))
    short = s.join(have, s["sid"] == have["_sid"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < need")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("need") - 1))).withColumn("slot", F.col("rank") + (n + n // 20 + 16 * k)).select(names)
    out = placed.unionByName(short)
    out = out.withColumn("pass_no", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    start = F.col("block") * block
    length = F.least(F.lit(block), F.col("source_size") - start)
    take = F.greatest(F.lit(0), F.least(length, F.col("goal") - F.col("pass_no") * F.col("source_size") - start))
    return out.select("slot", "sid", "rank", "pass_no", "block", take.alias("take"), length.alias("length"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per row of docs: key, source, size, source_size, target, taken.

    A block has the cube root of all words: their number and their size then
    both grow slower than the input.
    """
    sizes = shared.written(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size")), "sizes")
    sources = shared.written(shares(sizes, weights, most), "sources")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    block = 1
    while block**3 < total:
        block += 1
    tag = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("tag", tag).withColumn("shard", F.substring("tag", 1, 3))
    full = d.where("size > 0")
    offsets = full.groupBy("sid", "shard").agg(F.sum("size").alias("n"))
    offsets = offsets.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = Window.partitionBy("sid", "shard").orderBy("tag", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = full.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(offsets, ["sid", "shard"]).withColumn("at", F.col("at") + F.col("base"))
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    used = schedule(sources, block).groupBy("sid", "block").agg(F.sum(F.when(F.col("take") == F.col("length"), 1).otherwise(0)).alias("whole"), F.max(F.when(F.col("take") < F.col("length"), F.col("take")).otherwise(0)).alias("part"))
    got = F.coalesce(F.col("whole") * (hi - lo) + F.greatest(F.least(hi, F.col("part")) - lo, F.lit(0)), F.lit(0))
    taken = parts.join(used, ["sid", "block"], "left").groupBy("doc_id", "source", "size", "source_size", "target", "sid", "at").agg(F.sum(got).cast("long").alias("taken"))
    names = [F.col("doc_id").alias(key), "source", "size", "source_size", "target", "taken"]
    return taken.select(names).unionByName(d.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(names))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows from whole windows: each source goes round its stream until it has its target.
ORACLE = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as tag from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as sid from d group by source),
s1 as (select *, case sid % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s0),
s2 as (select *, 3.0::double * source_size / weight as ratio from s1),
s3 as (select *, ((sum(source_size) over ())::double - 3.0::double * coalesce(sum(source_size) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0)::double)
  / sum(weight) over (order by ratio, sid rows between current row and unbounded following) as level from s2),
s4 as (select *, least(3.0::double * source_size, coalesce((max(case when ratio >= level then level end) over ()) * weight, 3.0::double * source_size)) as target from s3),
s5 as (select s4.*, floor(target)::bigint as goal from s4 where floor(target) > 0),
s9 as (select *, goal as reach from s5),
p as (select d.*, sum(size) over (partition by source order by tag, doc_id, size rows unbounded preceding) - size as pos from d)
select p.doc_id, p.size, s4.source_size, s4.target,
  coalesce((reach // s4.source_size) * p.size + greatest(0, least(pos + p.size, reach % s4.source_size) - pos), 0)::bigint as taken
from p join s4 on p.source is not distinct from s4.source left join s9 on s9.sid = s4.sid
"""
