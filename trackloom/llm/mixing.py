"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots. Slot n falls on the point frac((n + 1) / golden ratio), and the point is looked up in the
cumulative weights of the sources; so any stretch of the mix holds the sources in nearly their final shares. The slots of
a source are ranked, and slot r takes the r-th of the equal-token blocks into which the source's shuffled documents are
cut: each document that begins in that block is read there, whole. A source that is to give more than it has is read
again from its start, up to `MOST_PASSES` times; its further reads lie in later blocks and so in later slots.

The schedule says where every read stands: `mix` returns the reads in order of their slots, and `taken_tokens` tells each
document's first and last slot. How much a source gives follows from its weight alone, so that its target is met to the word.

Shuffling is an order by md5 of seed and doc_id. Running sums over one source, which may hold a third of all rows, go by
4,096 hash ranges a source first and inside each range then; the same is done to rank slots. The number of slots is a
parameter, at least 64 a source; a source that no point falls on gets one slot at the end.

Defined results
* null source: a source of its own, last in order. Null, empty or blank text: size 0, nothing taken, no slot.
* repeated rows: each is a document of its own; equal rows are interchangeable. Equal ids go by size, then by text.
* a corpus without words: all targets 0. Empty table: an empty result. Further columns do not matter to the shares.
* very long texts: a document longer than a block stands in the slot where it begins; the blocks that it covers hold no
  beginning of another one, so that shares hold over stretches longer than the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table, words_of

MOST_PASSES = 3
WEIGHT_CYCLE = 3
SLOTS = 1 << 16
SLOTS_PER_SOURCE = 64
#: A schedule of up to so many slots (three numbers and a source each) is broadcast; a longer one is joined by shuffle.
BROADCAST_SLOTS = 1 << 17
GOLDEN = 0.6180339887498949
_BINS = 4096
_CHUNK = 1024
SEED = "mix"


def source_key(source) -> F.Column:
    """Orders as the code points of the sources, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _numbered(docs: DataFrame, seed: str, text_col: str, source_col: str, carry: list) -> DataFrame:
    """Each row with its place in its source's shuffled order: a hash range and, in it, number and first token."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        *carry,
        source_key(F.col(f"`{source_col}`")).alias("skey"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        F.xxhash64(text).alias("text_key"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    order = Window.partitionBy("skey", "bucket").orderBy("key", "size", "text_key")
    return rows.withColumns({
        "rn": F.row_number().over(order),
        "start": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
    })


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source: its size, weight and target (weights share all tokens; nobody above MOST_PASSES times its size).

    `sizes` holds skey and size. Sources are put in order of cap over weight; those whose cap is reached form its beginning.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    per = per.withColumns({
        "weight": (F.row_number().over(everything.orderBy("skey")) - 1) % WEIGHT_CYCLE + 1,
        "cap": F.col("source_size") * MOST_PASSES,
        "total": F.sum("source_size").over(everything),
    })
    before = everything.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), zero)
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    per = per.withColumn("full", F.col("cap") / F.col("weight") <= left / weight_left)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    rest_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest / rest_weight * F.col("weight"))
    return per.select("skey", "source_size", "weight", target.alias("target"), F.floor(target + 0.5).cast("long").alias("tokens"))


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, skey, rank, block): the mix as a row of slots; rank counts a source's slots from 0, block is the tokens of each of its blocks."""
    everything = Window.partitionBy()
    shares = sources.filter("tokens > 0").withColumns({
        "hi": F.sum("target").over(everything.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("target").over(everything),
        "n_slots": F.greatest(F.lit(slots).cast("long"), F.count(F.lit(1)).over(everything) * SLOTS_PER_SOURCE),
    })
    shares = shares.withColumn("lo", F.lag("hi", 1, 0.0).over(everything.orderBy("skey")))
    last = F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1))
    binned = shares.select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * _BINS), last)).alias("bin"))
    n = shares.agg(F.max("n_slots").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))).alias("chunk"), "n")
    points = n.select("chunk", F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * _CHUNK) - 1)).alias("slot"))
    turn = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = points.withColumn("u", turn - F.floor(turn)).withColumn("bin", F.floor(F.col("u") * _BINS))
    hit = points.join(binned, "bin").filter("u >= lo and u < hi").select("slot", "chunk", "skey")
    starved = shares.join(hit.select("skey").distinct(), "skey", "left_anti")
    at_end = F.col("n_slots") + F.row_number().over(everything.orderBy("skey")) - 1
    hit = hit.unionByName(starved.select(at_end.alias("slot"), F.floor(at_end / _CHUNK).alias("chunk"), "skey"))
    counts = hit.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("c"))
    by_source = Window.partitionBy("skey")
    counts = counts.withColumns({
        "before": F.coalesce(F.sum("c").over(by_source.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        "own_slots": F.sum("c").over(by_source),
    })
    blocks = counts.join(sources.select("skey", "tokens"), "skey").withColumn("block", F.ceil(F.col("tokens") / F.col("own_slots")))
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1).join(blocks, ["skey", "chunk"])
    return ranked.select("slot", "skey", (F.col("before") + F.col("r")).alias("rank"), "block")


def _reads(docs: DataFrame, seed: str, slots: int, text_col: str, source_col: str, carry: list) -> tuple[DataFrame, int]:
    """(documents with their size, source_size, target and reads: an array of (tokens taken, slot), number of slots)."""
    rows = _numbered(docs, seed, text_col, source_col, carry)
    # small tables (a row a source and hash range, a source, a slot), each written once, so that plans stay short
    by_bucket = cut_lineage(_numbered(docs, seed, text_col, source_col, []).groupBy("skey", "bucket").agg(F.sum("size").alias("size")))
    sources = cut_lineage(source_targets(by_bucket))
    plan = cut_lineage(schedule(sources, slots))
    n_slots, last = plan.agg(F.count(F.lit(1)), F.max("slot")).first()
    in_source = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("size").over(in_source), F.lit(0).cast("long"))).drop("size")
    blocks = plan.groupBy("skey").agg(F.max("block").alias("block"))
    placed = rows.join(offsets.join(sources, "skey").join(blocks, "skey", "left"), ["skey", "bucket"]).withColumn("start", F.col("start") + F.col("offset"))
    reads = []
    for p in range(MOST_PASSES):
        lo = F.least(F.col("start") + p * F.col("source_size"), F.col("tokens"))
        hi = F.least(F.col("start") + F.col("size") + p * F.col("source_size"), F.col("tokens"))
        at = plan.select("skey", F.col("rank").alias(f"rank{p}"), F.col("slot").alias(f"slot{p}"))
        if n_slots <= BROADCAST_SLOTS:
            at = F.broadcast(at)
        placed = placed.withColumns({f"take{p}": hi - lo, f"rank{p}": F.when(hi > lo, F.floor(lo / F.col("block")))}).join(at, ["skey", f"rank{p}"], "left")
        reads.append(F.when(F.col(f"slot{p}").isNotNull(), F.struct(F.col(f"take{p}").alias("taken"), F.col(f"slot{p}").alias("slot"))))
    return placed.withColumn("reads", F.array_compact(F.array(*reads))), (0 if last is None else last + 1)


def taken_tokens(docs: DataFrame, seed: str = SEED, slots: int = SLOTS, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: skey, bucket, rn (its place), doc_id, size, source_size, target, the tokens that the mix takes from it, and the
    number of its reads with the first and last of their slots (null for none)."""
    placed, _ = _reads(docs, seed, slots, text_col, source_col, [F.col("doc_id")])
    slot = F.transform("reads", lambda r: r["slot"])
    taken = F.aggregate("reads", F.lit(0).cast("long"), lambda total, r: total + r["taken"])
    return placed.select(
        "skey", "bucket", "rn", "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.size("reads").cast("long").alias("n_reads"), F.array_min(slot).alias("first_slot"), F.array_max(slot).alias("last_slot"),
    )


def mix(docs: DataFrame, seed: str = SEED, slots: int = SLOTS, with_slot: bool = False) -> DataFrame:
    """The mixed corpus with the columns of `docs` (doc_id, text, source among them): a row for each time a document is read, in order
    of the slots: partitions hold consecutive stretches of slots, each in order. `with_slot` adds the column mix_slot.

    A document that a source's share ends in is cut to the words taken, which one space then parts; n_chars follows the text where there is one.
    """
    placed, end = _reads(docs, seed, slots, "text", "source", [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")])
    reads = placed.select("doc", "size", "skey", "bucket", "rn", F.explode("reads").alias("read"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reads = reads.repartitionById(parts, F.floor(F.col("read.slot") * parts / max(1, end)).cast("int")).sortWithinPartitions("read.slot", "skey", "bucket", "rn")
    cut = F.col("read.taken") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words_of(F.col("doc.text")), F.lit(1), F.col("read.taken").cast("int")), " ")).otherwise(F.col("doc.text"))
    own = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    more = [F.col("read.slot").alias("mix_slot")] if with_slot else []
    return reads.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns], *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return taken_tokens(docs).select("doc_id", "size", "source_size", "target", "taken", "n_reads", "first_slot", "last_slot")


SQL = rf"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as skey, hash(text) as th,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as size,
    md5('{SEED}|' || coalesce(doc_id::varchar, '')) as key
  from documents),
per as (select skey, sum(size)::bigint as source_size, {MOST_PASSES} * sum(size)::bigint as cap, (row_number() over (order by skey) - 1) % {WEIGHT_CYCLE} + 1 as weight from d group by skey),
f as (
  select *, cap / weight <= ((select sum(source_size) from per) - coalesce(sum(cap) over b, 0)) / ((select sum(weight) from per) - coalesce(sum(weight) over b, 0)) as is_full
  from per window b as (order by cap / weight, skey rows between unbounded preceding and 1 preceding)),
s as (
  select skey, source_size, case when is_full then cap::double else
    ((select sum(source_size) from f) - (select sum(case when is_full then cap else 0 end) from f))::double / (select sum(case when is_full then 0 else weight end) from f)::double * weight end as target
  from f),
c as (
  select *, floor(target + 0.5)::bigint as tokens,
    sum(target) over (order by skey rows between unbounded preceding and current row) / sum(target) over () as hi, greatest({SLOTS}, {SLOTS_PER_SOURCE} * count(*) over ()) as n_slots
  from s where floor(target + 0.5) > 0),
shares as (select *, lag(hi, 1, 0e0) over (order by skey) as lo from c),
points as (select n as slot, (n + 1) * {GOLDEN}e0 - floor((n + 1) * {GOLDEN}e0) as u from (select unnest(range((select coalesce(max(n_slots), 0) from c))) as n)),
hit as (select slot, skey from points join shares on u >= lo and u < hi),
plan0 as (select slot, skey from hit union all select n_slots + row_number() over (order by skey) - 1, skey from shares where skey not in (select skey from hit)),
plan as (
  select slot, p.skey, row_number() over (partition by p.skey order by slot) - 1 as rank, (tokens + count(*) over (partition by p.skey) - 1) // count(*) over (partition by p.skey) as block
  from plan0 p join c on c.skey = p.skey),
blocks as (select skey, max(block) as block from plan group by skey),
placed as (
  select row_number() over () as rid, d.doc_id, d.size, s.skey, s.source_size, s.target, floor(s.target + 0.5)::bigint as a,
    (sum(d.size) over (partition by d.skey order by key, size, th rows between unbounded preceding and current row) - d.size)::bigint as c
  from d join s on d.skey = s.skey),
reads as (select rid, skey, least(c + p * source_size, a) as lo, least(c + size + p * source_size, a) as hi from placed, range({MOST_PASSES}) as g(p)),
slotted as (
  select rid, sum(hi - lo)::bigint as taken, count(*) as n_reads, min(slot)::bigint as first_slot, max(slot)::bigint as last_slot
  from reads r join blocks b on b.skey = r.skey join plan on plan.skey = r.skey and plan.rank = r.lo // b.block where hi > lo group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(n_reads, 0)::bigint as n_reads, first_slot, last_slot
from placed left join slotted using (rid)
"""
