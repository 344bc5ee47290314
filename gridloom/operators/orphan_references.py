"""References to records that do not exist: missing, not there yet, or deleted.

A reference (group, key, time) is sound if a parent row of the same group and key holds at that time:
``valid_from <= time < valid_to`` (null ``valid_to``: no end). For the others the reason is ``missing``
(no parent row of that key at all), ``late`` (all its parent rows begin after the reference) or
``deleted``.

Plan: a Bloom filter of the parents' keys is built in the JVM. It is sharded: a hash of the key names one of
its blocks of 4 KB, of which there are as many as the parents need at ten bits a key, so that the filter
stays as sharp however many there are. The blocks are joined to the references by that hash and tested in
generated code: they are broadcast where their size, known beforehand, is ``max_broadcast`` bytes at most,
else the join shuffles. What the filter rejects is missing for certain and is never shuffled further. The
rest is verified by exact joins on the key: an anti join against the parents' validity merged into disjoint
periods (at most one of which can hold a time, so a hot key multiplies nothing), then, for what is left, a
join with the first begin of each key. The parents are shuffled once by key for both; a hot key among the
references is split by adaptive skew handling.

Defined results: a null key refers to nothing (no row); a null group matches no parent (``missing``);
a reference of null time is never sound: ``missing`` or ``deleted``; a parent of null begin never
holds, but counts as a row of its key that is not late; repeated parents and overlapping periods count
once; repeated references come out as often as they are given; without parents all are missing; without
references the result is empty; any further columns are carried along, but names beginning with ``_o_``
are reserved (``ValueError``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASHES, BITS_A_KEY, BLOCK_BITS = 5, 10, 1 << 15


def filter_blocks(keys: int) -> int:
    """Blocks of a filter for so many keys; each takes 4 KB."""
    return max(1, -(-BITS_A_KEY * keys // BLOCK_BITS))


def _block(key: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")


def _bit(hashed: Column, i: int) -> Column:
    """The place of the i-th bit within a block, by double hashing."""
    step = F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
    return F.pmod(F.pmod(hashed, F.lit(BLOCK_BITS)) + F.lit(i) * F.pmod(step, F.lit(BLOCK_BITS)), F.lit(BLOCK_BITS)).cast("int")


def _second(key: list[Column]) -> Column:
    return F.xxhash64(F.lit(7919), *key)


def bloom_blocks(parents: DataFrame, key: list[str], blocks: int) -> DataFrame:
    """(_o_block, _o_words): the blocks of the filter as arrays of 64-bit words, blocks without key too. Two numbers a
    parent are shuffled, once."""
    cols = [F.col(k) for k in key]
    hashed = parents.select(_block(cols, blocks).alias("_o_block"), _second(cols).alias("_o_hash"))
    every = parents.sparkSession.range(blocks).select(F.col("id").cast("int").alias("_o_block"), F.lit(None).cast("bigint").alias("_o_hash"))
    rows = hashed.unionByName(every).repartition("_o_block")
    # (word, bit set in it); a row without hash gives all words of its block, without bits
    all_words = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: -1 - w)
    bits = F.when(F.col("_o_hash").isNull(), all_words).otherwise(F.array(*(_bit(F.col("_o_hash"), i) for i in range(HASHES))))
    at = rows.select("_o_block", F.explode(bits).alias("p"))
    word = F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.shiftright("p", 6))
    bit = F.when(F.col("p") < 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int")))
    words = at.groupBy("_o_block", word.alias("w")).agg(F.bit_or(bit).alias("b"))
    held = words.groupBy("_o_block").agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("m"))  # BLOCK_BITS / 64 entries
    return held.select("_o_block", F.transform("m", lambda x: x["b"]).alias("_o_words"))


def may_contain(words: Column, key: list[Column]) -> Column:
    """Whether a block holds the key; False is certain."""
    held, hashed = F.lit(True), _second(key)
    for i in range(HASHES):
        bit = _bit(hashed, i)
        held = held & (F.call_function("shiftright", F.get(words, F.shiftright(bit, 6)), F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return held


def merged_periods(parents: DataFrame, key: list[str], begin: str, end: str) -> DataFrame:
    """Disjoint periods of validity of each key, from rows that may overlap and repeat. No row is left out before the
    last step, so that an exchange of the parents can serve others too."""
    forever = F.lit("9999-12-31 23:59:59.999999").cast(parents.schema[begin].dataType)
    holds = F.coalesce(F.col(end), forever) > F.col(begin)
    rows = parents.select(*key, F.when(holds, F.col(begin)).alias("_o_from"), F.when(holds, F.coalesce(F.col(end), forever)).alias("_o_to"))
    by = W.partitionBy(*key).orderBy("_o_from", "_o_to")
    before = F.max("_o_to").over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_o_new", F.when(before >= F.col("_o_from"), 0).otherwise(1))
    rows = rows.withColumn("_o_run", F.sum("_o_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key, "_o_run").agg(F.min("_o_from").alias("_o_from"), F.max("_o_to").alias("_o_to")).drop("_o_run").where("_o_from is not null")


def orphan_references(refs: DataFrame, parents: DataFrame, key: list[str], time: str, begin: str, end: str, max_broadcast: int = 64 << 20) -> DataFrame:
    """The rows of ``refs`` that refer to nothing, with the column ``reason``.

    ``key`` names the columns of group and key in both tables; the last of them is the key proper."""
    if any(c.startswith("_o_") or c == "reason" for c in [*refs.columns, *parents.columns]):
        raise ValueError("columns named reason or beginning with _o_ clash with those made here")
    if len(set(refs.columns)) < len(refs.columns):
        raise ValueError("the references have two columns of one name")
    refs = refs.where(F.col(key[-1]).isNotNull())
    parents = parents.select(*key, begin, end).dropna(subset=key)
    keys = parents.agg(F.approx_count_distinct(F.xxhash64(*key)).alias("n")).first()["n"]  # one number
    blocks, cols = filter_blocks(keys), [F.col(k) for k in key]
    bloom = bloom_blocks(parents, key, blocks)
    bloom = F.broadcast(bloom) if blocks * BLOCK_BITS // 8 <= max_broadcast else bloom
    hashed = refs.withColumn("_o_at", _block(cols, blocks))
    tested = hashed.join(bloom, F.col("_o_at") == F.col("_o_block")).withColumn("_o_known", may_contain(F.col("_o_words"), cols)).drop("_o_at", "_o_block", "_o_words")
    for k in key[:-1]:  # the hash skips nulls
        tested = tested.withColumn("_o_known", F.col("_o_known") & F.col(k).isNotNull())
    definite = tested.where(~F.col("_o_known")).drop("_o_known").withColumn("reason", F.lit("missing"))
    by_key = parents.repartition(*key)  # one exchange for periods and first begins
    periods, right = merged_periods(by_key, key, begin, end), [F.col(f"p.{k}") for k in key]
    verify = tested.where("_o_known").drop("_o_known").alias("r")
    same = F.lit(True)
    for k, p in zip(key, right, strict=True):
        same = same & (F.col(f"r.{k}") == p)
    # an outer join and a test for null: an anti join would be moved below the filter
    during = same & (F.col("_o_from") <= F.col(f"r.{time}")) & (F.col(f"r.{time}") < F.col("_o_to"))
    open_ = verify.join(periods.alias("p"), during, "left").where("_o_to is null").select("r.*")
    # the first begin of each key; its end only keeps the exchange the same. A null begin counts as a row that is not late
    start = F.min(F.when(F.col(begin).isNotNull(), F.struct(F.col(begin).alias("at"), F.col(end).alias("to"))))
    first = by_key.groupBy(*key).agg(start.alias("_o_start"), F.max(F.col(begin).isNull()).alias("_o_null"))
    held = open_.alias("r").join(first.alias("p"), same, "left").select("r.*", "_o_start", "_o_null")
    reason = F.when(F.col("_o_null").isNull(), "missing").when(~F.col("_o_null") & (F.col("_o_start.at") > F.col(time)), "late").otherwise("deleted")
    return definite.unionByName(held.withColumn("reason", reason).drop("_o_start", "_o_null"))
