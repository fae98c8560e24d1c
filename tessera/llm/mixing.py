"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source gets an integer share ``q`` of a period of ``Q`` slots. Its block ``j`` is released at slot
``floor(j Q / q)`` and due before slot ``ceil((j + 1) Q / q)``; in each slot the released block with the
earliest deadline runs (ties: the source that sorts first). After any number of slots each source has run
within less than one block of its share. The schedule repeats after ``Q`` slots, so one period is computed,
by a fold over the slots of an array with one entry for each source, and all blocks of all sources get their
slots from it by arithmetic and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

BLOCK_DOCS = 16
PERIOD = 1024
#: No more rows of shares and schedule than this are broadcast, 16 MB.
BROADCAST_ROWS = 200_000


def shares(counts: DataFrame, temperature: float = 0.5, period: int = PERIOD) -> DataFrame:
    """(source, q) from (source, n): weights n ** temperature as whole parts of ``period``, one at least."""
    total = F.sum(F.pow("n", F.lit(temperature))).over(W.partitionBy())  # one row for each source
    return counts.select("source", F.greatest(F.lit(1), F.round(F.pow("n", F.lit(temperature)) / total * period)).cast("long").alias("q"))


def schedule(targets: DataFrame) -> DataFrame:
    """One period of (source, k, slot, q, period): block k of the source (k < q) runs in that slot.

    ``targets`` has (source, q), one row for each source. One row holds all sources here; its size is the
    number of sources, not of documents.
    """
    one = targets.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "q"))).alias("s"), F.sum("q").alias("period"))
    next_block = lambda t: F.array_min(
        F.transform(
            "s",
            lambda x, i: F.when(
                (F.element_at(t["done"], i + 1) < x["q"]) & (F.element_at(t["done"], i + 1) * F.col("period") < (t["slot"] + 1) * x["q"]),
                F.struct(F.ceil((F.element_at(t["done"], i + 1) + 1) * F.col("period") / x["q"]).alias("due"), i.alias("i")),
            ),
        )
    )

    def run(state: Column, slot: Column) -> Column:
        return F.transform(
            F.array(F.struct(state["done"].alias("done"), state["ran"].alias("ran"), slot.alias("slot"))),
            lambda t: F.transform(
                F.array(next_block(t)["i"]),
                lambda i: F.struct(
                    F.transform(t["done"], lambda d, k: F.when(k == i, d + 1).otherwise(d)).alias("done"),
                    F.concat(t["ran"], F.array(F.struct(i.alias("i"), F.element_at(t["done"], i + 1).alias("k"), t["slot"].alias("slot")))).alias("ran"),
                ),
            )[0],
        )[0]

    empty = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("ran"))
    ran = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), empty, run, lambda t: t["ran"])
    return one.filter(F.size("s") > 0).select("s", "period", F.explode(ran).alias("r")).select(
        F.element_at("s", F.col("r.i") + 1)["source"].alias("source"), F.element_at("s", F.col("r.i") + 1)["q"].alias("q"), F.col("r.k").alias("k"), F.col("r.slot").alias("slot"), "period"
    )


def mix(docs: DataFrame, targets: DataFrame | None = None, block_docs: int = BLOCK_DOCS, temperature: float = 0.5, period: int = PERIOD) -> DataFrame:
    """Adds block, slot and place (in the block) to (doc_id, source, ...): ordered by slot and place, ``docs`` is the mix.

    ``targets``: (source, q), whole shares of the period; by default from the counts, damped by
    ``temperature``. Every row stays, once: as long as all sources have blocks, each is within less than one
    block of its share of the slots so far; the slots of a source that has run out are passed over. Documents
    of a source are dealt to its blocks in the order of the MD5 digest of doc_id as text. A null source is a source. Repeated
    rows are told apart by a number of their own, so each gets its own place. Sources that have no target share
    one. An empty table gives an empty mix. Columns named block, slot or place are replaced; others, of whatever name and size, pass.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).withColumns({"source": F.col("_doc.source"), "doc_id": F.col("_doc.doc_id")})
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    wanted = shares(counts, temperature, period) if targets is None else counts.join(targets.select(F.col("source").alias("_s"), F.col("q").cast("long")), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("q", F.lit(1)).alias("q"))
    slots, sources = wanted.agg(F.coalesce(F.sum("q"), F.lit(0)), F.count("*")).first()
    small = F.broadcast if slots + sources <= BROADCAST_ROWS else lambda df: df  # so many rows have both tables that are joined
    plan = small(schedule(wanted).select(F.col("source").alias("_s"), F.col("k").alias("_k"), F.col("slot").alias("_slot"), F.col("period").alias("_period")))
    share = small(wanted.select(F.col("source").alias("_s"), F.col("q").alias("_q")))
    rows = common.ranked(whole, "source", ["doc_id"], "_rank")
    placed = rows.withColumn("block", F.expr(f"_rank div {int(block_docs)}")).withColumn("place", (F.col("_rank") % block_docs).cast("int"))
    placed = placed.join(share, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_j", F.col("block") % F.col("_q")).withColumn("_turn", F.expr("block div _q"))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_j") == F.col("_k")))
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("block", "slot", "place")]
    return placed.select(*own, "block", (F.col("_turn") * F.col("_period") + F.col("_slot")).alias("slot"), "place")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, place of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "slot", "place")


SQL = f"""
WITH RECURSIVE wanted AS (
    SELECT source, greatest(1, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * {PERIOD}))::BIGINT AS q FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
), numbered AS (SELECT source, q, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM wanted),
one AS (SELECT list(q ORDER BY i) AS qs, sum(q)::BIGINT AS period FROM numbered),
run AS (
    SELECT -1::BIGINT AS slot, [0::BIGINT FOR q IN qs] AS done, -1::BIGINT AS i, 0::BIGINT AS k FROM one
    UNION ALL
    SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda j: done[j] + (j - 1 = next)::BIGINT), next, done[next + 1]
    FROM (
        SELECT slot, done, list_min(list_transform(range(1, len(qs) + 1), lambda j: CASE WHEN done[j] < qs[j] AND done[j] * period < (slot + 2) * qs[j]
            THEN ((done[j] + 1) * period + qs[j] - 1) // qs[j] * 1000000 + j - 1 END)) % 1000000 AS next
        FROM run, one WHERE slot + 1 < period
    )
), dealt AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS r FROM documents)
SELECT doc_id, d.source, r // {BLOCK_DOCS} AS block, (r // {BLOCK_DOCS} // q * period + slot)::BIGINT AS slot, (r % {BLOCK_DOCS})::INTEGER AS place
FROM dealt d JOIN numbered n ON d.source IS NOT DISTINCT FROM n.source JOIN run ON run.i = n.i AND run.k = r // {BLOCK_DOCS} % q, one
"""
