"""Mixing sources to target weights by systematic sampling.

Targets share the size of all documents by weight; a target stops at ``cap`` times its source's size and the excess
goes to the others by weight until none is above. Within a source the documents' expected copies are summed along a
fixed order, one offset is added, and a document is emitted once for every integer the running sum crosses. That is
done first for the few documents whose size class starts above 1/64 of their source, then for the rest with the rate
that still leads to the target; documents go by falling size class, so the words taken stay near the target.

The order within a source is cut into groups by size class and share; running sums are a group's own rank plus the
counts of the groups before it, so a source with a third of all rows is many groups. Only DataFrame operations.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows are sampled one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm._io import materialize, text_column

WORD = "[^\\x20\\x09-\\x0D]+"
SHARES = 16
ROWS_A_SHARE = 200_000
LARGE = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _fraction(text: Column) -> Column:
    """A number in [0, 1) that depends on a string alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _share(doc_id: Column, tie: Column, shares: int) -> Column:
    text = F.concat(F.lit("share:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), tie.cast("string"))))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(shares))


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``: one row for each source throughout.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... Sorted by how soon a rising level meets their caps,
    the capped ones are a prefix; it ends where the level that the rest would share lies below the next cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sources.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    rising = Window.orderBy((cap * F.col("source_size") / F.col("w")), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    run = weighed.select(
        "*",
        F.coalesce(F.sum(cap * F.col("source_size")).over(rising), F.lit(0)).alias("held"),
        F.coalesce(F.sum("w").over(rising), F.lit(0)).alias("gone"),
        F.sum("source_size").over(all_rows).alias("total"),
        F.sum("w").over(all_rows).alias("weights"),
    )
    level = run.withColumn("level", (F.col("total") - F.col("held")) / (F.col("weights") - F.col("gone")))
    level = level.withColumn("capped", cap * F.col("source_size") <= F.col("level") * F.col("w"))
    final = level.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("gone"), F.col("level")))).over(all_rows)["level"])
    return final.select("source", "source_size", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("final") * F.col("w")).alias("target"))


_KEY = ["s", "unknown", "level", "share"]


def copies(sized: DataFrame, cap: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, tie`` with any other columns to the same with ``source_size, target, copies``; ``tie``, a hash of the
    text, orders rows that are alike in the others, so that reruns agree.

    ``cap``: most copies of a document and of its source's size; ``seed``: another gives other offsets.
    """
    s = materialize(sized.select("*", F.length(F.bin("size")).alias("level"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("unknown")), "sized")
    shares = max(SHARES, -(-s.count() // ROWS_A_SHARE))
    s = s.withColumn("share", _share(F.col("doc_id"), F.col("tie"), shares))
    groups = materialize(s.groupBy(*_KEY).agg(F.count("*").alias("n"), F.sum("size").alias("group_size")), "groups")
    sources = groups.groupBy("s", "unknown").agg(F.sum("group_size").alias("source_size"))
    goal = targets(sources.select(F.when(~F.col("unknown"), F.col("s")).alias("source"), "source_size"), cap)
    goal = goal.select(
        F.coalesce("source", F.lit("")).alias("s"),
        F.col("source").isNull().alias("unknown"),
        "source_size",
        "target",
        _fraction(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))).alias("u"),
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0)).alias("rate"),
    )
    # a level holds sizes from 2^(level - 1), so a large one has fewer than LARGE documents of the source
    groups = groups.join(materialize(goal, "goal"), ["s", "unknown"])
    groups = groups.withColumn("large", F.expr(f"shiftleft(1L, level - 1) * {LARGE} > source_size"))
    order = Window.partitionBy("s", "unknown", "large").orderBy(F.desc("level"), F.col("share")).rowsBetween(Window.unboundedPreceding, 0)
    groups = materialize(groups.withColumn("before", F.sum("n").over(order) - F.col("n")), "ordered")

    large = _ranked(s.select("doc_id", "size", "tie", *_KEY).join(groups.where("large"), _KEY))
    spent = large.groupBy("s", "unknown").agg(F.sum(F.col("size") * _crossed("rate", cap)).alias("spent"))
    held = groups.where("large").groupBy("s", "unknown").agg(F.sum("group_size").alias("held"))
    rest = materialize(spent.join(held, ["s", "unknown"]), "spent")
    groups = groups.join(rest, ["s", "unknown"], "left").fillna(0, ["spent", "held"])
    left = F.col("source_size") - F.col("held")
    wanted = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("target") - F.col("spent")) / F.nullif(left, F.lit(0))))
    groups = groups.withColumn("rate", F.when(F.col("large"), F.col("rate")).otherwise(F.coalesce(wanted, F.lit(0.0))))
    done = _ranked(s.join(groups.select(*_KEY, "before", "rate", "u", "source_size", "target"), _KEY))
    copies = F.when(F.col("size") > 0, _crossed("rate", cap)).otherwise(F.lit(0))
    return done.select(*sized.columns, "source_size", "target", copies.alias("copies"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_KEY).orderBy(F.desc("size"), F.col("doc_id"), F.col("tie"))
    return rows.withColumn("rank", F.col("before") + F.row_number().over(order))


def _crossed(rate: str, cap: int) -> Column:
    """Integers between the running sums before and after a document."""
    end = F.floor(F.col("rank") * F.col(rate) + F.col("u"))
    return F.least(end - F.floor((F.col("rank") - 1) * F.col(rate) + F.col("u")), F.lit(cap)).cast("long")


def mix(docs: DataFrame, cap: int = 3, seed: str = "mix") -> DataFrame:
    """Per document of ``docs(doc_id, source, text)``: ``doc_id, size, source_size, target, taken, copies``."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text_column()).alias("size"), F.xxhash64(text_column()).alias("tie"))
    return copies(sized, cap, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = f"""
WITH w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT greatest({SHARES}, CAST(ceil(count(*) / {ROWS_A_SHARE}.0) AS BIGINT)) AS shares FROM w),
d AS (SELECT doc_id, source, size, length(bin(size)) AS level,
        CAST('0x' || substr(md5('share:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT shares FROM c) AS share FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
v AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS held, coalesce(sum(w) OVER o, 0) AS gone, sum(source_size) OVER () AS total, sum(w) OVER () AS weights
      FROM v WINDOW o AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(total - held AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS level FROM r),
f AS (SELECT *, 3 * source_size <= level * w AS capped FROM l),
g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
        ELSE (SELECT level FROM f WHERE NOT capped ORDER BY gone LIMIT 1) * w END AS target,
        CAST('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate FROM g),
k AS (SELECT d.*, source_size, target, u, rate, (1::BIGINT << (level - 1)) * {LARGE} > source_size AS large FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source, large ORDER BY level DESC, share, size DESC, doc_id) AS rank FROM k),
p AS (SELECT source, sum(size * least(CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT), 3)) AS spent, sum(size) AS held FROM n WHERE large GROUP BY source),
q AS (SELECT n.*, CASE WHEN large THEN rate ELSE coalesce(greatest(0.0, least(3.0::DOUBLE, (target - coalesce(spent, 0)) / nullif(source_size - coalesce(held, 0), 0)::DOUBLE)), 0.0) END AS rr
      FROM n LEFT JOIN p ON n.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN size > 0 THEN least(CAST(floor(rank * rr + u) - floor((rank - 1) * rr + u) AS BIGINT), 3) ELSE 0 END AS BIGINT) AS taken FROM q
"""
