"""Mixing sources to target weights by capped water-filling.

Every source should get words in proportion to its weight, but at most
``max_epochs`` times the words it has. Sources above that are clamped and
what they can't take is shared again among the others by weight, until none
is above. A source then takes each document as often as its target allows
whole repetitions, and for the fraction that is left the first documents of
a seeded order once more, the last of them in part.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracekit.llm._common import ranked, written

SEED = 17
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ORDER_BITS = 60  # of the seeded order, from an MD5
LEVELS = (50, 40, 30)  # the order's leading bits, ten more at each level


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """Add the double ``target`` to (source, size, weight).

    Each round clamps the sources that their share of the rest would put
    above ``max_epochs`` times their size; two sums of a round come to the
    driver. The rounds end when none is above, at most one per source.
    """
    cap = F.col("size") * F.lit(max_epochs)
    level, clamped = 0.0, F.lit(False)
    seen = -1
    while True:
        filled = sources.agg(F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)).alias("taken"),
                             F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("weight"),
                             F.count(F.when(clamped, 1)).alias("n")).first()
        if filled["n"] == seen or not filled["weight"]:
            break
        seen = filled["n"]
        level = float(total - filled["taken"]) / float(filled["weight"])
        clamped = F.col("weight") * F.lit(level) > cap
    share = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return sources.withColumn("target", F.when(cap > 0, share).otherwise(F.lit(0.0)))


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with each row's ``size`` and its ``place`` in the seeded order."""
    spell = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                     F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    place = F.conv(F.substring(F.md5(F.encode(spell, "UTF-8")), 1, ORDER_BITS // 4), 16, 10).cast("long")
    return docs.select("*", F.col("source").cast("string").alias("__source"), n_words(F.col("text")).alias("__size"), place.alias("__place"))


def _shares(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """What each source takes: ``whole`` times everything, and ``rest`` words
    more: all of places before ``part``, which have ``before`` words, and the
    remainder from the ``words`` at that place."""
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    turn = F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    sizes = ranked(sizes, [F.col("source").asc_nulls_last()]).withColumn("weight", turn).drop("rank")
    filled = water_fill(written(sizes, "mix-weights"), total, max_epochs)

    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    plan = filled.select("source", F.col("size").alias("source_size"), "target", whole.alias("whole"))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    plan = written(plan.select("*", F.when(F.col("whole") >= max_epochs, F.lit(0)).otherwise(rest).cast("long").alias("rest"),
                               F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("before")), "mix-plan")

    for shift in (*LEVELS, 0):
        same = rows["source"].eqNullSafe(plan["source"])
        inside = F.col("rest") > 0
        if shift != LEVELS[0]:
            upper = LEVELS[LEVELS.index(shift) - 1] if shift else LEVELS[-1]
            inside = inside & (F.shiftright("place", upper) == F.col("part"))
        parts = (rows.join(plan, same).where(inside)
                 .groupBy(plan["source"].alias("of"), F.shiftright("place", shift).alias("found"))
                 .agg(F.sum("size").alias("words")))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("found"))
        parts = parts.select("of", "found", "words", (upto - F.col("words")).alias("start"))
        plan = plan.drop("words")
        reached = F.col("before") + F.col("start")
        cut = (plan.join(parts, plan["source"].eqNullSafe(parts["of"]), "left")
               .where(F.col("found").isNull() | (reached < F.col("rest")) & (reached + F.col("words") >= F.col("rest"))))
        plan = written(cut.select("source", "source_size", "target", "whole", "rest",
                                  F.coalesce("found", F.lit(0)).cast("long").alias("part"),
                                  (F.col("before") + F.coalesce("start", F.lit(0))).cast("long").alias("before"),
                                  F.coalesce("words", F.lit(0)).cast("long").alias("words")), "mix-plan")
    return plan.withColumnRenamed("source", "of")


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return written(_measured(docs, seed).select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"),
                                                F.col("__place").alias("place")), "mix-rows")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row.

    Sources in code point order, null last, weigh ``weights`` in turn and
    share as many words as there are. taken is at most ``max_epochs`` times
    size. The seeded order of a source is by a hash of (doc_id, text); rows
    equal in both share the fraction at the cut evenly, each rounded down.
    Null texts count no words, empty tables give none, other columns are not
    used. Reruns agree.

    The cut of a source is found by sums over 1024 parts of its order, then of
    the part that holds the cut, three times, and at last over single hashes:
    no window sees more than 1024 rows a source and what is left of a billion
    of its rows after thirty bits, however many rows a source has. Runs jobs.
    """
    rows = _rows(docs, seed)
    joined = rows.join(_shares(rows, weights, max_epochs), rows["source"].eqNullSafe(F.col("of")))
    at_cut = F.floor(F.col("size") * (F.col("rest") - F.col("before")) / F.col("words"))
    once_more = (F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("place") < F.col("part"), F.col("size"))
                 .when((F.col("place") == F.col("part")) & (F.col("words") > 0), at_cut).otherwise(F.lit(0)))
    return joined.select("doc_id", "size", "source", "source_size", "target",
                         (F.col("whole") * F.col("size") + once_more).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                    seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix
    takes them. Rows at the cut come once more if the mix takes at least half
    of them, so that only whole texts are repeated; texts without words
    follow their place in the order. Texts don't move: a source's share is a
    row that is joined to them."""
    shares = _shares(_rows(docs, seed), weights, max_epochs)
    joined = _measured(docs, seed).join(shares, F.col("__source").eqNullSafe(F.col("of")))
    once_more = (F.col("rest") > 0) & ((F.col("__place") < F.col("part"))
                                       | (F.col("__place") == F.col("part")) & (2 * (F.col("rest") - F.col("before")) >= F.col("words")))
    times = (F.col("whole") + F.when(once_more, F.lit(1)).otherwise(F.lit(0))).cast("int")
    return (joined.select(*[docs[c] for c in docs.columns], times.alias("__times")).where("__times > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by the contract's weights."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS weight
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS k FROM s),
l AS (SELECT a.k, (sum(a2.size) - sum(CASE WHEN a2.k < a.k THEN 3 * a2.size ELSE 0 END))::DOUBLE
                  / sum(CASE WHEN a2.k >= a.k THEN a2.weight ELSE 0 END)::DOUBLE AS level
      FROM o a, o a2 GROUP BY a.k),
f AS (SELECT min(k) AS k FROM o JOIN l USING (k) WHERE o.weight * level <= 3 * size),
t AS (SELECT source, size AS source_size,
             CASE WHEN size = 0 THEN 0.0 ELSE least(weight * (SELECT level FROM l JOIN f USING (k)), (3 * size)::DOUBLE) END AS target
      FROM s),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE round(target - whole * source_size)::BIGINT END AS rest FROM q),
c AS (SELECT d.source, place, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
w AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) - words AS start FROM c)
SELECT d.doc_id, d.size::BIGINT AS size, d.source, r.source_size, r.target,
       (whole * d.size + CASE WHEN rest <= start THEN 0 WHEN start + words <= rest THEN d.size
                              ELSE floor(d.size * (rest - start)::DOUBLE / words) END)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
       JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.place = w.place
"""
