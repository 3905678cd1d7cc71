"""Mixing sources to target weights by capped water-filling.

Sources share ``BUDGET`` times all words in proportion to their weights, but
none gets more than ``MAX_EPOCHS`` times its own words: such sources are
clamped and what they cannot take is shared again among the others by weight,
until none is above its cap. A source's target is then met by whole
repetitions of all its documents plus one fractional repetition: its documents
in a seeded random order, up to the one whose middle passes the rest. The
running sums behind that order are global prefix sums, so a source that holds
a third of all rows is spread like any other. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import fresh, written
from candlewick.llm.prefix import running

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_order(doc_id: Column, seed: str = SEED) -> Column:
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
                             .cast("binary")), 1, 16)


def water_level(sources: DataFrame) -> float:
    """Words per unit of weight at which no unclamped source is above its cap.

    ``sources`` has ``source_size`` and ``weight``. Each round clamps the
    sources whose cap per weight lies below the level and recomputes it from
    the rest; two sums come to the driver a round, and the level only rises.
    """
    cap = MAX_EPOCHS * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        free = cap / F.col("weight") >= F.lit(level)
        clamped, weight = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            return level
        raised = (BUDGET * total - (clamped or 0)) / weight
        if raised <= level:
            return level
        level = raised


def source_plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, rest), one row a source.

    ``whole`` repetitions of every document and ``rest`` words of a fractional
    one make up ``target``. A source without words has target zero.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked, _ = written(running(sums, [F.col("source").asc_nulls_last()], {"rank": "one"})
                        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                                                           (F.col("rank") % len(WEIGHTS) + 1).cast("int"))),
                        "sources")
    level = water_level(ranked)
    target = F.least(F.lit(float(MAX_EPOCHS)) * F.col("source_size"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return written(ranked.select("source", "source_size", target.alias("target"))
                   .withColumn("whole", whole.cast("long"))
                   .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")[0]


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"), seeded_order(F.col(doc_id)).alias("draw"))


def _repeats(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with its source's plan and ``extra`` (0 or 1): whether the fractional
    repetition takes the row."""
    order = [F.col("source").asc_nulls_last(), F.col("draw"), F.col("doc_id"), F.col("size")]
    placed, _ = written(running(sized, order, {"before": "size"}), "mix-order")
    first = placed.groupBy("source").agg(F.min("before").alias("first"))
    plan = plan.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan, _ = written(plan, "mix-first")           # one row a source: Spark broadcasts it while it is small
    middle = F.col("before") - F.col("first") + F.col("size") / 2
    return (placed.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("extra", (middle < F.col("rest")).cast("long")))


def mix_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    ``taken`` is the words the mix takes of the row, repeats counted: its
    size times 0, 1 or 2. A source's taken words differ from its target by at
    most half of its longest document. Rows without words take nothing; a
    null source is a source of its own, ranked last; rows of one source that
    are equal may stand for each other; other columns are not read; an empty
    table gives an empty result. Every run takes the same words.
    """
    sized, _ = written(_sized(docs, doc_id, text, source), "mix-sizes")
    return _repeats(sized, source_plan(sized)).select(
        "doc_id", "size", "source_size", "target",
        ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0, 1 or 2 times).

    Only ids and sizes are ordered; texts meet a table of one row a source
    with the last document of its fractional repetition. Rows that equal that
    document in id and size are taken by a seeded coin with the right odds.
    Columns keep their names, order and types.
    """
    sized, _ = written(_sized(docs, doc_id, text, source), "mix-sizes")
    plan = source_plan(sized)
    repeats = _repeats(sized, plan)
    key = F.struct("draw", F.col("doc_id").isNotNull().alias("known"), "doc_id", "size")
    last = (repeats.where("extra = 1").groupBy(F.col("source").alias("s"))
            .agg(F.max(key).alias("last")))
    at_last = (repeats.withColumn("key", key).join(last, F.col("source").eqNullSafe(F.col("s")))
               .where(F.col("key") == F.col("last")).groupBy("s", "last")
               .agg((F.sum("extra") / F.count("*")).alias("odds")))
    names = {n: fresh(docs, f"mix_{n}") for n in ("source", "whole", "last", "odds", "key", "size")}
    ends, _ = written(plan.join(at_last, F.col("source").eqNullSafe(F.col("s")), "left")
                      .select(*[F.col(c).alias(names[c]) for c in ("source", "whole", "last", "odds")]), "mix-ends")
    row_key = F.struct(seeded_order(F.col(doc_id)).alias("draw"), F.col(doc_id).isNotNull().alias("known"),
                       F.col(doc_id).alias("doc_id"), F.col(names["size"]).alias("size"))
    extra = F.when(F.col(names["key"]) < F.col(names["last"]), 1) \
        .when((F.col(names["key"]) == F.col(names["last"])) & (F.rand(17) < F.col(names["odds"])), 1).otherwise(0)
    return (docs.withColumn(names["size"], word_count(F.col(text)))
            .withColumn(names["key"], row_key)
            .join(ends, F.col(f"`{source}`").eqNullSafe(F.col(names["source"])))
            .withColumn(names["whole"], F.when(F.col(names["size"]) > 0, F.col(names["whole"]) + extra).otherwise(0))
            .withColumn(names["odds"], F.explode(F.array_repeat(F.lit(1), F.col(names["whole"]).cast("int"))))
            .select(*[f"`{c}`" for c in docs.columns]))


ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS draw FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]
    AS weight FROM sums),
ladder AS (SELECT source, {MAX_EPOCHS} * source_size / weight AS ratio, ({BUDGET} * sum(source_size) OVER ()
    - coalesce(sum({MAX_EPOCHS} * source_size) OVER below, 0)) / sum(weight) OVER above AS level
  FROM weighed WINDOW below AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    above AS (ORDER BY {MAX_EPOCHS} * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
plan AS (SELECT source, source_size, least({MAX_EPOCHS}::DOUBLE * source_size,
    (SELECT level FROM ladder WHERE level <= ratio ORDER BY ratio, source LIMIT 1) * weight) AS target FROM weighed),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan),
laid AS (SELECT s.*, source_size, target, whole, target - whole * source_size AS rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((whole + CASE WHEN before + size / 2 < rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM laid
"""
