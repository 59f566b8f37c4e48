"""Temporal facts, retrieval metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.documents import numbered, running
from corvane.operators.intervals import bound_micros

OPEN = -(2**62)


def bounds(facts: DataFrame) -> DataFrame:
    """Facts with their bounds in microseconds (f, u); null where open or unreadable."""
    lo, hi = bound_micros(F.col("valid_from"), OPEN), bound_micros(F.col("valid_to"), OPEN)
    return facts.withColumn("f", F.nullif(lo, F.lit(OPEN))).withColumn("u", F.nullif(hi, F.lit(OPEN)))


def as_of(facts: DataFrame, at: int) -> DataFrame:
    """Facts valid at a time; a missing bound is open."""
    return bounds(facts).filter((F.col("f").isNull() | (F.col("f") <= at)) & (F.col("u").isNull() | (F.col("u") > at)))


def timeline(facts: DataFrame, subject: str) -> DataFrame:
    """One subject's facts in order of validity, those without start first."""
    own = bounds(facts.filter(F.col("subject") == subject))
    return numbered(own, [F.col("f").asc_nulls_first(), F.col("created_at"), F.col("id")])


def superseded(facts: DataFrame) -> DataFrame:
    """(id, closed_us, superseded_by): where the next fact of a subject and predicate closes one.

    A hot subject is spread by day: inside a day the next row closes a fact, and a day's last fact is closed by
    the first of the next day that has any, which a summary of one row a day supplies.
    """
    k = bounds(facts).filter("f is not null and subject is not null").select("id", "subject", "predicate", "f")
    k = k.withColumn("day", F.floor(F.col("f") / F.lit(86_400_000_000)))
    nxt = F.struct("f", "id")
    days = k.groupBy("subject", "predicate", "day").agg(F.min(nxt).alias("first"))
    after = days.select("subject", "predicate", "day", F.lead("first").over(W.partitionBy("subject", "predicate").orderBy("day")).alias("after"))
    w = W.partitionBy("subject", "predicate", "day").orderBy("f", "id")
    inner = k.withColumn("n", F.lead(nxt).over(w)).join(after, ["subject", "predicate", "day"])
    got = inner.select("id", F.coalesce("n", "after").alias("n")).filter("n is not null")
    return got.select("id", F.col("n.f").alias("closed_us"), F.col("n.id").alias("superseded_by"))


def predicate_key(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def retrieval_metrics(run: DataFrame, k: int, digits: int | None = 6) -> DataFrame:
    """(q, recall_at_k, rr, ndcg_at_k) of ranked lists (q, doc_id, rank, gain); the gain of a grade g is 2^g - 1."""
    gain = F.pow(F.lit(2.0), F.col("gain")) - 1
    ideal = run.filter("gain > 0").withColumn("i", F.row_number().over(W.partitionBy("q").orderBy(F.desc("gain")))).filter(F.col("i") <= k).groupBy("q").agg(
        F.sum(gain / F.log2(F.col("i") + 1)).alias("idcg"))
    m = run.groupBy("q").agg(
        (F.count_if((F.col("rank") <= k) & (F.col("gain") > 0)) / F.nullif(F.count_if(F.col("gain") > 0), F.lit(0))).alias("recall"),
        F.max(F.when(F.col("gain") > 0, F.lit(1.0) / F.col("rank"))).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    ).join(ideal, "q", "left")
    out = (lambda c: F.coalesce(c, F.lit(0.0))) if digits is None else (lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits))
    return m.select("q", out(F.col("recall")).alias(f"recall_at_{k}"), out(F.col("rr")).alias("rr"), out(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))).alias(f"ndcg_at_{k}"))


def calibration(samples: DataFrame, digits: int | None = 6) -> DataFrame:
    """Precision, recall, F1 and Wilson lower bound at every distinct score taken as threshold.

    Samples collapse to distinct scores map-side; only these are ordered.
    """
    s = samples.filter("score is not null").groupBy("score").agg(F.count("*").alias("n"), F.count_if("relevant").alias("pos"))
    total = s.agg(F.sum("pos").alias("p"))
    c = running(s, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")})
    c = c.select(F.col("score").alias("threshold"), "tp", "fp").join(F.broadcast(total))  # one row
    m = F.col("tp") + F.col("fp")
    c = c.withColumn("prec", F.col("tp") / m).withColumn("rec", F.col("tp") / F.col("p"))
    p = F.col("prec")
    f1 = 2 * p * F.col("rec") / F.nullif(p + F.col("rec"), F.lit(0.0))
    wilson = (p + 1.9208 / m - 1.96 * F.sqrt(p * (1 - p) / m + 0.9604 / (m * m))) / (1 + 3.8416 / m)
    r = (lambda x: x) if digits is None else (lambda x: F.round(x, digits))
    return c.select("threshold", "tp", "fp", r(p).alias("prec"), r(F.col("rec")).alias("rec"), r(f1).alias("f1"), r(wilson).alias("wilson"))
