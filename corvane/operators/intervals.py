"""Continuous periods and gaps from overlapping intervals of an entity.

Each start is compared with the running maximum of the ends before it; where it
lies beyond that maximum a new island begins. A hot entity is split by time:
the running maximum is taken inside (entity, time bucket), and what earlier
buckets carry into a bucket comes from a small per-bucket summary, so no window
ever spans more than one bucket's distinct starts or one entity's buckets.

Defined results: a null or blank bound is open; an unreadable bound or an end
not after its start drops the fact; blank or null entities give no rows;
repeated facts count once; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_FROM, OPEN_TO = -(2**63) + 1, 2**63 - 1
DAY_US = 86_400_000_000
BOUND = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


SPACES = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def bound_micros(text: Column, when_open: int) -> Column:
    """Microseconds of a written bound in UTC; ``when_open`` for null or blank, null if unreadable."""
    t = F.upper(trimmed(text))
    n = F.length(t)
    written = (
        F.when(n == 10, F.concat(t, F.lit(" 00:00:00Z")))
        .when(t.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), t)
        .when(t.rlike(r"[+-]\d{4}$"), F.concat(F.substring(t, F.lit(1), n - 2), F.lit(":"), F.right(t, F.lit(2))))
        .when(t.rlike(r":\d{2}(?:\.\d+)?[+-]\d{2}$"), F.concat(t, F.lit(":00")))
        .otherwise(F.concat(t, F.lit("Z")))
    )
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(when_open)).otherwise(
        F.when(t.rlike(BOUND), F.unix_micros(written.try_cast("timestamp")))
    )


def micros_text(c: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC whatever the session's zone; empty for an open bound."""
    ntz = F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(c.isin(OPEN_FROM, OPEN_TO), F.lit("")).otherwise(F.substring(ntz.cast("string"), 1, 19))


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, bucket_us: int = DAY_US) -> DataFrame:
    """(entity, span, lo, hi) for every maximal period and every gap between two, bounds in microseconds.

    ``start`` and ``end`` are long columns, never null, half-open, end > start.
    """
    # copies and repeated starts collapse map-side before anything is sorted
    starts = (
        df.select(F.col(entity).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
        .groupBy("k", "s").agg(F.max("e").alias("e"))
        .withColumn("b", F.floor(F.col("s") / F.lit(bucket_us)).cast("long"))
    )
    by_bucket = starts.groupBy("k", "b").agg(F.max("e").alias("m"))
    earlier = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carry = by_bucket.select("k", "b", F.max("m").over(earlier).alias("carry"))
    inside = W.partitionBy("k", "b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    opened = (
        starts.join(carry, ["k", "b"])
        .withColumn("prev", F.greatest("carry", F.max("e").over(inside)))  # nulls are skipped
        .filter(F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .select("k", "b", "s", "prev")
    )
    # a period ends where the next island's running maximum stands, the last one at the entity's maximum
    nexts = opened.groupBy("k", "b").agg(F.min_by("prev", "s").alias("p"))
    tops = by_bucket.groupBy("k").agg(F.max("m").alias("top"))
    later = nexts.withColumn("after", F.lead("p").over(W.partitionBy("k").orderBy("b"))).join(tops, "k")
    ends = later.select("k", "b", F.coalesce("after", "top").alias("after"))
    spans = (
        opened.withColumn("inner", F.lead("prev").over(W.partitionBy("k", "b").orderBy("s")))
        .join(ends, ["k", "b"])
        .select("k", F.explode(F.array(
            F.struct(F.lit("period").alias("span"), F.col("s").alias("lo"), F.coalesce("inner", "after").alias("hi")),
            F.struct(F.lit("gap").alias("span"), F.col("prev").alias("lo"), F.col("s").alias("hi")),
        )).alias("x"))
        .select(F.col("k").alias(entity), "x.*")
    )
    return spans.filter(F.col("lo").isNotNull())


def fact_periods(facts: DataFrame) -> DataFrame:
    """Periods and gaps of every subject of temporal facts, bounds as text."""
    clean = facts.select(
        trimmed(F.col("subject")).alias("subject"),
        bound_micros(F.col("valid_from"), OPEN_FROM).alias("s"),
        bound_micros(F.col("valid_to"), OPEN_TO).alias("e"),
    ).filter((F.col("subject") != "") & (F.col("e") > F.col("s")))
    return periods_and_gaps(clean, "subject", "s", "e").select(
        "subject", "span", micros_text(F.col("lo")).alias("span_from"), micros_text(F.col("hi")).alias("span_to")
    )
