"""Change events between consecutive full snapshots.

Rows are reduced to (key, snapshot, row hash) before the only shuffle. Runs of
equal hash over adjacent snapshots (gaps and islands) form validity intervals;
an interval that starts after an absence is ``added``, one that meets its
predecessor is ``changed``, one that ends before the last snapshot without a
successor is ``removed``.

Defined results: rows without key or snapshot, or of a snapshot that is not
listed, count for nothing; of several rows of a key in a snapshot the highest
version wins (null lowest), repeated rows are one; nulls in compared columns equal each
other; JSON compares by content, text that is no JSON by its characters; the
first snapshot and an empty table give no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_content(c: Column) -> Column:
    """A text equal for JSON of equal content: keys sorted, spacing and number spelling gone."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def row_digest(*cols: Column) -> Column:
    """128 bits over the columns, null told from empty."""
    s = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))
    return F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(0x5BD1E995), F.reverse(s)).alias("b"))


def validity_intervals(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(key, from_ix, to_ix, prev_to, next_from) per island of equal digest.

    rows: snap, key, version, digest. snapshots: snap, the few distinct published
    snapshots; their order is the order of ``snap``.
    """
    order = snapshots.select("snap").distinct().withColumn("ix", F.row_number().over(W.orderBy("snap")))
    kept = (
        rows.filter(F.col("key").isNotNull() & F.col("snap").isNotNull())
        .join(F.broadcast(order), "snap")  # one row per published snapshot
        .groupBy("key", "ix")
        .agg(F.max(F.struct("version", "digest"))["digest"].alias("digest"))
    )
    w = W.partitionBy("key").orderBy("ix")
    marked = kept.withColumn(
        "fresh",
        F.coalesce((F.lag("ix").over(w) != F.col("ix") - 1) | (F.lag("digest").over(w) != F.col("digest")), F.lit(True)),
    ).withColumn("island", F.sum(F.col("fresh").cast("int")).over(w))
    islands = marked.groupBy("key", "island").agg(F.min("ix").alias("from_ix"), F.max("ix").alias("to_ix"))
    w2 = W.partitionBy("key").orderBy("from_ix")
    return islands.select(
        "key", "from_ix", "to_ix", F.lag("to_ix").over(w2).alias("prev_to"), F.lead("from_ix").over(w2).alias("next_from")
    )


def snapshot_changes(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snap, key, change) events derived from the validity intervals."""
    order = snapshots.select("snap").distinct().withColumn("ix", F.row_number().over(W.orderBy("snap")))
    iv = validity_intervals(rows, snapshots)
    none = F.lit(None).cast("struct<ix:int,change:string>")
    opened = F.when(
        F.col("from_ix") > 1,
        F.struct(
            F.col("from_ix").alias("ix"),
            F.when(F.col("prev_to") == F.col("from_ix") - 1, "changed").otherwise("added").alias("change"),
        ),
    ).otherwise(none)
    closed = F.when(
        F.coalesce(F.col("next_from") != F.col("to_ix") + 1, F.lit(True)),
        F.struct((F.col("to_ix") + 1).alias("ix"), F.lit("removed").alias("change")),
    ).otherwise(none)
    events = iv.select("key", F.explode(F.array_compact(F.array(opened, closed))).alias("e")).select("key", "e.*")
    # an interval that reaches the last snapshot has no snapshot after it to be removed in
    return events.join(F.broadcast(order), "ix").select("snap", "key", "change")


def revision_file_changes(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Files added, removed or changed between published code-index revisions."""
    rows = files.select(
        F.col("index_revision").alias("snap"),
        F.col("document_id").alias("key"),
        F.col("document_revision").alias("version"),
        row_digest(
            F.col("path"), F.col("project"), F.col("document_revision"), F.col("content_hash"), json_content(F.col("analysis_json"))
        ).alias("digest"),
    )
    snaps = revisions.select(F.col("rev_id").alias("snap")).filter(F.col("snap").isNotNull())
    return snapshot_changes(rows, snaps).select(
        F.col("snap").alias("index_revision"), F.col("key").alias("document_id"), "change"
    )
