"""Document store: scopes, lists, pages, lookups, hydration, counts.

Columns are the test tables' (doc_id for the reference's text id). Blank filter
values are ignored; a null or blank status is active; archived and tombstone
rows are hidden unless asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.sources.tables import checkpointed

HIDDEN = ("archived", "tombstone")


def blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def status_of(c: str = "status") -> Column:
    return F.when(blank(c) == "", "active").otherwise(blank(c))


def scope(docs: DataFrame, *, hidden: bool = False, **equal: str | None) -> DataFrame:
    """Documents of a scope: trimmed equality on any column, hidden ones only if asked for."""
    out = docs if hidden else docs.filter(~status_of().isin(*HIDDEN))
    for name, value in equal.items():
        if value is not None and value.strip():
            out = out.filter(F.trim(F.col(name)) == value.strip())
    return out


def has_scope(**equal: str | None) -> bool:
    """Whether any scope value other than a status is set."""
    return any(v and v.strip() for k, v in equal.items() if k != "status")


def listed(docs: DataFrame, limit: int) -> DataFrame:
    """First rows of a list: pinned ones, then the higher boost (where the rows have such columns), the newest, then by title and id."""
    first = [F.coalesce(c, F.lit(d)).desc() for c, d in (("pinned", False), ("boost", 0)) if c in docs.columns]
    return docs.orderBy(*first, F.col("updated_at").desc_nulls_last(), F.col("title").asc_nulls_first(), "doc_id").limit(limit)


def catalog_page(docs: DataFrame, text: str | None, offset: int, limit: int, compiled: DataFrame | None = None, only: bool | None = None, **equal) -> DataFrame:
    """A page of documents whose title, uri or source_file holds a text in any letter case, with the total.

    ``equal`` gives values that columns must have, white space around them aside. With ``compiled`` (doc_id) every row says
    whether it is among them, and ``only`` keeps those that are or are not.
    """
    hit = docs.filter(reduce(lambda a, b: a & b, [F.trim(c) == v for c, v in equal.items()], F.lit(True)))
    if text and text.strip():
        t = text.strip().lower()
        columns = [c for c in ("title", "uri", "source_file") if c in docs.columns]
        hit = hit.filter(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(t) for c in columns]))
    if compiled is not None:
        known = compiled.select("doc_id").distinct().withColumn("_c", F.lit(True))
        hit = hit.join(known, "doc_id", "left").withColumn("compiled", F.coalesce("_c", F.lit(False))).drop("_c")
        if only is not None:
            hit = hit.filter(F.col("compiled") == only)
    total = hit.agg(F.count("*").alias("total"))
    page = hit.orderBy("doc_id").offset(offset).limit(max(1, min(limit, 200)))
    return page.join(F.broadcast(total))  # one row


def keyset(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The rows after a key, in order."""
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def multi_get(spark, docs: DataFrame, ids: list[int]) -> DataFrame:
    """Up to 100 documents in the order asked for; missing ones say so."""
    if len(ids) > 100:
        raise ValueError("at most 100 ids")
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, doc_id bigint")
    found = docs.join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    return asked.join(found, "doc_id", "left").withColumn("missing", F.col("title").isNull() & F.col("text").isNull() & F.col("created_at").isNull())


def expand_chunks(chunks: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """The chunks around each seed (document_id, chunk_index) within its document, each once per seed."""
    c = chunks.dropDuplicates(["document_id", "chunk_index"])
    s = seeds.select("document_id", F.col("chunk_index").alias("seed"))
    # the few seed indexes are spread to the indexes they reach, so the join is an equality
    reach = s.withColumn("chunk_index", F.explode(F.sequence(F.col("seed") - radius, F.col("seed") + radius)))
    return c.join(reach, ["document_id", "chunk_index"])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; ranks are cut before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Counts by layer, kind, status and wing with the defaults of missing values, one pass over the rows."""
    buckets = {
        "layer": F.coalesce(F.nullif(blank("layer"), F.lit("")), F.lit("raw")),
        "kind": F.coalesce(F.nullif(blank("kind"), F.lit("")), F.lit("document")),
        "status": status_of(),
        "wing": F.coalesce(F.nullif(blank("wing"), F.lit("")), F.lit("(unscoped)")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("bucket"), v.alias("value")) for k, v in buckets.items()])
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.bucket", "p.value").agg(F.count("*").alias("n"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Running sums over a total order without gathering the rows in one task.

    Rows are range-partitioned by ``order``; a window runs inside each part, and what earlier parts add up to comes
    from one row per part.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = checkpointed(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    own = own.withColumns({f"_s_{k}": v for k, v in sums.items()})
    totals = own.groupBy("_p").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    before = totals.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inner = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = own.join(F.broadcast(before), "_p").withColumns({k: F.sum(f"_s_{k}").over(inner) + F.col(f"_b_{k}") for k in sums})
    return out.drop("_p", *[f"{x}_{k}" for k in sums for x in ("_s", "_b")])


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows numbered from 1 in a total order, in parallel."""
    return running(df, order, {name: F.lit(1).cast("long")})


def content_key(c: str = "text") -> Column:
    return F.sha2(F.col(c), 256)


def duplicate_groups(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Groups of equal text: size, survivor (oldest, then smallest id) and hash, largest first.

    Members stay rows: a group may hold a third of the table.
    """
    g = docs.filter(F.col("text").isNotNull()).groupBy(content_key().alias("hash")).agg(
        F.count("*").alias("n"), F.min(F.struct("created_at", "doc_id"))["doc_id"].alias("survivor"))
    g = g.filter("n > 1").orderBy(F.desc("n"), "hash")
    return g if most is None else g.limit(most)


def duplicate_members(docs: DataFrame) -> DataFrame:
    """Every copy with the survivor of its group."""
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", content_key().alias("hash"))
    return keyed.join(duplicate_groups(docs).select("hash", "survivor"), "hash").select("doc_id", "survivor")
