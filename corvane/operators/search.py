"""Lexical, vector and hybrid search as plans.

Scores are doubles. Scope is applied before ranking. Query terms and top-k lists
are the small sides; postings and vectors are never collected. Ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = r"[^\p{L}\p{N}]+"
K1, B, RRF_K = 1.2, 0.75, 60.0


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), WORDS), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def check_query(query: str, top_k: int) -> None:
    """Refuses what a search may not ask: k over 100, or a query of no or over 4,096 characters."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be 1 to 100")
    if not 1 <= len(query.strip()) <= 4096:
        raise ValueError("a query has 1 to 4096 characters")


def postings(docs: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """(key, term, tf, dl). With ``terms`` only theirs: the others end as a length, before any shuffle."""
    words = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    if terms is not None:
        # counted within the row: the shuffle of all words never happens
        hits = F.array(*[F.struct(F.lit(t).alias("term"), (F.size("w") - F.size(F.array_remove("w", t))).alias("tf")) for t in terms])
        return words.select("key", "dl", F.explode(hits).alias("h")).filter("h.tf > 0").select("key", "h.term", "h.tf", "dl")
    return words.select("key", "dl", F.explode("w").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of texts and their mean length in words."""
    return docs.filter(F.col(text).isNotNull()).agg(
        F.count("*").cast("double").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def bm25(docs: DataFrame, key: str, text: str, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """(key, score) of texts with a query term; statistics are the whole corpus's, the scope only filters."""
    terms = query_terms(query)
    post = postings(docs.filter(F.col(text).isNotNull()), key, text, terms)
    df = post.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    post = post.join(F.broadcast(df), "term").join(F.broadcast(corpus_stats(docs, text)))  # the query's terms; one row
    if allowed is not None:
        post = post.join(allowed, "key", "left_semi")
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1 - B) + B * F.col("dl") / F.col("avgdl")))
    return post.groupBy("key").agg(F.sum(part).alias("score")).filter("score > 0")


def term_frequency(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score): raw counts of the query's terms, a repeated term counted each time."""
    import re

    asked = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    post = postings(docs, key, text, list(dict.fromkeys(asked)))
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(asked) for x in (t, asked.count(t))])
    return post.groupBy("key").agg(F.sum(F.col("tf") * times[F.col("term")]).cast("double").alias("score"))


def _cosine(batches: Iterator[pa.RecordBatch], query: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = np.linalg.norm(query)
    for b in batches:
        ids, col = b.column(0), b.column(1)
        lens = np.diff(np.asarray(col.offsets))
        keep = np.flatnonzero((lens == len(query)) & np.asarray(col.is_valid()))
        x = col.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(query))
        m = np.linalg.norm(x, axis=1)
        with np.errstate(all="ignore"):
            s = np.where((m > 0) & (n > 0), (x @ query) / (m * n), 0.0)
        ok = np.isfinite(s)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep[ok])), pa.array(np.clip(s[ok], -1, 1))], ["key", "score"])


def cosine(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """(key, score) of every comparable vector; batches of columns, never rows, go through Python."""
    return vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>")).mapInArrow(
        partial(_cosine, query=np.array(query, dtype=np.float64)), "key bigint, score double")


def best(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "key").limit(k)


top_k = best


def ranked(top: DataFrame) -> DataFrame:
    """1-based ranks of a short list."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key")))


def rrf(lists: list[DataFrame], k: float = RRF_K) -> DataFrame:
    """(key, score) of reciprocal rank fusion over ranked short lists."""
    every = reduce(DataFrame.unionByName, [x.select("key", "rank") for x in lists])
    return every.groupBy("key").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def capped(hits: DataFrame, group: str, n: int) -> DataFrame:
    """At most n hits of each group in rank order."""
    return hits.withColumn("_c", F.row_number().over(W.partitionBy(group).orderBy("rank"))).filter(F.col("_c") <= n).drop("_c")


def recency(score: Column, age_days: Column, half_life: float) -> Column:
    return score * (F.lit(1.0) + F.pow(F.lit(2.0), -age_days / F.lit(half_life)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _mmr(frames: Iterator[pd.DataFrame], k: int, share: float, per_group: int) -> Iterator[pd.DataFrame]:
    pool = pd.concat(list(frames))
    if not len(pool):
        return
    pool = pool.sort_values("rank").reset_index(drop=True)
    words = [set(w) for w in pool["words"]]
    left, chosen, used, out = list(range(len(pool))), [], {}, []
    worst = [0.0] * len(pool)
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (share * pool["score"][i] - (1 - share) * worst[i], -pool["rank"][i]))
        left.remove(best)
        g = pool["grp"][best]
        if used.get(g, 0) >= per_group:
            continue
        used[g] = used.get(g, 0) + 1
        chosen.append(best)
        out.append((int(pool["key"][best]), len(chosen)))
        for i in left:
            u = len(words[i] | words[best])
            worst[i] = max(worst[i], len(words[i] & words[best]) / u if u else 0.0)
    yield pd.DataFrame(out, columns=["key", "position"])


def mmr(pool: DataFrame, k: int, share: float = 0.7, per_group: int = 3) -> DataFrame:
    """(key, position): greedy choice of relevance against overlap with what is chosen.

    ``pool`` is the bounded candidate pool of a query (key, grp, score, rank, words), at most 4,096 rows.
    """
    return pool.orderBy("rank", "key").limit(4096).coalesce(1).mapInPandas(partial(_mmr, k=k, share=share, per_group=per_group), "key bigint, position int")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: eighths by character class, rounded up."""
    alnum = F.length(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    space = F.length(F.regexp_replace(text, r"[^ \t\n\r\f]", ""))
    other = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) - alnum - space
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.ceil((alnum * 2 + space + other * 4 + wide * 8) / 8)


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """Ranked hits while their estimated tokens fit a budget; the one that crosses it keeps what is left."""
    w = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cost").over(w), F.lit(0))
    return hits.withColumn("before", before).filter(F.col("before") < budget).withColumn(
        "kept", F.least("cost", F.lit(budget) - F.col("before"))).drop("before")


def snippet(text: Column, terms: list[str], width: int) -> Column:
    """An excerpt around the first query term, from the start if there is none."""
    low = F.lower(text)
    places = [F.nullif(F.locate(t, low), F.lit(0)) for t in terms]
    first = F.least(*places) if len(places) > 1 else places[0]
    at = F.greatest(F.coalesce(first, F.lit(1)) - width // 4, F.lit(1))
    return F.substring(text, at, F.lit(width))


def search(
    chunks: DataFrame, docs: DataFrame, query: str, vector: list[float] | None = None, mode: str = "hybrid", top_k: int = 10, per_document: int | None = 3,
    least: float | None = None, half_life: float | None = None, now: str = "2026-06-01", budget: int | None = None, radius: int = 0, index=None,
) -> DataFrame:
    """Ranked hits of one query: (rank, chunk_id, document_id, score, snippet, context, kept).

    chunks: id, document_id, chunk_index, content, embedding. docs: the allowed documents (doc_id, title, uri,
    updated_at); chunks of others are never candidates, while term statistics stay the whole corpus's. The candidate
    pool is max(5 k, 50) and doubles up to 4,096 while the cap per document leaves fewer than k hits, since
    in a fused list a larger pool adds terms to hits of the smaller one. Then in this order: least score, recency, field boosts, order,
    equal chunks once, cap per document, k, snippets, context, token budget. The lexical leg reads ``index``, a stored index of stems;
    without one it counts plain words in the chunks themselves.
    """
    check_query(query, top_k)
    if mode not in ("vec", "lex", "hybrid"):
        raise ValueError("mode is vec, lex or hybrid")
    if mode != "lex" and vector is None:
        raise ValueError("this mode needs a query vector")
    from corvane.sources.tables import checkpointed

    own = chunks.dropDuplicates(["id"])
    allowed = own.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("key"), "document_id")
    pool = max(5 * top_k, 50)
    lex = vec = None
    if mode != "vec":
        scores = bm25(own, "id", "content", query, allowed.select("key")) if index is None else index.bm25(query, allowed.select("key"))
        lex = checkpointed(best(scores, 4096))
    if mode != "lex":
        near = cosine(own, "id", "embedding", vector).join(allowed.select("key"), "key", "left_semi")
        vec = checkpointed(best(near, 4096))
    while True:
        legs = [ranked(best(x, pool)) for x in (vec, lex) if x is not None]
        hits = rrf(legs) if len(legs) > 1 else legs[0].select("key", "score")
        hits = hits.join(F.broadcast(allowed.join(F.broadcast(hits.select("key")), "key", "left_semi")), "key")
        if per_document is None or pool >= 4096:
            break
        room = hits.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.sum(F.least("n", F.lit(per_document)))).first()[0] or 0
        if room >= top_k:
            break
        pool = min(4096, pool * 2)
    if least is not None:
        hits = hits.filter(F.col("score") >= least)
    fields = docs.select(F.col("doc_id").alias("document_id"), "title", "uri", "updated_at")
    hits = fields.join(F.broadcast(hits), "document_id")  # at most two pools of hits
    body = own.join(F.broadcast(hits.select(F.col("key").alias("id"))), "id", "left_semi").select(F.col("id").alias("key"), "chunk_index", "content")
    hits = hits.join(body, "key")
    score = F.col("score")
    if half_life is not None:
        score = recency(score, F.datediff(F.lit(now).cast("date"), F.to_date("updated_at")).cast("double"), half_life)
    terms = query_terms(query)
    uri = F.lower(F.coalesce("uri", F.lit("")))
    in_uri = reduce(lambda a, b: a & b, [uri.contains(t) for t in terms]) if terms else F.lit(False)
    score = score * F.when(F.lower(F.trim("title")) == query.strip().lower(), 1.35).otherwise(1.0) * F.when(in_uri, 1.15).otherwise(1.0)
    hits = hits.withColumn("score", score)
    order = W.orderBy(F.desc("score"), "document_id", "chunk_index", "key")
    hits = hits.withColumn("rank", F.row_number().over(order))
    if per_document is not None:
        hits = capped(hits, "document_id", per_document)
    hits = hits.orderBy("rank").limit(top_k).withColumn("rank", F.row_number().over(W.orderBy("rank")))
    hits = hits.withColumn("snippet", snippet(F.col("content"), terms, 160) if terms else F.substring("content", 1, 160))
    if radius:
        spots = hits.select("document_id", F.col("chunk_index").alias("seed")).distinct()
        reach = spots.withColumn("chunk_index", F.explode(F.sequence(F.col("seed") - radius, F.col("seed") + radius)))
        near = own.select("document_id", "chunk_index", "id", "content").join(F.broadcast(reach), ["document_id", "chunk_index"])
        parts = near.groupBy("document_id", F.col("seed").alias("chunk_index")).agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("chunk_index", "id", "content")))["content"], "\n").alias("context"))
        hits = hits.join(parts, ["document_id", "chunk_index"], "left")
    else:
        hits = hits.withColumn("context", F.col("content"))
    hits = hits.withColumn("cost", token_estimate(F.col("context")))
    hits = packed(hits, budget) if budget is not None else hits.withColumn("kept", F.col("cost"))
    return hits.select("rank", F.col("key").alias("chunk_id"), "document_id", "score", "snippet", "context", "kept")


def rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Hits (key, rank) in the order of outside scores (key, s); those without keep their order behind the others."""
    w = W.orderBy(F.col("s").desc_nulls_last(), "rank")
    return hits.join(scores, "key", "left").withColumn("rank", F.row_number().over(w)).drop("s")
