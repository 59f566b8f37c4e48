"""Queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import bpe, markup, neighbours, packing, sentences, splitting
from corvane.sources.tables import load, written


def p1_found(spark, d):
    """Requests whose item had to be cut, and whether it offers natural boundaries throughout."""
    pieces = splitting.split_oversized(splitting.requested_items(spark, d), "request_id", "item", "limit", "overlap", only_oversized=True, content=False)
    return pieces.filter("piece = 0").select(
        F.col("key").alias("request_id"), F.when(F.col("has_stretch"), "forced").otherwise("natural").alias("cut"))


def p1_pieces(spark, d):
    """Every piece of every requested item."""
    pieces = splitting.split_oversized(splitting.requested_items(spark, d), "request_id", "item", "limit", "overlap")
    return pieces.select(F.col("key").alias("request_id"), "piece", "start_char", "end_char", "cut", "content")


def p4_found(spark, d):
    """Kinds of markup in each requested text."""
    calls = load(spark, d, "ingest_requests")
    model = markup.fit(calls, "request_id", "text")
    return markup.markup_kinds(calls, "request_id", "text", model).select(F.col("key").alias("request_id"), "markup")


def p4_clean(spark, d):
    """Clean text of each ingest_text and ingest_raw call, block by block."""
    calls = load(spark, d, "ingest_requests")
    model = markup.fit(calls, "request_id", "text")
    texts = calls.filter(F.col("tool").isin("ingest_text", "ingest_raw"))
    return markup.clean_texts(texts, "request_id", "text", model).withColumnRenamed("key", "request_id")


DIMS = 64


def p6_found(spark, d):
    """Pairs of chunks of cosine 0.92 or more, one among the five most similar of the other."""
    near = neighbours.most_similar(load(spark, d, "chunks"), "id", "embedding", DIMS, k=5, least=0.92)
    return near.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


def p6_most_similar(spark, d):
    """The five most similar chunks of every chunk."""
    near = neighbours.most_similar(load(spark, d, "chunks"), "id", "embedding", DIMS, k=5, degree=24, trees=5)
    return near.select("id", "other", F.round("sim", 9).alias("sim"), "rank")


def p6_search(spark, d):
    """The five nearest chunks of every query vector, found by greedy search of the neighbour graph.

    Queries are all chunks whose id is divisible by 20, against all chunks; each finds itself first.
    """
    codes = written(neighbours.usable(load(spark, d, "chunks"), "id", "embedding", DIMS).select("id", "code"), "codes", "id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    graph = neighbours.knn_graph(codes, DIMS, degree=24, trees=5)
    queries = codes.filter("id % 20 = 0").select(F.col("id").alias("q"), F.col("code").alias("qcode"))
    return neighbours.greedy_search(graph, codes, queries, DIMS).select(F.col("q").alias("query_id"), F.col("id").alias("chunk_id"), F.round("s", 4).alias("sim"))


def p7_ids(spark, d):
    """doc_id and ids of every document's text."""
    return bpe.encode_texts(load(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark, d):
    """Containers of 2,048 tokens over all documents."""
    sizes = bpe.encode_texts(load(spark, d, "documents"), "doc_id", "text").select("doc_id", F.size("ids").alias("tokens"))
    return packing.pack(sizes, "doc_id", "tokens", 2048).select(
        "container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), F.col("used").alias("container_tokens"))


def p9_found(spark, d):
    """Sentences or other smallest units of reading of every document."""
    return sentences.sentence_units(load(spark, d, "documents"), "doc_id", "text", "kind").withColumnRenamed("key", "doc_id")


QUERIES = {"p9_found": p9_found, "p1_found": p1_found, "p1_pieces": p1_pieces, "p4_found": p4_found, "p4_clean": p4_clean, "p6_found": p6_found, "p6_most_similar": p6_most_similar, "p6_search": p6_search, "p8_containers": p8_containers, "p7_ids": p7_ids}

SQL: dict[str, str] = {
    "p1_found": r"""
with b as (select canonical_path p, content from code_index_source_blobs),
r as (select request_id, wing, text item from ingest_requests where tool in ('ingest_text', 'ingest_raw')
  union all
  select request_id, wing, content from (
    select request_id, wing, '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      replace(trim(path), chr(92), '/'), '^file://', ''), '/+(\./+)*', '/', 'g'), '/[^/]+/\.\./', '/', 'g'), '^/', '') q
    from ingest_requests where tool = 'ingest_file' and path is not null) join b on q = p),
l as (select request_id, item, coalesce(c.chunk_size, (select chunk_size from chunk_profiles where wing = '*')) n
  from r left join chunk_profiles c on lower(trim(r.wing)) = c.wing)
select request_id, case when list_max(list_transform(string_split_regex(item, '[\s\p{Z}.!?…。！？।؟,;:，、；：،]+'), lambda x: length(x))) > n then 'forced' else 'natural' end cut
from l where length(item) > n""",
}
