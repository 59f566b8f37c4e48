"""Smaller operators: lookups, batches, layouts, plans, ledgers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.operators import code as C
from corvane.operators import documents as D
from corvane.operators import graph as G
from corvane.operators import search as S
from corvane.plans import code as PC
from corvane.operators.lexical import content_words
from corvane.plans import graph as PG
from corvane.plans import search as PS
from corvane.plans.base import Plans

P = Plans()
query = P.query


@query("select count(*) as n from documents where source = 'vault-main'")
def count_by_eq(t):
    return t("documents").filter("source = 'vault-main'").agg(F.count("*").alias("n"))


@query("select doc_id, uri from documents where doc_id = 3 or uri = 'vault://loom/note/225'")
def find_by_id_or_uri(t):
    return t("documents").filter("doc_id = 3 or uri = 'vault://loom/note/225'").select("doc_id", "uri")


@query("select doc_id, text from documents where doc_id in (2, 4, 8, 16, 32, 64)")
def batch_bodies(t):
    """Whole bodies by a list of ids."""
    return t("documents").filter(F.col("doc_id").isin(2, 4, 8, 16, 32, 64)).select("doc_id", "text")


@query("select doc_id from documents where sha256(text) = (select sha256(text) from documents where text is not null group by 1 order by count(*) desc, 1 limit 1)")
def list_by_hash(t):
    d = t("documents").filter("text is not null").select("doc_id", D.content_key().alias("h"))
    top = d.groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(1).select("h")
    return d.join(F.broadcast(top), "h", "left_semi").select("doc_id")


@query("select trim(wing) as wing, trim(room) as room, count(*) as n from documents where trim(coalesce(room,'')) <> '' group by 1, 2")
def room_counts(t):
    return t("documents").filter(D.blank("room") != "").groupBy(F.trim("wing").alias("wing"), F.trim("room").alias("room")).agg(F.count("*").alias("n"))


@query("""select doc_id, case when doc_id % 50 = 0 then 'tombstone' else coalesce(nullif(trim(status),''),'active') end as status from documents where doc_id % 77 <> 0""")
def disposition_batch(t):
    return t("documents").filter("doc_id % 77 <> 0").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "tombstone").otherwise(D.status_of()).alias("status"))


@query("""select id, document_id, chunk_index from (select distinct id, document_id, chunk_index from chunks where document_id <> 38) union all select 900000001, 38, 0""")
def replace_chunks(t):
    c = t("chunks").filter("document_id <> 38").select("id", "document_id", "chunk_index").distinct()
    new = c.sparkSession.range(1).select(F.lit(900000001).cast("long").alias("id"), F.lit(38).cast("long").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"))
    return c.unionByName(new)


@query("select distinct id, coalesce(parent_chunk_id, id) as parent_id from chunks")
def backfill_chunk_parents(t):
    return t("chunks").select("id", F.coalesce("parent_chunk_id", "id").alias("parent_id")).distinct()


@query("select user_id, count(*) as calls, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as evidence, round(sum(value), 4) as total from events group by 1")
def task_stats(t):
    k = lambda x: F.count_if(F.col("event_type") == x)
    return t("events").groupBy("user_id").agg(F.count("*").alias("calls"), k("error").alias("errors"), k("purchase").alias("evidence"), F.round(F.sum("value"), 4).alias("total"))


@query("""with r as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events where value is not null) select max(value) filter (i = floor((n - 1) * 0.9 + 0.5)) as p90 from r""")
def percentile_nearest_rank(t):
    v = t("events").filter("value is not null").groupBy("value").agg(F.count("*").alias("c"))
    # distinct values with their counts; one running sum gives every rank
    r = D.running(v, [F.col("value")], {"hi": F.col("c")}).join(F.broadcast(v.agg(F.sum("c").alias("n"))))
    at = F.floor((F.col("n") - 1) * F.lit(0.9) + F.lit(0.5))
    return r.filter((at < F.col("hi")) & (at >= F.col("hi") - F.col("c"))).select(F.col("value").alias("p90"))


@query(f"""with {PS.BM25}, lt as (select key, row_number() over (order by score desc, key) as rank from lex qualify rank <= 5)
select string_agg('[' || rank || '] ' || content, chr(10) || chr(10) order by rank) as block from lt join c on c.id = key""")
def context_block(t):
    """The five best hits as one numbered block."""
    hits = S.ranked(S.top_k(PS.lexical(t), 5)).join(PS.chunks(t).select(F.col("id").alias("key"), "content"), "key")
    parts = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), "rank", F.lit("] "), "content").alias("x"))))
    return hits.agg(F.array_join(parts["x"], "\n\n").alias("block"))


@query(rf"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents where text is not null)
select doc_id, len(list_filter(w, lambda x: x not in ({PS.STOPPED}))) as content_words from w""")
def stopword_filter(t):
    return t("documents").filter("text is not null").select("doc_id", F.size(content_words(F.col("text"))).alias("content_words"))


@query()
def vector_digest(t):
    """64-bit digests of vectors, for change detection."""
    return t("embeddings").select("vec_id", F.xxhash64("embedding").alias("digest"))


@query()
def line_diffs(t):
    """Lines added and removed between each document and the next of its source."""
    d = t("documents").filter("text is not null").select("doc_id", "source", "text")
    # the neighbour is found on ids alone, then its text is joined
    ids = D.latest(d.select("source", "doc_id").distinct(), ["source", "doc_id"], [F.col("doc_id")])
    nxt = ids.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next_id")).filter("next_id is not null")

    @F.pandas_udf(T.StructType([T.StructField("added", T.IntegerType()), T.StructField("removed", T.IntegerType())]))
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([X.line_diff(x, y) for x, y in zip(a, b)], columns=["added", "removed"])

    j = nxt.join(d.select("doc_id", F.col("text").alias("a")), "doc_id").join(d.select(F.col("doc_id").alias("next_id"), F.col("text").alias("b")), "next_id")
    return j.select("doc_id", "next_id", diff("a", "b").alias("x")).select("doc_id", "next_id", "x.added", "x.removed")


@query(f"""with recursive {PG.NET}, r(node, depth) as (select distinct dst, 0 from e where dst = 'w:resolver' union select u.dst, r.depth + 1 from r join u on u.src = r.node where r.depth < 2), m as (select node, min(depth) as depth from r group by 1),
p as (select node, depth, 2 * {math.pi} * (row_number() over (partition by depth order by node) - 1) / count(*) over (partition by depth) as a from m) select node, depth, round(depth * cos(a), 6) as x, round(depth * sin(a), 6) as y from p""")
def radial_layout(t):
    """Rings of equal angles around a node."""
    n = PG.net(t)
    m = G.reach(G.undirected(n), n.filter("dst = 'w:resolver'").select(F.col("dst").alias("node")), 2)
    a = F.lit(2 * math.pi) * (F.row_number().over(W.partitionBy("depth").orderBy("node")) - 1) / F.count("*").over(W.partitionBy("depth"))
    return m.withColumn("a", a).select("node", "depth", F.round(F.col("depth") * F.cos("a"), 6).alias("x"), F.round(F.col("depth") * F.sin("a"), 6).alias("y"))


@query(f"with {PG.NET} select e.src, e.dst from e join documents on 'd' || doc_id = e.src where wing = 'atlas'")
def project_graph(t):
    own = t("documents").filter("wing = 'atlas'").select(F.concat(F.lit("d"), "doc_id").alias("src"))
    return PG.net(t).join(own, "src", "left_semi")


@query(f"with {PG.TAGS} select tag from g join documents on doc_id = key group by 1 having count(*) filter (coalesce(status,'') <> 'tombstone') = 0")
def prune_orphan_tags(t):
    """Tags that only removed documents carry."""
    d = t("documents").select(F.col("doc_id").alias("key"), "status")
    return PG.tags(t).join(d, "key").groupBy("tag").agg(F.count_if(F.coalesce("status", F.lit("")) != "tombstone").alias("n")).filter("n = 0").select("tag")


@query(f"with {PG.TAGS} select key as doc_id, tag from g where tag <> 'wing' union select doc_id, 'reviewed' from documents where kind = 'decision'")
def set_tags(t):
    """One tag removed everywhere, one added to a kind."""
    kept = PG.tags(t).filter("tag <> 'wing'").select(F.col("key").alias("doc_id"), "tag")
    return kept.unionByName(t("documents").filter("kind = 'decision'").select("doc_id", F.lit("reviewed").alias("tag"))).distinct()


@query("""select action, count(*) as n from (select 'merge' as action from documents where text in (select text from documents where text is not null group by 1 having count(*) > 1)
union all select 'delete' from documents where trim(coalesce(text,''), ' ') = '' union all select 'file' from documents where trim(coalesce(wing,'')) = '') group by 1""")
def heuristic_plan(t):
    """Allowed actions for the issues found."""
    d = t("documents")
    merge = D.duplicate_members(d).select(F.lit("merge").alias("action"))
    rest = d.select(F.explode(F.array_compact(F.array(F.when(D.blank("text") == "", "delete"), F.when(D.blank("wing") == "", "file")))).alias("action"))
    return merge.unionByName(rest).groupBy("action").agg(F.count("*").alias("n"))


@query()
def compress_pairs(t):
    """Pairs of the report over all documents, best first, each document in one pair at most."""

    def choose(frames):
        f = pd.concat(list(frames)).sort_values(["sim", "a", "b"], ascending=[False, True, True])
        used, out = set(), []
        for r in f.itertuples():
            if r.a not in used and r.b not in used:
                used |= {r.a, r.b}
                out.append((r.a, r.b, r.sim))
        yield pd.DataFrame(out, columns=["a", "b", "sim"])

    return PS.near_duplicate_documents(t).coalesce(1).mapInPandas(choose, "a bigint, b bigint, sim double")


@query("select max(event_id) as journal_end, least(max(event_id), 5000) as cursor, max(event_id) - least(max(event_id), 5000) as gap, max(event_id) - least(max(event_id), 5000) > 1000 as stale from events")
def cursor_staleness(t):
    top = t("events").agg(F.max("event_id").alias("journal_end"))
    c = F.least("journal_end", F.lit(5000))
    return top.select("journal_end", c.alias("cursor"), (F.col("journal_end") - c).alias("gap"), (F.col("journal_end") - c > 1000).alias("stale"))


@query("select e.event_id from events e where e.event_type = 'signup' and not exists (select 1 from events s where s.user_id = e.user_id and s.event_type = 'purchase' and s.event_id > e.event_id)")
def outbox(t):
    """Signups with no later purchase: entries not sent yet."""
    e = t("events")
    last = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("m"))
    return e.filter("event_type = 'signup'").join(last, "user_id", "left").filter("m is null or m < event_id").select("event_id")


@query(r"""with u as (select canonical_path, lower(unnest(regexp_extract_all(content, '(?i)\b(?:from|join)\s+([A-Za-z_][0-9A-Za-z_.]*)', 1))) as name from code_index_source_blobs),
s as (select name, count(distinct canonical_path) as readers from u where name like '%\_log' escape '\' group by 1) select name as table_name, readers from s""")
def table_impact(t):
    """Readers of each log table."""
    return C.table_reads(PC.blobs(t)).filter(F.col("table_name").endswith("_log")).groupBy("table_name").agg(F.countDistinct("canonical_path").alias("readers"))
