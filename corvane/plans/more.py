"""Further operators: the whole search, graph views, collections, revisions, judges, code facts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import graph as G
from corvane.operators import search as S
from corvane.plans import graph as PG
from corvane.plans import search as PS
from corvane.plans.base import Plans

P = Plans()
query = P.query
QUERY = PS.QUERY


SCOPED = f"ok as (select c.id as key, c.document_id, c.chunk_index, d.title, d.uri, d.updated_at from c join documents d on d.doc_id = c.document_id where {PS.ACTIVE})"
BOOST = "case when lower(trim(title)) = 'lexical snapshot of the ranking' then 1.35e0 else 1e0 end * case when contains(lower(coalesce(uri,'')), 'lexical') and contains(lower(coalesce(uri,'')), 'snapshot') and contains(lower(coalesce(uri,'')), 'of') and contains(lower(coalesce(uri,'')), 'the') and contains(lower(coalesce(uri,'')), 'ranking') then 1.15e0 else 1e0 end"
FINISH = """o as (select *, row_number() over (order by score desc, document_id, chunk_index, key) as r from h), cp as (select *, row_number() over (partition by document_id order by r) as n from o)
select row_number() over (order by r) as rank, key as chunk_id, document_id, round(score, 6) as score from cp where n <= %d order by r limit 10"""


@query(f"""with {PS.BM25}, {PS.VEC}, {SCOPED}, lt as (select key, row_number() over (order by score desc, key) as rank from lex semi join ok using (key) qualify rank <= 50),
vt as (select key, row_number() over (order by score desc, key) as rank from vec semi join ok using (key) qualify rank <= 50),
f as (select key, sum(1e0 / (60 + rank)) as s from (select * from lt union all select * from vt) group by 1),
h as (select key, document_id, chunk_index, s * (1 + pow(2e0, -date_diff('day', updated_at::date, date '2026-06-01') / 90e0)) * {BOOST} as score from f join ok using (key)), {FINISH % 1}""")
def search_hybrid_ranks(t):
    """The ranks of the hybrid search below, without texts and budget."""
    c = PS.chunks(t)
    return S.search(c, D.scope(t("documents")), QUERY, PS.seed_vector(c), "hybrid", 10, per_document=1, half_life=90.0, index=PS.index(t)).select("rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@query()
def search_hybrid(t):
    """Lexical and vector legs, fused and finished in the fixed order."""
    c = PS.chunks(t)
    return S.search(c, D.scope(t("documents")), QUERY, PS.seed_vector(c), "hybrid", 10, per_document=1, half_life=90.0, budget=2000, radius=1, index=PS.index(t))


@query(f"with {PS.BM25}, {SCOPED}, f as (select key, score as s from lex where score >= 0.5), h as (select key, document_id, chunk_index, s * {BOOST} as score from f join ok using (key)), {FINISH % 2}")
def search_lexical(t):
    return S.search(PS.chunks(t), D.scope(t("documents")), QUERY, mode="lex", top_k=10, per_document=2, least=0.5, index=PS.index(t)).select("rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@query(f"with {PS.CH}, {PS.VEC}, {SCOPED}, f as (select key, score as s from vec), h as (select key, document_id, chunk_index, s * {BOOST} as score from f join ok using (key)), {FINISH % 3}")
def search_vector(t):
    c = PS.chunks(t)
    return S.search(c, D.scope(t("documents")), QUERY, PS.seed_vector(c), "vec", 10).select("rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@query(f"""with {PS.BM25}, lt as (select key, row_number() over (order by score desc, key) as rank from lex qualify rank <= 30)
select key, row_number() over (order by length(content) desc, rank) as rank from lt join c on c.id = key""")
def rerank_apply(t):
    hits = S.ranked(S.top_k(PS.lexical(t), 30)).select("key", "rank")
    return S.rerank(hits, PS.chunks(t).select(F.col("id").alias("key"), F.length("content").alias("s")))


@query(f"""with {PS.BM25}, lt as (select key from lex order by score desc, key limit 20), {PG.LINKS.replace('l as', 'lk as')}
select distinct c.document_id as doc_id, target from lt join c on c.id = lt.key join lk on lk.key = c.document_id""")
def graph_expand_search(t):
    hits = S.top_k(PS.lexical(t), 20).join(PS.chunks(t).select(F.col("id").alias("key"), "document_id"), "key").select(F.col("document_id").alias("key")).distinct()
    return PG.links(t).join(F.broadcast(hits), "key", "left_semi").select(F.col("key").alias("doc_id"), "target").distinct()


@query("""select request_id, tag from (select request_id, unnest(from_json(json_extract(metadata_json, '$.tags'), '["VARCHAR"]')) as tag from ingest_requests where json_valid(metadata_json)) group by 1, 2""")
def metadata_tags(t):
    tags = F.from_json(F.get_json_object("metadata_json", "$.tags"), "array<string>")
    return t("ingest_requests").select("request_id", F.explode(F.array_distinct(tags)).alias("tag"))


@query(f"""with {PG.NET}, v as (select dst as node from (select distinct dst from e where dst like 't:%') order by 1 limit 25) select e.src, e.dst from e join v on v.node = e.dst""")
def graph_view(t):
    """Edges of the first 25 tags in label order, the view's own bound."""
    n = PG.net(t)
    v = n.filter("dst like 't:%'").select("dst").distinct().orderBy("dst").limit(25)
    return n.join(F.broadcast(v), "dst", "left_semi").select("src", "dst")


@query("""select doc_id, how from (select doc_id, how, row_number() over (order by p, doc_id) as r from (
 select doc_id, 'id' as how, 0 as p from documents where cast(doc_id as varchar) = 'open points' union all select doc_id, 'uri', 1 from documents where uri = 'open points'
 union all select doc_id, 'label', 2 from documents where trim(lower(title)) = 'open points')) where r = 1""")
def seed_resolve(t):
    """The document a seed text names: by id, else uri, else label."""
    d, seed = t("documents"), "open points"
    p = F.when(F.col("doc_id").cast("string") == seed, 0).when(F.col("uri") == seed, 1).when(F.trim(F.lower("title")) == seed, 2)
    return d.select("doc_id", p.alias("p")).filter("p is not null").orderBy("p", "doc_id").limit(1).select("doc_id", F.element_at(F.array(F.lit("id"), F.lit("uri"), F.lit("label")), F.col("p") + 1).alias("how"))


@query(f"with {PG.NET}, n as (select distinct dst as node from e), i as (select node, row_number() over (order by node) - 1 as i, ceil(sqrt(count(*) over ()))::bigint as w from n) select node, i % w as x, i // w as y from i")
def overview_grid(t):
    """A grid of the link targets and tags in label order."""
    n = PG.net(t).select(F.col("dst").alias("node")).distinct()
    w = n.agg(F.ceil(F.sqrt(F.count("*").cast("double"))).alias("w"))
    i = D.numbered(n, [F.col("node")], "i").withColumn("i", F.col("i") - 1).join(F.broadcast(w))
    return i.select("node", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).alias("y"))


@query(f"with {PG.NET}, s as (select src as a, min(dst) as keep, count(*) as n from e group by 1) select a as node, n as degree, keep as first_target from s where n >= 3")
def graph_hubs(t):
    return PG.net(t).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.min("dst").alias("first_target")).filter("degree >= 3")


@query(f"with {PG.LINKS}, o as (select key, target, row_number() over (partition by key, target order by ordinal) as r from l) select key as doc_id, target from o where r = 1 and key not in (select doc_id from documents where status = 'tombstone')")
def edge_rewire(t):
    """Document edges once each, those of removed documents gone."""
    gone = t("documents").filter("status = 'tombstone'").select(F.col("doc_id").alias("key"))
    return PG.links(t).select("key", "target").distinct().join(gone, "key", "left_anti").select(F.col("key").alias("doc_id"), "target")


@query("""select 'chunks' as what, count(*) as n from (select distinct id, document_id from chunks) where document_id not in (select doc_id from documents)
union all select 'parents', count(*) from (select distinct id, parent_chunk_id from chunks) where parent_chunk_id is not null and parent_chunk_id not in (select id from chunks)""")
def prune_orphans(t):
    """What a pruning would remove."""
    c = t("chunks").dropDuplicates(["id"])
    a = c.join(t("documents").select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").agg(F.lit("chunks").alias("what"), F.count("*").alias("n"))
    b = c.filter("parent_chunk_id is not null").join(t("chunks").select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti").agg(F.lit("parents").alias("what"), F.count("*").alias("n"))
    return a.union(b)


@query("select wing as collection, doc_id, row_number() over (partition by wing order by created_at, doc_id) as position from documents where kind = 'decision' and wing is not null")
def collection_entries(t):
    """Ordered packs: a wing's decisions."""
    d = t("documents").filter("kind = 'decision' and wing is not null")
    return d.select(F.col("wing").alias("collection"), "doc_id", F.row_number().over(W.partitionBy("wing").orderBy("created_at", "doc_id")).alias("position"))


@query("select document_id, document_revision, count(*) as seen, min(index_revision) as first_index from code_index_revision_files where document_id is not null group by 1, 2")
def revision_list(t):
    return t("code_index_revision_files").filter("document_id is not null").groupBy("document_id", "document_revision").agg(F.count("*").alias("seen"), F.min("index_revision").alias("first_index"))


@query("select document_id, max(path) as path, max(project) as project from code_index_revision_files where document_id is not null and document_revision = 1 group by 1")
def revision_snapshot(t):
    return t("code_index_revision_files").filter("document_id is not null and document_revision = 1").groupBy("document_id").agg(F.max("path").alias("path"), F.max("project").alias("project"))


@query("""select 'status' as part, coalesce(nullif(trim(status),''),'active') as name, count(*) as n from documents group by 2 union all
select 'kind', kind, count(*) from documents where coalesce(nullif(trim(status),''),'active') = 'active' group by 2""")
def wake_up(t):
    d = t("documents")
    a = d.groupBy(F.lit("status").alias("part"), D.status_of().alias("name")).agg(F.count("*").alias("n"))
    b = d.filter(D.status_of() == "active").groupBy(F.lit("kind").alias("part"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


@query("select doc_id, case when kind = 'memory' and coalesce(nullif(trim(status),''),'active') = 'active' then 'archived' else coalesce(nullif(trim(status),''),'active') end as status from documents")
def archive_memories(t):
    return t("documents").select("doc_id", F.when((F.col("kind") == "memory") & (D.status_of() == "active"), "archived").otherwise(D.status_of()).alias("status"))


@query(r"""with w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as q, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as a from documents where title is not null and text is not null),
s as (select doc_id, case when len(q) = 0 then 0e0 else len(list_intersect(q, a))::double / len(q) end as complete from w)
select doc_id, round(complete, 6) as complete, case when complete >= 0.8 then 'pass' when complete >= 0.5 then 'partial' else 'fail' end as verdict from s""")
def heuristic_judge(t):
    """Whether a text answers its title: the share of the title's words it holds."""
    w = t("documents").filter("title is not null and text is not null").select("doc_id", F.array_distinct(S.tokens(F.col("title"))).alias("q"), F.array_distinct(S.tokens(F.col("text"))).alias("a"))
    c = F.when(F.size("q") == 0, 0.0).otherwise(F.size(F.array_intersect("q", "a")) / F.size("q"))
    return w.select("doc_id", c.alias("c")).select("doc_id", F.round("c", 6).alias("complete"), F.when(F.col("c") >= 0.8, "pass").when(F.col("c") >= 0.5, "partial").otherwise("fail").alias("verdict"))


@query(f"with {PG.LINKS}, h as (select key, count(distinct target) as cited, count(distinct target) filter (target in ('resolver','subject','manifest')) as expected from l group by 1) select key as doc_id, cited, 3 - expected as missing, cited > 0 as present from h")
def citation_judge(t):
    """Of three expected citations those a document lacks."""
    want = F.col("target").isin("resolver", "subject", "manifest")
    return PG.links(t).groupBy(F.col("key").alias("doc_id")).agg(
        F.countDistinct("target").alias("cited"), (F.lit(3) - F.countDistinct(F.when(want, F.col("target")))).alias("missing"), (F.count("*") > 0).alias("present"))


@query(r"""select canonical_path, lower(unnest(list_distinct(regexp_extract_all(content, '(?i)(?:href|src)=["'']?([^"''\s>]+)', 1)))) as target from code_index_source_blobs where canonical_path like '%.html'""")
def file_resources(t):
    """Resources that HTML sources name."""
    return t("code_index_source_blobs").filter("canonical_path like '%.html'").select("canonical_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"""(?i)(?:href|src)=["']?([^"'\s>]+)"""), F.lit(1)))).alias("target")).select("canonical_path", F.lower("target").alias("target"))


@query(r"""with r as (select canonical_path, lower(unnest(list_distinct(regexp_extract_all(content, '\]\(([^)\s]+)\)', 1)))) as target from code_index_source_blobs),
k as (select distinct lower(regexp_extract(canonical_path, '([^/]+)$', 1)) as name from code_index_source_blobs)
select canonical_path, target, k.name is not null as exists_here from r left join k on k.name = regexp_extract(target, '([^/]+)$', 1)""")
def resource_targets(t):
    """Link targets of sources and whether an indexed file has that name."""
    b = t("code_index_source_blobs")
    r = b.select("canonical_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1)))).alias("x")).select("canonical_path", F.lower("x").alias("target"))
    k = b.select(F.lower(F.regexp_extract("canonical_path", "([^/]+)$", 1)).alias("name")).distinct().withColumn("here", F.lit(True))
    return r.withColumn("name", F.regexp_extract("target", "([^/]+)$", 1)).join(k, "name", "left").select("canonical_path", "target", F.coalesce("here", F.lit(False)).alias("exists_here"))


@query(r"""select canonical_path, count(*) as definitions from (select canonical_path, unnest(regexp_extract_all(content, '(?m)^\s*let ([a-z_0-9]+) =', 1)) as name from code_index_source_blobs) group by 1""")
def local_definitions(t):
    """Local bindings per source: what a data slice starts from."""
    return t("code_index_source_blobs").select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*let ([a-z_0-9]+) ="), F.lit(1))).alias("name")).groupBy("canonical_path").agg(F.count("*").alias("definitions"))


@query(r"""with d as (select canonical_path as p, unnest(regexp_extract_all(content, '(?m)^\s*(?:let |)([a-z_]+_[0-9]+) =', 1)) as name from code_index_source_blobs), u as (select canonical_path as p, unnest(regexp_extract_all(content, '\b([a-z_]+_[0-9]+)\b', 1)) as name from code_index_source_blobs),
a as (select p, name, count(*) as defs from d group by 1, 2), b as (select p, name, count(*) as uses from u group by 1, 2)
select coalesce(a.p, b.p) as canonical_path, coalesce(a.name, b.name) as name, coalesce(defs, 0) as defs, coalesce(uses, 0) - coalesce(defs, 0) as uses from a full join b on a.p = b.p and a.name = b.name where defs is null or uses = defs""")
def name_usage(t):
    """Local names that are used without definition or defined without use."""
    b = t("code_index_source_blobs")
    pick = lambda pattern, n: b.select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("name")).groupBy("canonical_path", "name").agg(F.count("*").alias(n))
    j = pick(r"(?m)^\s*(?:let |)([a-z_]+_[0-9]+) =", "defs").join(pick(r"\b([a-z_]+_[0-9]+)\b", "uses"), ["canonical_path", "name"], "full")
    return j.filter("defs is null or uses = defs").select("canonical_path", "name", F.coalesce("defs", F.lit(0)).alias("defs"), (F.coalesce("uses", F.lit(0)) - F.coalesce("defs", F.lit(0))).alias("uses"))


@query("""select s.run_id, count(distinct s.canonical_path) as files, count(*) filter (s.delivered_at > r.finished_at) as late from source_scan s join sync_runs r using (run_id) group by 1""")
def sync_job_report(t):
    s, r = t("source_scan"), t("sync_runs").select("run_id", "finished_at")
    return s.join(F.broadcast(r), "run_id").groupBy("run_id").agg(F.countDistinct("canonical_path").alias("files"), F.count_if(F.col("delivered_at") > F.col("finished_at")).alias("late"))


@query("""select event_id, user_id, row_number() over (order by event_id) + 500 as primary_seq from events where event_id not in (select event_id from events where event_type = 'click') and user_id = (select min(user_id) from events)""")
def accept_changes(t):
    """Changes of one origin that are not known yet, numbered on from the journal's end."""
    e = t("events")
    known = e.filter("event_type = 'click'").select("event_id")
    origin = e.agg(F.min("user_id").alias("user_id"))
    new = e.select("event_id", "user_id").join(F.broadcast(origin), "user_id", "left_semi").join(known, "event_id", "left_anti")
    return D.numbered(new, [F.col("event_id")], "n").select("event_id", "user_id", (F.col("n") + 500).alias("primary_seq"))


@query("""with p as (select id, xxh from (select id, md5(content) as xxh from (select distinct id, content from chunks))), n as (select id, md5(content || case when id % 10 = 0 then '!' else '' end) as xxh from (select distinct id, content from chunks))
select n.id from n where not exists (select 1 from p where p.id = n.id and p.xxh is not distinct from n.xxh)""")
def incremental_refresh(t):
    """Chunks whose digest is not the stored one: what a refresh has to embed again."""
    c = t("chunks").dropDuplicates(["id"]).select("id", "content")
    old = c.select("id", F.md5("content").alias("d"))
    new = c.select("id", F.md5(F.concat("content", F.when(F.col("id") % 10 == 0, "!").otherwise(""))).alias("d"))
    return new.join(old, (new["id"] == old["id"]) & new["d"].eqNullSafe(old["d"]), "left_anti").select("id")
