"""What is written to a store and how it changes: links, tunnels, pages, memories, plans, evaluations, schemas.

Each operator takes tables and gives the tables after it, so that a caller can publish several of them in one commit.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import graph as G
from corvane.operators import lifecycle as L
from corvane.operators import search as S
from corvane.plans import graph as PG
from corvane.plans import search as PS
from corvane.plans.base import Plans

P = Plans()
query = P.query
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings chunks ingest_requests code_index_source_blobs source_manifest "
    "source_scan kg_facts code_index_revision_files code_index_revisions sync_runs chunk_profiles"
).split()
TYPE = "case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'DATE' then 'date' when 'TIMESTAMP WITH TIME ZONE' then 'timestamp' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' when 'DOUBLE[]' then 'array<double>' else lower(data_type) end"
CATALOG = f"k as (select table_name, column_name, ordinal_position::int as position, {TYPE} as type from information_schema.columns where table_name in ({', '.join(repr(x) for x in TABLES)}))"


def catalog(t):
    """(table_name, column_name, position, type) of every table."""
    rows = [(n, c, i + 1, k) for n in TABLES for i, (c, k) in enumerate(t(n).dtypes)]
    return t("region").sparkSession.createDataFrame(rows, "table_name string, column_name string, position int, type string")


@query(f"with {CATALOG} select table_name, column_name, position, type from k")
def catalog_capture(t):
    """Columns and types of all tables as data."""
    return catalog(t)


@query(f"""with {CATALOG}, u as (select table_name as target, substr(column_name, instr(column_name, '_') + 1) as stem, type from k where column_name = left(table_name, 1) || '_' || table_name || 'key')
select k.table_name, k.column_name, target from k join u on u.stem = substr(k.column_name, instr(k.column_name, '_') + 1) and u.type = k.type and u.target <> k.table_name""")
def inferred_foreign_keys(t):
    """Columns whose stem names the key of one other table of the same type."""
    return L.inferred_keys(catalog(t)).select("table_name", "column_name", "target")


@query(f"""with {CATALOG}, u as (select table_name as target, substr(column_name, instr(column_name, '_') + 1) as stem, type from k where column_name = left(table_name, 1) || '_' || table_name || 'key'),
i as (select k.table_name, k.column_name, target from k join u on u.stem = substr(k.column_name, instr(k.column_name, '_') + 1) and u.type = k.type and u.target <> k.table_name),
d as (select * from (values ('chunks','document_id','documents'), ('orders','o_custkey','customer')) v(table_name, column_name, target))
select table_name, column_name, target, 'declared' as basis from d union all select table_name, column_name, target, 'inferred' from i where not exists (select 1 from d where d.table_name = i.table_name and d.column_name = i.column_name)""")
def foreign_keys(t):
    """Declared relations, and inferred ones for columns that have none."""
    declared = t("region").sparkSession.createDataFrame([("chunks", "document_id", "documents"), ("orders", "o_custkey", "customer")], "table_name string, column_name string, target string")
    return L.relations(declared, L.inferred_keys(catalog(t)))


@query(f"""with {CATALOG}, b as (select table_name, column_name, case when column_name = 'kind' then 'int' else type end as type from k where table_name <> 'region' and column_name <> 'room' union all select 'extra', 'id', 'bigint')
select coalesce(k.table_name, b.table_name) as table_name, coalesce(k.column_name, b.column_name) as column_name, case when k.type is null then 'added' when b.type is null then 'removed' else 'changed' end as change
from k full join b on k.table_name = b.table_name and k.column_name = b.column_name where k.type is distinct from b.type""")
def catalog_drift(t):
    """Columns added, removed or changed between two captured schemas."""
    a = catalog(t).select("table_name", "column_name", "type")
    b = a.filter("table_name <> 'region' and column_name <> 'room'").withColumn("type", F.when(F.col("column_name") == "kind", "int").otherwise(F.col("type")))
    b = b.unionByName(a.sparkSession.createDataFrame([("extra", "id", "bigint")], a.schema))
    return L.schema_drift(a, b)


URLS = ("https://atlas.example/a", "http://docs.atlas.example:8080/x?y#z", "ftp://atlas.example/f", "https://evil.example/", "https:///nohost", "not a url", "HTTPS://Atlas.Example/up", "https://user@atlas.example/p", "https://atlas.example.evil.example/")


@query("""select * from (values ('https://atlas.example/a','atlas.example','ok'), ('http://docs.atlas.example:8080/x?y#z','docs.atlas.example','ok'), ('ftp://atlas.example/f','atlas.example','scheme'), ('https://evil.example/','evil.example','host'),
 ('https:///nohost',null,'no host'), ('not a url',null,'scheme'), ('HTTPS://Atlas.Example/up','atlas.example','ok'), ('https://user@atlas.example/p','atlas.example','ok'), ('https://atlas.example.evil.example/','atlas.example.evil.example','host')) v(url, host, verdict)
union all select uri, regexp_extract(uri, '^[a-z]+://([^/]+)', 1), 'scheme' from (select distinct uri from documents where uri is not null)""")
def url_check(t):
    """Addresses that may be fetched: http or https, and a host of the list, exact or below a wildcard."""
    own = t("documents").filter("uri is not null").select(F.col("uri").alias("url")).distinct()
    some = own.sparkSession.createDataFrame([(u,) for u in URLS], "url string")
    return L.checked_urls(some.unionByName(own), "url", ["atlas.example", "*.atlas.example"])


@query("select doc_id, row_number() over (order by updated_at desc, doc_id) as place from documents where doc_id in (select document_id from source_manifest where size_bytes > 2000) order by place limit 50")
def pinned_list(t):
    """Pinned documents, the last changed first; the tables mark none, so those of large files count as pinned here."""
    pins = t("source_manifest").filter("size_bytes > 2000").select(F.col("document_id").alias("doc_id")).distinct()
    top = t("documents").join(pins, "doc_id", "left_semi").orderBy(F.desc("updated_at"), "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(W.orderBy(F.desc("updated_at"), "doc_id")).alias("place"))


@query("""with g as (select doc_id from documents where source = 'vault-main') select 'documents' as part, count(*) as kept from documents where source is distinct from 'vault-main'
union all select 'chunks', count(*) from (select distinct id, document_id from chunks) where document_id is null or document_id not in (select doc_id from g)
union all select 'facts', count(*) from kg_facts where source_document_id is null or source_document_id not in (select doc_id from g)""")
def delete_by_source(t):
    """What stays once the documents of one source, their chunks and their facts are gone."""
    d, c, k = L.without_source(t("documents"), t("chunks").dropDuplicates(["id"]), t("kg_facts"), "vault-main")
    one = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("kept"))
    return one(d, "documents").union(one(c, "chunks")).union(one(k, "facts"))


@query("select doc_id, coalesce(nullif(trim(layer),''),'raw') as layer, 0 as boost, lower(trim(regexp_replace(coalesce(title,''), '[ \t\r\n]+', ' ', 'g'), ' ')) as label_key, 3 as schema_version from documents")
def schema_migrate(t):
    """Documents brought from version 0 to the newest of a list of steps; what is done already is not done again."""
    steps = L.Migrations("documents")
    steps.add(1, "boost", lambda df: df.withColumn("boost", F.lit(0)))
    steps.add(2, "layer", lambda df: df.withColumn("layer", F.coalesce(F.nullif(D.blank("layer"), F.lit("")), F.lit("raw"))))
    steps.add(3, "label_key", lambda df: df.withColumn("label_key", G.label_key(F.coalesce("title", F.lit("")))))
    done, version = steps.run(t("documents").drop("boost"), 0)
    again, same = steps.run(done, version)
    assert same == version
    return again.select("doc_id", "layer", "boost", "label_key", F.lit(same).alias("schema_version"))


@query(f"with {PG.NET} select src, dst, case when dst like 't:%' then 'extract' when dst like 'w:%' and hash_of % 2 = 0 then 'explicit' else 'extract' end as origin from (select src, dst, length(dst) as hash_of from e)")
def backfill_edge_origins(t):
    """Origins of edges from before there were any: what somebody linked is explicit, what a text says is extracted. (Links of even length stand for those by hand.)"""
    e = PG.net(t).withColumn("legacy", F.when(F.col("dst").startswith("w:") & (F.length("dst") % 2 == 0), "manual").when(F.col("dst").startswith("w:"), "parser"))
    return L.with_origins(e).select("src", "dst", "origin")


@query("select a.doc_id as a, b.doc_id as b from documents a join documents b on b.doc_id = a.doc_id + 1 where a.doc_id % 5 = 0 and a.wing is not null")
def relation_pairs(t):
    """Pairs of documents joined by edges of one kind, among edges of several kinds between nodes of several kinds."""
    d = t("documents").select("doc_id", "wing")
    made = d.filter("doc_id % 5 = 0 and wing is not null").select(F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("d"), F.col("doc_id") + 1).alias("dst"), F.lit("follows").alias("rel"))
    edges = PG.net(t).select("src", "dst", F.lit("related").alias("rel")).unionByName(made)
    return L.relation_pairs(edges, d.select(F.concat(F.lit("d"), "doc_id").alias("node"), "doc_id"), "follows")


@query(f"""with {PG.LINKS}, n as (select label, min(doc) as doc, count(distinct doc) as c from (
 select trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as label, doc_id as doc from documents where title is not null
 union all select lower(regexp_extract(uri, '([^/]+)$', 1)), doc_id from documents where uri is not null union all select * from (values ('resolver', 1), ('subject', 2), ('subject', 3), ('manifest', 4)) v) group by 1)
select target, doc, count(*) as links from l join n on n.label = l.target and n.c = 1 and n.label <> '' group by 1, 2""")
def promoted_stubs(t):
    """Stubs that become documents: their label is the title or the last step of the address of one document only."""
    d = t("documents")
    labels = d.filter("title is not null").select(G.label_key(F.col("title")).alias("label"), "doc_id").unionByName(
        d.filter("uri is not null").select(F.lower(F.regexp_extract("uri", "([^/]+)$", 1)).alias("label"), "doc_id"))
    # the tables' links meet no title; aliases of four documents do, one of them two documents'
    labels = labels.unionByName(d.sparkSession.createDataFrame([("resolver", 1), ("subject", 2), ("subject", 3), ("manifest", 4)], "label string, doc_id bigint"))
    return L.promoted(PG.links(t).groupBy("target").agg(F.count("*").alias("links")), labels)


@query(f"""with {PG.NET}, x as (select src, dst, 'related' as rel, 1e0 as weight from e union all select 'd1', 'd' || doc_id, 'related', 2e0 from documents where doc_id in (2, 3) union all select 'd1', 'd3', 'cites', 0.5e0)
select src, dst, rel, weight from x""")
def link_nodes(t):
    """Edges with some added by hand; an added edge that is there already takes the new weight."""
    e = PG.net(t).select("src", "dst", F.lit("related").alias("rel"), F.lit(1.0).alias("weight"))
    new = e.sparkSession.createDataFrame([("d1", "d2", None, 2.0), ("d1", "d3", None, 1.0), ("d1", "d3", None, 2.0), ("d1", "d3", "cites", 0.5)], "src string, dst string, rel string, weight double").withColumn("seq", F.monotonically_increasing_id())
    return L.link(e, new)


TUNNELS = """t0 as (select least(a.doc_id, b.doc_id) as a, greatest(a.doc_id, b.doc_id) as b, count(*)::double as weight from (select distinct source_document_id as doc_id, subject from kg_facts where source_document_id is not null and subject is not null) a
 join (select distinct source_document_id as doc_id, subject from kg_facts where source_document_id is not null and subject is not null) b on a.subject = b.subject and a.doc_id < b.doc_id
 where a.subject in (select subject from kg_facts where source_document_id is not null group by 1 having count(distinct source_document_id) between 2 and 6) group by 1, 2)"""


def tunnels(t):
    """Stored tunnels: documents that state facts of one subject, for subjects of a few documents."""
    f = t("kg_facts").filter("source_document_id is not null and subject is not null").select(F.col("source_document_id").alias("doc_id"), "subject").distinct()
    few = f.groupBy("subject").agg(F.count("*").alias("n")).filter("n between 2 and 6").select("subject")
    own = f.join(few, "subject")
    pairs = own.withColumnRenamed("doc_id", "x").join(own.withColumnRenamed("doc_id", "y"), "subject").filter("x < y")
    made = pairs.select("x", "y", F.lit(1.0).alias("weight"))
    return L.tunnelled(None, made)


@query(f"with {TUNNELS} select a, b, weight from t0")
def create_tunnels(t):
    """Undirected pairs, each once however it is given, weights added."""
    return tunnels(t)


@query(f"with {TUNNELS}, m as (select a as n from t0 union all select b from t0), top as (select n from m group by 1 order by count(*) desc, n limit 1) select a, b, weight from t0 where a = (select n from top) or b = (select n from top)")
def list_tunnels(t):
    """Tunnels of the best connected document."""
    x = tunnels(t)
    top = x.select(F.col("a").alias("n")).union(x.select("b")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return x.join(F.broadcast(top), (F.col("a") == F.col("n")) | (F.col("b") == F.col("n"))).select("a", "b", "weight")  # one row


@query(f"""with recursive {TUNNELS}, u as (select a as x, b as y from t0 union all select b, a from t0), m as (select x from u group by 1 order by count(*) desc, x limit 1), r(node, depth) as (select x, 0 from m union select y, depth + 1 from r join u on x = node where depth < 3) select node, min(depth) as depth from r group by 1""")
def follow_tunnels(t):
    """Documents within three tunnels of the best connected one."""
    x = tunnels(t)
    e = G.undirected(x.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    top = e.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("node"))
    return G.reach(e, top, 3)


@query(f"with {TUNNELS} select a, b, weight from t0 join documents p on p.doc_id = a join documents q on q.doc_id = b where trim(p.wing) = 'atlas' or trim(q.wing) = 'atlas' order by weight desc, a, b limit 40")
def find_tunnels(t):
    """Tunnels with an end in a wing, the heaviest first."""
    return L.tunnels_of_wing(tunnels(t), t("documents"), "atlas").orderBy(F.desc("weight"), "a", "b").limit(40)


@query(f"with {TUNNELS} select count(*) as n from t0 where not (a in (select min(a) from t0) and b in (select min(b) from t0 where a = (select min(a) from t0)))")
def delete_tunnel(t):
    """Tunnels left once the first is removed."""
    x = tunnels(t)
    first = x.orderBy("a", "b").limit(1).select("a", "b")
    return x.join(F.broadcast(first), ["a", "b"], "left_anti").agg(F.count("*").alias("n"))


@query("""select doc_id, action, case when action not in ('merge','archive','file','delete') then 'unknown action' when target is null and action in ('merge','file') then 'no target' else 'kept' end as verdict from (
 select doc_id, case doc_id % 5 when 0 then 'merge' when 1 then 'archive' when 2 then 'file' when 3 then 'delete' else 'publish' end as action, case when doc_id % 3 = 0 then null else doc_id - 1 end as target from documents)""")
def plan_filter(t):
    """Planned actions that are known and have the target they need, and why others are rejected."""
    k = F.col("doc_id") % 5
    plan = t("documents").select("doc_id", F.when(k == 0, "merge").when(k == 1, "archive").when(k == 2, "file").when(k == 3, "delete").otherwise("publish").alias("action"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") - 1).alias("target"))
    return L.filtered_plan(plan, ["merge", "archive", "file", "delete"], ["merge", "file"]).select("doc_id", "action", "verdict")


@query("""select doc_id, case when trim(coalesce(title,''), ' ') = '' then 'no title' when doc_id % 3 = 0 then 'conflict' else 'written' end as outcome, case when trim(coalesce(title,''), ' ') <> '' and doc_id % 3 <> 0 then coalesce(revision, 0) + 1 else revision end as revision from documents where kind = 'wiki_page'""")
def write_wiki_pages(t):
    """Pages after writes that name the revision they are based on: one of three names an old one and is refused."""
    pages = t("documents").filter("kind = 'wiki_page'")
    writes = pages.select("doc_id", "title", F.concat(F.coalesce("text", F.lit("")), F.lit("\\n")).alias("text"), F.when(F.col("doc_id") % 3 == 0, F.coalesce("revision", F.lit(0)) - 1).otherwise(F.coalesce("revision", F.lit(0))).alias("expected"))
    return L.written_pages(pages, writes).select("doc_id", "outcome", "revision")


@query("""with c as (select subject, source_document_id as doc_id, count(*) as n from kg_facts where source_document_id is not null and subject is not null and trim(subject) <> '' group by 1, 2),
r as (select subject, doc_id, row_number() over (partition by subject order by n desc, doc_id) as place from c qualify place <= 3)
select subject, '# ' || subject || chr(10) || chr(10) || string_agg('[' || place || '] ' || coalesce(title, 'untitled') || ' <' || coalesce(uri, '') || '>', chr(10) order by place) as page from r join documents using (doc_id) group by 1""")
def filed_answers(t):
    """A page for every subject that cites the documents with most facts of it, numbered in that order."""
    f = t("kg_facts").filter("source_document_id is not null and subject is not null and trim(subject) <> ''").groupBy("subject", F.col("source_document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    best = f.withColumn("place", F.row_number().over(W.partitionBy("subject").orderBy(F.desc("n"), "doc_id"))).filter("place <= 3")
    return L.answer_pages(best.join(t("documents").select("doc_id", "title", "uri"), "doc_id"), "subject")


@query("""select agent, place, note from (select 'agent-' || user_id % 7 as agent, row_number() over (partition by user_id % 7 order by ts, event_id) as place, event_type as note from events where event_type <> 'view')""")
def diary_write(t):
    """Notes appended to each agent's diary, numbered on in the order they were given."""
    e = t("events").filter("event_type <> 'view'").select(F.concat(F.lit("agent-"), F.col("user_id") % 7).alias("agent"), "ts", "event_id", F.col("event_type").alias("note"))
    return L.appended(e, "agent", ["ts", "event_id"]).select("agent", "place", "note")


@query("""select doc_id, case when kind = 'memory' and trim(coalesce(status,'')) <> 'tombstone' and doc_id % 4 = 0 then 'consolidated' else coalesce(nullif(trim(status),''),'active') end as status, case when kind = 'memory' and trim(coalesce(status,'')) <> 'tombstone' and doc_id % 4 = 0 then 1 end as output from documents""")
def consolidate_memories(t):
    """Chosen memories marked with the document that holds what they said; doing it twice changes nothing."""
    d = t("documents").select("doc_id", "kind", D.status_of().alias("status"), F.lit(None).cast("long").alias("output"))
    chosen = d.filter("doc_id % 4 = 0").select("doc_id")
    once = L.consolidated(d, chosen, 1)
    return L.consolidated(once, chosen, 1).select("doc_id", "status", "output")


@query("""select mode, n, round(recall, 6) as context_recall, null::double as faithfulness, round(mrr, 6) as mrr from (select event_type as mode, count(*) as n, avg(case when value >= 10 then 1e0 else 0e0 end) as recall, avg(1e0 / (1 + floor(value / 10))) as mrr from events group by 1)""")
def triad_report(t):
    """A row of metrics for each mode; what no judge measured stays null instead of nought."""
    runs = t("events").select(F.col("event_type").alias("mode"), F.when(F.col("value") >= 10, 1.0).otherwise(0.0).alias("context_recall"), (1 / (1 + F.floor(F.col("value") / 10))).alias("mrr"))
    return L.metric_report(runs, "mode", ["context_recall", "faithfulness", "mrr"]).select("mode", "n", *[F.round(c, 6).alias(c) for c in ("context_recall", "faithfulness", "mrr")])


@query("""select event_id, case when event_id % 3 = 0 then round(value / 100, 6) else 0.5 end as complete, case when event_id % 3 = 0 then 'model' else 'heuristic' end as judge, case when (case when event_id % 3 = 0 then round(value / 100, 6) else 0.5 end) >= 0.5 then 'pass' else 'fail' end as verdict from events""")
def merged_scores(t):
    """Heuristic scores, replaced where a model gave one."""
    e = t("events")
    base = e.select("event_id", F.lit(0.5).alias("complete"))
    model = e.filter("event_id % 3 = 0").select("event_id", F.round(F.col("value") / 100, 6).alias("complete"))
    return L.merged_scores(base, model, "event_id", "complete")


@query("select event_type as label, count(*) as n from events where json_extract_string(props, '$.k')::int < 30 group by 1")
def error_labels(t):
    """Labels read from JSON lines, counted."""
    lines = t("events").select(F.to_json(F.struct(F.col("event_id").alias("query_id"), F.col("event_type").alias("label"), "props")).alias("line"))
    return L.labels(lines, "line", "query_id bigint, label string, props string").filter(F.get_json_object("props", "$.k").cast("int") < 30).groupBy("label").agg(F.count("*").alias("n"))


@query("select event_id from events where event_type = 'error' and event_id % 3 <> 0")
def checkpoint_resume(t):
    """Queries of a run that no completed record covers."""
    e = t("events").select("event_id", "event_type")
    return L.remaining(e.filter("event_type = 'error'"), e.filter("event_id % 3 = 0"), "event_id").select("event_id")


@query("select event_type as mode, count(*) as runs, sum(case when (value >= 20) = (value >= 25) then 0 else 1 end)::bigint as changed from events group by 1")
def bundle_replay(t):
    """Stored verdicts judged again with another threshold, and how many change."""
    stored = t("events").select(F.col("event_type").alias("mode"), F.to_json(F.struct("event_id", "value", (F.col("value") >= 20).alias("passed"))).alias("run"))
    return L.replayed(stored, "run", "event_id bigint, value double, passed boolean", F.col("value") >= 25, "mode")


@query("""with recursive s as (select event_id as span, case when event_id % 8 <> 0 then event_id // 2 end as parent, value from events where event_id < 100000),
r(span, depth, path) as (select span, 0, span::varchar from s where parent is null union all select s.span, depth + 1, path || '/' || s.span from r join s on s.parent = r.span)
select span, depth, path from r""")
def trace_spans(t):
    """Spans with their depth and the path of spans around them."""
    s = t("events").select(F.col("event_id").alias("span"), F.when(F.col("event_id") % 8 != 0, F.floor(F.col("event_id") / 2)).alias("parent"))
    return L.nested_spans(s)


@query("select document_id, index_revision, case when document_id % 2 = 0 then 'acknowledged' else 'open' end as state from (select distinct document_id, index_revision from code_index_revision_files where document_id is not null and content_hash is null)")
def drift_acknowledge(t):
    """Findings marked as seen by their ids, all or none."""
    found = t("code_index_revision_files").filter("document_id is not null and content_hash is null").select("document_id", "index_revision").distinct()
    return L.acknowledged(found, found.filter("document_id % 2 = 0").select("document_id").distinct(), "document_id")


@query("select event_id, props from events where contains(props, '9') and event_id > 100 order by event_id limit 25")
def task_notes(t):
    """The next page of notes that hold a literal text, after a given one."""
    return L.note_page(t("events").select("event_id", "props"), "event_id", "props", "9", 100, 25)


@query("""select doc_id, case when kind = 'code' then 'code' when regexp_matches(text, '(^|\\n)#{1,6} ') then 'sections' else 'prose' end as profile from documents where text is not null""")
def chunk_profiles_chosen(t):
    """How each document is cut: code by lines, marked-up prose by sections, other prose by size."""
    return L.chunk_profile(t("documents").filter("text is not null"), "doc_id", "text", "kind")


@query("select 'audit' as extension, 'audit_log' as table_name, 3 as columns union all select 'tags', 'tag_index', 2")
def schema_extensions(t):
    """Tables that extensions register besides the library's own; one name can be taken once."""
    own = L.Extensions()
    own.register("audit", "audit_log", "id bigint, at timestamp, what string")
    own.register("tags", "tag_index", "tag string, doc_id bigint")
    own.register("tags", "tag_index", "tag string, doc_id bigint")
    return own.tables(t("region").sparkSession)


@query("""with m as (select canonical_path as p, max(document_id) as doc from source_manifest group by 1), s as (select distinct canonical_path as p from source_scan)
select coalesce(m.p, s.p) as canonical_path, case when s.p is null then 'deleted' when m.p is null then 'added' else 'known' end as state from m full join s on m.p = s.p""")
def source_manifest_diff(t):
    """Files of the manifest that were seen no more, files seen for the first time, and the others."""
    m, s = t("source_manifest").select("canonical_path").distinct(), t("source_scan").select("canonical_path").distinct()
    return L.seen_against_known(m, s, "canonical_path")


@query("""with d as (select user_id as key, ts, event_id from events), a as (select user_id, event_id, row_number() over (partition by user_id, event_type order by event_id) as k from events)
select event_id, min(event_id) over (partition by user_id, event_type) + 1000 as primary_seq, k = 1 as fresh from (select e.*, row_number() over (partition by user_id, event_type order by event_id) as k from events e)""")
def replayed_changes(t):
    """Changes of an origin under one key: the first gets a number, a replay returns the number it got then."""
    return L.accepted(t("events"), ["user_id", "event_type"], "event_id").select("event_id", (F.col("first") + 1000).alias("primary_seq"), "fresh")


@query("""with h as (select sha256(text) as h, min(doc_id) as keep from documents where text is not null group by 1 having count(*) > 1), m as (select doc_id, keep from documents join h on sha256(text) = h.h)
select distinct coalesce(k.keep, f.source_document_id) as doc_id, subject, predicate, object from kg_facts f left join m k on k.doc_id = f.source_document_id where f.source_document_id is not null""")
def rewired_facts(t):
    """Facts of duplicate documents pointed at the one that stays, each once."""
    d = t("documents").filter("text is not null").select("doc_id", D.content_key().alias("h"))
    keep = d.groupBy("h").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    moved = d.join(keep, "h").select("doc_id", "keep")
    return L.rewired(t("kg_facts").filter("source_document_id is not null").select(F.col("source_document_id").alias("doc_id"), "subject", "predicate", "object"), "doc_id", moved)


@query(f"""with {PS.BM25}, h as (select key, row_number() over (order by score desc, key) as r from lex qualify r <= 30), s as (select r, key, length('[' || r || '] T' || key || chr(10)) + case when r > 1 then 2 else 0 end as head, length(content) as n from h join c on c.id = key)
select key, least(n, 2000 - coalesce(sum(head + n) over (order by r rows between unbounded preceding and 1 preceding), 0) - head) as kept from s qualify coalesce(sum(head + n) over (order by r rows between unbounded preceding and 1 preceding), 0) + head < 2000""")
def packed_context(t):
    """Hits in order within a budget of characters, headers and separators charged, the last body cut to what is left."""
    hits = S.ranked(S.top_k(PS.lexical(t), 30)).select("key", "rank")
    c = hits.join(PS.chunks(t).select(F.col("id").alias("key"), "content"), "key").withColumn("title", F.concat(F.lit("T"), F.col("key").cast("string")))
    return L.packed(c, 2000).select("key", F.length("body").alias("kept"))


@query(r"""select doc_id, coalesce(nullif(regexp_replace(lower(trim(coalesce(project, ''))), '[^a-z0-9]+', '-', 'g'), ''), 'unfiled') || '/' || doc_id || '.md' as file, 6 + (case when title is null then 0 else 0 end) as head_lines from (select doc_id, wing as project, title from documents)""")
def vault_files(t):
    """One markdown file for each document: its path under the project's folder, and its front matter."""
    v = L.vault(t("documents"))
    return v.select("doc_id", "file", F.size(F.split(F.regexp_extract("page", r"(?s)^(---\n.*?\n---)\n", 1), "\n")).alias("head_lines"))
