"""Code-analysis queries over indexed sources and revisions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import code as C
from corvane.operators import documents as D
from corvane.operators import search as S
from corvane.plans.base import Plans

P = Plans()
query = P.query
DEFS = r"""s as (select canonical_path, unnest(n) as name, generate_subscripts(n, 1) - 1 as ordinal from (select canonical_path, regexp_extract_all(content, '(?m)^\s*(?:pub fn|def|fn|function|class|struct)\s+([A-Za-z_][0-9A-Za-z_]*)', 1) as n from code_index_source_blobs))"""
REFS = r"""r as (select canonical_path, name, count(*) as n from (select canonical_path, unnest(regexp_extract_all(content, '([A-Za-z_][0-9A-Za-z_]*)\(', 1)) as name from code_index_source_blobs) group by 1, 2)"""
LIVE = "f as (select * from code_index_revision_files where index_revision = (select max(rev_id) from code_index_revisions) and document_id is not null), l as (select document_id, max(document_revision) as document_revision, any_value(path) as path, any_value(project) as project, any_value(content_hash) as content_hash, any_value(analysis_json) as j from f group by 1)"


def blobs(t):
    return t("code_index_source_blobs").filter("content is not null")


def live(t):
    """Files of the newest published revision, each once."""
    newest = t("code_index_revisions").agg(F.max("rev_id").alias("index_revision"))
    f = t("code_index_revision_files").filter("document_id is not null").join(F.broadcast(newest), "index_revision", "left_semi")
    return D.latest(f, ["document_id"], [F.desc("document_revision")])


@query(f"with {DEFS} select canonical_path, ordinal, name from s")
def code_symbols(t):
    return C.symbols(blobs(t))


@query(f"with {REFS} select canonical_path, name, n from r")
def code_references(t):
    return C.references(blobs(t))


@query(f"with {DEFS}, {REFS}, c as (select name, count(*) as k, min(canonical_path) as p from s group by 1) select r.canonical_path, r.name, n, coalesce(k, 0) as candidates, case when k = 1 then p end as target from r left join c on c.name = r.name")
def resolve_references(t):
    return C.resolve(C.references(blobs(t)), C.symbols(blobs(t)))


@query(r"""select canonical_path, lower(name) as table_name, count(*) as reads from (select canonical_path, unnest(regexp_extract_all(content, '(?i)\b(?:from|join)\s+([A-Za-z_][0-9A-Za-z_.]*)', 1)) as name from code_index_source_blobs) group by 1, 2""")
def sql_table_usage(t):
    return C.table_reads(blobs(t))


@query(f"with {DEFS} select canonical_path, name from s where name = 'main' or name like 'test%' or name like 'sync%'")
def entrypoints(t):
    n = F.col("name")
    return C.symbols(blobs(t)).filter((n == "main") | n.startswith("test") | n.startswith("sync")).select("canonical_path", "name")


@query(f"with {DEFS} select regexp_replace(lower(name), '_[a-z]+$', '') as family, count(*) as members, count(distinct canonical_path) as files from s group by 1 having count(*) > 1")
def name_families(t):
    return C.symbols(blobs(t)).groupBy(F.regexp_replace(F.lower("name"), "_[a-z]+$", "").alias("family")).agg(
        F.count("*").alias("members"), F.countDistinct("canonical_path").alias("files")).filter("members > 1")


@query(r"""select family, count(*) as files from (select regexp_replace(regexp_replace(lower(regexp_extract(canonical_path, '([^/]+)$', 1)), '[.][^.]*$', ''), '(?:[ _-]*(?:copy|backup|old|final|[0-9]+))+$', '') as family
 from (select distinct canonical_path from source_manifest)) group by 1 having count(*) > 1""")
def duplicate_families(t):
    return t("source_manifest").select("canonical_path").distinct().groupBy(C.family(F.col("canonical_path")).alias("family")).agg(F.count("*").alias("files")).filter("files > 1")


@query(r"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null)
select doc_id, len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) as shingles from w where len(w) >= 5""")
def shingle_counts(t):
    w = t("documents").filter("text is not null").select("doc_id", S.tokens(F.col("text")).alias("w")).filter(F.size("w") >= 5)
    return w.select("doc_id", F.size(C.shingles(F.col("w"), 5)).alias("shingles"))


@query(f"with {LIVE} select project, json_extract_string(j, '$.language') as language, count(*) as files, sum(json_extract_string(j, '$.symbols')::bigint)::bigint as symbols, sum(json_extract_string(j, '$.unresolved')::bigint)::bigint as unresolved from l group by 1, 2")
def index_status(t):
    j = lambda k: F.get_json_object("analysis_json", f"$.{k}")
    return live(t).groupBy("project", j("language").alias("language")).agg(
        F.count("*").alias("files"), F.sum(j("symbols").cast("long")).alias("symbols"), F.sum(j("unresolved").cast("long")).alias("unresolved"))


@query("select rev_id, max(fingerprint) as fingerprint, max(epoch_us(created_at)) as created_us from code_index_revisions group by 1 order by rev_id desc limit 5")
def history_list(t):
    return t("code_index_revisions").groupBy("rev_id").agg(F.max("fingerprint").alias("fingerprint"), F.max(F.unix_micros("created_at")).alias("created_us")).orderBy(F.desc("rev_id")).limit(5)


@query("select distinct rev_id, json_extract_string(graph_json, '$.nodes')::bigint as nodes, json_extract_string(graph_json, '$.edges')::bigint as edges from code_index_revisions")
def revision_graph(t):
    g = lambda k: F.get_json_object("graph_json", f"$.{k}").cast("long")
    return t("code_index_revisions").select("rev_id", g("nodes").alias("nodes"), g("edges").alias("edges")).distinct()


@query(f"with {LIVE}, b as (select content_hash as h, canonical_path as p from code_index_source_blobs) select state, count(*) as n from (select case when l.content_hash is null then 'unreadable' when b.h is null then 'missing' else 'fresh' end as state from l left join (select distinct h from b) b on b.h = l.content_hash) group by 1")
def index_freshness(t):
    seen = t("code_index_source_blobs").select("content_hash", F.lit(True).alias("seen")).distinct()
    state = F.when(F.col("content_hash").isNull(), "unreadable").when(F.col("seen").isNull(), "missing").otherwise("fresh")
    return live(t).join(seen, "content_hash", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""with r as (select distinct index_revision, document_id, document_revision, content_hash from code_index_revision_files where document_id is not null and index_revision in (select rev_id from code_index_revisions)),
n as (select *, lag(content_hash) over (partition by document_id order by index_revision, document_revision) as before, row_number() over (partition by document_id order by index_revision, document_revision) as k from r)
select document_id, index_revision, document_revision from n where k > 1 and before is distinct from content_hash""")
def drift_report(t):
    from pyspark.sql import Window as W

    known = t("code_index_revisions").select(F.col("rev_id").alias("index_revision")).distinct()
    r = t("code_index_revision_files").filter("document_id is not null").select("index_revision", "document_id", "document_revision", "content_hash").distinct()
    w = W.partitionBy("document_id").orderBy("index_revision", "document_revision")
    n = r.join(F.broadcast(known), "index_revision", "left_semi").withColumn("before", F.lag("content_hash").over(w)).withColumn("k", F.row_number().over(w))
    return n.filter((F.col("k") > 1) & ~F.col("before").eqNullSafe(F.col("content_hash"))).select("document_id", "index_revision", "document_revision")


@query(f"with {LIVE} select count(*) as files, count(distinct project) as projects, avg(case when content_hash is null then 1.0 else 0.0 end)::double as unreadable_share from l")
def documentation_quality(t):
    return live(t).agg(
        F.count("*").alias("files"), F.countDistinct("project").alias("projects"),
        F.avg(F.when(F.col("content_hash").isNull(), 1.0).otherwise(0.0)).alias("unreadable_share"))


@query(f"with {LIVE} select project, case when sum(json_extract_string(j, '$.unresolved')::bigint) * 4 > sum(json_extract_string(j, '$.references')::bigint) then 'deny' when sum(json_extract_string(j, '$.unresolved')::bigint) * 9 > sum(json_extract_string(j, '$.references')::bigint) then 'ask' else 'allow' end as decision from l group by 1")
def gate_decision(t):
    j = lambda k: F.sum(F.get_json_object("analysis_json", f"$.{k}").cast("long"))
    return live(t).groupBy("project").agg(
        F.when(j("unresolved") * 4 > j("references"), "deny").when(j("unresolved") * 9 > j("references"), "ask").otherwise("allow").alias("decision"))


@query(r"select canonical_path, array_to_string(list_slice(string_split(content, chr(10)), 3, 6), chr(10)) as source_lines from code_index_source_blobs")
def code_read(t):
    """Lines 3 to 6 of every source."""
    return blobs(t).select("canonical_path", F.array_join(F.slice(F.split("content", "\n"), 3, 4), "\n").alias("source_lines"))


@query("""with m as (select distinct regexp_extract(canonical_path, '([^/]+)$', 1) as name from code_index_source_blobs union select distinct regexp_extract(path, '([^/]+)$', 1) from code_index_revision_files where path is not null),
w as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_-]+[.][a-z]{2,4}'))) as name from documents where text is not null)
select w.name, count(*) as mentions, m.name is not null as indexed from w left join m on m.name = w.name group by 1, 3""")
def literal_mentions(t):
    """File names that documents mention, and whether an indexed file has that name."""
    last = lambda c: F.regexp_extract(c, "([^/]+)$", 1).alias("name")
    known = t("code_index_source_blobs").select(last("canonical_path")).union(t("code_index_revision_files").filter("path is not null").select(last("path"))).distinct().withColumn("k", F.lit(True))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_-]+[.][a-z]{2,4})"), F.lit(1)))
    said = t("documents").filter("text is not null").select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))
    return said.join(known, "name", "left").select("name", "mentions", F.coalesce("k", F.lit(False)).alias("indexed"))


@query("""with a as (select regexp_extract(canonical_path, '^/[^/]+/([^/]+)', 1) as project, regexp_extract(lower(canonical_path), '[.]([^./]+)$', 1) as ext from code_index_source_blobs)
select project, count(*) as files, count(*) filter (ext in ('py','rs','sql','sh')) as code_files from a group by 1""")
def catalog_projects(t):
    p = F.col("canonical_path")
    a = t("code_index_source_blobs").select(F.regexp_extract(p, "^/[^/]+/([^/]+)", 1).alias("project"), F.regexp_extract(F.lower(p), "[.]([^./]+)$", 1).alias("ext"))
    return a.groupBy("project").agg(F.count("*").alias("files"), F.count_if(F.col("ext").isin("py", "rs", "sql", "sh")).alias("code_files"))


@query()
def python_facts(t):
    """Classes, functions and calls of the Python sources, by their syntax tree."""
    return C.python_facts(blobs(t))


@query("""with r as (select rev_id, lead(rev_id) over (order by rev_id) as next from (select distinct rev_id from code_index_revisions)),
f as (select index_revision, document_id, arg_max({'h': content_hash}, coalesce(document_revision, -1)).h as h from code_index_revision_files where document_id is not null group by all),
a as (select next as rev, document_id, h from f join r on rev_id = index_revision where next is not null), b as (select index_revision as rev, document_id, h from f where index_revision in (select next from r))
select coalesce(a.rev, b.rev) as index_revision, case when a.document_id is null then 'added' when b.document_id is null then 'removed' when a.h is distinct from b.h then 'changed' else 'same' end as change, count(*) as n
from a full join b on a.rev = b.rev and a.document_id = b.document_id group by 1, 2""")
def revision_diff(t):
    """Files added, removed, changed in content and kept at every published revision; of several rows of a file the highest document revision's."""
    r = t("code_index_revisions").select("rev_id").distinct()
    order = r.select(F.sort_array(F.collect_set("rev_id").over(W.partitionBy())).alias("all"), "rev_id").select("rev_id", F.expr("get(all, int(array_position(all, rev_id)))").alias("next"))  # a handful of revisions
    f = t("code_index_revision_files").filter("document_id is not null").groupBy(F.col("index_revision").alias("rev_id"), "document_id").agg(
        F.max_by("content_hash", F.coalesce("document_revision", F.lit(-1))).alias("h")).join(F.broadcast(order), "rev_id")
    a = f.filter("next is not null").select(F.col("next").alias("rev"), "document_id", F.col("h").alias("a"), F.lit(True).alias("has_a"))
    first = order.agg(F.min("rev_id").alias("m"))
    b = f.join(F.broadcast(first), f.rev_id > F.col("m")).select(F.col("rev_id").alias("rev"), "document_id", F.col("h").alias("b"), F.lit(True).alias("has_b"))
    j = a.join(b, ["rev", "document_id"], "full")
    change = F.when(F.col("has_a").isNull(), "added").when(F.col("has_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return j.groupBy(F.col("rev").alias("index_revision"), change.alias("change")).agg(F.count("*").alias("n"))
