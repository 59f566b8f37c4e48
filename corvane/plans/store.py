"""Store queries: scans, filters, lookups, joins, counts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import lifecycle as L
from corvane.plans.base import Plans
from corvane.sources import files

P = Plans()
query = P.query
ACTIVE = "coalesce(nullif(trim(status),''),'active') not in ('archived','tombstone')"
US = "epoch_us(%s)"


@query("select doc_id, title, kind from documents")
def scan_projected(t):
    return t("documents").select("doc_id", "title", "kind")


@query("select doc_id, upper(title) as shout from documents where title is not null and n_chars > 200")
def scan_filter_map(t):
    return t("documents").filter("title is not null and n_chars > 200").select("doc_id", F.upper("title").alias("shout"))


@query(r"""select doc_id from documents where (kind in ('note','paper') or status is null) and not (lang = 'en')
 and title is not null and lower(title) like '%e%' and contains(text, '.') and regexp_matches(text, '[0-9]+\.[0-9]')""")
def predicate_grammar(t):
    d = t("documents")
    return d.filter(
        (d.kind.isin("note", "paper") | d.status.isNull()) & ~(d.lang == "en") & d.title.isNotNull()
        & d.title.ilike("%e%") & d.text.contains(".") & d.text.rlike(r"[0-9]+\.[0-9]")
    ).select("doc_id")


@query("select doc_id, kind from documents where kind = 'paper' order by doc_id limit 20")
def query_filter_take(t):
    return t("documents").filter("kind = 'paper'").orderBy("doc_id").limit(20).select("doc_id", "kind")


@query("select doc_id, title from documents where uri = (select min(uri) from documents)")
def find_by_uri(t):
    d = t("documents")
    return d.join(F.broadcast(d.agg(F.min("uri").alias("uri"))), "uri", "left_semi").select("doc_id", "title")


@query("select doc_id, title, kind from documents where doc_id = 7")
def get_by_id(t):
    return t("documents").filter("doc_id = 7").select("doc_id", "title", "kind")


@query("select count(*) > 0 as found from documents where doc_id = 7")
def exists_by_id(t):
    return t("documents").filter("doc_id = 7").agg((F.count("*") > 0).alias("found"))


@query("select count(*) as n, count(*) filter (kind = 'note') as notes, count(*) filter (status is null) as no_status from documents")
def count_rows(t):
    return t("documents").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("status").isNull()).alias("no_status"))


@query(f"select doc_id, wing, kind from documents where {ACTIVE} and trim(wing) = 'atlas' and trim(room) = 'papers'")
def scope_filter(t):
    return D.scope(t("documents"), wing="atlas", room=" papers ", layer="").select("doc_id", "wing", "kind")


@query(f"""select doc_id, title, {US % 'updated_at'} as updated_us, pinned, boost from (select *, doc_id in (select document_id from source_manifest where size_bytes > 2000 and document_id is not null) as pinned, length(coalesce(lang, '')) as boost from documents)
 where {ACTIVE} and trim(kind) = 'note' order by pinned desc, boost desc, updated_at desc nulls last, title asc nulls first, doc_id limit 50""")
def document_list(t):
    """Pinned notes first, then by boost, age and title. (Documents of large files count as pinned, language codes' length as boost.)"""
    large = t("source_manifest").filter("size_bytes > 2000").select(F.col("document_id").alias("doc_id"), F.lit(True).alias("p")).distinct()
    d = D.scope(t("documents"), kind="note").join(large, "doc_id", "left").withColumn("pinned", F.coalesce("p", F.lit(False))).withColumn("boost", F.length(F.coalesce("lang", F.lit(""))))
    return D.listed(d, 50).select("doc_id", "title", F.unix_micros("updated_at").alias("updated_us"), "pinned", "boost")


@query("""with m as (select document_id, min(canonical_path) as source_file from source_manifest group by 1),
h as (select doc_id, title, doc_id in (select source_document_id from kg_facts) as compiled from documents left join m on document_id = doc_id where trim(kind) = 'note'
 and (lower(coalesce(title,'')) like '%note%' or lower(coalesce(uri,'')) like '%note%' or lower(coalesce(source_file,'')) like '%note%'))
select doc_id, title, compiled, (select count(*) from h where compiled) as total from h where compiled order by doc_id limit 25 offset 10""")
def document_catalog_page(t):
    """A page of the notes that facts were taken from, found by title, address or file."""
    m = t("source_manifest").groupBy(F.col("document_id").alias("doc_id")).agg(F.min("canonical_path").alias("source_file"))
    compiled = t("kg_facts").select(F.col("source_document_id").alias("doc_id"))
    page = D.catalog_page(t("documents").join(m, "doc_id", "left"), "NOTE", 10, 25, compiled, True, kind="note")
    return page.select("doc_id", "title", "compiled", "total")


@query("select doc_id from documents where doc_id > 500 order by doc_id limit 100")
def document_keyset_page(t):
    return D.keyset(t("documents").select("doc_id"), "doc_id", 500, 100)


@query("select doc_id from documents d where not exists (select 1 from chunks c where c.document_id = d.doc_id) order by doc_id limit 200")
def graph_rebuild_candidates(t):
    d = t("documents").select("doc_id")
    return D.keyset(d.join(t("chunks").select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti"), "doc_id", None, 200)


@query(f"select doc_id, count(*) over () as total from documents where {ACTIVE} and trim(coalesce(wing,'')) = '' order by doc_id limit 50")
def active_unscoped(t):
    d = D.scope(t("documents")).filter(D.blank("wing") == "")
    return d.select("doc_id").join(F.broadcast(d.agg(F.count("*").alias("total")))).orderBy("doc_id").limit(50)


@query("select doc_id, sha256(text) as hash from documents where doc_id in (1,2,3,50,51)")
def content_hashes(t):
    return t("documents").filter(F.col("doc_id").isin(1, 2, 3, 50, 51)).select("doc_id", D.content_key().alias("hash"))


@query("""select pos, a.doc_id, title, d.created_at is null as missing from (values (0,5),(1,999999999),(2,1),(3,5)) a(pos, doc_id)
 left join documents d using (doc_id)""")
def multi_get(t):
    d = t("documents")
    return D.multi_get(d.sparkSession, d, [5, 999999999, 1, 5]).select("pos", "doc_id", "title", "missing")


@query("""with c as (select distinct document_id, chunk_index, char_start from chunks)
select s.document_id, s.chunk_index as seed, c.chunk_index, c.char_start from (select distinct document_id, chunk_index from chunks where chunk_index = 3) s
join c on c.document_id = s.document_id and c.chunk_index between s.chunk_index - 2 and s.chunk_index + 2""")
def expand_chunks(t):
    c = t("chunks")
    return D.expand_chunks(c, c.filter("chunk_index = 3").select("document_id", "chunk_index").distinct(), 2).select(
        "document_id", "seed", "chunk_index", "char_start")


@query("select distinct id, chunk_index, length(content) as chars from chunks where document_id = (select min(document_id) from chunks where chunk_index = 2)")
def chunk_list(t):
    c = t("chunks")
    one = c.filter("chunk_index = 2").agg(F.min("document_id").alias("document_id"))
    return c.join(F.broadcast(one), "document_id", "left_semi").select("id", "chunk_index", F.length("content").alias("chars")).distinct()


@query("""select a.id, min(b.id) as reuse_id from chunks a join chunks b on sha256(a.content) = sha256(b.content) and b.embedding is not null
 where a.embedding is null group by 1""")
def chunk_vectors_by_content(t):
    c = t("chunks")
    have = c.filter("embedding is not null").groupBy(D.content_key("content").alias("h")).agg(F.min("id").alias("reuse_id"))
    return c.filter("embedding is null").select("id", D.content_key("content").alias("h")).distinct().join(have, "h").select("id", "reuse_id")


@query("select event_id, event_type from events where event_type in ('signup','purchase') order by event_id desc limit 30")
def ops_log_recent(t):
    return t("events").filter(F.col("event_type").isin("signup", "purchase")).orderBy(F.desc("event_id")).limit(30).select("event_id", "event_type")


@query("select event_id, event_type, props from events where event_id = 77 or json_extract_string(props, '$.k') = '9' order by event_id")
def ops_log_entry(t):
    """Entries of the log by their number or their key."""
    return t("events").filter((F.col("event_id") == 77) | (F.get_json_object("props", "$.k") == "9")).select("event_id", "event_type", "props")


@query(f"select doc_id, title from documents where layer = 'wiki' and {ACTIVE}")
def wiki_page_list(t):
    return D.scope(t("documents"), layer="wiki").select("doc_id", "title")


@query(f"select doc_id, revision from documents where kind = 'memory' and {ACTIVE} order by created_at desc, doc_id limit 40")
def diary_list(t):
    return D.scope(t("documents"), kind="memory").orderBy(F.desc("created_at"), "doc_id").limit(40).select("doc_id", "revision")


@query("select doc_id, kind from documents where trim(status) = 'tombstone'")
def lifecycle_candidates(t):
    return t("documents").filter(F.trim("status") == "tombstone").select("doc_id", "kind")


ENDINGS = ", ".join(repr(e) for e in [*files.DOCUMENTS.split(), *(e for v in files.LANGUAGES.values() for e in v.split())])
ODD_FILES = ("/x/Dockerfile", "/x/Dockerfile.dev", "/x/go.mod", "/x/.gitignore", "/x/README", "/x/a.PY", "/x/archive.tar.gz", "/x/my.dockerfile")


@query(f"""select path, supported from (values ('/x/Dockerfile', true), ('/x/Dockerfile.dev', true), ('/x/go.mod', true), ('/x/.gitignore', false), ('/x/README', false), ('/x/a.PY', true), ('/x/archive.tar.gz', false), ('/x/my.dockerfile', true)) v(path, supported)
union all select path, regexp_extract(lower(path), '[.]([^./]+)$', 1) in ({ENDINGS}) from (select distinct canonical_path as path from source_manifest)""")
def supported_source(t):
    """Files that can be read, of the manifest and some with odd names."""
    m = t("source_manifest").select(F.col("canonical_path").alias("path")).distinct()
    some = m.sparkSession.createDataFrame([(x,) for x in ODD_FILES], "path string")
    return some.unionByName(m).select("path", files.is_supported(F.col("path")).alias("supported"))


@query("""select request_id, regexp_extract(uri, '^[a-z]+://([^/]+)', 1) as host,
 regexp_extract(uri, '^[a-z]+://([^/]+)', 1) in ('atlas', 'beacon') or regexp_extract(uri, '^[a-z]+://([^/]+)', 1) like '%.lantern' as allowed from ingest_requests where uri is not null""")
def host_allowed(t):
    """Whether the host of an address is of a list, exact or below a wildcard."""
    u = L.checked_urls(t("ingest_requests").filter("uri is not null"), "uri", ["atlas", "beacon", "*.lantern"], ("vault",), ["request_id"])
    return u.select("request_id", "host", (F.col("verdict") == "ok").alias("allowed"))


@query("""select content_type, url, kind from (values ('text/html; charset=utf-8','/a','html'), ('TEXT/MARKDOWN','/a.html','markdown'), ('text/plain','/a.md','markdown'), ('text/plain','/a','text'), (null,'/a.md?x=1','markdown'), (null,'/a.txt#y','text'), ('application/pdf','/a.pdf',null), ('application/xhtml+xml',null,'html')) v(content_type, url, kind)
union all select null, path, case when regexp_matches(lower(path), '[.](md|markdown)$') then 'markdown' when regexp_matches(lower(path), '[.]txt$') then 'text' else 'html' end from (select distinct path from ingest_requests where path is not null and not contains(path, '?') and not contains(path, '#'))""")
def content_type_classify(t):
    """Kinds of pages by content type and address."""
    p = t("ingest_requests").filter("path is not null and not contains(path, '?') and not contains(path, '#')").select(F.lit(None).cast("string").alias("content_type"), F.col("path").alias("url")).distinct()
    rows = [("text/html; charset=utf-8", "/a"), ("TEXT/MARKDOWN", "/a.html"), ("text/plain", "/a.md"), ("text/plain", "/a"), (None, "/a.md?x=1"), (None, "/a.txt#y"), ("application/pdf", "/a.pdf"), ("application/xhtml+xml", None)]
    both = p.sparkSession.createDataFrame(rows, "content_type string, url string").unionByName(p)
    return both.select("content_type", "url", files.page_kind(F.col("content_type"), F.col("url")).alias("kind"))


@query("""select request_id, json_extract_string(metadata_json, '$.author') as author, json_extract_string(metadata_json, '$.n') as n from ingest_requests""")
def metadata_fields(t):
    return t("ingest_requests").select(
        "request_id", F.get_json_object("metadata_json", "$.author").alias("author"), F.get_json_object("metadata_json", "$.n").alias("n"))


@query("""select count(*) as docs, coalesce(sum(strlen(text)), 0)::bigint as bytes, max(strlen(text)) as largest, count(*) <= 100000 and coalesce(sum(strlen(text)), 0) <= 1000000 as fits from documents""")
def portable_preflight(t):
    """What an export would hold against its limits."""
    return files.preflight(t("documents"), "text", 100_000, 1_000_000)


@query("""select canonical_path, size_bytes, document_id from source_manifest where canonical_root = '/vaults/atlas/decisions'""")
def source_manifest_root(t):
    return t("source_manifest").filter("canonical_root = '/vaults/atlas/decisions'").select("canonical_path", "size_bytes", "document_id")


@query("select document_id as doc_id, id as chunk_id, title, uri from (select distinct id, document_id from chunks) join documents on document_id = doc_id")
def hit_hydration(t):
    """Every chunk with its document's title and address."""
    hits = t("chunks").select(F.col("document_id").alias("doc_id"), F.col("id").alias("chunk_id")).distinct()
    return hits.join(t("documents").select("doc_id", "title", "uri"), "doc_id")


@query(f"select id from chunks where document_id in (select doc_id from documents where {ACTIVE} and trim(wing) = 'loom')")
def scope_semi_join(t):
    allowed = D.scope(t("documents"), wing="loom").select(F.col("doc_id").alias("document_id"))
    return t("chunks").select("id", "document_id").join(allowed, "document_id", "left_semi").select("id")


@query("select doc_id from documents where length(trim(coalesce(text,''), ' ')) > 0 and doc_id not in (select document_id from chunks where document_id is not null)")
def missing_chunks(t):
    return t("documents").filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select("doc_id").join(
        t("chunks").select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")


@query("""select doc_id from documents where coalesce(nullif(trim(layer),''),'raw') = 'raw'
 and not exists (select 1 from kg_facts where source_document_id = doc_id)""")
def uncompiled_raw(t):
    raw = t("documents").filter(F.coalesce(F.nullif(D.blank("layer"), F.lit("")), F.lit("raw")) == "raw").select("doc_id")
    return raw.join(t("kg_facts").select(F.col("source_document_id").alias("doc_id")), "doc_id", "left_anti")


@query("select doc_id from documents where doc_id in (select source_document_id from kg_facts union select document_id from source_manifest)")
def compiled_ids(t):
    cited = t("kg_facts").select(F.col("source_document_id").alias("doc_id")).union(t("source_manifest").select("document_id")).distinct()
    return t("documents").select("doc_id").join(cited, "doc_id", "left_semi")


@query("""with s as (select distinct subject, source_document_id as doc_id from kg_facts where subject is not null), r as (select subject, max(updated_at) as newest from s join documents using (doc_id) where layer = 'raw' group by 1)
select doc_id as wiki_id, count(*) as subjects, epoch_us(max(newest)) as newest_us from s join documents using (doc_id) join r using (subject) where layer = 'wiki' and updated_at < newest group by 1""")
def stale_wiki(t):
    """Wiki pages older than a raw document of one of their subjects; a subject's raw documents count by their newest."""
    f = t("kg_facts").filter("source_document_id is not null and subject is not null").select("subject", F.col("source_document_id").alias("doc_id")).distinct()
    d = t("documents").select("doc_id", "layer", "updated_at").filter(F.col("layer").isin("wiki", "raw"))
    s = f.join(d, "doc_id")
    raw = s.filter("layer = 'raw'").groupBy("subject").agg(F.max("updated_at").alias("newest"))
    hit = s.filter("layer = 'wiki'").join(raw, "subject").filter("updated_at < newest")
    return hit.groupBy(F.col("doc_id").alias("wiki_id")).agg(F.count("*").alias("subjects"), F.unix_micros(F.max("newest")).alias("newest_us"))


@query("select source, count(*) as n from documents group by 1")
def group_count_1(t):
    return D.counts_by(t("documents"), "source")


@query("select wing, room, count(*) as n from documents group by 1, 2")
def group_count_2(t):
    return D.counts_by(t("documents"), "wing", "room")


@query("select wing, room, kind, count(*) as n from documents group by 1, 2, 3")
def group_count_3(t):
    return D.counts_by(t("documents"), "wing", "room", "kind")


@query("select trim(wing) as wing, count(*) as n from documents where trim(coalesce(wing,'')) <> '' group by 1")
def wing_counts(t):
    return t("documents").filter(D.blank("wing") != "").groupBy(F.trim("wing").alias("wing")).agg(F.count("*").alias("n"))


@query("""select wing, room, count(*) as n, grouping_id(wing, room) as level from (select coalesce(nullif(trim(wing),''),'(unscoped)') as wing,
 coalesce(nullif(trim(room),''),'(none)') as room from documents) group by rollup (wing, room)""")
def taxonomy(t):
    named = t("documents").select(
        F.coalesce(F.nullif(D.blank("wing"), F.lit("")), F.lit("(unscoped)")).alias("wing"),
        F.coalesce(F.nullif(D.blank("room"), F.lit("")), F.lit("(none)")).alias("room"))
    return named.rollup("wing", "room").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""with b as (select coalesce(nullif(trim(layer),''),'raw') l, coalesce(nullif(trim(kind),''),'document') k,
 coalesce(nullif(trim(status),''),'active') s, coalesce(nullif(trim(wing),''),'(unscoped)') w from documents)
select 'layer' as bucket, l as value, count(*) as n from b group by 2 union all select 'kind', k, count(*) from b group by 2
union all select 'status', s, count(*) from b group by 2 union all select 'wing', w, count(*) from b group by 2""")
def corpus_counts(t):
    return D.corpus_counts(t("documents"))


@query("select avg(length(text)) as mean_chars, sum(length(text))::bigint as total_chars, count(*) as n from documents")
def size_stats(t):
    return t("documents").agg(F.avg(F.length("text")).alias("mean_chars"), F.sum(F.length("text")).alias("total_chars"), F.count("*").alias("n"))


@query("""select sha256(text) as hash, count(*) as n, arg_min(doc_id, (created_at, doc_id)) as survivor from documents where text is not null
 group by 1 having count(*) > 1""")
def exact_duplicate_groups(t):
    return D.duplicate_groups(t("documents")).select("hash", "n", "survivor")


@query("""with g as (select doc_id, first_value(doc_id) over w as survivor, count(*) over (partition by text) as n from documents where text is not null
 window w as (partition by text order by created_at, doc_id)) select doc_id, survivor from g where n > 1""")
def duplicate_survivors(t):
    return D.duplicate_members(t("documents"))


@query("""select doc_id, string_agg(reason, '+' order by reason) as reasons from (
 select doc_id, 'hash' as reason from documents where sha256(text) in (select sha256(text) from documents where text is not null group by 1 having count(*) > 1)
 union all select doc_id, 'uri' from documents where uri in (select uri from documents where uri is not null group by 1 having count(*) > 1)) group by 1""")
def duplicate_probe(t):
    d = t("documents").select("doc_id", "uri", D.content_key().alias("h"))
    many = lambda c: d.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(c)
    by_hash = d.join(many("h"), "h", "left_semi").select("doc_id", F.lit("hash").alias("reason"))
    by_uri = d.join(many("uri"), "uri", "left_semi").select("doc_id", F.lit("uri").alias("reason"))
    return by_hash.unionByName(by_uri).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), "+").alias("reasons"))


@query("""select 'chunks_without_document' as what, count(*) as n from chunks where document_id not in (select doc_id from documents)
union all select 'chunks_without_parent', count(*) from chunks where parent_chunk_id is not null and parent_chunk_id not in (select id from chunks)
union all select 'facts_without_document', count(*) from kg_facts where source_document_id is not null and source_document_id not in (select doc_id from documents)
union all select 'manifest_without_document', count(*) from source_manifest where document_id is not null and document_id not in (select doc_id from documents)
union all select 'files_without_revision', count(*) from code_index_revision_files where index_revision is not null and index_revision not in (select rev_id from code_index_revisions)""")
def integrity_counts(t):
    def orphans(what, df, key, of, of_key):
        ids = of.select(F.col(of_key).alias(key)).distinct()
        return df.filter(F.col(key).isNotNull()).join(ids, key, "left_anti").agg(F.lit(what).alias("what"), F.count("*").alias("n"))

    d, c = t("documents"), t("chunks")
    parts = [
        orphans("chunks_without_document", c, "document_id", d, "doc_id"),
        orphans("chunks_without_parent", c, "parent_chunk_id", c, "id"),
        orphans("facts_without_document", t("kg_facts"), "source_document_id", d, "doc_id"),
        orphans("manifest_without_document", t("source_manifest"), "document_id", d, "doc_id"),
        orphans("files_without_revision", t("code_index_revision_files"), "index_revision", t("code_index_revisions"), "rev_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""select coalesce(nullif(trim(layer),''),'raw') as layer, count(*) as n, count(*) filter (coalesce(nullif(trim(status),''),'active') = 'active') as active,
 count(*) filter (trim(coalesce(text,''), ' ') = '') as empty from documents group by 1""")
def layer_health(t):
    return t("documents").groupBy(F.coalesce(F.nullif(D.blank("layer"), F.lit("")), F.lit("raw")).alias("layer")).agg(
        F.count("*").alias("n"), F.count_if(D.status_of() == "active").alias("active"), F.count_if(D.blank("text") == "").alias("empty"))


@query("""select wing, room, count(*) as n from documents where coalesce(nullif(trim(layer),''),'raw') = 'raw'
 and not exists (select 1 from kg_facts where source_document_id = doc_id) group by 1, 2 order by n desc, wing nulls first, room nulls first limit 15""")
def uncompiled_shelves(t):
    raw = t("documents").filter(F.coalesce(F.nullif(D.blank("layer"), F.lit("")), F.lit("raw")) == "raw").select("doc_id", "wing", "room")
    left = raw.join(t("kg_facts").select(F.col("source_document_id").alias("doc_id")), "doc_id", "left_anti")
    return D.counts_by(left, "wing", "room").orderBy(F.desc("n"), F.col("wing").asc_nulls_first(), F.col("room").asc_nulls_first()).limit(15)


@query("select 'documents' as what, count(*) as n from documents union all select 'chunks', count(*) from chunks union all select 'facts', count(*) from kg_facts union all select 'files', count(*) from source_manifest")
def store_stats(t):
    one = lambda name, what: t(name).agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return one("documents", "documents").union(one("chunks", "chunks")).union(one("kg_facts", "facts")).union(one("source_manifest", "files"))


@query(f"""select count(*) as n, count(distinct room) as rooms, count(distinct uri) as uris, max({US % 'updated_at'}) as updated_us,
 count(*) filter ({ACTIVE}) as active from documents where wing = 'atlas'""")
def project_home(t):
    return t("documents").filter("wing = 'atlas'").agg(
        F.count("*").alias("n"), F.countDistinct("room").alias("rooms"), F.countDistinct("uri").alias("uris"),
        F.max(F.unix_micros("updated_at")).alias("updated_us"), F.count_if(~D.status_of().isin(*D.HIDDEN)).alias("active"))


@query(f"select canonical_root, count(distinct canonical_path) as files, max({US % 'last_seen'}) as seen_us, max({US % 'last_synced'}) as synced_us from source_manifest group by 1")
def source_roots(t):
    return t("source_manifest").groupBy("canonical_root").agg(
        F.countDistinct("canonical_path").alias("files"), F.max(F.unix_micros("last_seen")).alias("seen_us"), F.max(F.unix_micros("last_synced")).alias("synced_us"))


@query("""select canonical_path, lower(content_hash) as hash, count(*) as n, min(document_id) as survivor,
 case when count(distinct document_id) > 1 then 'review' else 'safe' end as safety from source_manifest where content_hash is not null group by 1, 2 having count(*) > 1""")
def source_duplicate_groups(t):
    return t("source_manifest").filter("content_hash is not null").groupBy("canonical_path", F.lower("content_hash").alias("hash")).agg(
        F.count("*").alias("n"), F.min("document_id").alias("survivor"),
        F.when(F.countDistinct("document_id") > 1, "review").otherwise("safe").alias("safety")).filter("n > 1")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(n) as calls, max(value) filter (i = floor((n - 1) * 0.5 + 0.5)) as p50, max(value) filter (i = floor((n - 1) * 0.95 + 0.5)) as p95 from r group by 1""")
def call_summary_percentiles(t):
    # ranks come from counts of distinct values, so no group's values are ever collected
    v = t("events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = W.partitionBy("event_type").orderBy("value")
    r = v.withColumn("hi", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy("event_type")))
    at = lambda q: F.max(F.when((F.floor((F.col("n") - 1) * F.lit(q) + F.lit(0.5)) < F.col("hi")) & (F.floor((F.col("n") - 1) * F.lit(q) + F.lit(0.5)) >= F.col("hi") - F.col("c")), F.col("value")))
    return r.groupBy("event_type").agg(F.max("n").alias("calls"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("select user_id, count(*) as calls, count(*) filter (event_type = 'error') as errors, max(epoch_us(ts)) as last_us from events group by 1")
def agent_activity(t):
    return t("events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))


@query("""select document_id, id from (select document_id, id, row_number() over (partition by document_id order by chunk_index, id) r from chunks) where r = 1""")
def embedding_representative(t):
    return D.latest(t("chunks").select("document_id", "id", "chunk_index"), ["document_id"], [F.col("chunk_index"), F.col("id")]).select("document_id", "id")


@query("""with v as (select distinct document_id, id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from chunks where len(embedding) = 64
 and document_id in (select doc_id from documents where kind = 'paper')),
s as (select document_id, i, sum(case when isfinite(x) then x::double else 0 end) as x from v group by 1, 2),
n as (select document_id, sqrt(sum(x * x)) as n from s group by 1)
select s.document_id, i - 1 as dim, round(x / n, 6) as x from s join n using (document_id) where n > 0""")
def centroid(t):
    papers = t("documents").filter("kind = 'paper'").select(F.col("doc_id").alias("document_id"))
    c = t("chunks").filter(F.size("embedding") == 64).dropDuplicates(["document_id", "id"]).join(papers, "document_id", "left_semi")
    v = c.select("document_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.when(F.isnan("x") | F.isnull("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x").cast("double")))
    s = v.groupBy("document_id", "dim").agg(F.sum("x").alias("x"))
    n = s.groupBy("document_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return s.join(n, "document_id").filter("n > 0").select("document_id", "dim", F.round(F.col("x") / F.col("n"), 6).alias("x"))


@query(f"""select doc_id from documents where {ACTIVE} and coalesce(layer,'raw') <> 'schema' order by updated_at nulls first, doc_id limit 100""")
def archive_candidates(t):
    d = D.scope(t("documents")).filter(F.coalesce("layer", F.lit("raw")) != "schema")
    return d.orderBy("updated_at", "doc_id").limit(100).select("doc_id")


@query("""select doc_id, date_diff('day', updated_at, timestamptz '2026-06-01 00:00:00+00') as age from documents where length(trim(coalesce(text,''), ' ')) < 60
 and date_diff('day', updated_at, timestamptz '2026-06-01 00:00:00+00') > 30""")
def aging_stubs(t):
    age = F.datediff(F.lit("2026-06-01").cast("date"), F.to_date("updated_at"))
    return t("documents").filter(F.length(D.blank("text")) < 60).select("doc_id", age.alias("age")).filter("age > 30")


@query("""select id from kg_facts where (coalesce(confidence, -1), id) > (0.5, 100) order by coalesce(confidence, -1), id limit 50""")
def pagination_cursor(t):
    f = t("kg_facts").select("id", F.coalesce("confidence", F.lit(-1.0)).alias("c"))
    return f.filter("c > 0.5d or (c = 0.5d and id > 100)").orderBy("c", "id").limit(50).select("id")
