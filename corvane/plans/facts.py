"""Temporal facts, text scalars, maintenance, mutations as table expressions, evaluation and change capture."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import facts as K
from corvane.operators import graph as G
from corvane.operators import search as S
from corvane.plans.base import Plans
from corvane.streaming import changes as V

P = Plans()
query = P.query
KG = """k as (select *, case when coalesce(trim(valid_from),'') = '' then null else epoch_us(try_cast(case when length(trim(valid_from)) = 10 then trim(valid_from) || ' 00:00:00Z' when regexp_matches(trim(valid_from),'(Z|[+-][0-9]{2}:[0-9]{2})$') then trim(valid_from) else trim(valid_from) || 'Z' end as timestamptz)) end as f,
 case when coalesce(trim(valid_to),'') = '' then null else epoch_us(try_cast(case when length(trim(valid_to)) = 10 then trim(valid_to) || ' 00:00:00Z' when regexp_matches(trim(valid_to),'(Z|[+-][0-9]{2}:[0-9]{2})$') then trim(valid_to) else trim(valid_to) || 'Z' end as timestamptz)) end as u from kg_facts)"""
AT = 1735689600000000  # 2025-01-01


@query(f"with {KG} select id, count(*) over () as total from k where predicate = 'depends_on' and (f is null or f <= {AT}) and (u is null or u > {AT})")
def kg_as_of(t):
    hits = K.as_of(t("kg_facts").filter("predicate = 'depends_on'"), AT)
    return hits.select("id").join(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


@query("select id, subject, object from kg_facts where status = 'active' and predicate = 'owned_by'")
def kg_active(t):
    return t("kg_facts").filter("status = 'active' and predicate = 'owned_by'").select("id", "subject", "object")


@query(f"with {KG} select id, row_number() over (order by f nulls first, created_at, id) as position from k where subject = 'vault-gateway'")
def kg_timeline(t):
    return K.timeline(t("kg_facts"), "vault-gateway").select("id", "position")


@query(f"with {KG}, a as (select id, subject, predicate, f, lead(f) over w as n, lead(id) over w as by_id from k where f is not null and subject is not null window w as (partition by subject, predicate order by f, id)) select id, n as closed_us, by_id as superseded_by from a where n is not null")
def kg_supersede(t):
    """Where each fact is closed by the next one of its subject and predicate."""
    return K.superseded(t("kg_facts"))


@query("select status, count(*) as n, count(distinct subject) as subjects, count(distinct predicate) as predicates from kg_facts group by 1")
def kg_stats(t):
    return t("kg_facts").groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("predicate").alias("predicates"))


@query("select distinct replace(lower(trim(predicate)), ' ', '_') as predicate from kg_facts")
def kg_predicates(t):
    return t("kg_facts").select(K.predicate_key(F.col("predicate")).alias("predicate")).distinct()


@query("""select subject, predicate, object, min(id) as kept, count(*) as times from kg_facts where status = 'active' and subject is not null group by 1, 2, 3""")
def kg_add_idempotent(t):
    """Adding all active facts one after another keeps the first of each subject, predicate and object."""
    return t("kg_facts").filter("status = 'active' and subject is not null").groupBy("subject", "predicate", "object").agg(F.min("id").alias("kept"), F.count("*").alias("times"))


@query(f"with {KG} select id, {AT} as closed_us from k where predicate = 'hosted_in' and status = 'active' and (u is null or u > {AT}) and (f is null or f <= {AT})")
def kg_invalidate(t):
    return K.as_of(t("kg_facts").filter("predicate = 'hosted_in' and status = 'active'"), AT).select("id", F.lit(AT).cast("long").alias("closed_us"))


# text and scalar functions

@query("select doc_id, sha256(text) as hash from documents where text is not null")
def content_hash(t):
    return t("documents").filter("text is not null").select("doc_id", D.content_key().alias("hash"))


@query(r"select doc_id, trim(regexp_replace(lower(title), '[ \t\r\n]+', ' ', 'g'), ' ') as label, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents where title is not null")
def label_and_slug(t):
    return t("documents").filter("title is not null").select("doc_id", G.label_key(F.col("title")).alias("label"), F.expr("trim(BOTH '-' FROM regexp_replace(lower(title), '[^a-z0-9]+', '-'))").alias("slug"))


@query(r"select doc_id, string_split(text, chr(10))[1] as first_line, case when length(text) > 80 then left(text, 79) || '…' else text end as excerpt from documents where text is not null")
def first_line_excerpt(t):
    return t("documents").filter("text is not null").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("first_line"),
        F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 79), F.lit("…"))).otherwise(F.col("text")).alias("excerpt"))


@query(r"select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' and left(x, 1) <> '#')[1] as prose from documents where text is not null")
def first_prose_line(t):
    return t("documents").filter("text is not null").select(
        "doc_id", F.get(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & (F.substring(x, 1, 1) != "#")), F.lit(0)).alias("prose"))


@query("select id, round(list_sum(list_transform(string_split(content, ' '), lambda w: length(w)))::double / len(string_split(content, ' ')), 6) as mean_word, chr(34) || id || '-' || chunk_index || chr(34) as etag from (select distinct id, chunk_index, content from chunks) where content is not null")
def etag_and_words(t):
    w = F.split("content", " ")
    mean = F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, x: a + x) / F.size(w)
    return t("chunks").dropDuplicates(["id"]).filter("content is not null").select("id", F.round(mean, 6).alias("mean_word"), F.concat(F.lit('"'), "id", F.lit("-"), "chunk_index", F.lit('"')).alias("etag"))


@query(r"select doc_id, contains(text, '[[') or regexp_matches(text, '\[[0-9]+\]') as cited from documents where text is not null")
def citation_markers(t):
    return t("documents").filter("text is not null").select("doc_id", (F.col("text").contains("[[") | F.col("text").rlike(r"\[[0-9]+\]")).alias("cited"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as text, epoch_us(ts) as us from events")
def timestamp_text(t):
    e = t("events").withColumn("n", F.col("ts").cast("timestamp_ntz"))
    return e.select("event_id", F.substring(F.col("n").cast("string"), 1, 19).alias("text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("select n_name, r_name, levenshtein(n_name, r_name) as distance from nation join region on n_regionkey = r_regionkey")
def edit_distance(t):
    r = t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return t("nation").join(F.broadcast(r), "n_regionkey").select("n_name", "r_name", F.levenshtein("n_name", "r_name").alias("distance"))


@query(r"""select id, ceil((2 * length(regexp_replace(content, '[^0-9A-Za-z]', '', 'g')) + length(regexp_replace(content, '[^ \t\n\r\f]', '', 'g'))
 + 4 * (length(regexp_replace(content, '[^\x00-\x7F]', '', 'g')) - length(regexp_replace(content, '[^0-9A-Za-z]', '', 'g')) - length(regexp_replace(content, '[^ \t\n\r\f]', '', 'g')))
 + 8 * length(regexp_replace(content, '[\x00-\x7F]', '', 'g'))) / 8e0)::bigint as tokens from (select distinct id, content from chunks) where content is not null""")
def token_estimate(t):
    return t("chunks").dropDuplicates(["id"]).filter("content is not null").select("id", S.token_estimate(F.col("content")).alias("tokens"))


# maintenance and mutations, each as the table it leaves

@query("""select doc_id, title, revision from (select doc_id, title, revision, 0 as p from documents union all select doc_id, 'renamed', revision + 1, 1 from documents where doc_id <= 20
 union all select 900000001, 'new', 1, 1) qualify row_number() over (partition by doc_id order by p desc) = 1""")
def upsert_by_id(t):
    d = t("documents").select("doc_id", "title", "revision", F.lit(0).alias("p"))
    patch = t("documents").filter("doc_id <= 20").select("doc_id", F.lit("renamed").alias("title"), (F.col("revision") + 1).alias("revision"), F.lit(1).alias("p"))
    new = d.sparkSession.range(1).select(F.lit(900000001).cast("long").alias("doc_id"), F.lit("new").alias("title"), F.lit(1).cast("long").alias("revision"), F.lit(1).alias("p"))
    return D.latest(d.unionByName(patch).unionByName(new), ["doc_id"], [F.desc("p")]).drop("p")


@query("""select doc_id, case when expected = revision then revision + 1 else revision end as revision, expected is not null and expected <> revision as conflict from
 (select doc_id, revision, case when doc_id % 3 = 0 then 1 end as expected from documents)""")
def compare_and_set(t):
    """Revision check of a patch: rows of another revision than expected stay and are reported."""
    x = t("documents").select("doc_id", "revision", F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("expected"))
    return x.select(
        "doc_id", F.when(F.col("expected") == F.col("revision"), F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        F.coalesce(F.col("expected") != F.col("revision"), F.lit(False)).alias("conflict"))


@query("""select 'chunks' as what, count(*) as n from chunks where document_id not in (select doc_id from documents where status = 'tombstone')
union all select 'documents', count(*) from documents where coalesce(status,'') <> 'tombstone' union all select 'facts', count(*) from kg_facts where source_document_id is null or source_document_id not in (select doc_id from documents where status = 'tombstone')""")
def delete_cascade(t):
    gone = t("documents").filter("status = 'tombstone'").select("doc_id")
    left = lambda df, key, what: df.join(gone.withColumnRenamed("doc_id", key), key, "left_anti").agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return left(t("chunks"), "document_id", "chunks").union(left(t("documents"), "doc_id", "documents")).union(left(t("kg_facts"), "source_document_id", "facts"))


@query("""with g as (select doc_id, first_value(doc_id) over (partition by text order by created_at, doc_id) as survivor from documents where text is not null)
select c.id, coalesce(survivor, document_id) as document_id from (select distinct id, document_id from chunks) c left join g on g.doc_id = c.document_id""")
def merge_duplicates(t):
    """Chunks re-pointed to the survivors of exact duplicates."""
    m = D.duplicate_members(t("documents")).withColumnRenamed("doc_id", "document_id")
    c = t("chunks").select("id", "document_id").distinct().join(m, "document_id", "left")
    return c.select("id", F.coalesce("survivor", "document_id").alias("document_id"))


@query("select doc_id, coalesce(nullif(trim(wing),''), regexp_extract(uri, '^[a-z]+://([^/]+)', 1)) as wing, coalesce(status, 'active') as status from documents")
def metadata_patch(t):
    return t("documents").select(
        "doc_id", F.coalesce(F.nullif(F.trim("wing"), F.lit("")), F.regexp_extract("uri", "^[a-z]+://([^/]+)", 1)).alias("wing"), F.coalesce("status", F.lit("active")).alias("status"))


@query("""with v as (select source, wing, count(*) as n from documents where trim(coalesce(wing,'')) <> '' group by 1, 2), b as (select source, wing, n from v qualify row_number() over (partition by source order by n desc, wing) = 1)
select doc_id, b.wing as suggested, n as votes from documents d join b on b.source = d.source where trim(coalesce(d.wing,'')) = ''""")
def organise(t):
    """For documents without a wing the commonest wing of their source."""
    d = t("documents")
    votes = d.filter(D.blank("wing") != "").groupBy("source", "wing").agg(F.count("*").alias("n"))
    best = D.latest(votes, ["source"], [F.desc("n"), F.col("wing")]).select("source", F.col("wing").alias("suggested"), F.col("n").alias("votes"))
    return d.filter(D.blank("wing") == "").select("doc_id", "source").join(best, "source").select("doc_id", "suggested", "votes")


@query("""select issue, severity, count(*) as n from (select 'duplicate' as issue, 'warn' as severity from documents where text in (select text from documents where text is not null group by 1 having count(*) > 1)
union all select 'empty', 'error' from documents where trim(coalesce(text,''), ' ') = '' union all select 'unscoped', 'info' from documents where trim(coalesce(wing,'')) = '' union all select 'oversized', 'warn' from documents where length(text) > 10000) group by 1, 2""")
def corpus_analysis(t):
    d = t("documents")
    dup = D.duplicate_members(d).select(F.lit("duplicate").alias("issue"), F.lit("warn").alias("severity"))
    one = lambda cond, issue, sev: d.filter(cond).select(F.lit(issue).alias("issue"), F.lit(sev).alias("severity"))
    every = dup.unionByName(one(D.blank("text") == "", "empty", "error")).unionByName(one(D.blank("wing") == "", "unscoped", "info")).unionByName(one(F.length("text") > 10000, "oversized", "warn"))
    return every.groupBy("issue", "severity").agg(F.count("*").alias("n"))


@query("""select doc_id, title, coalesce(nullif(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' and left(x, 1) <> '#')[1], ''), title) as summary from documents where layer = 'wiki'""")
def wiki_index_rebuild(t):
    prose = F.get(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & (F.substring(x, 1, 1) != "#")), F.lit(0))
    return t("documents").filter("layer = 'wiki'").select("doc_id", "title", F.coalesce(F.nullif(prose, F.lit("")), "title").alias("summary"))


@query("select kind, row_number() over (order by kind, title, doc_id) as line, '- ' || title as entry from documents where layer = 'wiki' and title is not null")
def wiki_index_render(t):
    """The catalog line by line, grouped by kind: as rows, since a catalog has no bound."""
    w = t("documents").filter("layer = 'wiki' and title is not null").select("kind", "title", "doc_id")
    return D.numbered(w, [F.col("kind"), F.col("title"), F.col("doc_id")], "line").select("kind", "line", F.concat(F.lit("- "), "title").alias("entry"))


# evaluation: a source is a query, its documents by length are the ranked list, papers are relevant

RANKED = """r as (select source as q, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank, case when kind = 'paper' then 1 + revision % 3 else 0 end as gain from documents)"""


def run_of(t):
    d = t("documents").select(F.col("source").alias("q"), "doc_id", "n_chars", F.when(F.col("kind") == "paper", 1 + F.col("revision") % 3).otherwise(0).alias("gain"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("n_chars"), "doc_id"))).select("q", "doc_id", "rank", "gain")


@query(f"""with {RANKED}, i as (select q, gain, row_number() over (partition by q order by gain desc) as rank from r), idcg as (select q, sum((pow(2, gain) - 1) / log2(rank + 1)) as idcg from i where rank <= 10 group by 1),
m as (select q, sum(case when rank <= 10 and gain > 0 then 1 else 0 end)::double / nullif(sum(case when gain > 0 then 1 else 0 end), 0) as recall, max(case when gain > 0 then 1e0 / rank end) as rr, sum(case when rank <= 10 then (pow(2, gain) - 1) / log2(rank + 1) else 0 end) as dcg from r group by 1)
select q, round(coalesce(recall, 0), 6) as recall_at_10, round(coalesce(rr, 0), 6) as rr, round(coalesce(dcg / nullif(idcg, 0), 0), 6) as ndcg_at_10 from m join idcg using (q)""")
def retrieval_metrics(t):
    return K.retrieval_metrics(run_of(t), 10)


@query(f"""with {RANKED}, m as (select q, max(case when gain > 0 then 1e0 / rank end) as rr from r group by 1) select round(coalesce(avg(coalesce(rr, 0)), 0), 6) as mrr, count(*) as queries from m""")
def macro_average(t):
    m = K.retrieval_metrics(run_of(t), 10, digits=None)
    return m.agg(F.round(F.coalesce(F.avg("rr"), F.lit(0.0)), 6).alias("mrr"), F.count("*").alias("queries"))


@query(f"""with {RANKED}, s as (select source as q, doc_id, row_number() over (partition by source order by revision desc, doc_id) as rank, case when kind = 'paper' then 1 else 0 end as gain from documents),
a as (select q, coalesce(max(case when gain > 0 then 1e0 / rank end), 0) as v from r group by 1), b as (select q, coalesce(max(case when gain > 0 then 1e0 / rank end), 0) as v from s group by 1)
select q, round(b.v - a.v, 6) as delta from a join b using (q) where abs(b.v - a.v) > 0.01""")
def compare_profiles(t):
    d = t("documents").select(F.col("source").alias("q"), "doc_id", "revision", F.when(F.col("kind") == "paper", 1).otherwise(0).alias("gain"))
    other = d.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("revision"), "doc_id")))
    a = K.retrieval_metrics(run_of(t), 10, digits=None).select("q", F.col("rr").alias("a"))
    b = K.retrieval_metrics(other.select("q", "doc_id", "rank", "gain"), 10, digits=None).select("q", F.col("rr").alias("b"))
    return a.join(b, "q").withColumn("delta", F.round(F.col("b") - F.col("a"), 6)).filter("abs(b - a) > 0.01").select("q", "delta")


CAL = """s as (select confidence as x, count(*) as n, count(*) filter (status = 'active') as pos from kg_facts where confidence is not null group by 1),
c as (select x, sum(pos) over w as tp, sum(n - pos) over w as fp, sum(pos) over () as p from s window w as (order by x desc)),
m as (select x as threshold, tp::bigint as tp, fp::bigint as fp, tp::double / (tp + fp) as prec, tp::double / p as rec from c)"""


@query(f"with {CAL} select threshold, tp, fp, round(prec, 6) as prec, round(rec, 6) as rec, round(2 * prec * rec / nullif(prec + rec, 0), 6) as f1, round((prec + 1.9208e0 / (tp + fp) - 1.96e0 * sqrt(prec * (1 - prec) / (tp + fp) + 0.9604e0 / ((tp + fp) * (tp + fp)))) / (1 + 3.8416e0 / (tp + fp)), 6) as wilson from m")
def calibration_table(t):
    return K.calibration(t("kg_facts").select(F.col("confidence").alias("score"), (F.col("status") == "active").alias("relevant")))


@query(f"with {CAL} select threshold, round(2 * prec * rec / nullif(prec + rec, 0), 6) as f1 from m where prec >= 0.7 order by 2 desc, threshold limit 1")
def calibration_fit(t):
    c = K.calibration(t("kg_facts").select(F.col("confidence").alias("score"), (F.col("status") == "active").alias("relevant")), digits=None)
    return c.filter("prec >= 0.7d").select("threshold", F.round("f1", 6).alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


# change capture over the event log

@query("""with o as (select * from events where event_id > 2000 and event_id <= 7000), k as (select count(distinct event_id) < 5000 as rebuild from o)
select user_id, rebuild, count(*) as changes from events, k where rebuild or (event_id > 2000 and event_id <= 7000) group by 1, 2""")
def changed_since(t):
    """Users with changes in a span of the log; if any number of the span is missing, everything has to be built again."""
    whole = t("events").select("event_id", "user_id")
    own = V.changed_between(whole, "event_id", "user_id", 2000, 7000)
    span = whole.filter("event_id > 2000 and event_id <= 7000")
    rows = whole if own is None else span.join(own, "user_id", "left_semi")
    return rows.groupBy("user_id", F.lit(own is None).alias("rebuild")).agg(F.count("*").alias("changes"))


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def journal_latest(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("select event_id, user_id from events where event_id > 1234 order by event_id limit 200")
def cursor_pull(t):
    return D.keyset(t("events").select("event_id", "user_id"), "event_id", 1234, 200)


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 1 hour then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, epoch_us(min(ts)) as began_us, epoch_us(max(ts)) as last_us, count(*) as events from s group by user_id, n""")
def debounce_sessions(t):
    """Bursts of a user's events with less than an hour between them."""
    e = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(
        F.unix_micros(F.min("ts")).alias("began_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.count("*").alias("events")).drop("w")


@query("select epoch_us(time_bucket(interval 1 day, ts)) as day_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def telemetry_windows(t):
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.unix_micros("w.start").alias("day_us"), "event_type", "n", "total")


@query("select c.id from (select distinct id from chunks) c where c.id not in (select vec_id from embeddings)")
def reembed_pending(t):
    return t("chunks").select("id").distinct().join(t("embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")
