"""Queries of the general training-data problems, with the SQL they are checked against."""

from __future__ import annotations

from corvane.operators.incremental import files_taken
from corvane.operators.intervals import fact_periods
from corvane.operators.snapshots import revision_file_changes
from corvane.sources.tables import load

QUERIES = {
    "p2_found": lambda s, d: files_taken(load(s, d, "source_manifest"), load(s, d, "source_scan"), load(s, d, "sync_runs")),
    "p3_found": lambda s, d: fact_periods(load(s, d, "kg_facts")),
    "p5_found": lambda s, d: revision_file_changes(load(s, d, "code_index_revision_files"), load(s, d, "code_index_revisions")),
}

SQL = {
    "p2_found": """
with h as (
  select canonical_root root, canonical_path path, regexp_replace(lower(regexp_replace(content_hash,'\\s+','','g')),'^([a-z0-9_-]+:|0x)','') hash,
         last_synced observed, -1 tie, null::timestamptz delivered from source_manifest where last_synced is not null and content_hash is not null
  union all
  select canonical_root, canonical_path, regexp_replace(lower(regexp_replace(content_hash,'\\s+','','g')),'^([a-z0-9_-]+:|0x)',''),
         observed_at, scan_row_id, delivered_at from source_scan where content_hash is not null and delivered_at is not null),
runs as (select run_id, canonical_root root, finished_at f, lag(finished_at) over (partition by canonical_root order by finished_at, run_id) p
         from sync_runs where status = 'succeeded'),
cur as (select r.run_id, h.path, arg_max(h.hash, (h.observed, h.tie)) st from runs r join h on h.root = r.root and (h.delivered is null or h.delivered <= r.f) group by all),
prv as (select r.run_id, h.path, arg_max(h.hash, (h.observed, h.tie)) st from runs r join h on h.root = r.root and (h.delivered is null or h.delivered <= r.p) group by all)
select cur.run_id, cur.path as canonical_path from cur left join prv on cur.run_id = prv.run_id and cur.path = prv.path
where prv.st is null or prv.st <> cur.st""",
    "p3_found": """
with t as (
  select trim(subject, ' \t\n\r') subject, trim(valid_from, ' \t\n\r') f, trim(valid_to, ' \t\n\r') t from kg_facts),
b as (
  select subject,
    case when coalesce(f,'')='' then -9223372036854775807 else epoch_us(try_cast(case when regexp_matches(f,'([Zz]|[+-][0-9]{2}:[0-9]{2})$') and length(f)>10 then f when length(f)=10 then f||' 00:00:00Z' else f||'Z' end as timestamptz)) end s,
    case when coalesce(t,'')='' then 9223372036854775807 else epoch_us(try_cast(case when regexp_matches(t,'([Zz]|[+-][0-9]{2}:[0-9]{2})$') and length(t)>10 then t when length(t)=10 then t||' 00:00:00Z' else t||'Z' end as timestamptz)) end e
  from t where subject <> ''),
m as (select subject, s, e, max(e) over (partition by subject order by s, e rows between unbounded preceding and 1 preceding) pe from b where e > s),
i as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by subject order by s, e rows unbounded preceding) g from m),
p as (select subject, g, min(s) s, max(e) e from i group by all),
g as (select subject, e s, lead(s) over (partition by subject order by g) e from p),
u as (select subject, 'period' span, s, e from p union all select subject, 'gap', s, e from g where e is not null)
select subject, span, case when s = -9223372036854775807 then '' else strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') end span_from,
  case when e = 9223372036854775807 then '' else strftime(make_timestamp(e), '%Y-%m-%d %H:%M:%S') end span_to from u""",
    "p5_found": """
with r as (select rev_id, row_number() over (order by rev_id) ix from (select distinct rev_id from code_index_revisions where rev_id is not null)),
f as (select ix, document_id, arg_max({'p': path, 'j': project, 'v': document_revision, 'h': content_hash,
        'l': analysis_json->>'$.language', 's': analysis_json->>'$.symbols', 'r': analysis_json->>'$.references', 'u': analysis_json->>'$.unresolved'}, coalesce(document_revision, -1)) x
      from code_index_revision_files join r on rev_id = index_revision where document_id is not null group by all),
c as (select coalesce(b.ix, a.ix + 1) ix, coalesce(a.document_id, b.document_id) document_id,
        case when a.document_id is null then 'added' when b.document_id is null then 'removed' when a.x is distinct from b.x then 'changed' end change
      from f a full join f b on b.ix = a.ix + 1 and a.document_id = b.document_id)
select r.rev_id as index_revision, document_id, change from c join r on r.ix = c.ix where change is not null and r.ix > 1""",
}
