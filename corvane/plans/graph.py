"""Object-graph queries: what documents link to and are tagged with."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import graph as G
from corvane.plans.base import Plans

P = Plans()
query = P.query

BARE = r"regexp_replace(text, '(?s)```.*?```|`[^`\n]+`', ' ', 'g')"
LINKS = rf"""l as (select key, i - 1 as ordinal, trim(regexp_replace(lower(t), '[ \t\r\n]+', ' ', 'g'), ' ') as target from
 (select doc_id as key, unnest(f) as t, generate_subscripts(f, 1) as i from (select doc_id, regexp_extract_all({BARE}, '\[\[([^\[\]|#\n]+)(#[^\[\]|\n]*)?(\|[^\[\]\n]*)?\]\]', 1) as f from documents where contains(text, '[['))))"""
TAGS = rf"""g as (select distinct key, tag from (select doc_id as key, lower(unnest(regexp_extract_all({BARE}, '(?:^|[^0-9A-Za-z_#&/])#([A-Za-z][0-9A-Za-z_-]*)', 1))) as tag from documents where contains(text, '#'))
 where not regexp_matches(tag, '^[0-9]+$') and not regexp_matches(tag, '^(?:[0-9a-f]{{3}}|[0-9a-f]{{4}}|[0-9a-f]{{6}}|[0-9a-f]{{8}})$'))"""
NET = f"{LINKS}, {TAGS}, e as (select distinct 'd' || key as src, 'w:' || target as dst from l union select 'd' || key, 't:' || tag from g), u as (select src, dst from e union select dst, src from e)"


def links(t):
    return G.links(t("documents").select("doc_id", "text"), "doc_id", "text")


def tags(t):
    return G.tags(t("documents").select("doc_id", "text"), "doc_id", "text")


def net(t):
    """Edges from documents to link targets and tags."""
    a = links(t).select(F.concat(F.lit("d"), "key").alias("src"), F.concat(F.lit("w:"), "target").alias("dst"))
    b = tags(t).select(F.concat(F.lit("d"), "key").alias("src"), F.concat(F.lit("t:"), "tag").alias("dst"))
    return a.unionByName(b).distinct()


@query(f"with {LINKS} select key as doc_id, ordinal, target from l")
def wikilinks(t):
    return links(t).select(F.col("key").alias("doc_id"), "ordinal", "target")


@query(f"with {TAGS} select key as doc_id, tag from g")
def document_tags(t):
    return tags(t).select(F.col("key").alias("doc_id"), "tag")


@query(f"with {LINKS} select key as doc_id, target, ordinal, row_number() over (partition by key, target order by ordinal) - 1 as occurrence from l")
def link_occurrences(t):
    return G.ranked_occurrences(links(t)).select(F.col("key").alias("doc_id"), "target", "ordinal", "occurrence")


RESOLVED = f"""{LINKS}, n as (select trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as target, min(doc_id) as doc, count(*) as c from documents where title is not null group by 1)"""


@query(f"with {RESOLVED} select key as doc_id, ordinal, l.target, doc from l left join n on n.target = l.target and n.c = 1 and n.target <> ''")
def resolve_links(t):
    return G.resolve(links(t), t("documents"), "doc_id", "title").select(F.col("key").alias("doc_id"), "ordinal", "target", "doc")


@query(f"with {LINKS} select target, count(*) as links, count(distinct key) as documents, min(key) as first_document from l where target not in (select trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g'), ' ') from documents where title is not null) group by 1")
def link_stubs(t):
    known = t("documents").filter("title is not null").select(G.label_key(F.col("title")).alias("target"))
    return links(t).join(known, "target", "left_anti").groupBy("target").agg(
        F.count("*").alias("links"), F.countDistinct("key").alias("documents"), F.min("key").alias("first_document"))


@query("select k as label, count(*) as documents from (select trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g'), ' ') as k from documents where title is not null) where k <> '' group by 1 having count(*) > 1")
def ambiguous_labels(t):
    return t("documents").filter("title is not null").groupBy(G.label_key(F.col("title")).alias("label")).agg(F.count("*").alias("documents")).filter("documents > 1 and label <> ''")


@query(f"with {LINKS} select distinct key as doc_id, title from l join documents on doc_id = key where target = 'resolver'")
def backlinks(t):
    to = links(t).filter("target = 'resolver'").select(F.col("key").alias("doc_id")).distinct()
    return t("documents").select("doc_id", "title").join(to, "doc_id")


@query(f"with {LINKS} select distinct key as doc_id from l join documents on doc_id = key where target = 'resolver' and wing = 'atlas'")
def backlinks_in_wing(t):
    to = links(t).filter("target = 'resolver'").select(F.col("key").alias("doc_id")).distinct()
    return t("documents").filter("wing = 'atlas'").select("doc_id").join(to, "doc_id", "left_semi")


@query(f"with {NET} select left(dst, 1) as kind, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from e group by 1")
def graph_stats(t):
    return net(t).groupBy(F.substring("dst", 1, 1).alias("kind")).agg(
        F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"with {NET} select doc_id from documents where 'd' || doc_id not in (select src from e)")
def orphan_documents(t):
    have = net(t).select(F.expr("cast(substring(src, 2) as bigint)").alias("doc_id"))
    return t("documents").select("doc_id").join(have, "doc_id", "left_anti")


@query(f"with {NET} select src as node from e union select dst from e")
def incident_nodes(t):
    n = net(t)
    return n.select(F.col("src").alias("node")).union(n.select("dst")).distinct()


@query(f"with recursive {NET}, r(node, depth) as (select distinct dst, 0 from e where dst = 'w:resolver' union select u.dst, r.depth + 1 from r join u on u.src = r.node where r.depth < 3) select node, min(depth) as depth from r group by 1")
def graph_neighbours(t):
    n = net(t)
    return G.reach(G.undirected(n), n.filter("dst = 'w:resolver'").select(F.col("dst").alias("node")), 3)


@query(f"""with {NET}, d1 as (select distinct dst as node from u where src = 'w:resolver' order by node limit 19), s1 as (select distinct dst as node, 0 as depth from e where dst = 'w:resolver' union all select node, 1 from d1),
d2 as (select distinct dst as node from u where src in (select node from d1) and dst not in (select node from s1))
select node, depth from s1 union all select node, 2 from (select node from d2 order by node limit greatest(0, 20 - (select count(*) from s1)))""")
def graph_neighbours_capped(t):
    n = net(t)
    return G.reach(G.undirected(n), n.filter("dst = 'w:resolver'").select(F.col("dst").alias("node")), 2, node_cap=20)


@query(f"""with recursive {NET}, n as (select src as node from e union select dst from e), r(node, seen) as (select node, node from n union select r.node, u.dst from r join u on u.src = r.seen)
select node, min(seen) as component from r group by 1""")
def connected_components(t):
    return G.components(net(t))


@query("""select doc_id, 'wing' as rel, trim(wing) as parent from documents where trim(coalesce(wing,'')) <> ''
union all select doc_id, 'room', trim(wing) || '/' || trim(room) from documents where trim(coalesce(wing,'')) <> '' and trim(coalesce(room,'')) <> ''""")
def structural_edges(t):
    d = t("documents").filter(D.blank("wing") != "")
    room = F.when(D.blank("room") != "", F.struct(F.lit("room").alias("rel"), F.concat(F.trim("wing"), F.lit("/"), F.trim("room")).alias("parent")))
    return d.select("doc_id", F.explode(F.array_compact(F.array(F.struct(F.lit("wing").alias("rel"), F.trim("wing").alias("parent")), room))).alias("e")).select("doc_id", "e.rel", "e.parent")


@query(rf"with {LINKS}, p as (select distinct a.target as a, b.target as b, a.key from l a join l b on a.key = b.key and a.ordinal + 1 = b.ordinal and a.target <> b.target) select least(a, b) as a, greatest(a, b) as b, count(distinct key) as weight from p group by 1, 2")
def link_tunnels(t):
    """Undirected pairs of targets that follow each other in a document, by number of documents."""
    l = links(t)  # noqa: E741
    nxt = l.select("key", (F.col("ordinal") - 1).alias("ordinal"), F.col("target").alias("b"))
    pairs = l.withColumnRenamed("target", "a").join(nxt, ["key", "ordinal"]).filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.countDistinct("key").alias("weight"))


@query("""select id, min(chunk_id) as chunk_id from (select l.doc_id as id, c.id as chunk_id, c.chunk_index from (select doc_id, instr(text, '[[') - 1 as s from documents where contains(text, '[[')) l
 join chunks c on c.document_id = l.doc_id and c.char_start <= l.s and c.char_end >= l.s + 2) group by 1""")
def chunk_span_lookup(t):
    """The chunk that holds the first link of a document."""
    at = t("documents").filter(F.col("text").contains("[[")).select(F.col("doc_id").alias("id"), (F.instr("text", "[[") - 1).alias("s"))
    c = t("chunks").select(F.col("document_id").alias("id"), F.col("id").alias("chunk_id"), "char_start", "char_end")
    return at.join(c, "id").filter("char_start <= s and char_end >= s + 2").groupBy("id").agg(F.min("chunk_id").alias("chunk_id"))


@query(f"""with {LINKS}, x as (select key as doc_id, 'duplicate_link' as issue from l group by key, target having count(*) > 1
 union select doc_id, 'empty_page' from documents where trim(coalesce(text,''), ' ') = '' union select key, 'self_link' from l join documents on doc_id = key and trim(regexp_replace(lower(title), '[ \\t\\r\\n]+', ' ', 'g'), ' ') = target
 union select doc_id, 'untitled' from documents where title is null) select doc_id, issue from x""")
def lint_wiki(t):
    d, l = t("documents").select("doc_id", "title", "text"), links(t)  # noqa: E741
    dup = l.groupBy("key", "target").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("doc_id"), F.lit("duplicate_link").alias("issue"))
    me = l.join(d.select(F.col("doc_id").alias("key"), G.label_key(F.col("title")).alias("target")), ["key", "target"]).select(F.col("key").alias("doc_id"), F.lit("self_link").alias("issue"))
    empty = d.filter(D.blank("text") == "").select("doc_id", F.lit("empty_page").alias("issue"))
    untitled = d.filter("title is null").select("doc_id", F.lit("untitled").alias("issue"))
    return dup.unionByName(me).unionByName(empty).unionByName(untitled).distinct()
