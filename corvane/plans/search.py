"""Search queries over documents and chunks."""

from __future__ import annotations

import os

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import documents as D
from corvane.operators import search as S
from corvane.functions.text import STEP2, STEP3, STEP4, STOPWORDS
from corvane.operators.lexical import LexicalIndex, stems
from corvane.plans.base import Plans
from corvane.sources.tables import scratch

P = Plans()
query = P.query
QUERY = "lexical snapshot of the ranking"
TERMS = "('lexical'),('snapshot'),('of'),('the'),('ranking')"
ACTIVE = "coalesce(nullif(trim(status),''),'active') not in ('archived','tombstone')"

CH = """c as (select id, any_value(document_id) document_id, any_value(chunk_index) chunk_index, any_value(content) content, any_value(embedding) embedding from chunks group by id)"""
TOK = r"tok as (select id as key, unnest(string_split_regex(lower(content), '[^\p{L}\p{N}]+')) as term from c where content is not null), words as (select * from tok where term <> '')"


def _shape(e: str, one: bool = False) -> str:
    """SQL of a word's consonants and vowels, as C and V, runs as one letter or letter by letter."""
    n = "" if one else "+"
    x = f"regexp_replace(regexp_replace(regexp_replace({e}, '^y', 'b'), '([aeiou])y', '\\1b', 'g'), 'y', 'a', 'g')"
    return f"regexp_replace(regexp_replace({x}, '[aeiou]{n}', 'V', 'g'), '[^V]{n}', 'C', 'g')"


def _suffix(step: str, source: str, table: dict[str, str], turns: str, also: str = "true") -> str:
    """SQL of one table step of the stemmer: the longest suffix goes if its stem has the turns of vowels and consonants asked for."""
    pick = " ".join(f"when x like '%{k}' then '{k}'" for k in sorted(table, key=len, reverse=True))
    to = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"""{step}a as (select w, x, case {pick} end as s from {source}), {step}b as (select *, left(x, length(x) - length(s)) as st from {step}a),
{step} as (select w, case when s is not null and regexp_matches({_shape('st')}, '{turns}') and {also} then st || case s {to} end else x end as x from {step}b)"""


#: the published stemmer over the table ``terms(w)`` in SQL, as ``stem(w, x)``
PORTER = f"""p1 as (select w, case when w like '%sses' or w like '%ies' then left(w, length(w) - 2) when w like '%ss' then w when w like '%s' then left(w, length(w) - 1) else w end as x from terms),
p2 as (select w, case when x like '%eed' then case when contains({_shape('left(x, length(x) - 3)')}, 'VC') then left(x, length(x) - 1) else x end
 when x like '%ed' and contains({_shape('left(x, length(x) - 2)')}, 'V') then left(x, length(x) - 2) when x like '%ing' and contains({_shape('left(x, length(x) - 3)')}, 'V') then left(x, length(x) - 3) else x end as x,
 x not like '%eed' and (x like '%ed' and contains({_shape('left(x, length(x) - 2)')}, 'V') or x not like '%ed' and x like '%ing' and contains({_shape('left(x, length(x) - 3)')}, 'V')) as cut from p1),
p3 as (select w, case when not cut then x when x like '%at' or x like '%bl' or x like '%iz' then x || 'e' when length(x) > 1 and right(x, 1) = substr(x, length(x) - 1, 1) and not regexp_matches(x, '[aeioulsz]$') then left(x, length(x) - 1)
 when regexp_matches({_shape('x')}, '^C?VCV?$') and regexp_matches({_shape('x', True)}, 'CVC$') and not regexp_matches(x, '[wxy]$') then x || 'e' else x end as x from p2),
p4 as (select w, case when x like '%y' and contains({_shape('left(x, length(x) - 1)')}, 'V') then left(x, length(x) - 1) || 'i' else x end as x from p3),
{_suffix('p5', 'p4', STEP2, 'VC')}, {_suffix('p6', 'p5', STEP3, 'VC')}, {_suffix('p7', 'p6', dict.fromkeys(STEP4, ''), 'VC.*VC', "(s <> 'ion' or regexp_matches(st, '[st]$'))")},
p8 as (select w, case when x like '%e' and (regexp_matches({_shape('left(x, length(x) - 1)')}, 'VC.*VC') or regexp_matches({_shape('left(x, length(x) - 1)')}, '^C?VCV?$') and not (regexp_matches({_shape('left(x, length(x) - 1)', True)}, 'CVC$') and not regexp_matches(left(x, length(x) - 1), '[wxy]$'))) then left(x, length(x) - 1) else x end as x from p7),
stem as (select w, case when length(w) <= 2 or not regexp_matches(w, '^[a-z]+$') then w when x like '%ll' and regexp_matches({_shape('left(x, length(x) - 1)')}, 'VC.*VC') then left(x, length(x) - 1) else x end as x from p8)"""
STOPPED = ", ".join(f"'{w}'" for w in STOPWORDS)
STEMS = rf"""tok as (select id as key, unnest(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+')) as term from c where content is not null), plain as (select * from tok where term <> '' and term not in ({STOPPED})),
terms as (select distinct term as w from plain), {PORTER}, words as (select key, x as term from plain join stem on w = term)"""
BM25 = rf"""{CH}, {STEMS}, dl as (select c.id as key, count(w.term)::double as dl from c left join words w on w.key = c.id where c.content is not null group by 1),
st as (select count(*)::double as n, avg(dl) as avgdl from dl), tf as (select key, term, count(*)::double as tf from words where term in ('lexic', 'snapshot', 'rank') group by 1, 2),
df as (select term, count(*)::double as df from tf group by 1),
lex as (select key, sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) as score
 from tf join df using (term) join dl using (key), st group by 1)"""
VEC = """q as (select embedding::double[] as q from c where id = (select min(id) from c where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: isfinite(x))))),
v as (select id as key, embedding::double[] as e from c where len(embedding) = 64),
vec as (select key, case when list_sum(list_transform(e, lambda x: x * x)) > 0 then greatest(-1, least(1, list_cosine_similarity(e, q))) else 0 end as score from v, q
 where list_bool_and(list_transform(e, lambda x: isfinite(x))))"""
TOPS = """lt as (select key, score, row_number() over (order by score desc, key) as rank from lex qualify rank <= 50),
vt as (select key, score, row_number() over (order by score desc, key) as rank from vec qualify rank <= 50)"""


def chunks(t):
    """Chunks, each once."""
    return t("chunks").dropDuplicates(["id"])


def seed_vector(c) -> list[float]:
    """Vector of the first usable chunk: one row."""
    ok = c.filter((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return ok.orderBy("id").select("embedding").first()[0]


_INDEXES: dict = {}


def index(t) -> LexicalIndex:
    """The index of the chunks' contents; built once a session for one set of tables, in the shared folder."""
    c = t("chunks")
    spark = c.sparkSession
    key = (spark.sparkContext.applicationId, *c.inputFiles())
    if key not in _INDEXES:
        _INDEXES[key] = LexicalIndex(spark, scratch(spark, "index")).build(c, "id", "content")
    return _INDEXES[key]


def lexical(t):
    return index(t).bm25(QUERY)


def vector(t):
    c = chunks(t)
    return S.cosine(c, "id", "embedding", seed_vector(c))


@query(rf"with {CH}, {TOK} select key, count(*) as n_tokens, count(distinct term) as n_terms from words group by 1")
def tokenise(t):
    w = chunks(t).filter("content is not null").select(F.col("id").alias("key"), S.tokens(F.col("content")).alias("w"))
    return w.filter(F.size("w") > 0).select("key", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_terms"))


@query(f"with {CH}, {STEMS}, tf as (select key, term, count(*) tf from words group by 1, 2) select term, count(*) as df, sum(tf)::bigint as cf from tf group by 1")
def bm25_index(t):
    """Terms of the stored index, with the texts that hold each and how often."""
    return index(t).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"with {BM25} select key, round(score, 6) as score from lex order by lex.score desc, key limit 20")
def bm25_topk(t):
    S.check_query(QUERY, 20)
    return S.top_k(lexical(t), 20).select("key", F.round("score", 6).alias("score"))


@query(f"with {BM25}, ok as (select c.id from c join documents d on d.doc_id = c.document_id where {ACTIVE} and trim(d.wing) = 'atlas') select key, round(score, 6) as score from lex where key in (select id from ok) order by lex.score desc, key limit 20")
def bm25_scoped_topk(t):
    c = chunks(t)
    allowed = c.join(D.scope(t("documents"), wing="atlas").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("key"))
    return S.top_k(index(t).bm25(QUERY, allowed), 20).select("key", F.round("score", 6).alias("score"))


@query(rf"with {CH}, {TOK} select key, count(*)::double as score from words where term in (select col0 from (values {TERMS})) group by 1 order by score desc, key limit 20")
def tf_topk(t):
    return S.top_k(S.term_frequency(chunks(t), "id", "content", QUERY), 20)


@query(f"with {CH}, {VEC} select key, round(score, 6) as score from vec order by vec.score desc, key limit 20")
def vec_topk(t):
    return S.top_k(vector(t), 20).select("key", F.round("score", 6).alias("score"))


@query(f"with {CH}, {VEC}, ok as (select c.id from c join documents d on d.doc_id = c.document_id where {ACTIVE} and trim(d.wing) = 'loom') select key, round(score, 6) as score from vec where key in (select id from ok) order by vec.score desc, key limit 20")
def vec_scoped_topk(t):
    c = chunks(t)
    allowed = D.scope(t("documents"), wing="loom").select(F.col("doc_id").alias("document_id"))
    return S.top_k(S.cosine(c.join(allowed, "document_id", "left_semi"), "id", "embedding", seed_vector(c)), 20).select("key", F.round("score", 6).alias("score"))


@query(f"with {BM25}, {VEC}, {TOPS} select key, round(sum(1e0 / (60 + rank)), 9) as score from (select key, rank from lt union all select key, rank from vt) group by 1 order by sum(1e0 / (60 + rank)) desc, key limit 20")
def hybrid_rrf(t):
    fused = S.rrf([S.ranked(S.top_k(lexical(t), 50)), S.ranked(S.top_k(vector(t), 50))])
    return S.top_k(fused, 20).select("key", F.round("score", 9).alias("score"))


@query(rf"""with {CH}, {TOK}, one as (select key, count(*) as s from words where term = 'ranking' group by 1), two as (select key, count(*) as s from words where term = 'snapshot' group by 1),
r as (select key, row_number() over (order by s desc, key) as rank from one qualify rank <= 50 union all select key, row_number() over (order by s desc, key) as rank from two qualify rank <= 50)
select key, round(sum(1e0 / (60 + rank)), 9) as score from r group by 1""")
def multi_query_rrf(t):
    legs = [S.ranked(S.top_k(S.term_frequency(chunks(t), "id", "content", q), 50)) for q in ("ranking", "snapshot")]
    return S.rrf(legs).select("key", F.round("score", 9).alias("score"))


@query(f"""with {BM25}, lt as (select key, score, row_number() over (order by score desc, key) as rank from lex qualify rank <= 50)
select key, rank from (select key, rank, row_number() over (partition by document_id order by rank) as n from lt join c on c.id = lt.key) where n <= 1""")
def cap_per_document(t):
    hits = S.ranked(S.top_k(lexical(t), 50)).join(chunks(t).select(F.col("id").alias("key"), "document_id"), "key")
    return S.capped(hits, "document_id", 1).select("key", "rank")


@query(f"""with {BM25}, lt as (select key from lex order by score desc, key limit 50) select sum(least(n, 2))::bigint as capacity from
 (select document_id, count(*) as n from lt join c on c.id = lt.key group by 1)""")
def diversity_capacity(t):
    hits = S.top_k(lexical(t), 50).join(chunks(t).select(F.col("id").alias("key"), "document_id"), "key")
    return hits.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.sum(F.least("n", F.lit(2))).alias("capacity"))


@query(f"with {BM25} select key, round(score, 6) as score from lex where score >= 1.5")
def min_score(t):
    return lexical(t).filter("score >= 1.5").select("key", F.round("score", 6).alias("score"))


@query(f"""with {BM25}, lt as (select key, score from lex order by score desc, key limit 50)
select key, round(score * (1 + pow(2e0, -date_diff('day', d.updated_at::date, date '2026-06-01') / 30e0)), 6) as score from lt join c on c.id = key join documents d on d.doc_id = c.document_id""")
def recency_boost(t):
    hits = S.top_k(lexical(t), 50).join(chunks(t).select(F.col("id").alias("key"), F.col("document_id").alias("doc_id")), "key").join(t("documents").select("doc_id", "updated_at"), "doc_id")
    age = F.datediff(F.lit("2026-06-01").cast("date"), F.to_date("updated_at")).cast("double")
    return hits.select("key", F.round(S.recency(F.col("score"), age, 30.0), 6).alias("score"))


@query(f"""with {BM25}, lt as (select key, score from lex order by score desc, key limit 50)
select key, round(score * case when lower(trim(title)) = 'open points' then 1.35e0 else 1e0 end * case when contains(lower(coalesce(uri,'')), 'ranking') then 1.15e0 else 1e0 end
 * case when contains(lower(c.content), '# ') then 1.15e0 else 1e0 end, 6) as score from lt join c on c.id = key join documents d on d.doc_id = c.document_id""")
def field_boosts(t):
    hits = S.top_k(lexical(t), 50).join(chunks(t).select(F.col("id").alias("key"), F.col("document_id").alias("doc_id"), "content"), "key").join(t("documents").select("doc_id", "title", "uri"), "doc_id")
    boost = (
        F.when(F.lower(F.trim("title")) == "open points", 1.35).otherwise(1.0)
        * F.when(F.lower(F.coalesce("uri", F.lit(""))).contains("ranking"), 1.15).otherwise(1.0)
        * F.when(F.lower("content").contains("# "), 1.15).otherwise(1.0)
    )
    return hits.select("key", F.round(F.col("score") * boost, 6).alias("score"))


@query("select id, count(*) as copies, min(chunk_index) as chunk_index from chunks group by 1 having count(*) > 1")
def hit_dedupe(t):
    return t("chunks").groupBy("id").agg(F.count("*").alias("copies"), F.min("chunk_index").alias("chunk_index")).filter("copies > 1")


@query()
def mmr_select(t):
    """Ten chunks by relevance against overlap; the pool is the bounded candidate pool of one query."""
    hits = S.ranked(S.top_k(lexical(t), 50)).join(chunks(t).select(F.col("id").alias("key"), F.col("document_id").alias("grp"), F.array_distinct(S.tokens(F.col("content"))).alias("words")), "key")
    return S.mmr(hits.select("key", "grp", "score", "rank", "words"), 10)


@query(f"""with {BM25}, lt as (select key, score, row_number() over (order by score desc, key) as rank from lex qualify rank <= 40),
k as (select key, rank, ceil((2 * length(regexp_replace(content, '[^0-9A-Za-z]', '', 'g')) + length(regexp_replace(content, '[^ \\t\\n\\r\\f]', '', 'g'))
 + 4 * (length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g')) - length(regexp_replace(content, '[^0-9A-Za-z]', '', 'g')) - length(regexp_replace(content, '[^ \\t\\n\\r\\f]', '', 'g')))
 + 8 * length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g'))) / 8e0)::bigint as cost from lt join c on c.id = lt.key),
b as (select *, coalesce(sum(cost) over (order by rank rows between unbounded preceding and 1 preceding), 0)::bigint as before from k)
select key, rank, cost, least(cost, 800 - before) as kept from b where before < 800""")
def context_packing(t):
    hits = S.ranked(S.top_k(lexical(t), 40)).join(chunks(t).select(F.col("id").alias("key"), S.token_estimate(F.col("content")).alias("cost")), "key")
    return S.packed(hits, 800).select("key", "rank", "cost", "kept")


@query(f"""with {BM25}, lt as (select key from lex order by score desc, key limit 10)
select key, substring(content, greatest(coalesce(least(nullif(instr(lower(content), 'lexical'), 0), nullif(instr(lower(content), 'ranking'), 0)), 1) - 20, 1)::bigint, 80) as snippet from lt join c on c.id = lt.key""")
def snippets(t):
    hits = S.top_k(lexical(t), 10).join(chunks(t).select(F.col("id").alias("key"), "content"), "key")
    return hits.select("key", S.snippet(F.col("content"), ["lexical", "ranking"], 80).alias("snippet"))


@query(f"""with {BM25}, lt as (select key from lex order by score desc, key limit 10), s as (select c.document_id, c.chunk_index from lt join c on c.id = lt.key)
select s.document_id, s.chunk_index as seed, string_agg(c.content, ' | ' order by c.chunk_index, c.id) as context from s join c on c.document_id = s.document_id and abs(c.chunk_index - s.chunk_index) <= 1 group by 1, 2""")
def neighbour_context(t):
    c = chunks(t)
    seeds = S.top_k(lexical(t), 10).join(c.select(F.col("id").alias("key"), "document_id", "chunk_index"), "key").select("document_id", F.col("chunk_index").alias("seed")).distinct()
    reach = seeds.withColumn("chunk_index", F.explode(F.sequence(F.col("seed") - 1, F.col("seed") + 1)))
    near = c.join(F.broadcast(reach), ["document_id", "chunk_index"])  # three rows for each of ten hits
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "id", "content")))
    return near.groupBy("document_id", "seed").agg(F.array_join(parts["content"], " | ").alias("context"))


@query(rf"""with {CH}, {TOK}, s as (select key, list(distinct term) as w from words group by 1), q as (select list(col0) as q from (values {TERMS}))
select key, round(len(list_intersect(w, q))::double / len(list_distinct(list_concat(w, q))), 6) as score from s, q where len(list_intersect(w, q)) > 2""")
def jaccard_rerank(t):
    q = F.array(*[F.lit(x) for x in S.query_terms(QUERY)])
    w = chunks(t).filter("content is not null").select(F.col("id").alias("key"), F.array_distinct(S.tokens(F.col("content"))).alias("w"))
    return w.filter(F.size(F.array_intersect("w", q)) > 2).select("key", F.round(S.jaccard(F.col("w"), q), 6).alias("score"))


@query("""select 'all' as how, doc_id from documents where contains(lower(text), 'ranking') and contains(lower(text), 'snapshot')
union all select 'any', doc_id from documents where contains(lower(text), 'ranking') or contains(lower(text), 'snapshot')""")
def match_all_any(t):
    low = t("documents").filter("text is not null").select("doc_id", F.lower("text").alias("x"))
    hit = low.select("doc_id", F.col("x").contains("ranking").alias("a"), F.col("x").contains("snapshot").alias("b")).filter("a or b")
    return hit.select(F.explode(F.when(F.col("a") & F.col("b"), F.array(F.lit("all"), F.lit("any"))).otherwise(F.array(F.lit("any")))).alias("how"), "doc_id")


@query(rf"""with {CH}, {TOK}, s as (select key, list(distinct term) as w from words group by 1), q as (select list(col0) as q from (values {TERMS}))
select key, len(list_intersect(w, q))::double / 5 as coverage from s, q""")
def token_coverage(t):
    q = F.array(*[F.lit(x) for x in S.query_terms(QUERY)])
    w = chunks(t).filter("content is not null").select(F.col("id").alias("key"), F.array_distinct(S.tokens(F.col("content"))).alias("w")).filter(F.size("w") > 0)
    return w.select("key", (F.size(F.array_intersect("w", q)) / F.lit(5.0)).alias("coverage"))


@query(r"""with w as (select doc_id, title, list_filter(string_split_regex(lower(coalesce(title,'')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as tt,
 list_filter(string_split_regex(lower(coalesce(uri,'')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ut from documents where layer = 'wiki'),
s as (select doc_id, title, ((list_contains(ut,'open')::int + list_contains(ut,'points')::int) * 4e0 + (list_contains(tt,'open')::int + list_contains(tt,'points')::int) * 3e0) / 2
 + case when list_contains(tt,'open') and list_contains(tt,'points') then 0.5e0 else 0 end as score from w)
select doc_id, title, score from s where score > 0 order by score desc, title nulls first, doc_id limit 30""")
def wiki_index_query(t):
    w = t("documents").filter("layer = 'wiki'").select("doc_id", "title", S.tokens(F.coalesce("title", F.lit(""))).alias("tt"), S.tokens(F.coalesce("uri", F.lit(""))).alias("ut"))
    has = lambda c, x: F.array_contains(c, x).cast("int")
    score = ((has("ut", "open") + has("ut", "points")) * 4.0 + (has("tt", "open") + has("tt", "points")) * 3.0) / 2 + F.when(
        F.array_contains("tt", "open") & F.array_contains("tt", "points"), 0.5).otherwise(0.0)
    return w.select("doc_id", "title", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), F.col("title").asc_nulls_first(), "doc_id").limit(30)


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)), 6) as score from embeddings where vec_id <> 1 order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)) desc, vec_id limit 25")
def find_similar(t):
    e = t("embeddings")
    seed = e.filter("vec_id = 1").select("embedding").first()[0]
    return S.top_k(S.cosine(e.filter("vec_id <> 1"), "vec_id", "embedding", seed), 25).select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings")
def vector_norm(t):
    v = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@query(f"""with {CH}, {VEC}, pool as (select id, embedding::double[] as e, row_number() over (order by id) as r from c where len(embedding) = 64
 and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0 qualify r <= 200)
select a.id as a, b.id as b, round(list_cosine_similarity(a.e, b.e), 6) as sim from pool a join pool b on a.id < b.id
 where list_cosine_similarity(a.e, b.e) >= 0.6 order by list_cosine_similarity(a.e, b.e) desc, a.id, b.id limit 100""")
def near_duplicate_report(t):
    """Closest pairs among the first 200 vectors: the report's own bound; the unbounded join is p6."""
    import numpy as np
    import pandas as pd

    def pairs(frames):
        f = pd.concat(list(frames)).sort_values("id")
        x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
        keep = np.isfinite(x).all(1) & (np.abs(x).sum(1) > 0)
        ids, x = f["id"].to_numpy()[keep], x[keep]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.triu(x @ x.T, 1)
        i, j = np.nonzero(s >= 0.6)
        yield pd.DataFrame({"a": ids[i], "b": ids[j], "sim": s[i, j]})

    ok = chunks(t).filter((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    found = ok.select("id", "embedding").orderBy("id").limit(200).coalesce(1).mapInPandas(pairs, "a bigint, b bigint, sim double")
    return found.orderBy(F.desc("sim"), "a", "b").limit(100).select("a", "b", F.round("sim", 6).alias("sim"))


def closest_pairs(vectors, most: int, floor: float, size: int = 16_000):
    """(a, b, sim): the ``most`` closest pairs of all (id, embedding) from ``floor`` on, compared in pairs of blocks of about ``size``.

    Cosines count to 9 decimals, so that equal vectors tie and go by id. Each pair of blocks gives its own best pairs only.
    """
    import numpy as np
    import pandas as pd

    def best(key, f):
        blocks = []
        for n in sorted(set(key)):
            own = f[f["block"] == n].sort_values("id")
            x = np.stack(own["embedding"].to_numpy()).astype(np.float64) if len(own) else np.zeros((0, 1))
            blocks.append((own["id"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)))
        (ids, x), (others, y) = blocks[0], blocks[-1]
        a, b, sim, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), floor
        for at in range(0, len(x), 256) if len(y) else ():
            s = x[at:at + 256] @ y.T
            if len(blocks) == 1:
                s[np.arange(len(y))[None, :] <= np.arange(at, at + len(s))[:, None]] = -2.0
            i, j = np.nonzero(s >= least - 1e-9)
            r = np.round(s[i, j], 9)
            cut = max(least, np.partition(r, len(r) - most)[len(r) - most] if len(r) > most else least)
            i, j, r = i[r >= cut], j[r >= cut], r[r >= cut]
            a, b, sim = np.r_[a, np.minimum(ids[at + i], others[j])], np.r_[b, np.maximum(ids[at + i], others[j])], np.r_[sim, r]
            keep = np.lexsort((b, a, -sim))[:most]
            a, b, sim = a[keep], b[keep], sim[keep]
            if len(sim) == most:
                least = sim[-1]
        return pd.DataFrame({"a": a, "b": b, "sim": sim})

    n = max(1, -(-vectors.count() // size))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    sent = vectors.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = sent.select("id", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = pairs.groupBy("i", "j").applyInPandas(best, "a bigint, b bigint, sim double")
    return found.orderBy(F.desc("sim"), "a", "b").limit(most)


@query()
def near_duplicate_documents(t):
    """Closest 100 pairs of all documents by the vector of each one's first chunk that has a usable one; ``near_duplicate_report`` and its SQL compare 200 chunks."""
    ok = chunks(t).filter((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0))
    first = ok.filter("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(F.min(F.struct("chunk_index", F.col("id").alias("chunk"), "embedding"))["embedding"].alias("embedding"))
    return closest_pairs(first, 100, 0.6).select("a", "b", F.round("sim", 6).alias("sim"))


del os, W
