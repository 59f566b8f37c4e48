"""Queries of the per-text functions, the readers and the streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.operators import search as S
from corvane.plans import search as PS
from corvane.plans.base import Plans
from corvane.sources import files
from corvane.sources.tables import shared_dir
from corvane.streaming import changes

P = Plans()
query = P.query


def per_text(fn, kind):
    """A pandas UDF of a function of one text; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


@query()
def html_text(t):
    """Readable text of the requests that hold HTML."""
    r = t("ingest_requests").filter(F.col("text").rlike(r"(?i)<(html|p|div|body|ul|table|h[1-6])\b"))
    return r.select("request_id", per_text(files.html_to_text, T.StringType())("text").alias("text"))


@query(r"""with recursive d as (select doc_id as key, text, length(text) as n from documents where length(text) > 0),
r(key, chunk_index, char_start, char_end) as (
 select key, 0, 0, case when n > 800 then coalesce(nullif(640 + length(regexp_extract(substr(text, 641, 160), '^((?s:.*)[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}])', 1)), 640), 800) else n end from d
 union all
 select d.key, chunk_index + 1, s, case when d.n > s + 800 then coalesce(nullif(s + 640 + length(regexp_extract(substr(text, s + 641, 160), '^((?s:.*)[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}])', 1)), s + 640), s + 800) else d.n end
 from (select key, chunk_index, char_end, greatest(char_end - 100, char_start + 1) as s from r) x join d on d.key = x.key where char_end < d.n)
select key, chunk_index, char_start, char_end from r""")
def chunk_fixed(t):
    """Windows of at most 800 characters that end at white space of their last fifth, each sharing 100 with the one before."""
    return X.chunked(t("documents"), "doc_id", "text", 800, 100).select("key", "chunk_index", "char_start", "char_end")


@query()
def chunk_code(t):
    pieces = per_text(lambda s: [{"a": a, "b": b} for a, b in X.code_chunks(s, 600)], T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])))
    b = t("code_index_source_blobs").filter("content is not null")
    return b.select("canonical_path", F.posexplode(pieces("content")).alias("piece", "p")).select("canonical_path", "piece", F.col("p.a").alias("char_start"), F.col("p.b").alias("char_end"))


@query()
def markdown_sections(t):
    heads = per_text(lambda s: [{"at": o, "path": p} for o, p in X.heading_paths(s)], T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType()))])))
    d = t("documents").filter("text is not null")
    return d.select("doc_id", F.explode(heads("text")).alias("h")).select("doc_id", F.col("h.at").alias("char_start"), F.col("h.path").alias("heading_path")).filter(F.size("heading_path") > 0)


@query(rf"""with w as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))) as w from documents where text is not null), n as (select w, count(*) as documents from w group by 1), terms as (select w from n), {PS.PORTER}
select n.w as word, x as stem, documents from n join stem on stem.w = n.w""")
def porter_terms(t):
    """Stems of the corpus's words with their documents; each distinct word is stemmed once."""
    w = t("documents").filter("text is not null").select("doc_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("word"))
    words = w.groupBy("word").agg(F.count("*").alias("documents"))
    return words.select("word", per_text(X.porter, T.StringType())("word").alias("stem"), "documents")


@query()
def mock_embed(t):
    return X.embedded(t("documents"), "doc_id", "text", 16)


@query()
def display_labels(t):
    return t("documents").filter("title is not null").select("doc_id", per_text(X.display_label, T.StringType())("title").alias("label"))


@query(r"""select * from (values (-1, 'a        z'), (-2, 'x ' || '   ' || chr(10) || '     ' || chr(10) || '    y'), (-3, 'lone ` tick'), (-4, '      ' || chr(10) || '   ')) v(doc_id, masked)
union all select doc_id, text from documents where contains(text, '`')""")
def mask_code(t):
    """Texts with code blanked, every offset kept. No document of the tables holds any, so four texts here do."""
    d = t("documents").select("doc_id", "text")
    some = d.sparkSession.createDataFrame([(-1, "a `code` z"), (-2, "x ```\nlet x\n``` y"), (-3, "lone ` tick"), (-4, "```not\nend")], "doc_id bigint, text string")
    both = some.unionByName(d).filter(F.col("text").contains("`"))
    return both.select("doc_id", per_text(X.mask_code, T.StringType())("text").alias("masked"))


@query("select event_type, count(*) as n from events group by 1")
def stream_counts(t):
    """The event log read as a stream until its end; the counts agree with the batch."""
    import uuid

    e = t("events")
    spark, root = e.sparkSession, f"{shared_dir(e.sparkSession)}/stream-{uuid.uuid4().hex}"
    e.select("event_id", "event_type").write.parquet(f"{root}/log")
    stream = changes.change_log(spark, f"{root}/log", "event_id bigint, event_type string")
    out = stream.select("event_id", "event_type").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select request_id, json_extract_string(metadata_json, '$.author') as author, 'x' as added from ingest_requests where json_valid(metadata_json)""")
def metadata_merge(t):
    m = files.merge_metadata(F.col("metadata_json"), F.lit('{"added": "x"}'))
    return t("ingest_requests").filter(F.try_parse_json("metadata_json").isNotNull()).select(
        "request_id", F.get_json_object(m, "$.author").alias("author"), F.get_json_object(m, "$.added").alias("added"))
