"""Operators over what is stored: relations, schemas, links, tunnels, pages, memories, plans, evaluations.

They take tables and give the tables after a change. Defined results: null keys never match; repeated rows count once where a key
is unique; empty tables give empty results; other columns are kept where rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import graph as G


def inferred_keys(catalog: DataFrame) -> DataFrame:
    """(table_name, column_name, target): columns named like another table's key, and of its type.

    A table's key is its column ``x_<table>key``, x being its first letter. Two keys of one stem bind to neither.
    """
    stem = F.expr("substr(column_name, instr(column_name, '_') + 1)")
    own = F.col("column_name") == F.concat(F.substring("table_name", 1, 1), F.lit("_"), "table_name", F.lit("key"))
    keys = catalog.filter(own).select(F.col("table_name").alias("target"), stem.alias("stem"), "type").withColumn("n", F.count("*").over(W.partitionBy("stem", "type"))).filter("n = 1").drop("n")
    return catalog.withColumn("stem", stem).join(keys, ["stem", "type"]).filter("target <> table_name").select("table_name", "column_name", "target")


def relations(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """(table_name, column_name, target, basis): declared relations, and inferred ones of columns without any."""
    rest = inferred.join(declared.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    return declared.select("table_name", "column_name", "target", F.lit("declared").alias("basis")).unionByName(rest.select("table_name", "column_name", "target", F.lit("inferred").alias("basis")))


def schema_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, column_name, change) between two captures of (table_name, column_name, type)."""
    j = before.withColumnRenamed("type", "a").join(after.withColumnRenamed("type", "b"), ["table_name", "column_name"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("table_name", "column_name", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def checked_urls(df: DataFrame, url: str, allowed: list[str], schemes: tuple[str, ...] = ("http", "https"), keep: list[str] = []) -> DataFrame:
    """(url, host, verdict): ``ok``, or the first thing wrong: ``scheme``, ``no host``, ``host``. ``*.x`` allows what lies below x."""
    u = F.col(url)
    host = F.nullif(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    exact = [a.lower() for a in allowed if not a.startswith("*.")]
    below = [a[1:].lower() for a in allowed if a.startswith("*.")]
    good = F.col("host").isin(exact)
    for b in below:
        good = good | F.col("host").endswith(b)
    web = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*schemes)
    return df.select(*keep, u.alias("url"), host.alias("host"), web.alias("web")).select(
        *keep, "url", "host", F.when(~F.col("web"), "scheme").when(F.col("host").isNull(), "no host").when(good, "ok").otherwise("host").alias("verdict"))


def without_source(documents: DataFrame, chunks: DataFrame, facts: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the documents of a source (exact match), their chunks and their facts."""
    gone = documents.filter(F.col("source") == source).select(F.col("doc_id").alias("gone")).distinct()
    kept = documents.filter(~F.col("source").eqNullSafe(F.lit(source)))
    return kept, chunks.join(gone, chunks["document_id"] == gone["gone"], "left_anti"), facts.join(gone, facts["source_document_id"] == gone["gone"], "left_anti")


class Migrations:
    """Numbered steps that bring a table's rows from one version to the next."""

    def __init__(self, table: str):
        self.table, self.steps = table, {}

    def add(self, version: int, name: str, how: Callable[[DataFrame], DataFrame]) -> None:
        if version in self.steps:
            raise ValueError(f"{self.table} has a step {version} already")
        self.steps[version] = (name, how)

    def run(self, rows: DataFrame, version: int) -> tuple[DataFrame, int]:
        """Rows and version after every step above ``version``, in order; the newest version changes nothing."""
        for v in sorted(self.steps):
            if v > version:
                rows, version = self.steps[v][1](rows), v
        return rows, version


class Extensions:
    """Tables that others add to the library's own."""

    def __init__(self):
        self.known: dict[str, tuple[str, str]] = {}

    def register(self, extension: str, table: str, schema: str) -> None:
        """Once more is no error; under another schema or by another extension it is."""
        if self.known.setdefault(table, (extension, schema)) != (extension, schema):
            raise ValueError(f"{table} is taken")

    def tables(self, spark: SparkSession) -> DataFrame:
        """(extension, table_name, columns)."""
        rows = [(e, n, len(spark.createDataFrame([], s).columns)) for n, (e, s) in self.known.items()]
        return spark.createDataFrame(rows, "extension string, table_name string, columns int")


def with_origins(edges: DataFrame, legacy: str = "legacy") -> DataFrame:
    """Edges with ``origin``: what somebody made is explicit, everything else was extracted."""
    return edges.withColumn("origin", F.when(F.col(legacy).isin("manual", "user", "explicit"), "explicit").otherwise("extract"))


def relation_pairs(edges: DataFrame, nodes: DataFrame, rel: str) -> DataFrame:
    """(a, b): documents of the nodes (node, doc_id) at both ends of the edges (src, dst, rel) of one kind, each pair once."""
    own = edges.filter(F.col("rel") == rel)
    a, b = nodes.select(F.col("node").alias("src"), F.col("doc_id").alias("a")), nodes.select(F.col("node").alias("dst"), F.col("doc_id").alias("b"))
    return own.join(a, "src").join(b, "dst").select("a", "b").distinct()


def promoted(stubs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stubs (target, ...) with the document (label, doc_id) whose label they carry, where there is just one."""
    only = labels.filter("label <> ''").groupBy("label").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc")).filter("n = 1")
    return stubs.join(only.select(F.col("label").alias("target"), "doc"), "target")


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, dst, rel, weight) with new ones (and seq) in; a known edge takes the last weight given. Without rel it is ``related``."""
    key = ["src", "dst", "rel"]
    last = new.withColumn("rel", F.coalesce("rel", F.lit("related"))).groupBy(*key).agg(F.max_by("weight", "seq").alias("weight"))
    return edges.join(last.select(*key), key, "left_anti").select(*key, "weight").unionByName(last)


def tunnelled(tunnels: DataFrame | None, made: DataFrame) -> DataFrame:
    """(a, b, weight): tunnels with (x, y, weight) added, whichever way round; weights of a pair add up, a node has none to itself."""
    new = made.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")
    both = new if tunnels is None else tunnels.select("a", "b", "weight").unionByName(new)
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def tunnels_of_wing(tunnels: DataFrame, documents: DataFrame, wing: str) -> DataFrame:
    """Tunnels with an end in a wing."""
    d = documents.select("doc_id", (F.trim("wing") == wing).alias("in"))
    ends = tunnels.join(d.select(F.col("doc_id").alias("a"), F.col("in").alias("p")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("in").alias("q")), "b")
    return ends.filter("p or q").select("a", "b", "weight")


def filtered_plan(plan: DataFrame, known: list[str], targeted: list[str]) -> DataFrame:
    """Actions with ``verdict``: kept, or why not."""
    a = F.col("action")
    verdict = F.when(~F.coalesce(a.isin(known), F.lit(False)), "unknown action").when(a.isin(targeted) & F.col("target").isNull(), "no target").otherwise("kept")
    return plan.withColumn("verdict", verdict)


def written_pages(pages: DataFrame, writes: DataFrame) -> DataFrame:
    """Pages after writes (doc_id, title, text, expected), with ``outcome``: written, conflict (another revision), no title, or null (no write)."""
    w = writes.select("doc_id", F.col("title").alias("new_title"), F.col("text").alias("new_text"), "expected", F.lit(True).alias("asked"))
    j = pages.join(w, "doc_id", "left")
    titled = F.trim(F.coalesce("new_title", F.lit(""))) != ""
    fits = F.coalesce("revision", F.lit(0)) == F.coalesce("expected", F.lit(0))
    outcome = F.when(F.col("asked").isNull(), F.lit(None)).when(~titled, "no title").when(~fits, "conflict").otherwise("written")
    done = F.coalesce(F.col("outcome") == "written", F.lit(False))
    return j.withColumn("outcome", outcome).withColumns({
        "title": F.when(done, F.col("new_title")).otherwise(F.col("title")), "text": F.when(done, F.col("new_text")).otherwise(F.col("text")),
        "revision": F.when(done, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision"))}).drop("new_title", "new_text", "expected", "asked")


def answer_pages(cited: DataFrame, subject: str) -> DataFrame:
    """(subject, page): a page for each subject with its citations (place, title, uri) as a numbered list."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.coalesce("title", F.lit("untitled")), F.lit(" <"), F.coalesce("uri", F.lit("")), F.lit(">"))
    own = cited.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return own.select(subject, F.concat(F.lit("# "), subject, F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("page"))


def appended(notes: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Notes with ``place``, their number in the owner's diary."""
    return notes.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(*order)))


def consolidated(memories: DataFrame, chosen: DataFrame, output: int) -> DataFrame:
    """Memories with the chosen ones marked by status and the document they went into; removed ones stay as they are."""
    c = chosen.select("doc_id").distinct().withColumn("c", F.lit(True))
    hit = F.coalesce("c", F.lit(False)) & (F.col("kind") == "memory") & (F.col("status") != "tombstone")
    return memories.join(c, "doc_id", "left").withColumns({"status": F.when(hit, "consolidated").otherwise(F.col("status")), "output": F.when(hit, F.lit(output)).otherwise(F.col("output"))}).drop("c")


def metric_report(runs: DataFrame, mode: str, metrics: list[str]) -> DataFrame:
    """(mode, n, metrics): means by mode; a metric that the runs lack is null."""
    return runs.groupBy(mode).agg(F.count("*").alias("n"), *[(F.avg(m) if m in runs.columns else F.lit(None).cast("double")).alias(m) for m in metrics])


def merged_scores(base: DataFrame, model: DataFrame, key: str, score: str, least: float = 0.5) -> DataFrame:
    """(key, score, judge, verdict): the model's score where there is one, else the heuristic one."""
    j = base.join(model.select(key, F.col(score).alias("m")), key, "left")
    best = F.coalesce("m", score)
    return j.select(key, best.alias(score), F.when(F.col("m").isNotNull(), "model").otherwise("heuristic").alias("judge"), F.when(best >= least, "pass").otherwise("fail").alias("verdict"))


def labels(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that aren't such are left out."""
    return lines.select(F.from_json(line, schema).alias("r")).filter("r is not null").select("r.*")


def remaining(queries: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Queries without a completed record."""
    return queries.join(completed.select(key).distinct(), key, "left_anti")


def replayed(stored: DataFrame, run: str, schema: str, passes: Column, by: str) -> DataFrame:
    """(by, runs, changed): stored runs judged again by ``passes``."""
    r = stored.select(by, F.from_json(run, schema).alias("r")).select(by, "r.*")
    return r.groupBy(by).agg(F.count("*").alias("runs"), F.sum(F.when(passes == F.col("passed"), 0).otherwise(1)).alias("changed"))


def nested_spans(spans: DataFrame) -> DataFrame:
    """(span, depth, path) of (span, parent): level by level, roots first; spans under no root have no row."""
    from corvane.sources.tables import checkpointed

    level = spans.filter("parent is null").select("span", F.lit(0).alias("depth"), F.col("span").cast("string").alias("path"))
    below, out = spans.filter("parent is not null"), None
    while True:
        level = checkpointed(level)
        if level.isEmpty():
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        up = level.select(F.col("span").alias("parent"), "depth", "path")
        level = below.join(up, "parent").select("span", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.col("span").cast("string")).alias("path"))


def acknowledged(findings: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Findings with ``state``; ids that name no finding make it an error, so that nothing is half done."""
    unknown = ids.join(findings.select(key), key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no finding {unknown[0][0]}")
    seen = ids.select(key).distinct().withColumn("s", F.lit("acknowledged"))
    return findings.join(seen, key, "left").withColumn("state", F.coalesce("s", F.lit("open"))).drop("s")


def note_page(notes: DataFrame, key: str, text: str, literal: str, after: int, limit: int) -> DataFrame:
    """The ``limit`` notes after a key that hold a literal text."""
    return notes.filter(F.col(text).contains(literal) & (F.col(key) > after)).orderBy(key).limit(limit)


def chunk_profile(documents: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, profile): code, sections (headings of markdown) or prose."""
    marked = F.col(text).rlike(r"(^|\n)#{1,6} ")
    return documents.select(key, F.when(F.col(kind) == "code", "code").when(marked, "sections").otherwise("prose").alias("profile"))


def seen_against_known(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(key, state): deleted (known, not seen), added (seen, not known) or known."""
    j = known.select(key, F.lit(1).alias("k")).join(seen.select(key, F.lit(1).alias("s")), key, "full")
    return j.select(key, F.when(F.col("s").isNull(), "deleted").when(F.col("k").isNull(), "added").otherwise("known").alias("state"))


def accepted(changes: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Changes with ``first``, the number of the first one under their key, and whether they are it; a replay gets its old number."""
    first = changes.groupBy(*key).agg(F.min(seq).alias("first"))
    return changes.join(first, key).withColumn("fresh", F.col(seq) == F.col("first"))


def rewired(edges: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """Edges with the ends that moved (doc_id, keep) pointed at what was kept, each once."""
    m = moved.select(F.col("doc_id").alias(column), "keep").distinct()
    return edges.join(m, column, "left").withColumn(column, F.coalesce("keep", column)).drop("keep").distinct()


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """(key, rank, header, body): hits in order within ``budget`` characters. Headers and the two characters between entries are charged;
    the first body that doesn't fit is cut to what is left and is the last. A list of hits is short, so one window orders it."""
    header = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"))
    h = hits.withColumn("header", header).withColumn("fixed", F.length("header") + F.when(F.col("rank") > 1, 2).otherwise(0))
    before = F.coalesce(F.sum(F.col("fixed") + F.length("content")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - F.col("before") - F.col("fixed")
    return h.withColumn("before", before).filter(room > 0).select("key", "rank", "header", F.expr(f"substring(content, 1, int(least(length(content), {budget} - before - fixed)))").alias("body"))


def vault(documents: DataFrame) -> DataFrame:
    """(doc_id, file, page): every document as one markdown file with front matter, in its project's folder; documents without a project lie under ``unfiled``."""
    folder = F.regexp_replace(F.lower(F.trim(F.coalesce("wing", F.lit("")))), "[^a-z0-9]+", "-")
    file = F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.lit("unfiled")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    quoted = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    value = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("doc_id").cast("string")), F.concat(F.lit("title: "), value(F.col("title"))), F.concat(F.lit("kind: "), value(F.col("kind"))), F.concat(F.lit("source: "), value(F.col("source"))), F.lit("---"))
    return documents.select("doc_id", file.alias("file"), F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("page"))


def write_vault(documents: DataFrame, path: str) -> DataFrame:
    """Writes each document's page under ``path`` from the executors and returns (file, changed); a file that differs is kept as ``.bak`` before it is replaced."""
    import os
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file, page in zip(f["file"], f["page"]):
                at = os.path.join(path, file)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                old = open(at, encoding="utf-8", newline="").read() if os.path.exists(at) else None
                if old != page:
                    if old is not None:
                        os.replace(at, at + ".bak")
                    stage = f"{at}.{os.getpid()}"
                    with open(stage, "w", encoding="utf-8", newline="") as out:
                        out.write(page)
                    os.replace(stage, at)
                rows.append((file, old != page))
            yield pd.DataFrame(rows, columns=["file", "changed"])

    return vault(documents).select("file", "page").mapInPandas(run, "file string, changed boolean")
