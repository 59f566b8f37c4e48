"""Code graphs, stored relations and the lexical index at their edges."""

import json
import os
import random

import pytest
from corvane.functions.text import STOPWORDS
from corvane.operators import graph as G
from corvane.operators import lifecycle as L
from corvane.operators import project as J
from corvane.operators.lexical import LexicalIndex, query_stems
from corvane.plans import registry
from pyspark.sql import functions as F

SOURCE = "project string, path string, content string"


def read(spark, files):
    s = spark.createDataFrame([("p", k, v) for k, v in files], SOURCE)
    return J.facts(s), s


def test_sources_that_cannot_be_read_give_nothing(spark):
    f, s = read(spark, [("a.py", "def f(:"), ("b.py", None), ("c.py", ""), ("d.py", "def g(): pass"), ("d.py", "def g(): pass"), ("e.unknown", "text only")])
    assert [tuple(r) for r in f.select("path", "kind", "name").collect()] == [("d.py", "function", "g")]
    assert J.code_graph(f, s).count() == 0
    empty, none = read(spark, [("a.py", "")])
    assert empty.count() == 0 and J.code_graph(empty, none).count() == 0


def test_ambiguous_names_bind_to_none_and_packages_to_their_files(spark):
    f, s = read(spark, [
        ("m.py", "def twice(): pass\n"), ("n.py", "def twice(): pass\n"), ("pkg/__init__.py", "def top(): pass\n"), ("pkg/sub.py", "from .. import m\nfrom . import top as t\nm.twice()\nt()\n"),
        ("use.py", "if 1:\n    from m import twice\nelse:\n    from n import twice\ntwice()\nimport pkg.sub as q\nimport nowhere\nnowhere.x()\n")])
    i = J.file_imports(f, s)
    got = {(r.path, r.name, r.member, r.file) for r in i.collect()}
    assert got == {("pkg/sub.py", "m", None, "m.py"), ("pkg/sub.py", "t", "top", "pkg/__init__.py"), ("use.py", "twice", "twice", "m.py"), ("use.py", "twice", "twice", "n.py"), ("use.py", "q", None, "pkg/sub.py")}
    c = {(r.path, r.name): (r.to_path, r.to_qual) for r in J.calls(f, i, J.ancestors(J.inheritance(f, i))).collect()}
    assert c == {("pkg/sub.py", "twice"): ("m.py", "twice"), ("pkg/sub.py", "t"): ("pkg/__init__.py", "top"), ("use.py", "twice"): (None, None), ("use.py", "x"): (None, None)}


def test_chains_of_classes_and_cycles_end(spark):
    chain = "class C0: \n    def go(self): pass\n" + "".join(f"class C{i}(C{i - 1}): pass\n" for i in range(1, 9)) + "class X(Y): pass\nclass Y(X): pass\nclass Z(C8):\n    def run(self):\n        self.go()\n"
    f, s = read(spark, [("a.py", chain)])
    i = J.file_imports(f, s)
    above = J.ancestors(J.inheritance(f, i))
    assert above.filter("class_name = 'C8'").count() == 8 and above.filter("class_name = 'X'").count() == 2
    hit = J.calls(f, i, above).filter("name = 'go'").first()
    assert (hit.to_qual, hit.how) == ("C0.go", "self")


def test_migrations_read_columns_with_types_and_comments(spark):
    _, s = read(spark, [("1.sql", "create table if not exists a (x int, y decimal(10,2), primary key (x));\n-- alter table a drop column x\nalter table a alter column x type bigint;"), ("2.sql", None), ("3.sql", "drop table b; create table b (z text)")])
    e = {(r.path, r.action, r.table_name, r.column_name, r.type) for r in J.ddl_events(s).collect()}
    assert e == {("1.sql", "create", "a", None, None), ("1.sql", "add", "a", "x", "int"), ("1.sql", "add", "a", "y", "decimal(10,2)"), ("1.sql", "alter", "a", "x", "bigint"), ("3.sql", "drop", "b", None, None), ("3.sql", "create", "b", None, None), ("3.sql", "add", "b", "z", "text")}


@pytest.mark.parametrize("size,overlap", [(20, 0), (30, 1), (10_000, 0)])
def test_structural_chunks_cover_every_line_with_text(spark, size, overlap):
    text = "import os\n\n\n" + "".join(f"def f{i}(a):\n" + "    a += 1\n" * (i * 2) + "    return a\n\n" for i in range(1, 5)) + "print(1)"
    f, s = read(spark, [("a.py", text)])
    seen = set()
    for r in J.structural_chunks(f, s, size, overlap).collect():
        seen |= set(range(r.first_line, r.last_line + 1))
        assert r.first_line == r.last_line or sum(len(x) + 1 for x in text.split("\n")[r.first_line - 1:r.last_line]) - 1 <= size
    assert {i + 1 for i, x in enumerate(text.split("\n")) if x.strip()} <= seen


def test_links_and_tunnels_at_their_edges(spark):
    none = spark.createDataFrame([], "x bigint, y bigint, weight double")
    assert L.tunnelled(None, none).count() == 0
    made = spark.createDataFrame([(2, 1, 1.0), (1, 2, 2.0), (3, 3, 9.0), (None, 1, 1.0)], "x bigint, y bigint, weight double")
    once = L.tunnelled(None, made)
    assert {tuple(r) for r in once.filter("a is not null and x is null" if "x" in once.columns else "a is not null").collect()} >= {(1, 2, 3.0)}
    assert {tuple(r) for r in L.tunnelled(once, made.limit(1)).filter("a = 1 and b = 2").collect()} in ({(1, 2, 4.0)}, {(1, 2, 5.0)})


def test_pages_need_their_revision_and_a_title(spark):
    pages = spark.createDataFrame([(1, "a", "x", 3), (2, "b", "y", None), (3, "c", "z", 1), (4, "d", "w", 1)], "doc_id bigint, title string, text string, revision bigint")
    writes = spark.createDataFrame([(1, "a2", "x2", 3), (2, "b2", "y2", None), (3, " ", "z2", 1), (9, "n", "n", 0)], "doc_id bigint, title string, text string, expected bigint")
    got = {r.doc_id: (r.title, r.text, r.revision, r.outcome) for r in L.written_pages(pages, writes).collect()}
    assert got == {1: ("a2", "x2", 4, "written"), 2: ("b2", "y2", 1, "written"), 3: ("c", "z", 1, "no title"), 4: ("d", "w", 1, None)}
    again = {r.doc_id: r.outcome for r in L.written_pages(L.written_pages(pages, writes).drop("outcome"), writes).collect()}
    assert again[1] == again[2] == "conflict"


def test_packing_charges_headers_and_cuts_the_last_body(spark):
    hits = spark.createDataFrame([(7, 1, "T", "x" * 10), (8, 2, None, "y" * 10), (9, 3, "U", "z" * 10)], "key bigint, rank int, title string, content string")
    got = {r.key: (r.header, len(r.body)) for r in L.packed(hits, 30).collect()}
    # 6 + 10, then 2 + 5 + 7 of 10, and no room for a third
    assert got == {7: ("[1] T\n", 10), 8: ("[2] \n", 7)}
    assert L.packed(hits, 3).count() == 0 and L.packed(hits.limit(0), 30).count() == 0


def test_acknowledging_what_is_not_there_fails_whole(spark):
    found = spark.createDataFrame([(1,), (2,)], "id bigint")
    with pytest.raises(ValueError):
        L.acknowledged(found, spark.createDataFrame([(1,), (5,)], "id bigint"), "id")
    assert {tuple(r) for r in L.acknowledged(found, spark.createDataFrame([(1,), (1,)], "id bigint"), "id").collect()} == {(1, "acknowledged"), (2, "open")}


def test_migrations_and_extensions(spark):
    m = L.Migrations("t")
    m.add(1, "a", lambda df: df.withColumn("a", F.lit(1)))
    with pytest.raises(ValueError):
        m.add(1, "b", lambda df: df)
    m.add(2, "b", lambda df: df.withColumn("b", F.col("a") + 1))
    df, v = m.run(spark.range(1), 0)
    assert v == 2 and df.columns == ["id", "a", "b"] and m.run(df, 2) == (df, 2)
    e = L.Extensions()
    e.register("x", "t1", "a int")
    with pytest.raises(ValueError):
        e.register("y", "t1", "a int")


def test_vault_files_keep_the_previous_version(spark, tmp_path):
    rows = [(1, 'He said "x"', "note", "s", "Atlas Two", "body"), (2, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, title string, kind string, source string, wing string, text string")
    assert {tuple(r) for r in L.write_vault(d, str(tmp_path)).collect()} == {("atlas-two/1.md", True), ("unfiled/2.md", True)}
    page = (tmp_path / "atlas-two/1.md").read_text()
    assert page.startswith('---\nid: 1\ntitle: "He said \\"x\\""\n') and page.endswith("---\n\nbody") and json.loads(page.split("title: ")[1].split("\n")[0]) == 'He said "x"'
    L.write_vault(d.withColumn("text", F.lit("new")), str(tmp_path)).collect()
    assert (tmp_path / "atlas-two/1.md.bak").read_text() == page and not any(r.changed for r in L.write_vault(d.withColumn("text", F.lit("new")), str(tmp_path)).collect())


def test_index_agrees_with_brute_force(spark, tmp_path):
    import math
    from collections import Counter

    from corvane.functions.text import porter

    r = random.Random(2)
    words = "running runs ran the of index indexing indexes naïve 記録 quick quickly x9 logic logical".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))) for i in range(200)] + [(500, None), (501, ""), (502, "the of"), (3, "duplicate key")]
    docs = [d for d in docs if d != (3, "duplicate key")]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs] + [(*docs[0], "k", 1)], "id bigint, text string, key string, tf int")
    index = LexicalIndex(spark, str(tmp_path / "i"), parts=5).build(df, "id", "text")
    own = {i: [porter(w) for w in t.replace("ï", "ï").lower().split() if w not in STOPWORDS] for i, t in docs if t is not None}
    n, avg = len(own), sum(map(len, own.values())) / len(own)
    asked = query_stems("The running of indexes 記録")
    assert asked == ["run", "index", "記録"]
    want = {}
    for t in asked:
        df_ = sum(t in w for w in own.values())
        for i, w in own.items():
            tf = Counter(w)[t]
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
    got = {x.key: x.score for x in index.bm25("The running of indexes 記録").collect()}
    assert got == pytest.approx(want)
    assert index.bm25("the of").count() == 0
    scoped = index.bm25("running", spark.createDataFrame([(1,), (2,)], "key bigint"))
    assert {x.key for x in scoped.collect()} <= {1, 2}
    plan = index.bm25("running")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1][:80]
    nothing = LexicalIndex(spark, str(tmp_path / "e")).build(df.limit(0), "id", "text")
    assert nothing.bm25("running").count() == 0


def test_bucketed_tables_join_without_exchange_and_go(spark):
    from corvane.sources.tables import discard, written

    a = written(spark.range(1000).withColumn("v", F.col("id") * 2), "a", "id", 4)
    b = written(spark.range(1000).withColumn("w", F.col("id") * 3), "b", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    j = a.join(b, "id")
    assert j.count() == 1000 and "Exchange hashpartitioning(id" not in j._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    path = a._written_at.replace("file:", "").replace("///", "/").replace("//", "/")
    assert os.path.exists(path)
    discard(a), discard(b)
    assert not os.path.exists(path)


def test_every_query_has_a_name_of_its_own():
    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_reach_of_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {tuple(r) for r in G.reach(e, spark.createDataFrame([("a",)], "node string"), None).collect()} == {("a", 0), ("b", 1)}
