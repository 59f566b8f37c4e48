"""Graph, code, files, versions, streams and text functions."""

import io
import random
import zipfile

import numpy as np
import pytest
from corvane.functions import text as X
from corvane.operators import code as C
from corvane.operators import graph as G
from corvane.plans import registry
from corvane.plans import search as PS
from corvane.sources import files
from corvane.sources.versioned import Conflict, VersionedTable
from corvane.streaming import changes
from pyspark.sql import functions as F


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree_with_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {tuple(x) for x in G.components(edges(spark, pairs)).collect()} == {(n, root(n)) for n in up}


def test_pagerank_agrees_with_matrix(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (3, 2), (0, 3), (2, 4)]
    n = 5
    m = np.zeros((n, n))
    for a, b in pairs:
        m[b, a] = 1 / sum(x == a for x, _ in pairs)
    rank = np.full(n, 1 / n)
    for _ in range(24):
        rank = 0.15 / n + 0.85 * (m @ rank + rank[4] / n)
    got = dict(tuple(x) for x in G.pagerank(edges(spark, pairs)).collect())
    assert np.allclose([got[i] for i in range(n)], rank)


def test_cycles_have_no_order(spark):
    got = dict(tuple(x) for x in G.topological(edges(spark, [(1, 2), (2, 3), (4, 5), (5, 4)])).collect())
    assert got == {3: 0, 2: 1, 1: 2, 4: None, 5: None}


def test_iterations_end_by_themselves(spark):
    chain = edges(spark, [(i, i + 1) for i in range(34)])
    seed = spark.createDataFrame([(0,)], "node bigint")
    assert {tuple(x) for x in G.reach(chain, seed, None).select("node", "depth").collect()} == {(i, i) for i in range(35)}
    with pytest.raises(RuntimeError):
        G.components(chain, rounds=1)
    with pytest.raises(RuntimeError):
        G.topological(edges(spark, [(1, 2), (2, 3)]), rounds=2)


def test_bytes_are_decoded_or_refused():
    assert files.decode_text("naïve".encode()) == ("naïve", "utf-8", "strict")
    assert files.decode_text(b"\xef\xbb\xbfa")[:2] == ("a", "utf-8-sig")
    assert files.decode_text("\ufeffдом".encode("utf-16-le"))[:2] == ("дом", "utf-16le")
    assert files.decode_text("\ufeffдом".encode("utf-16-be"))[:2] == ("дом", "utf-16be")
    assert files.decode_text("Привет, мир".encode("cp1251"))[:2] == ("Привет, мир", "cp1251")
    assert files.decode_text("café “x”".encode("cp1252"))[:2] == ("café “x”", "cp1252")
    for raw in ("a".encode("utf-32"), b"a\0b", b"\xef\xbb\xbf\xff", b"\xff\xfea", b"\x81abc", b"\xe9\x01"):
        with pytest.raises(ValueError):
            files.decode_text(raw)


def test_closest_pairs_of_all_documents(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 64))
    x = np.concatenate([x[r.integers(0, 60, 300)] + 0.5 * r.normal(size=(300, 64)), x[:3], x[:3]])
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(v @ v.T, 9)
    want = sorted((-s[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.6)[:100]
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "id bigint, embedding array<double>")
    for size in (1000, 50):
        got = [tuple(r) for r in PS.closest_pairs(df, 100, 0.6, size).collect()]
        assert [(a, b) for a, b, _ in got] == [(i, j) for _, i, j in want]
    rows = [(2 * i + k, i, k, e.tolist() if k == 0 else [1.0] * 64) for i, e in enumerate(x) for k in (0, 1)]
    spark.createDataFrame(rows, "id bigint, document_id bigint, chunk_index int, embedding array<double>").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {(r.a, r.b) for r in registry.queries()["near_duplicate_documents"](spark, str(tmp_path)).collect()} == {(i, j) for _, i, j in want}
    used = [n for r in registry.queries()["compress_pairs"](spark, str(tmp_path)).collect() for n in (r.a, r.b)]
    assert len(used) == len(set(used)) and max(used) > 200


def test_reach_caps_nodes_in_order(spark):
    e = edges(spark, [(0, x) for x in (5, 3, 9)] + [(3, 4)])
    seed = spark.createDataFrame([(0,)], "node bigint")
    assert {tuple(x) for x in G.reach(e, seed, 3).collect()} == {(0, 0), (3, 1), (5, 1), (9, 1), (4, 2)}
    assert {tuple(x) for x in G.reach(e, seed, 3, node_cap=3).collect()} == {(0, 0), (3, 1), (5, 1)}


def test_links_and_tags(spark):
    d = spark.createDataFrame([(1, "See [[A  b|x]] and `[[no]]` #Good #fff #123\n```\n[[no]] #no\n```\n[[A b#h]]"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(x) for x in G.links(d, "doc_id", "text").orderBy("ordinal").collect()] == [(1, 0, "a b"), (1, 1, "a b")]
    assert [tuple(x) for x in G.tags(d, "doc_id", "text").collect()] == [(1, "good")]


def test_c3_order(spark):
    bases = {"O": [], "A": ["O"], "B": ["O"], "C": ["A", "B"], "D": ["B", "A"], "E": ["C", "D"]}
    assert C.linearise(bases, "C") == ["C", "A", "B", "O"]
    with pytest.raises(ValueError):
        C.linearise(bases, "E")
    rows = [("p", c, b, i) for c, bs in bases.items() for i, b in enumerate(bs or [None])]
    got = {r.class_name: r.order for r in C.mro(spark.createDataFrame(rows, "project string, class_name string, base string, position int")).collect()}
    assert got["C"] == ["C", "A", "B", "O"] and got["E"] is None


def test_schema_replay(spark):
    rows = [("t", 1, "create", None, None), ("t", 2, "add", "a", "int"), ("t", 3, "add", "b", "int"), ("t", 4, "alter", "a", "text"), ("t", 5, "drop_column", "b", None), ("u", 1, "create", None, None), ("u", 2, "add", "x", "int"), ("u", 3, "drop", None, None), ("v", 1, "add", "x", "int")]
    got = C.replay_schema(spark.createDataFrame(rows, "table_name string, seq int, action string, column_name string, type string"))
    assert {tuple(x) for x in got.collect()} == {("t", "a", "text")}


def docx(parts):
    b = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{parts}</w:body></w:document>")
    return b.getvalue()


def xlsx():
    b = io.BytesIO()
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>3</v></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "skip.md").write_text("no")
    (tmp_path / "a.html").write_text("<html><nav>menu</nav><body><h1>T</h1><p>One <b>two</b></p><script>x</script></body></html>")
    (tmp_path / "b.docx").write_bytes(docx('<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'))
    (tmp_path / "c.xlsx").write_bytes(xlsx())
    (tmp_path / "d.txt").write_bytes("Gr\u00fc\u00dfe".encode("cp1252"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "f.bin").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.reason is None) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.html": ("T\nOne two", True), "b.docx": ("## Head\n\n| c |", True), "c.xlsx": ("name\t3", True), "d.txt": ("Grüße", True), "e.docx": (None, False), "f.bin": (None, False)}


def test_bundles_and_backups(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "id bigint, t string, x double")
    files.write_bundle(df, str(tmp_path / "b"))
    assert sorted(map(tuple, files.read_bundle(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, df.collect()))
    spark.createDataFrame([(3, "z", 1.0, 1)], "id bigint, t string, x double, other int").write.mode("append").json(str(tmp_path / "b/rows"))
    with pytest.raises(ValueError):
        files.read_bundle(spark, str(tmp_path / "b"))
    assert files.backup(df, str(tmp_path / "copy")) == {"rows": 2}


def test_graph_export(spark, tmp_path):
    n, e = spark.createDataFrame([("a", 1), ("b", None)], "node string, size int"), spark.createDataFrame([("a", "b")], "src string, dst string")
    for _ in range(2):
        files.export_graph(n, e, str(tmp_path / "g"))
    a, b = files.read_graph(spark, str(tmp_path / "g"), "node string, size int", "src string, dst string")
    assert sorted(map(tuple, a.collect()), key=str) == [("a", 1), ("b", None)] and [tuple(r) for r in b.collect()] == [("a", "b")]


def test_metadata_merge(spark):
    df = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}'), (None, '{"c":"1"}'), ("bad", None)], "a string, b string")
    assert [r[0] for r in df.select(files.merge_metadata(F.col("a"), F.col("b"))).collect()] == ['{"a":"1","b":"3"}', '{"c":"1"}', "{}"]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id")
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string, revision bigint")
    t.create(rows((1, "", 1)).schema)
    t.create(rows((1, "", 1)).schema)
    t.insert(rows((1, "a", 1), (2, "b", 1), (3, None, 1)))
    t.upsert(rows((2, "B", 1), (4, "d", 1)))
    t.delete(F.col("v") == "a")  # null keeps row 3
    assert {(r.id, r.v) for r in t.read().collect()} == {(2, "B"), (3, None), (4, "d")}
    cas = lambda i, e: spark.createDataFrame([(i, "new", e)], "id bigint, v string, expected bigint")
    t.compare_and_set(cas(4, 1))
    assert {(r.id, r.revision) for r in t.read().collect()} == {(2, 1), (3, 1), (4, 2)}
    with pytest.raises(Conflict):
        t.compare_and_set(cas(4, 1))
    t.update(F.col("id") == 3, v=F.lit("c"))
    t.delete_ids(spark.createDataFrame([(2,)], "id bigint"))
    assert {(r.id, r.change) for r in t.diff(2, t.versions()[-1]).collect()} == {(1, "removed"), (2, "removed"), (3, "changed"), (4, "added")}
    t.restore(2)
    assert t.read().count() == 3
    with pytest.raises(ZeroDivisionError):
        t.change(lambda now: now.filter(F.lit(1 / 0)))
    assert t.read().count() == 3


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.sql("select id as entity, id div 3 as generation, timestamp'2026-01-01' + make_interval(0,0,0,0,0,cast(id as int)*10) as ts from range(9)").write.parquet(log)
    schema = "entity bigint, generation bigint, ts timestamp"
    q = changes.latest_per_key(changes.change_log(spark, log, schema), "entity", "generation").writeStream.format("memory").queryName("gens").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("gens").count() == 9
    q = changes.windowed_counts(changes.change_log(spark, log, schema), "ts", ["generation"], "1 hour", "10 minutes").writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    # the watermark has passed the first hour, which holds two generations, and not the second
    assert {(r.generation, r.n) for r in spark.table("wins").collect()} == {(0, 3), (1, 3)}
    batch = spark.read.parquet(log)
    assert changes.changed_between(batch, "generation", "entity", 0, 2).count() == 6
    assert changes.changed_between(batch, "generation", "entity", 1, 3) is None


def test_text_functions():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("probate", "probat"), ("controll", "control"), ("adoption", "adopt"), ("sky", "sky")):
        assert X.porter(w) == s, w
    t = "word " * 50
    c = X.fixed_chunks(t, 60, 10)
    assert c[0][0] == 0 and c[-1][1] == len(t) and all(b - a <= 60 for a, b in c) and all(x[0] == max(p[1] - 10, p[0] + 1) for p, x in zip(c, c[1:]))
    assert X.fixed_chunks("", 5, 0) == [] and X.fixed_chunks("abc", 5, 0) == [(0, 3)]
    code = "def f():\n    pass\n\n\ndef g():\n    pass\n" * 9
    pieces = X.code_chunks(code, 100)
    assert "".join(code[a:b] for a, b in pieces) == code and all(b - a <= 100 for a, b in pieces)
    assert X.heading_paths("# A\n## B\n```\n# no\n```\n# C")[-1][1] == ["C"]
    m = "a `b` c"
    assert X.mask_code(m) == "a     c" and X.line_diff("a\nb", "a\nc") == (1, 1)
    v = X.mock_embedding(" x ", 8)
    assert v == X.mock_embedding("x", 8) and abs(sum(a * a for a in v) - 1) < 1e-9


def test_code_facts(spark):
    py = 'class A:\n    def f(self): pass\n\nclass B(A, metaclass=M):\n    def f(self):\n        return g(1)\n\n@app.get("/x/{id}")\ndef h(): pass\n'
    js = 'fetch("/api/a"); axios.post(`/api/b`); $t("hi"); $t("hi")\n'
    yml = "services:\n  web:\n    image: nginx:1\n  db:\n    ports: []\nvolumes:\n  v:\n"
    b = spark.createDataFrame([("/p/a.py", py), ("/p/b.py", "def ("), ("/p/c.js", js), ("/p/compose.yml", yml), ("/p/r.php", "Route::post('/z', 1);")], "canonical_path string, content string")
    facts = C.python_facts(b)
    assert {(r.kind, r.owner, r.name) for r in facts.collect()} == {("class", "", "A"), ("method", "A", "f"), ("class", "", "B"), ("method", "B", "f"), ("call", "B.f", "g"), ("call", "", "get"), ("function", "", "h")}
    bases = C.inheritance(b)
    assert {(r.class_name, r.base) for r in bases.collect()} == {("A", None), ("B", "A")}
    assert [tuple(r) for r in C.overrides(facts, bases).collect()] == [("B", "A", "f")]
    assert {(r.method, r.route) for r in C.routes(b).collect()} == {("get", "/x/{id}"), ("post", "/z")}
    assert {r.url for r in C.client_endpoints(b).collect()} == {"/api/a", "/api/b"}
    assert [tuple(r) for r in C.translation_keys(b).collect()] == [("hi", 2, 1)]
    assert {(r.service, r.image) for r in C.services(b).collect()} == {("web", "nginx:1"), ("db", None)}


def test_search_refuses_and_degenerates(spark):
    from corvane.operators import search as S

    c = spark.createDataFrame([(1, 1, 0, "a cat", [1.0, 0.0]), (2, 1, 1, "a dog", [0.0, 1.0]), (2, 1, 1, "a dog", [0.0, 1.0]), (3, 2, 0, None, None), (4, 3, 0, "", [0.0, 0.0])], "id bigint, document_id bigint, chunk_index bigint, content string, embedding array<float>")
    d = spark.sql("select cast(id as bigint) doc_id, 'T' title, null uri, timestamp'2026-05-31' updated_at from range(1, 4)").withColumn("uri", F.lit(None).cast("string"))
    for q, k in (("", 5), ("x" * 5000, 5), ("a", 0), ("a", 101)):
        with pytest.raises(ValueError):
            S.search(c, d, q, mode="lex", top_k=k)
    with pytest.raises(ValueError):
        S.search(c, d, "a", mode="vec")
    got = S.search(c, d, "cat", [1.0, 0.0], "hybrid", 5).collect()
    assert [r.chunk_id for r in got][0] == 1 and len({r.chunk_id for r in got}) == len(got)
    assert S.search(c, d, "nothing", mode="lex").count() == 0
    assert S.search(c.limit(0), d, "cat", mode="lex").count() == 0
