"""Code-graph queries over a small project held here and every indexed source of the tables.

The tables hold no imports and no calls between files, so what the operators must find is planted: a project of a few files in
several languages, read together with all sources. Its expected rows are written out in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import code as C
from corvane.operators import graph as G
from corvane.operators import project as J
from corvane.plans.base import Plans

P = Plans()
query = P.query

FILES = {
    "app/__init__.py": "",
    "app/models.py": """class Base:
    def save(self):
        return self.check()

    def check(self):
        return True


class Note(Base):
    def check(self):
        if self.text == "":
            return False
        return len(self.text) < 100

    def unused(self):
        return None
""",
    "app/store.py": """import os
from app.models import Note
from . import util

PATH = os.environ["STORE_PATH"]


def load(name):
    raw = util.read(name)
    parts = raw.split(",")
    text = parts[0]
    note = Note()
    note.text = text
    return note


def save(note):
    total = 0
    for p in note.parts:
        total += len(p)
    note.save()
    return total


def stale():
    return load("old")
""",
    "app/util.py": """def read(name):
    return open(name).read()


def spare():
    return read("x")
""",
    "app/web.py": """from app import store

app = object()


@app.get("/notes/{name}")
def show(name):
    return store.load(name)


@app.post("/notes")
def add(note):
    return store.save(note)
""",
    "app/orphan.py": """def lonely():
    return 1
""",
    "app/broken.py": "def broken(:\n",
    "tests/test_store.py": """from app.store import load
import app.util as u


def test_load():
    assert load("a").text == "a"


def test_read():
    assert u.read("a")
""",
    "ui/index.js": """import { show, hide as close } from './view';
import Panel from './panel';
const http = require('./http');

export function start() {
  show(); // close(2)
  close();
  http.send('7');
  return new Panel();
}

start();
""",
    "ui/view.js": """export function show() {
  return draw();
}
export function hide() { return 1; }
function draw() { return 2; }
""",
    "ui/panel.ts": """import { Base } from './base';
export default class Panel extends Base {
}
""",
    "ui/base.ts": """export class Base {
}
""",
    "ui/http.js": """function send(id) {
  return fetch(`/notes/${id}`);
}
function all() { return fetch('/notes'); }
function lost() { return fetch('/nowhere'); }
""",
    "db/001.sql": """create table notes (id bigint primary key, text varchar(100), old int); -- drop table notes
create table tags (note_id bigint, tag text, primary key (note_id, tag));
""",
    "db/002.sql": """alter table notes drop column old;
ALTER TABLE notes ADD COLUMN rank int;
drop table if exists tags;
""",
    "db/load.sql": """insert into notes (id, text, old) select id, text, 1 from notes where id > 3;
insert into tags (note_id) values (1);
""",
    "web/routes.php": """<?php
Route::get('/admin', 'Admin@index');
Route::post("/admin/users", 'Admin@add');
echo trans('greeting') . trans('parting');
""",
    "web/page.php": "<?php echo trans('greeting'); ?>",
    "deploy/compose.yml": """services:
  web:
    image: web:1
    ports:
      - "80:8080"
    depends_on: [db]
  db:
    image: store:16
""",
}
#: the same project one commit earlier
BEFORE = {k: v for k, v in FILES.items() if k != "app/orphan.py"} | {
    "app/util.py": "def read(name):\n    return open(name, 'rb').read()\n\n\ndef spare():\n    return   read(\"x\")\n\n\ndef gone():\n    return 0\n"}


def project(t, files=None):
    rows = [("demo", k, v) for k, v in (FILES if files is None else files).items()]
    return t("code_index_source_blobs").sparkSession.createDataFrame(rows, "project string, path string, content string")


def sources(t):
    """The planted project and every indexed source."""
    b = t("code_index_source_blobs").select(F.lit("vaults").alias("project"), F.regexp_replace("canonical_path", "^/", "").alias("path"), "content")
    return project(t).unionByName(b.filter("content is not null"))


_KNOWN: dict = {}


def _once(t, what: str, make):
    """Facts and graph of one set of tables are written once a session; the shared folder keeps them as long."""
    b = t("code_index_source_blobs")
    key = (b.sparkSession.sparkContext.applicationId, what, *b.inputFiles())
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]


def parsed(t):
    s = sources(t)
    return _once(t, "facts", lambda: J.facts(s)), s


def graph(t):
    f, s = parsed(t)
    return _once(t, "graph", lambda: J.code_graph(f, s)), f, s


def node(t, *names):
    return t("code_index_source_blobs").sparkSession.createDataFrame([(n,) for n in names], "node string")


def values(columns: str, *rows: tuple) -> str:
    """SQL of literal rows."""
    one = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns})"


@query(values(
    "path, name, member, file", ("app/store.py", "Note", "Note", "app/models.py"), ("app/store.py", "util", None, "app/util.py"), ("app/web.py", "store", None, "app/store.py"),
    ("tests/test_store.py", "load", "load", "app/store.py"), ("tests/test_store.py", "u", None, "app/util.py"), ("ui/index.js", "show", "show", "ui/view.js"),
    ("ui/index.js", "close", "hide", "ui/view.js"), ("ui/index.js", "Panel", "default", "ui/panel.ts"), ("ui/index.js", "http", None, "ui/http.js"), ("ui/panel.ts", "Base", "Base", "ui/base.ts")))
def import_targets(t):
    """Imports with the file each names."""
    return J.file_imports(*parsed(t)).select("path", "name", "member", "file")


@query(values(
    "caller, callee, how", ("app/models.py::Base.save", "app/models.py::Base.check", "self"), ("app/store.py::load", "app/util.py::read", "module"), ("app/store.py::load", "app/models.py::Note", "import"),
    ("app/store.py::stale", "app/store.py::load", "local"), ("app/util.py::spare", "app/util.py::read", "local"), ("app/web.py::show", "app/store.py::load", "module"), ("app/web.py::add", "app/store.py::save", "module"),
    ("tests/test_store.py::test_load", "app/store.py::load", "import"), ("tests/test_store.py::test_read", "app/util.py::read", "module"), ("ui/index.js::start", "ui/view.js::show", "import"),
    ("ui/index.js::start", "ui/view.js::hide", "import"), ("ui/index.js::start", "ui/http.js::send", "module"), ("ui/index.js::start", "ui/panel.ts::Panel", "import"), ("ui/index.js::", "ui/index.js::start", "local"),
    ("ui/view.js::show", "ui/view.js::draw", "local")))
def bound_calls(t):
    """Calls with the definition each binds to."""
    f, s = parsed(t)
    i = J.file_imports(f, s)
    c = J.calls(f, i, J.ancestors(J.inheritance(f, i))).filter("to_qual is not null and project = 'demo'")
    return c.select(F.concat_ws("::", "path", "owner").alias("caller"), F.concat_ws("::", "to_path", "to_qual").alias("callee"), "how").distinct()


@query(values("rel, edges", ("calls", 15), ("imports", 9), ("inherits", 2), ("overrides", 1)))
def edge_union_stats(t):
    """Edges of each kind in the union of all of the project's, each once."""
    return graph(t)[0].filter("project = 'demo'").groupBy("rel").agg(F.count("*").alias("edges"))


@query(values("class_name, base, to_file", ("Note", "Base", "app/models.py"), ("Panel", "Base", "ui/base.ts")))
def class_inheritance(t):
    f, s = parsed(t)
    return J.inheritance(f, J.file_imports(f, s)).select("class_name", "base", F.col("to_path").alias("to_file"))


@query(values("method, overridden", ("app/models.py::Note.check", "app/models.py::Base.check")))
def override_edges(t):
    f, s = parsed(t)
    return J.overrides(f, J.ancestors(J.inheritance(f, J.file_imports(f, s)))).select("method", "overridden")


@query(values("class_name, linear", ("A", "A,B,C,D"), ("B", "B,D"), ("C", "C,D"), ("D", "D"), ("E", "E,A,B,C,D"), ("X", None), ("Y", "Y"), ("Z", "Z")))
def method_order(t):
    """Method resolution orders of a diamond, of a class above it, and of one that has none."""
    rows = [("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("D", None, None), ("E", "A", 0), ("X", "Y", 0), ("X", "Z", 1), ("X", "Y", 2), ("Y", None, None), ("Z", None, None)]
    own = t("code_index_source_blobs").sparkSession.createDataFrame([("demo", *r) for r in rows], "project string, class_name string, base string, position int")
    return C.mro(own).select("class_name", F.array_join("order", ",").alias("linear"))


@query(values(
    "node, depth", ("app/util.py::read", 0), ("app/store.py::load", 1), ("app/util.py::spare", 1), ("tests/test_store.py::test_read", 1), ("app/store.py::stale", 2), ("app/web.py::show", 2), ("tests/test_store.py::test_load", 2)))
def impact_closure(t):
    """What depends on a function, directly or through others, with the least depth."""
    return J.impact(graph(t)[0], node(t, "app/util.py::read"))


@query(values("node, depth", ("ui/index.js::", 0), ("ui/index.js::start", 1), ("ui/view.js::", 1), ("ui/panel.ts::", 1), ("ui/http.js::", 1), ("ui/view.js::show", 2), ("ui/view.js::hide", 2), ("ui/http.js::send", 2), ("ui/panel.ts::Panel", 2),
    ("ui/base.ts::", 2), ("ui/view.js::draw", 3), ("ui/base.ts::Base", 3)))
def dependency_closure(t):
    """What a module depends on, directly or through others."""
    return G.reach(graph(t)[0], node(t, "ui/index.js::"), None)


@query(values(
    "path", ("app/web.py::show>app/store.py::load",), ("app/web.py::show>app/store.py::load>app/util.py::read",), ("app/web.py::show>app/store.py::load>app/models.py::Note",),
    ("app/web.py::show>app/store.py::load>app/models.py::Note>app/models.py::Base",)))
def trace_paths(t):
    """Simple paths of up to four steps from a route's function."""
    return G.simple_paths(graph(t)[0], "app/web.py::show", 4).select(F.array_join("path", ">").alias("path"))


@query(values(
    "node", ("app/models.py::Note.unused",), ("app/orphan.py::lonely",), ("app/store.py::stale",), ("app/util.py::spare",), ("ui/http.js::all",), ("ui/http.js::lost",)))
def dead_code(t):
    """Functions and methods of the project that nothing running reaches."""
    g, f, _ = graph(t)
    return J.dead_symbols(f.filter("project = 'demo'"), g.filter("project = 'demo'"))


@query(values("path", ("app/orphan.py",)))
def dead_files(t):
    g, f, _ = graph(t)
    return J.dead_files(f.filter("project = 'demo'"), g)


@query(values("node, depth", ("tests/test_store.py::test_read", 1), ("tests/test_store.py::test_load", 2)))
def affected_tests(t):
    """Tests that depend on a function."""
    return J.impact(graph(t)[0], node(t, "app/util.py::read")).filter(J.is_test(F.col("node")))


@query(values("file, depth", ("app/models.py", 0), ("app/store.py", 1), ("app/web.py", 2), ("tests/test_store.py", 2)))
def file_impact(t):
    """Files that import a file, directly or through others."""
    g = graph(t)[0].filter("rel = 'imports'")
    return J.impact(g, node(t, "app/models.py::")).select(F.regexp_replace("node", "::$", "").alias("file"), "depth")


@query(values(
    "node, change, depth", ("app/orphan.py::lonely", "added", 0), ("app/util.py::gone", "removed", 0), ("app/util.py::read", "changed", 0), ("app/store.py::load", None, 1), ("app/util.py::spare", None, 1),
    ("tests/test_store.py::test_read", None, 1), ("app/store.py::stale", None, 2), ("app/web.py::show", None, 2), ("tests/test_store.py::test_load", None, 2)))
def change_impact(t):
    """Symbols that differ between two states of a project, and what depends on them in the later one."""
    changed = J.tree_difference(project(t, BEFORE), project(t)).persist()
    reached = J.impact(graph(t)[0], changed.select("node"))
    return reached.join(changed, "node", "left").select("node", "change", "depth")


@query(values("file, level", ("app/util.py", 0), ("app/models.py", 0), ("app/store.py", 1), ("app/web.py", 2), ("tests/test_store.py", 2), ("ui/view.js", 0), ("ui/http.js", 0), ("ui/base.ts", 0), ("ui/panel.ts", 1), ("ui/index.js", 2)))
def dependency_order(t):
    """Levels in which files can be loaded, what they import first."""
    g = graph(t)[0].filter("rel = 'imports'")
    return G.topological(g).select(F.regexp_replace("node", "::$", "").alias("file"), "level")


@query("""with recursive e(src, dst) as (select * from (values ('s','a'), ('s','u'), ('w','s'), ('t','s'), ('t','u'), ('i','v'), ('i','p'), ('i','h'), ('p','b')) v),
n as (select src as x from e union select dst from e), d as (select src, count(*) as deg from e group by 1), name(x, file) as (select * from (values ('s','app/store.py'), ('a','app/models.py'), ('u','app/util.py'), ('w','app/web.py'),
 ('t','tests/test_store.py'), ('i','ui/index.js'), ('v','ui/view.js'), ('p','ui/panel.ts'), ('h','ui/http.js'), ('b','ui/base.ts')) v),
r(i, m) as (select 0, map_from_entries(list((x, 1e0 / 10))) from n union all
 select i + 1, map_from_entries((select list((x, 0.15e0 / 10 + 0.85e0 * (coalesce((select sum(m[e.src] / deg) from e join d on d.src = e.src where e.dst = n.x), 0) + (select sum(m[x]) from n where x not in (select src from e)) / 10))) from n)) from r where i < 24)
select file, round(m[x], 6) as rank from r, name where i = 24""")
def repo_map_rank(t):
    """Ranks of the project's files by what imports them."""
    g = graph(t)[0].filter("rel = 'imports'")
    return G.pagerank(g).select(F.regexp_replace("node", "::$", "").alias("file"), F.round("rank", 6).alias("rank"))


@query(values("file, symbol, callers", ("app/store.py", "load", 3), ("app/util.py", "read", 3), ("app/store.py", "save", 1), ("app/models.py", "Note", 1), ("app/models.py", "Base.check", 1), ("ui/view.js", "show", 1), ("ui/view.js", "hide", 1),
    ("ui/view.js", "draw", 1), ("ui/http.js", "send", 1), ("ui/panel.ts", "Panel", 1), ("ui/index.js", "start", 1)))
def repo_map(t):
    """The symbols of each file by how many others call them: what a map of the project shows first."""
    g = graph(t)[0].filter("rel = 'calls'").groupBy("dst").agg(F.countDistinct("src").alias("callers"))
    return g.select(F.split("dst", "::")[0].alias("file"), F.split("dst", "::")[1].alias("symbol"), "callers")


@query(values("name, depth", ("note", 0), ("Note", 1), ("text", 1), ("parts", 2), ("raw", 3), ("name", 4), ("util", 4)))
def data_slice_of_object(t):
    """An object's value comes from what its attributes are set to as well."""
    return J.data_slice(parsed(t)[0], "app/store.py", "load", "note")


@query(values("name, depth", ("text", 0), ("parts", 1), ("raw", 2), ("name", 3), ("util", 3)))
def data_slice(t):
    """What the value of a local name comes from."""
    return J.data_slice(parsed(t)[0], "app/store.py", "load", "text")


@query(values("function, value, given_when, callers", ("app/models.py::Base.check", "true", "", "app/models.py::Base.save"), ("app/models.py::Note.check", "false", "self.text == ''", ""), ("app/models.py::Note.check", "condition", "len(self.text) < 100", "")))
def policy_trace(t):
    """When functions return true or false, and who asks them."""
    g, f, _ = graph(t)
    return J.policy_trace(f, g).select("function", "value", F.col("condition").alias("given_when"), F.array_join("callers", ",").alias("callers"))


@query(values("kind, name, path", ("address", "/notes/${id}", "ui/http.js"), ("address", "/notes", "ui/http.js"), ("address", "/nowhere", "ui/http.js"), ("route", "/notes/{name}", "app/web.py"), ("route", "/notes", "app/web.py"), ("setting", "STORE_PATH", "app/store.py"),
    ("table", "notes", "db/load.sql"), ("table", "tags", "db/load.sql")))
def outside_references(t):
    """Tables, routes, addresses and settings that the project's sources refer to."""
    f, _ = parsed(t)
    return J.outside_references(f, project(t))


@query(values("address, route, handler", ("/notes/${id}", "/notes/{name}", "app/web.py::show"), ("/notes", "/notes", "app/web.py::add"), ("/nowhere", None, None)))
def endpoint_routes(t):
    """Client addresses and the routes they meet."""
    return J.endpoints_met(*parsed(t)).select("address", "route", "handler")


@query(values("table_name, column_name, type", ("notes", "id", "bigint"), ("notes", "text", "varchar(100)"), ("notes", "rank", "int")))
def schema_replay(t):
    """The tables after all schema statements of the sources in path order."""
    e = J.ddl_events(sources(t)).withColumn("seq", F.struct("path", "at", "part"))
    return C.replay_schema(e)


@query(values("path, table_name, column_name, problem", ("db/load.sql", "notes", "old", "no column"), ("db/load.sql", "tags", "note_id", "no table")))
def write_check(t):
    """Writes to tables or columns that the replayed schema lacks."""
    s = sources(t)
    schema = C.replay_schema(J.ddl_events(s).withColumn("seq", F.struct("path", "at", "part")))
    return J.write_problems(schema, J.inserts(s))


@query(values("path, table_name, column_name, problem", ("db/load.sql", "notes", "id", "no table"), ("db/load.sql", "notes", "text", "no table"), ("db/load.sql", "notes", "old", "no table"), ("db/load.sql", "tags", "note_id", "no table")))
def write_check_live(t):
    """The same writes against the tables that are there."""
    s = sources(t)
    live = [(n, c, k) for n in ("nation", "region", "documents", "chunks", "events") for c, k in t(n).dtypes]
    return J.write_problems(s.sparkSession.createDataFrame(live, "table_name string, column_name string, type string"), J.inserts(s))


@query(values("service, rel, target", ("web", "service", None), ("web", "image", "web:1"), ("web", "ports", "80:8080"), ("web", "depends_on", "db"), ("db", "service", None), ("db", "image", "store:16")))
def infrastructure_graph(t):
    return J.service_graph(sources(t)).select("service", "rel", "target")


@query(values(
    "path, symbol, part, first_line, last_line", ("app/models.py", "Base", 0, 1, 6), ("app/models.py", "Note", 0, 9, 12), ("app/models.py", "Note", 1, 13, 16), ("app/store.py", None, 0, 1, 7), ("app/store.py", "load", 0, 8, 12), ("app/store.py", "load", 1, 13, 14),
    ("app/store.py", "save", 0, 17, 21), ("app/store.py", "save", 1, 22, 22), ("app/store.py", "stale", 0, 25, 26), ("app/util.py", "read", 0, 1, 2), ("app/util.py", "spare", 0, 5, 6), ("app/web.py", None, 0, 1, 5),
    ("app/web.py", "show", 0, 6, 8), ("app/web.py", "add", 0, 11, 13), ("app/orphan.py", "lonely", 0, 1, 2)))
def structural_chunks(t):
    """Definitions as chunks, over 110 characters in parts of whole lines; only the application's own files."""
    f, s = parsed(t)
    own = s.filter("project = 'demo' and path like 'app/%'")
    return J.structural_chunks(f, own, 110)


@query(values("op, node", ("impact", "app/store.py::load"), ("impact", "app/store.py::stale"), ("impact", "app/util.py::read"), ("impact", "app/util.py::spare"), ("impact", "app/web.py::show"), ("impact", "tests/test_store.py::test_load"), ("impact", "tests/test_store.py::test_read"),
    ("tests", "tests/test_store.py::test_load"), ("tests", "tests/test_store.py::test_read"), ("callees", "app/util.py::read")))
def analysis_query(t):
    """Several questions about one symbol over one graph, each by its name."""
    g = graph(t)[0]
    seed = node(t, "app/util.py::read")
    up = J.impact(g, seed)
    ask = {"impact": up, "tests": up.filter(J.is_test(F.col("node"))), "callees": G.reach(g.filter("rel = 'calls'"), seed, 1)}
    out = None
    for op, df in ask.items():
        own = df.select(F.lit(op).alias("op"), "node")
        out = own if out is None else out.unionByName(own)
    return out


@query(values("component, nodes", ("app/models.py::", 5), ("ui/base.ts::", 5)))
def import_components(t):
    """Connected parts of the import graph, named by their smallest file."""
    g = graph(t)[0].filter("rel = 'imports'")
    return G.components(g).groupBy("component").agg(F.count("*").alias("nodes"))


@query(values("project, functions", ("demo", 21)) + r""" union all select 'vaults', count(*) from (select distinct canonical_path, unnest(regexp_extract_all(content, '(?m)^def ([A-Za-z_][0-9A-Za-z_]*)', 1)) from code_index_source_blobs where canonical_path like '%.py'
 union all select canonical_path, unnest(regexp_extract_all(content, '(?m)^[ \t\r\n\v\f]*(?:pub[ \t\r\n\v\f]+)?(?:async[ \t\r\n\v\f]+)?(?:fn|func|function|class|struct|def)[ \t\r\n\v\f]+([A-Za-z_][0-9A-Za-z_]*)', 1)) from code_index_source_blobs where canonical_path not like '%.py')""")
def parsed_functions(t):
    """Functions and methods that the front ends read, by project."""
    f, _ = parsed(t)
    return J.symbols(f).filter("kind <> 'class'").groupBy("project").agg(F.count("*").alias("functions"))


@query(values("path, method, route", ("app/web.py", "get", "/notes/{name}"), ("app/web.py", "post", "/notes"), ("web/routes.php", "get", "/admin"), ("web/routes.php", "post", "/admin/users")))
def route_registrations(t):
    """Routes that decorators and facades register."""
    return C.routes(sources(t).withColumnRenamed("path", "canonical_path")).withColumnRenamed("canonical_path", "path")


@query(values("path, url", ("ui/http.js", "/notes/${id}"), ("ui/http.js", "/notes"), ("ui/http.js", "/nowhere")))
def client_calls(t):
    return C.client_endpoints(sources(t).withColumnRenamed("path", "canonical_path")).withColumnRenamed("canonical_path", "path")


@query(values("key, uses, files", ("greeting", 2, 2), ("parting", 1, 1)))
def translation_uses(t):
    return C.translation_keys(sources(t).withColumnRenamed("path", "canonical_path"))


@query(values("name, depth, node", ("notes", 0, "db/load.sql::")) .replace("select *", "select name, depth, node"))
def table_readers(t):
    """Modules that read or write a table, and what depends on them."""
    g, f, s = graph(t)
    at = J.outside_references(f, s).filter("kind = 'table' and name = 'notes'").select(F.concat("path", F.lit("::")).alias("node"))
    return J.impact(g, at).select(F.lit("notes").alias("name"), "depth", "node")
