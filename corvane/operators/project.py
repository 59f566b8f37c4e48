"""Code graphs of whole projects: facts of sources, import binding, calls, and what follows from them.

``facts`` reads every source once, in Arrow batches: Python by its syntax tree, JavaScript and TypeScript by their
statements, other languages by their definitions. Everything after that is joins: imports to files, names to
definitions, calls to edges. A symbol is ``path::qualified.name``; ``path::`` is the module itself.

Defined results: sources that can't be parsed, and null ones, give no facts; repeated sources give their facts once; a name with
several definitions of equal standing binds to none.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.sources.tables import checkpointed

FACT = (
    "project string, path string, kind string, owner string, name string, target string, line int, last int, position int, text string, candidates array<string>"
)
SCRIPT = (".js", ".jsx", ".ts", ".tsx", ".mjs")
JS_IMPORT = re.compile(r"^\s*import\s+(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)\s*)?(?:\{([^}]*)\}\s*)?from\s*['\"]([^'\"]+)['\"]", re.M)
JS_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")
JS_DEF = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+(\w+)\s*\(|class\s+(\w+)(?:\s+extends\s+([\w.]+))?)", re.M)
JS_CALL = re.compile(r"(?<![\w.])(?:(\w+(?:\.\w+)*)\.)?(\w+)\s*\(")
JS_WORDS = frozenset("if for while switch catch function return typeof new await super import require constructor".split())
OTHER_DEF = re.compile(r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|func|function|class|struct|def)\s+([A-Za-z_]\w*)", re.M)


def _join(base: str, *parts: str) -> str:
    out: list[str] = []
    for p in [*base.split("/"), *(x for y in parts for x in y.split("/"))]:
        if p == "..":
            if out:
                out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _python_candidates(path: str, module: str, level: int, member: str | None) -> list[str]:
    """Files that an import may name, best first."""
    base = "/".join(path.split("/")[:-level]) if level else ""
    at = _join(base, module.replace(".", "/"))
    inner = [f"{at}/{member}.py".lstrip("/"), f"{at}/{member}/__init__.py".lstrip("/")] if member else []
    return [*inner, *([f"{at}.py"] if at else []), f"{at}/__init__.py".lstrip("/")]


def _python(path: str, source: str) -> Iterator[tuple]:
    tree = ast.parse(source)

    def dotted(n) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            d = dotted(n.value)
            return d and f"{d}.{n.attr}"
        return None

    def names(n) -> list[str]:
        return sorted({x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)})

    def flow(fn, owner: str, body, conditions: list[str]) -> Iterator[tuple]:
        """Definitions with the names they use, and boolean returns with their conditions, of one function."""
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(s, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and s.value is not None:
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    for x in ast.walk(t):
                        if isinstance(x, ast.Name):
                            used = names(s.value) + ([x.id] if isinstance(s, ast.AugAssign) else [])
                            for u in used or [None]:
                                yield "use", owner, x.id, u, s.lineno, None, None, None, None
            if isinstance(s, (ast.For, ast.AsyncFor)):
                for x in ast.walk(s.target):
                    if isinstance(x, ast.Name):
                        for u in names(s.iter) or [None]:
                            yield "use", owner, x.id, u, s.lineno, None, None, None, None
            if isinstance(s, ast.Return) and s.value is not None:
                for u in names(s.value):
                    yield "use", owner, "return", u, s.lineno, None, None, None, None
                if isinstance(s.value, ast.Constant) and isinstance(s.value.value, bool):
                    yield "flag", owner, str(s.value.value).lower(), None, s.lineno, None, None, " and ".join(conditions), None
                elif isinstance(s.value, (ast.Compare, ast.BoolOp)) or isinstance(s.value, ast.UnaryOp) and isinstance(s.value.op, ast.Not):
                    yield "flag", owner, "condition", None, s.lineno, None, None, " and ".join([*conditions, ast.unparse(s.value)]), None
            if isinstance(s, ast.If):
                test = ast.unparse(s.test)
                yield from flow(fn, owner, s.body, [*conditions, test])
                yield from flow(fn, owner, s.orelse, [*conditions, f"not ({test})"])
            else:
                for part in ("body", "orelse", "finalbody"):
                    yield from flow(fn, owner, getattr(s, part, None) or [], conditions)

    def visit(node, owner: str, inside_class: bool) -> Iterator[tuple]:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef):
                qual = f"{owner}.{c.name}" if owner else c.name
                yield "class", owner, c.name, None, c.lineno, c.end_lineno, None, None, None
                for i, b in enumerate(c.bases):
                    if d := dotted(b):
                        yield "base", qual, d.split(".")[-1], d.rpartition(".")[0] or None, c.lineno, None, i, None, None
                yield from visit(c, qual, True)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                qual = f"{owner}.{c.name}" if owner else c.name
                first = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                yield "method" if inside_class else "function", owner, c.name, None, first, c.end_lineno, None, None, None
                for d in c.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        if d.func.attr in ("get", "post", "put", "patch", "delete", "route"):
                            yield "route", qual, d.func.attr, d.args[0].value, d.lineno, None, None, None, None
                yield from flow(c, qual, c.body, [])
                yield from visit(c, qual, False)
            else:
                if isinstance(c, ast.Import):
                    for a in c.names:
                        yield "import", owner, a.asname or a.name, a.name, c.lineno, None, 0, None, _python_candidates(path, a.name, 0, None)
                elif isinstance(c, ast.ImportFrom):
                    for a in c.names:
                        yield "import", owner, a.asname or a.name, c.module or "", c.lineno, None, c.level, a.name, _python_candidates(path, c.module or "", c.level, a.name)
                elif isinstance(c, ast.Call) and (d := dotted(c.func)):
                    yield "call", owner, d.split(".")[-1], d.rpartition(".")[0] or None, c.lineno, None, None, None, None
                yield from visit(c, owner, inside_class)

    return visit(tree, "", False)


def _script(path: str, source: str) -> Iterator[tuple]:
    source = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group(0)), source, flags=re.S)
    line = lambda at: source.count("\n", 0, at) + 1
    base = path.rpartition("/")[0]

    def files(module: str) -> list[str]:
        if not module.startswith("."):
            return []
        at = _join(base, module)
        return [at, *(at + e for e in SCRIPT), *(f"{at}/index{e}" for e in SCRIPT)]

    def bound(names: str) -> Iterator[tuple[str, str]]:
        for n in names.split(","):
            if n.strip():
                member, _, alias = re.sub(r"\s*(?:\bas\b|:)\s*", " ", n.strip()).partition(" ")
                yield alias.strip() or member, member

    for m in JS_IMPORT.finditer(source):
        at, own = line(m.start(4)), files(m.group(4))
        if m.group(1):
            yield "import", "", m.group(1), m.group(4), at, None, 0, "default", own
        if m.group(2):
            yield "import", "", m.group(2), m.group(4), at, None, 0, None, own
        for alias, member in bound(m.group(3) or ""):
            yield "import", "", alias, m.group(4), at, None, 0, member, own
    for m in JS_REQUIRE.finditer(source):
        at, own = line(m.start(3)), files(m.group(3))
        if m.group(1):
            yield "import", "", m.group(1), m.group(3), at, None, 0, None, own
        for alias, member in bound(m.group(2) or ""):
            yield "import", "", alias, m.group(3), at, None, 0, member, own
    spans = []
    for m in JS_DEF.finditer(source):
        name = m.group(1) or m.group(2)
        depth, end, opened = 0, len(source), source.find("{", m.end() - 1)
        for i in range(opened, len(source)) if opened >= 0 else ():
            depth += (source[i] == "{") - (source[i] == "}")
            if depth == 0:
                end = i + 1
                break
        spans.append((m.start(), end, name))
        at = line(m.start(1) if m.group(1) else m.start(2))
        yield "function" if m.group(1) else "class", "", name, None, at, line(end), None, None, None
        if m.group(3):
            yield "base", name, m.group(3).split(".")[-1], m.group(3).rpartition(".")[0] or None, at, None, 0, None, None
    for m in JS_CALL.finditer(source):
        if m.group(2) in JS_WORDS or re.search(r"\bfunction\s+$", source[max(0, m.start() - 12):m.start()]):
            continue
        owner = next((n for a, b, n in sorted(spans, key=lambda s: s[1] - s[0]) if a <= m.start() < b), "")
        yield "call", owner, m.group(2), m.group(1), line(m.start()), None, None, None, None


def _other(path: str, source: str) -> Iterator[tuple]:
    for m in OTHER_DEF.finditer(source):
        yield "function", "", m.group(1), None, source.count("\n", 0, m.start(1)) + 1, None, None, None, None


def _facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for project, path, content in zip(f["project"], f["path"], f["content"]):
            read = _python if path.endswith(".py") else _script if path.endswith(SCRIPT) else _other
            try:
                rows += [(project, path, *x) for x in read(path, content)]
            except (SyntaxError, ValueError, RecursionError):
                continue
        yield pd.DataFrame(rows, columns=["project", "path", "kind", "owner", "name", "target", "line", "last", "position", "text", "candidates"]).astype(
            {"line": "Int32", "last": "Int32", "position": "Int32"})


def facts(sources: DataFrame) -> DataFrame:
    """Facts of (project, path, content), each once."""
    own = sources.filter("content is not null and path is not null").select("project", "path", "content").dropDuplicates(["project", "path"])
    return checkpointed(own.mapInPandas(_facts, FACT).distinct())


def _id(path: Column, qual: Column) -> Column:
    return F.concat(path, F.lit("::"), qual)


def _qual(owner: Column, name: Column) -> Column:
    return F.when(owner == "", name).otherwise(F.concat(owner, F.lit("."), name))


def symbols(f: DataFrame) -> DataFrame:
    """(project, path, kind, owner, name, qual, line, last): definitions."""
    return f.filter(F.col("kind").isin("class", "function", "method")).select(
        "project", "path", "kind", "owner", "name", _qual(F.col("owner"), F.col("name")).alias("qual"), "line", "last")


def file_imports(f: DataFrame, sources: DataFrame) -> DataFrame:
    """(project, path, name, member, file): each import with the file it names; the first of its candidates that exists.

    ``member`` is null where the name stands for the module itself.
    """
    files = sources.select("project", F.col("path").alias("file")).distinct()
    c = f.filter("kind = 'import'").select("project", "path", "name", "text", "line", F.posexplode("candidates").alias("rank", "file"))
    w = W.partitionBy("project", "path", "name", "text", "line").orderBy("rank")
    hit = c.join(files, ["project", "file"]).withColumn("r", F.row_number().over(w)).filter("r = 1")
    # from package import module: the member is the file
    itself = F.col("text").isNull() | F.col("file").rlike(r"\.py$") & (
        F.col("file").endswith(F.concat(F.lit("/"), "text", F.lit(".py"))) | (F.col("file") == F.concat("text", F.lit(".py"))) | F.col("file").endswith(F.concat(F.lit("/"), "text", F.lit("/__init__.py"))))
    return hit.select("project", "path", "name", F.when(~itself, F.col("text")).alias("member"), "file").distinct()


def _bind(uses: DataFrame, symbols_: DataFrame, imports: DataFrame) -> DataFrame:
    """Uses (project, path, name, target, ...) with the definition (to_path, to_qual, how) they bind to, if there is exactly one of the best standing.

    Standing: defined in the same file; imported by name; member of an imported module; member of an imported or local class.
    """
    uses = uses.withColumn("use", F.monotonically_increasing_id())
    uses = checkpointed(uses)
    top = symbols_.filter("owner = ''").select("project", F.col("path").alias("to_path"), F.col("name").alias("to_name"), F.col("qual").alias("to_qual")).distinct()
    member = symbols_.filter("owner <> ''").select("project", F.col("path").alias("to_path"), F.col("owner").alias("to_owner"), F.col("name").alias("to_name"), F.col("qual").alias("to_qual")).distinct()
    bare, reached = uses.filter("target is null"), uses.filter("target is not null")
    out = lambda df, how, rank: df.select("use", "to_path", "to_qual", F.lit(how).alias("how"), F.lit(rank).alias("rank"))
    local = bare.join(top.withColumnRenamed("to_path", "p"), (bare.project == top.project) & (F.col("path") == F.col("p")) & (F.col("name") == F.col("to_name"))).withColumn("to_path", F.col("p"))
    named = imports.filter("member is not null").select("project", "path", F.col("name").alias("alias"), "member", "file")
    whole = imports.filter("member is null").select("project", "path", F.col("name").alias("alias"), "file")
    real = F.when(F.col("member") == "default", F.col("name")).otherwise(F.col("member"))
    by_name = bare.join(named.withColumnRenamed("alias", "name"), ["project", "path", "name"]).withColumn("to_name", real).withColumnRenamed("file", "to_path").join(top, ["project", "to_path", "to_name"])
    by_module = reached.join(whole.withColumnRenamed("alias", "target"), ["project", "path", "target"]).withColumnRenamed("file", "to_path").withColumn("to_name", F.col("name")).join(top, ["project", "to_path", "to_name"])
    by_class = reached.join(named.withColumnRenamed("alias", "target"), ["project", "path", "target"]).withColumnRenamed("file", "to_path").withColumn("to_owner", F.col("member")).withColumn("to_name", F.col("name")).join(
        member, ["project", "to_path", "to_owner", "to_name"])
    own_class = reached.withColumn("to_path", F.col("path")).withColumn("to_owner", F.col("target")).withColumn("to_name", F.col("name")).join(member, ["project", "to_path", "to_owner", "to_name"])
    found = out(local, "local", 1).unionByName(out(by_name, "import", 2)).unionByName(out(by_module, "module", 3)).unionByName(out(by_class, "class", 4)).unionByName(out(own_class, "class", 4))
    best = found.distinct().withColumn("b", F.min("rank").over(W.partitionBy("use"))).filter("rank = b").withColumn("n", F.count("*").over(W.partitionBy("use"))).filter("n = 1")
    return uses.join(best.select("use", "to_path", "to_qual", "how"), "use", "left").drop("use")


def inheritance(f: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, path, class_name, base, position, to_path, to_qual): bases in order, with the class they bind to."""
    uses = f.filter("kind = 'base'").select("project", "path", F.col("owner").alias("class_name"), "name", "target", "position")
    bound = _bind(uses, symbols(f).filter("kind = 'class'"), imports)
    return bound.select("project", "path", "class_name", F.col("name").alias("base"), "position", "to_path", "to_qual")


def ancestors(bases: DataFrame) -> DataFrame:
    """(project, path, class_name, to_path, to_qual, distance): every class above a class, nearest first; ends when no longer chain is found."""
    step = checkpointed(bases.filter("to_qual is not null").select("project", "path", "class_name", "to_path", "to_qual").distinct())
    seen, frontier, distance = step.withColumn("distance", F.lit(1)), step, 1
    up = step.select("project", F.col("path").alias("to_path"), F.col("class_name").alias("to_qual"), F.col("to_path").alias("up_path"), F.col("to_qual").alias("up_qual"))
    key = ["project", "path", "class_name", "to_path", "to_qual"]
    while True:
        distance += 1
        more = frontier.join(up, ["project", "to_path", "to_qual"]).select("project", "path", "class_name", F.col("up_path").alias("to_path"), F.col("up_qual").alias("to_qual")).distinct()
        frontier = checkpointed(more.join(seen.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(distance)))


def overrides(f: DataFrame, above: DataFrame) -> DataFrame:
    """(project, method, overridden): methods and the nearest one above that each replaces, as symbols."""
    m = symbols(f).filter("kind = 'method'").select("project", "path", "owner", "name", "qual")
    mine = m.withColumnRenamed("owner", "class_name").join(above, ["project", "path", "class_name"])
    theirs = m.select("project", F.col("path").alias("to_path"), F.col("owner").alias("to_qual"), "name", F.col("qual").alias("over"))
    w = W.partitionBy("project", "path", "qual").orderBy("distance", "to_path", "over")
    hit = mine.join(theirs, ["project", "to_path", "to_qual", "name"]).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return hit.select("project", _id(F.col("path"), F.col("qual")).alias("method"), _id(F.col("to_path"), F.col("over")).alias("overridden"))


def calls(f: DataFrame, imports: DataFrame, above: DataFrame) -> DataFrame:
    """(project, path, owner, name, receiver, line, to_path, to_qual, how): every call with what it binds to, if anything.

    A call on self, cls or this binds to the method of the own class or else of the nearest class above.
    """
    uses = f.filter("kind = 'call'").select("project", "path", "owner", "name", "target", "line")
    on_self = F.coalesce(F.col("target").isin("self", "cls", "this"), F.lit(False))
    rest = _bind(uses.filter(~on_self), symbols(f), imports)
    mine = checkpointed(uses.filter(on_self).withColumn("class_name", F.regexp_replace("owner", r"\.[^.]*$", "")).withColumn("use", F.monotonically_increasing_id()))
    m = symbols(f).filter("kind = 'method'").select("project", F.col("path").alias("to_path"), F.col("owner").alias("to_owner"), "name", F.col("qual").alias("found"))
    lines = above.select("project", "path", "class_name", "to_path", F.col("to_qual").alias("to_owner"), "distance")
    at = mine.select("use", "project", "path", "class_name", "name", F.col("path").alias("to_path"), F.col("class_name").alias("to_owner"), F.lit(0).alias("distance")).unionByName(
        mine.join(lines, ["project", "path", "class_name"]).select("use", "project", "path", "class_name", "name", "to_path", "to_owner", "distance"))
    w = W.partitionBy("use").orderBy("distance", "to_path", "found")
    best = at.join(m, ["project", "to_path", "to_owner", "name"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("use", "to_path", F.col("found").alias("to_qual"), F.lit("self").alias("how"))
    both = rest.unionByName(mine.join(best, "use", "left").drop("use", "class_name"), allowMissingColumns=True)
    return both.withColumnRenamed("target", "receiver")


def code_graph(f: DataFrame, sources: DataFrame) -> DataFrame:
    """(project, src, dst, rel): calls, inherits and overrides between symbols, imports between modules; each once."""
    imports = checkpointed(file_imports(f, sources))
    bases = checkpointed(inheritance(f, imports))
    above = ancestors(bases)
    bound = calls(f, imports, above).filter("to_qual is not null")
    edge = lambda df, src, dst, rel: df.select("project", src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))
    out = edge(bound, _id(F.col("path"), F.col("owner")), _id(F.col("to_path"), F.col("to_qual")), "calls")
    out = out.unionByName(edge(imports.filter("path <> file"), _id(F.col("path"), F.lit("")), _id(F.col("file"), F.lit("")), "imports"))
    out = out.unionByName(edge(bases.filter("to_qual is not null"), _id(F.col("path"), F.col("class_name")), _id(F.col("to_path"), F.col("to_qual")), "inherits"))
    over = overrides(f, above)
    out = out.unionByName(edge(over, F.col("method"), F.col("overridden"), "overrides"))
    return checkpointed(out.distinct())


def impact(graph: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): what depends on the seeds (node), directly or through others."""
    return G.reach(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), seeds, depth)


def entry_points(f: DataFrame) -> DataFrame:
    """(node): what runs without being called: modules, main functions, tests, and functions that routes name."""
    s = symbols(f)
    own = s.filter((F.col("name") == "main") | F.col("name").startswith("test")).select(_id(F.col("path"), F.col("qual")).alias("node"))
    routed = f.filter("kind = 'route'").select(_id(F.col("path"), F.col("owner")).alias("node"))
    return own.union(routed).union(f.select(_id(F.col("path"), F.lit("")).alias("node"))).distinct()


def dead_symbols(f: DataFrame, graph: DataFrame) -> DataFrame:
    """(node): functions and methods that nothing running reaches; classes count as running when something calls or inherits from them.

    A live method that overrides another keeps that one, and the other way round: which of them runs is decided at run time. So is
    what a call on an unknown receiver runs: it keeps every method of its name in the project.
    """
    named = f.filter("kind = 'call' and target is not null").select("project", "name").distinct()
    asked = symbols(f).filter("kind = 'method'").join(named, ["project", "name"]).select(_id(F.col("path"), F.col("qual")).alias("node"))
    both = graph.select("src", "dst").unionByName(graph.filter("rel = 'overrides'").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    alive = G.reach(both.distinct(), entry_points(f).union(asked).distinct(), None)
    s = symbols(f).filter("kind <> 'class'").select(_id(F.col("path"), F.col("qual")).alias("node"))
    magic = F.col("node").rlike(r"__\w+__$")
    return s.filter(~magic).join(alive, "node", "left_anti").distinct()


def dead_files(f: DataFrame, graph: DataFrame) -> DataFrame:
    """(path): files that no other imports and that hold neither a main function, a route, a test nor module code that calls."""
    held = f.filter((F.col("kind") == "route") | (F.col("kind") == "function") & ((F.col("name") == "main") | F.col("name").startswith("test")) | (F.col("kind") == "call") & (F.col("owner") == ""))
    used = graph.filter("rel = 'imports'").select(F.regexp_replace("dst", "::$", "").alias("path"))
    return f.select("path").distinct().join(held.select("path").union(used).distinct(), "path", "left_anti")


def is_test(node: Column) -> Column:
    return node.rlike(r"(?:^|/)tests?/|(?:^|/)test_[^/]*::|::(?:.*\.)?test\w*$")


def data_slice(f: DataFrame, path: str, owner: str, name: str) -> DataFrame:
    """(name, depth): the names of one function that a name's value comes from, with the least number of steps; the name itself at 0."""
    uses = f.filter((F.col("kind") == "use") & (F.col("path") == path) & (F.col("owner") == owner) & F.col("target").isNotNull())
    seed = f.sparkSession.range(1).select(F.lit(name).alias("node"))
    return G.reach(uses.select(F.col("name").alias("src"), F.col("target").alias("dst")).distinct(), seed, None).withColumnRenamed("node", "name")


def policy_trace(f: DataFrame, graph: DataFrame) -> DataFrame:
    """(function, value, condition, callers): the boolean returns of every function, when each is given, and who asks."""
    flags = f.filter("kind = 'flag'").select(_id(F.col("path"), F.col("owner")).alias("function"), F.col("name").alias("value"), F.col("text").alias("condition"))
    callers = graph.filter("rel = 'calls'").groupBy(F.col("dst").alias("function")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
    return flags.join(callers, "function", "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))


def _ddl(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    statement = re.compile(
        r"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)\s*\(((?:[^()]|\([^()]*\))*)\)|\bdrop\s+table\s+(?:if\s+exists\s+)?([\w.]+)|\balter\s+table\s+([\w.]+)\s+(add|drop|alter)\s+(?:column\s+)?(\w+)(?:\s+(?:type\s+)?([\w()]+))?", re.I)
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"]):
            text = re.sub(r"--[^\n]*", " ", content)
            for i, m in enumerate(statement.finditer(text)):
                if m.group(1):
                    t = m.group(1).lower()
                    rows.append((path, i, 0, t, "create", None, None))
                    for j, c in enumerate(re.split(r",(?![^()]*\))", m.group(2))):
                        w = c.split()
                        if len(w) >= 2 and w[0].lower() not in ("primary", "foreign", "unique", "constraint", "check", "key"):
                            rows.append((path, i, j + 1, t, "add", w[0].lower(), w[1].lower()))
                elif m.group(3):
                    rows.append((path, i, 0, m.group(3).lower(), "drop", None, None))
                else:
                    act = m.group(5).lower()
                    rows.append((path, i, 0, m.group(4).lower(), "drop_column" if act == "drop" else act, m.group(6).lower(), m.group(7) and m.group(7).lower()))
        yield pd.DataFrame(rows, columns=["path", "at", "part", "table_name", "action", "column_name", "type"])


def ddl_events(sources: DataFrame) -> DataFrame:
    """(path, at, part, table_name, action, column_name, type): the schema statements of SQL sources, in order within a file; migrations run in path order."""
    sql = sources.filter(F.col("path").endswith(".sql") & F.col("content").isNotNull()).select("path", "content")
    return sql.mapInPandas(_ddl, "path string, at int, part int, table_name string, action string, column_name string, type string")


def inserts(sources: DataFrame) -> DataFrame:
    """(path, table_name, column_name): columns that INSERT statements name, in whatever language they stand."""
    pattern = r"(?i)\binsert\s+into\s+([\w.]+)\s*\(([^()]*)\)"
    a, b = (F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2))
    own = sources.filter("content is not null").select("path", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("x"))
    return own.select("path", F.lower("x.a").alias("table_name"), F.explode(F.split("x.b", ",")).alias("c")).select("path", "table_name", F.lower(F.trim("c")).alias("column_name")).distinct()


def write_problems(schema: DataFrame, written: DataFrame) -> DataFrame:
    """(path, table_name, column_name, problem): writes to tables or columns that the schema (table_name, column_name, type) lacks."""
    tables = schema.select("table_name").distinct().withColumn("t", F.lit(True))
    columns = schema.select("table_name", "column_name").distinct().withColumn("c", F.lit(True))
    j = written.join(tables, "table_name", "left").join(columns, ["table_name", "column_name"], "left")
    problem = F.when(F.col("t").isNull(), "no table").when(F.col("c").isNull(), "no column")
    return j.select("path", "table_name", "column_name", problem.alias("problem")).filter("problem is not null")


def outside_references(f: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, name, path): tables, routes, addresses and settings that sources refer to."""
    text = sources.filter("content is not null")
    pick = lambda kind, pattern: text.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("name"), "path")
    tables = pick("table", r"(?i)\b(?:from|join|into|update)\s+([a-z_]\w*)(?=\s+(?:where|set|join|on|order|group|limit)\b|\s*\(|\s*[;\"']|\s*$)")
    settings = pick("setting", r"""(?:os\.environ(?:\.get)?[\[(]\s*|getenv\(\s*|process\.env\.)["']?([A-Z][A-Z0-9_]+)""")
    address = pick("address", r"""(?:\bfetch\(|\baxios\.(?:get|post|put|patch|delete)\()\s*["'`]([^"'`]+)["'`]""")
    route = f.filter("kind = 'route'").select(F.lit("route").alias("kind"), F.col("target").alias("name"), "path")
    return tables.unionByName(settings).unionByName(address).unionByName(route).distinct()


def tree_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, change): symbols added, removed or changed between two states of the sources (project, path, content)."""

    def table(sources: DataFrame, name: str) -> DataFrame:
        s = symbols(facts(sources)).join(sources.select("project", "path", F.split(F.col("content"), "\n").alias("lines")), ["project", "path"])
        body = F.array_join(F.slice("lines", F.col("line"), F.coalesce("last", "line") - F.col("line") + 1), "\n")
        return s.select(_id(F.col("path"), F.col("qual")).alias("node"), F.sha2(F.regexp_replace(body, r"\s+", " "), 256).alias(name)).groupBy("node").agg(F.max(name).alias(name))

    j = table(before, "b").join(table(after, "a"), "node", "full")
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("node", kind.alias("change")).filter("change is not null")


def structural_chunks(f: DataFrame, sources: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(path, symbol, part, first_line, last_line): a source's top definitions as chunks, and what lies between them; over ``size`` characters in parts of whole lines.

    ``overlap`` lines of a part are repeated at the start of the next one.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, spans in zip(frame["path"], frame["content"], frame["spans"]):
                lines = content.split("\n")
                blocks, at = [], 1
                for s in sorted(spans if spans is not None else [], key=lambda s: s["line"]):
                    if s["line"] > at:
                        blocks.append((None, at, s["line"] - 1))
                    if (s["last"] or s["line"]) >= at:
                        blocks.append((s["qual"], max(at, s["line"]), s["last"] or s["line"]))
                        at = blocks[-1][2] + 1
                if at <= len(lines):
                    blocks.append((None, at, len(lines)))
                for name, a, b in blocks:
                    if not any(x.strip() for x in lines[a - 1:b]):
                        continue
                    part, lo = 0, a
                    while lo <= b:
                        hi, n = lo, len(lines[lo - 1])
                        while hi < b and n + 1 + len(lines[hi]) <= size:
                            n += 1 + len(lines[hi])
                            hi += 1
                        rows.append((path, name, part, lo, hi))
                        part, lo = part + 1, hi + 1 if hi == b else max(lo + 1, hi + 1 - overlap)
            yield pd.DataFrame(rows, columns=["path", "symbol", "part", "first_line", "last_line"])

    spans = symbols(f).filter("owner = ''").groupBy("project", "path").agg(F.collect_list(F.struct("line", "last", "qual")).alias("spans"))
    own = sources.filter("content is not null").join(spans, ["project", "path"]).select("path", "content", "spans")
    return own.mapInPandas(cut, "path string, symbol string, part int, first_line int, last_line int")


def endpoints_met(f: DataFrame, sources: DataFrame) -> DataFrame:
    """(address, caller, route, handler): client addresses with the route they meet, parameters in braces or after a colon standing for one step; null if none."""
    seen = outside_references(f, sources).filter("kind = 'address'").select(F.col("name").alias("address"), F.col("path").alias("caller"))
    steps = lambda c: F.filter(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), lambda x: x != "")
    shape = lambda c: F.array_join(F.transform(steps(c), lambda x: F.when(x.rlike(r"^[{:<]|^\$\{|^\d+$"), "*").otherwise(x)), "/")
    routes = f.filter("kind = 'route'").select(F.col("target").alias("route"), _id(F.col("path"), F.col("owner")).alias("handler"), shape(F.col("target")).alias("s"))
    return seen.withColumn("s", shape(F.col("address"))).join(routes, "s", "left").select("address", "caller", "route", "handler")


def service_graph(sources: DataFrame) -> DataFrame:
    """(path, service, rel, target): images, ports and dependencies of compose files' services."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                inside, name, key = False, None, None
                for line in content.split("\n"):
                    if not line.strip() or line.lstrip().startswith("#"):
                        continue
                    depth = len(line) - len(line.lstrip())
                    if depth == 0:
                        inside, name = line.startswith("services:"), None
                    elif inside and depth == 2 and (m := re.match(r"  ([\w.-]+):\s*$", line)):
                        name, key = m.group(1), None
                        rows.append((path, name, "service", None))
                    elif inside and name and depth == 4 and (m := re.match(r"    ([\w.-]+):\s*(.*)$", line)):
                        key, value = m.group(1), m.group(2).strip().strip("'\"")
                        if key == "image" and value:
                            rows.append((path, name, "image", value))
                        if key in ("depends_on", "ports") and value.startswith("["):
                            rows += [(path, name, key, v.strip().strip("'\"")) for v in value.strip("[]").split(",") if v.strip()]
                    elif inside and name and key in ("depends_on", "ports") and depth == 6:
                        v = re.match(r"\s*(?:-\s*)?['\"]?([^'\"\s]+?)['\"]?:?\s*$", line)
                        if v:
                            rows.append((path, name, key, v.group(1)))
            yield pd.DataFrame(rows, columns=["path", "service", "rel", "target"])

    own = sources.filter(F.col("path").rlike(r"(?:docker-)?compose[^/]*\.ya?ml$") & F.col("content").isNotNull()).select("path", "content")
    return own.mapInPandas(run, "path string, service string, rel string, target string")
