"""Static code facts: symbols, references, families, ordering, schema replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEF = r"(?m)^\s*(?:pub fn|def|fn|function|class|struct)\s+([A-Za-z_][0-9A-Za-z_]*)"
CALL = r"([A-Za-z_][0-9A-Za-z_]*)\("
TABLE_READ = r"(?i)\b(?:from|join)\s+([A-Za-z_][0-9A-Za-z_.]*)"


def symbols(blobs: DataFrame) -> DataFrame:
    """(path, ordinal, name) of the definitions in each source."""
    return blobs.select("canonical_path", F.posexplode(F.regexp_extract_all("content", F.lit(DEF), F.lit(1))).alias("ordinal", "name"))


def references(blobs: DataFrame) -> DataFrame:
    """(path, name, n) of what is called in each source."""
    return blobs.select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(CALL), F.lit(1))).alias("name")).groupBy("canonical_path", "name").agg(F.count("*").alias("n"))


def table_reads(blobs: DataFrame) -> DataFrame:
    return blobs.select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(TABLE_READ), F.lit(1))).alias("name")).groupBy("canonical_path", F.lower("name").alias("table_name")).agg(F.count("*").alias("reads"))


def resolve(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References with the number of definitions of their name and the only one's path, if there is one."""
    names = defs.groupBy("name").agg(F.count("*").alias("candidates"), F.min("canonical_path").alias("target"))
    joined = refs.join(names, "name", "left")
    return joined.select(
        "canonical_path", "name", "n", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(F.col("candidates") == 1, F.col("target")).alias("target"))


def family(path: Column) -> Column:
    """A file name without digits, copy marks and extension: members of a family differ in these only."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    stem = F.regexp_replace(name, r"[.][^.]*$", "")
    return F.regexp_replace(stem, r"(?:[ _-]*(?:copy|backup|old|final|[0-9]+))+$", "")


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def linearise(bases: dict[str, list[str]], name: str) -> list[str]:
    """C3 order of a class and its ancestors; raises if there is none."""
    done: dict[str, list[str]] = {}

    def order(c: str, path: tuple[str, ...]) -> list[str]:
        if c in path:
            raise ValueError(f"{c} inherits from itself")
        if c not in done:
            own = list(bases.get(c, []))
            rows = [list(order(b, (*path, c))) for b in own] + [own]
            out = [c]
            while rows := [r for r in rows if r]:
                head = next((r[0] for r in rows if not any(r[0] in o[1:] for o in rows)), None)
                if head is None:
                    raise ValueError(f"no order of the bases of {c}")
                out.append(head)
                rows = [r[1:] if r[0] == head else r for r in rows]
            done[c] = out
        return done[c]

    return order(name, ())


def mro(inheritance: DataFrame) -> DataFrame:
    """(project, class_name, order): method resolution orders from (project, class_name, base, position).

    A task holds one project's class table; a project without order for a class gives null.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        bases: dict[str, list[str]] = {}
        for r in f.sort_values("position").itertuples():
            bases.setdefault(r.class_name, [])
            if isinstance(r.base, str):
                bases[r.class_name].append(r.base)
        rows = []
        for c in sorted(bases):
            try:
                rows.append((f["project"].iloc[0], c, linearise(bases, c)))
            except ValueError:
                rows.append((f["project"].iloc[0], c, None))
        return pd.DataFrame(rows, columns=["project", "class_name", "order"])

    return inheritance.groupBy("project").applyInPandas(run, "project string, class_name string, order array<string>")


def replay_schema(ddl: DataFrame) -> DataFrame:
    """(table_name, column_name, type) after all events of (table_name, seq, action, column_name, type) in order.

    Actions: create, drop (the table); add, drop_column, alter (a column).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, str] = {}
        name, alive, out = None, False, []

        def close():
            if name is not None and alive:
                out.extend((name, c, k) for c, k in state.items())

        for f in frames:
            for r in f.itertuples():
                if r.table_name != name:
                    close()
                    name, alive, state = r.table_name, False, {}
                if r.action == "create":
                    alive, state = True, {}
                elif r.action == "drop":
                    alive, state = False, {}
                elif r.action in ("add", "alter") and alive:
                    state[r.column_name] = r.type
                elif r.action == "drop_column":
                    state.pop(r.column_name, None)
        close()
        yield pd.DataFrame(out, columns=["table_name", "column_name", "type"])

    ordered = ddl.repartition("table_name").sortWithinPartitions("table_name", "seq")
    return ordered.mapInPandas(run, "table_name string, column_name string, type string")


ROUTE = r"""(?m)^\s*@\w+\.(get|post|put|patch|delete|route)\(\s*["']([^"']+)["']"""
CLIENT = r"""(?:\bfetch\(|\baxios\.(?:get|post|put|patch|delete)\(|\$\.(?:get|post|ajax)\()\s*["'`]([^"'`]+)["'`]"""
PHP_ROUTE = r"""Route::(get|post|put|patch|delete|any)\(\s*["']([^"']+)["']"""
TRANSLATION = r"""(?:\b(?:gettext|_t|trans|i18n\.t)|\$t)\(\s*["']([^"']+)["']"""
CLASS = r"(?m)^\s*class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*:"


def _two(blobs: DataFrame, pattern: str, first: str, second: str) -> DataFrame:
    a, b = (F.regexp_extract_all("content", F.lit(pattern), F.lit(i)) for i in (1, 2))
    return blobs.select("canonical_path", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("x")).select(
        "canonical_path", F.col("x.a").alias(first), F.col("x.b").alias(second))


def routes(blobs: DataFrame) -> DataFrame:
    """(path, method, route) of decorator and facade registrations."""
    both = _two(blobs, ROUTE, "method", "route").unionByName(_two(blobs, PHP_ROUTE, "method", "route"))
    return both.withColumn("method", F.lower("method"))


def client_endpoints(blobs: DataFrame) -> DataFrame:
    """(path, url) of literal addresses in client calls."""
    return blobs.select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(CLIENT), F.lit(1))).alias("url"))


def translation_keys(blobs: DataFrame) -> DataFrame:
    return blobs.select("canonical_path", F.explode(F.regexp_extract_all("content", F.lit(TRANSLATION), F.lit(1))).alias("key")).groupBy("key").agg(
        F.count("*").alias("uses"), F.countDistinct("canonical_path").alias("files"))


def inheritance(blobs: DataFrame) -> DataFrame:
    """(path, class_name, base, position): bases of each class in order, a null base if it has none."""
    c = _two(blobs, CLASS, "class_name", "bases")
    names = F.filter(F.transform(F.split("bases", ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("="))
    return c.select("canonical_path", "class_name", F.posexplode_outer(names).alias("position", "base"))


def python_facts(blobs: DataFrame) -> DataFrame:
    """(path, kind, owner, name, line) of a Python source's classes, methods, functions and calls; unparsable sources give none."""
    import ast

    def walk(tree):
        def visit(node, owner):
            for c in ast.iter_child_nodes(node):
                if isinstance(c, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    # decorators run where the definition stands, not inside it
                    yield from visit(ast.List(elts=c.decorator_list), owner)
                    c.decorator_list = []
                if isinstance(c, ast.ClassDef):
                    yield "class", owner, c.name, c.lineno
                    yield from visit(c, c.name)
                elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield ("method" if isinstance(node, ast.ClassDef) else "function"), owner, c.name, c.lineno
                    yield from visit(c, f"{owner}.{c.name}" if owner else c.name)
                else:
                    if isinstance(c, ast.Call):
                        f = c.func
                        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                        if name:
                            yield "call", owner, name, c.lineno
                    yield from visit(c, owner)

        return visit(tree, "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["canonical_path"], f["content"]):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(path, *x) for x in walk(tree)]
            yield pd.DataFrame(rows, columns=["canonical_path", "kind", "owner", "name", "line"])

    py = blobs.filter(F.col("canonical_path").endswith(".py")).select("canonical_path", "content")
    return py.mapInPandas(run, "canonical_path string, kind string, owner string, name string, line int")


def overrides(facts: DataFrame, bases: DataFrame) -> DataFrame:
    """(class_name, base, method): methods a class defines that a direct base defines too."""
    m = facts.filter("kind = 'method'").select(F.col("owner").alias("class_name"), F.col("name").alias("method")).distinct()
    b = bases.filter("base is not null").select("class_name", "base").distinct()
    return m.join(b, "class_name").join(m.withColumnRenamed("class_name", "base"), ["base", "method"]).select("class_name", "base", "method")


def services(blobs: DataFrame) -> DataFrame:
    """(path, service, image) of compose files' services."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for f in frames:
            rows = []
            for path, content in zip(f["canonical_path"], f["content"]):
                inside, name = False, None
                for line in content.split("\n"):
                    if re.match(r"\S", line):
                        inside, name = line.startswith("services:"), None
                    elif inside and (m := re.match(r"  ([\w.-]+):\s*$", line)):
                        name = m.group(1)
                        rows.append([path, name, None])
                    elif inside and name and (m := re.match(r"    image:\s*['\"]?([^'\"\s]+)", line)):
                        rows[-1][2] = m.group(1)
            yield pd.DataFrame(rows, columns=["canonical_path", "service", "image"])

    own = blobs.filter(F.col("canonical_path").rlike(r"(?:docker-)?compose[^/]*\.ya?ml$")).select("canonical_path", "content")
    return own.mapInPandas(run, "canonical_path string, service string, image string")
