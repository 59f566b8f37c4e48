"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from corvane.plans import code, extra, facts, graph, lifecycle, more, problems, project, search, store, text

FLAGSHIP = "hybrid_rrf"
MODULES = (problems, store.P, search.P, graph.P, facts.P, code.P, text.P, more.P, extra.P, project.P, lifecycle.P)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
