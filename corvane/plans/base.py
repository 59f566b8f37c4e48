"""How a plan module names its queries."""

from __future__ import annotations

from corvane.sources.tables import load


class Plans:
    """Collects queries by function name, each with the SQL it is checked against, if SQL can say it."""

    def __init__(self):
        self.QUERIES: dict = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            def run(spark, d):
                return f(lambda name: load(spark, d, name))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.QUERIES[f.__name__] = run
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add
