"""How a module of queries registers them."""

from __future__ import annotations


class Registry:
    """Queries by name, and their SQL where SQL can express them."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register
