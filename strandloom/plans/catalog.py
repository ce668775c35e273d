"""A catalog of queries: each is registered under its name with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return register
