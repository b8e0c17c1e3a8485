"""Registry of runnable queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


# Addresses as the check finds them: its regexes repeat 1000 times at most, so the bound of
# 2048 characters is spelled in three parts.
_URL_CHARS = """[^ \\t\\r\\n'")\\]}>]"""
SQL_URLS = f"https?://{_URL_CHARS}{{1,1000}}{_URL_CHARS}{{0,1000}}{_URL_CHARS}{{0,48}}"
SQL_IS_URL = "(?i)(https?|ftp)://[^ \\t\\r\\n<>]"

QUERIES: dict[str, Query] = {}
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    """Declare a common table the check SQL may build on."""
    _VIEWS[name] = (needs, body)


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        needs, _ = _VIEWS[name]
        _ordered(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_views(names: tuple[str, ...], body: str) -> str:
    ctes = [f"{n} AS ({_VIEWS[n][1]})" for n in _ordered(names, [])]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query; `views` names the common tables its SQL uses."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else with_views(tuple(views.split()), sql)
        QUERIES[name] = Query(name, fn, text)
        return fn

    return register
