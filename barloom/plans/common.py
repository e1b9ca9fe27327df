"""Shared pieces of the registered queries: rounding on the Spark side, CTEs on the SQL side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(name)
    CTES[name] = body


def sql(body: str) -> str:
    """Prefix `body` with the CTEs it mentions, in dependency order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                order.append(word)

    visit(body)
    if not order:
        return body
    recursive = "RECURSIVE " if any(CTES[n].lstrip().startswith("--recursive") for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def r(expr: str, digits: int, name: str | None = None) -> str:
    """SQL rounding; the CASE turns -0.0 into 0.0."""
    alias = name or expr
    return f"CASE WHEN round({expr},{digits})=0 THEN 0.0 ELSE round({expr},{digits}) END::DOUBLE AS {alias}"


def rnd(col, digits: int, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits).alias(name or col)


def big(col, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)


def pick_sql(plain=(), **digits) -> str:
    return ", ".join([*plain, *[r(c, n) for c, n in digits.items()]])
