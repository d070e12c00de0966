"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.plans.tables import Tables
from cohortspark.plans.twin_ctes import CTES

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def finish(df: DataFrame) -> DataFrame:
    """Fixed types at the edge: doubles rounded, whole numbers as BIGINT, flags and text as they are."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        col = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), DIGITS)
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        out.append(col.alias(f.name))
    return df.select(*out)


def twin(final: str, doubles: str = "") -> str:
    """A full statement: the needed CTEs (found by name, dependencies first), the body, doubles rounded."""
    needed: list[str] = []
    open_: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and name not in open_:
                open_.append(name)
                visit(body)
                open_.remove(name)
                if name not in needed:
                    needed.append(name)

    visit(final)
    head = ""
    body = final.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        head, body = "RECURSIVE ", body[len("WITH RECURSIVE"):].strip()
    elif body.upper().startswith("WITH"):
        body = body[4:].strip()
    else:
        body = f"final_ AS ({body}) SELECT * FROM final_"
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    stmt = f"WITH {head}{ctes}{',' if ctes else ''}\n{body}"
    if not doubles:
        return stmt
    rep = ", ".join(f"round({d}, {DIGITS}) + 0.0 AS {d}" for d in doubles.split())
    return f"SELECT * REPLACE ({rep}) FROM ({stmt})"


def query(name: str, sql: str | None = None, doubles: str = ""):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, None if sql is None else twin(sql, doubles))
        return fn
    return add


def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: finish(fn(Tables(spark, sf_dir)))
