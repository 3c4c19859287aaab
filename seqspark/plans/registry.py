"""Name -> query and name -> SQL, filled by the ``query`` decorator."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from seqspark.sources.frames import VIEWS, Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, keys: str = "", floats: str = "", sql: str | None = None, digits: int = DIGITS, materialised: bool = False):
    """Register ``f(tables) -> DataFrame`` under ``name``.

    ``keys`` and ``floats`` name its columns; floats are rounded on both sides,
    since sums depend on the order of rows. ``sql`` is the body of the DuckDB
    query over the base tables and VIEWS, with the same columns; ``materialised``
    has DuckDB keep each of its common tables instead of evaluating them again.
    """
    ks, fs = keys.split(), floats.split()

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir):
            df = f(Tables(spark, sf_dir))
            return df.select(*ks, *((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in fs)) if ks or fs else df

        QUERIES[name] = run
        if sql is not None:
            used = [v for k, v in VIEWS.items() if re.search(rf"\b{k}\b", sql)]
            inner = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
            start = "WITH RECURSIVE " if inner and inner[1] else "WITH "
            head = start + ",\n".join(used) + (", " if inner else " ") if used else (start if inner else "")
            body = sql[inner.end() :] if inner else sql
            cut = _main_select(body) if inner else 0
            out = ", ".join([*ks, *(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in fs)]) or "*"
            text = f"{head}{body[:cut]}SELECT {out} FROM ({body[cut:]}) AS result_rows"
            ORACLES[name] = re.sub(r"\b(\w+) AS \((SELECT|WITH)\b", r"\1 AS MATERIALIZED (\2", text) if materialised else text
        return f

    return add


def _main_select(body: str) -> int:
    """Where the main SELECT of a text of common table expressions begins."""
    depth = 0
    for m in re.finditer(r"[()]|\bSELECT\b", body):
        if m[0] == "SELECT":
            if depth == 0:
                return m.start()
        else:
            depth += 1 if m[0] == "(" else -1
    raise ValueError("no main SELECT")
