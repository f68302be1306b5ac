"""Runs SQL files with typed parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrace.sources import sinks


@dataclass(frozen=True)
class Identifier:
    """A table or column name, or a format and path."""

    name: str

    def sql(self) -> str:
        if not re.fullmatch(r"[\w.]+", self.name):
            raise ValueError(f"no identifier: {self.name}")
        return self.name


@dataclass(frozen=True)
class Fragment:
    """SQL text, put in as it is."""

    text: str

    def sql(self) -> str:
        return self.text


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render(sql: str, parameters: dict[str, object]) -> str:
    """Puts parameters in for ``${name}``; one that is missing raises."""

    def put(m: re.Match) -> str:
        if m[1] not in parameters:
            raise KeyError(f"missing parameter: {m[1]}")
        v = parameters[m[1]]
        return v.sql() if isinstance(v, (Identifier, Fragment)) else literal(v)

    return re.sub(r"\$\{(\w+)\}", put, sql)


_PIECE = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|;|[^;'"`/-]+|.""", re.S)


def split(sql: str) -> list[str]:
    """Statements, split at semicolons outside quotes and comments; comments go, hints stay."""
    out, now = [], []
    for m in _PIECE.finditer(sql):
        piece = m[0]
        if piece == ";":
            out.append("".join(now).strip())
            now = []
        elif piece.startswith("/*+") or not piece.startswith(("--", "/*")):
            now.append(piece)
    out.append("".join(now).strip())
    return [s for s in out if s]


def is_query(statement: str) -> bool:
    """By its first word, so a column named updated_at makes no UPDATE of it."""
    return re.match(r"[\s(]*(\w*)", statement)[1].upper() in ("SELECT", "WITH", "VALUES", "FROM", "SHOW", "DESCRIBE", "TABLE", "EXPLAIN")


@dataclass
class Step:
    name: str
    sql: str
    sink: str = "dataframe"  # dataframe, view or table
    target: str | None = None


class SqlRunner:
    """Runs steps in order; with ``continue_on_error``, errors are kept and reported."""

    def __init__(self, spark: SparkSession, parameters: dict[str, object] | None = None, continue_on_error: bool = False):
        self.spark, self.parameters, self.continue_on_error = spark, parameters or {}, continue_on_error
        self.results: dict[str, DataFrame | None] = {}
        self.errors: dict[str, str] = {}

    def run(self, steps: list[Step]) -> dict[str, DataFrame | None]:
        for step in steps:
            try:
                last = None
                for statement in split(render(step.sql, self.parameters)):
                    got = self.spark.sql(statement)
                    last = got if is_query(statement) else None
                self.results[step.name] = sinks.deliver(last, step.sink, step.target) if last is not None else None
            except Exception as e:
                self.errors[step.name] = f"{type(e).__name__}: {e}"
                if not self.continue_on_error:
                    raise
        return self.results

    def run_file(self, path: str, **more) -> DataFrame | None:
        with open(path, encoding="utf-8") as f:
            return self.run([Step(path, f.read(), **more)])[path]
