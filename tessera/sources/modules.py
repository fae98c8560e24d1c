"""Modules that add SQL functions, table functions and templates to a session; one that fails leaves nothing behind."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Tables
from .sql import run_template, validate

_NAME = re.compile("[a-z][a-z0-9_]*")


@dataclass
class Module:
    """What a module brings; filled by its loader. Functions are called ``<module>_<name>`` in SQL."""

    name: str
    version: str = "1"
    needs: tuple[str, ...] = ()
    functions: dict[str, str] = field(default_factory=dict)
    python: dict[str, object] = field(default_factory=dict)
    templates: dict[str, str] = field(default_factory=dict)
    entities: dict[str, str] = field(default_factory=dict)

    def function(self, name: str, arguments: str, returns: str, body: str) -> None:
        """A function in SQL, such as ("band", "x DOUBLE", "STRING", "CASE WHEN x > 0 ..."); ``returns`` may be TABLE (...) with a query as the body."""
        self._new(name, self.functions, self.python)
        self.functions[name] = f"({arguments}) RETURNS {returns} RETURN {body}"

    def python_function(self, name: str, what: object) -> None:
        """A pandas or Python UDF, or a UDTF."""
        self._new(name, self.functions, self.python)
        self.python[name] = what

    def template(self, name: str, sql: str) -> None:
        self._new(name, self.templates)
        validate(sql)
        self.templates[name] = sql

    def entity(self, name: str, column: str) -> None:
        """Where an entity of texts is stored, as table.column."""
        if not re.fullmatch(r"\w+\.\w+", column):
            raise ValueError(f"{column} is no table.column")
        self.entities[name] = column

    def _new(self, name: str, *known: dict) -> None:
        if not _NAME.fullmatch(name) or any(name in k for k in known):
            raise ValueError(f"{name} is there already, or no name")


class Modules:
    """The modules of one session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.loaded, self.failed = spark, {}, {}

    def load(self, name: str, loader: Callable[[Module], None], needs: tuple[str, ...] = ()) -> bool:
        """Runs a module's loader and registers what it brought. Whatever goes wrong is kept in ``failed``; then none of the
        module's functions or templates is known, and an earlier version of it stays as it was."""
        mine, done = Module(name, needs=needs), []
        before = self.loaded.get(name)
        try:
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r} is no name of a module")
            if missing := [n for n in needs if n not in self.loaded]:
                raise ValueError(f"needs modules that aren't loaded: {missing}")
            loader(mine)
            for f, text in mine.functions.items():
                self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{f}{text}")
                done.append(f)
            for f, what in mine.python.items():
                self._register(f"{name}_{f}", what)
                done.append(f)
        except Exception as problem:  # a module's code may raise anything; the session goes on without it
            self._drop(name, done)
            self.failed[name] = f"{type(problem).__name__}: {problem}"
            if before:
                self._restore(before)
            return False
        if before:
            self._drop(name, [f for f in (*before.functions, *before.python) if f not in done])
        self.loaded[name] = mine
        self.failed.pop(name, None)
        return True

    def unload(self, name: str) -> None:
        mine = self.loaded.pop(name)
        self._drop(name, [*mine.functions, *mine.python])

    def names(self) -> list[str]:
        return list(self.loaded)

    def run(self, tables: Tables, module: str, template: str, values: dict) -> DataFrame:
        return run_template(tables, self.loaded[module].templates[template], values)

    def entities(self) -> dict[str, str]:
        """All modules' entities; of one name that of the module loaded last."""
        return {k: v for m in self.loaded.values() for k, v in m.entities.items()}

    def _register(self, name: str, what: object) -> None:
        from pyspark.sql.udtf import UserDefinedTableFunction

        (self.spark.udtf if isinstance(what, UserDefinedTableFunction) else self.spark.udf).register(name, what)

    def _restore(self, module: Module) -> None:
        for f, text in module.functions.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {module.name}_{f}{text}")
        for f, what in module.python.items():
            self._register(f"{module.name}_{f}", what)

    def _drop(self, name: str, functions: list[str]) -> None:
        for f in functions:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}_{f}")
