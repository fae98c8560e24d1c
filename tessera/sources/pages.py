"""A management system's accounts as a data source of Spark: numbered JSON pages in a folder, read and written in parallel.

    connectors.Connectors(spark).register("pages", JsonPages)
    accounts = spark.read.format("json_pages").option("tenant", "7").load(folder)
    policies.write.format("json_pages").mode("append").option("tenant_column", "tenant").save(folder)

A page is a file ``{"seq": n, "tenant": t, "rows": [...]}`` of at most ``page_rows`` rows of one tenant. ``_manifest.json`` lists the pages
that count and the columns that rows have; it is replaced in one move. Writing takes two steps: tasks put pages in a folder of their
job, and only when all tasks are done the driver lists those pages. A task that fails, is tried again or runs twice leaves nothing that a
reader sees, and what a job leaves in its folder besides the listed pages is removed. Paths are those that Arrow's file
systems know (local folders, HDFS, object stores).
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"


def opened(path: str):
    """(Arrow file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _load(system, path: str) -> dict | None:
    from pyarrow import fs

    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def _store(system, path: str, what: dict) -> None:
    with system.open_output_stream(path) as f:
        f.write(json.dumps(what, ensure_ascii=False).encode())


def to_json(value: object, kind: T.DataType) -> object:
    """A column's value as JSON has it; dates, times and decimals as text."""
    if value is None or isinstance(kind, T.StringType | T.BooleanType | T.IntegralType):
        return value
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return value if value == value and abs(value) != float("inf") else str(value)
    if isinstance(kind, T.ArrayType):
        return [to_json(x, kind.elementType) for x in value]
    return value.isoformat() if isinstance(value, datetime.date | datetime.datetime) else str(value)


def from_json(value: object, kind: T.DataType) -> object:
    if value is None or isinstance(kind, T.StringType | T.BooleanType | T.IntegralType):
        return value
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if isinstance(kind, T.FractionalType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [from_json(x, kind.elementType) for x in value]
    return datetime.date.fromisoformat(value) if isinstance(kind, T.DateType) else datetime.datetime.fromisoformat(value)


SUPPORTED = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType, T.TimestampNTZType, T.ArrayType)


@dataclass
class Page(InputPartition):
    name: str
    tenant: str | None
    seq: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    pages: list[Page]


class JsonPages(DataSource):
    """Options: ``tenant`` (read): one tenant or several with commas between, only their pages are opened. ``tenant_column`` (write): the column that tells a row's tenant; ``page_rows``."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> T.StructType:
        system, path = opened(self.options["path"])
        known = _load(system, f"{path}/{MANIFEST}")
        if known is None:
            raise FileNotFoundError(f"{path} holds no pages")
        return T.StructType.fromJson(known["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options, schema, overwrite)


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.tenant, self.schema = options["path"], options["tenant"].split(",") if "tenant" in options else None, schema

    def partitions(self) -> list[Page]:
        system, path = opened(self.folder)
        known = _load(system, f"{path}/{MANIFEST}") or {"pages": []}
        return [Page(**p) for p in known["pages"] if self.tenant is None or p["tenant"] in self.tenant] or [Page("", None, 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.name:
            system, path = opened(self.folder)
            page = _load(system, f"{path}/{partition.name}")
            if len(page["rows"]) != partition.rows:
                raise ValueError(f"{partition.name} has {len(page['rows'])} rows, not {partition.rows}")
            for row in page["rows"]:
                yield tuple(from_json(row.get(f.name), f.dataType) for f in self.schema)


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        for f in schema:
            if not isinstance(f.dataType, SUPPORTED):
                raise ValueError(f"{f.name}: pages hold no {f.dataType.simpleString()}")
        self.folder, self.schema, self.overwrite = options["path"], T.StructType([T.StructField(f.name, f.dataType) for f in schema]), overwrite
        self.tenant, self.page_rows, self.job = options.get("tenant_column"), int(options.get("page_rows", 1000)), f"job-{uuid.uuid4().hex}"
        if self.tenant is not None and self.tenant not in schema.names:
            raise ValueError(f"no column {self.tenant}")

    def write(self, iterator: Iterator[Row]) -> Written:
        """Runs in a task: pages under names that no other attempt uses. One page a tenant is held at a time."""
        system, path = opened(self.folder)
        system.create_dir(f"{path}/{self.job}", recursive=True)
        held: dict[str | None, list[dict]] = {}
        done: list[Page] = []

        def store(tenant: str | None) -> None:
            rows = held.pop(tenant)
            page = Page(f"{self.job}/{uuid.uuid4().hex}.json", tenant, len(done), len(rows))
            _store(system, f"{path}/{page.name}", {"seq": page.seq, "tenant": tenant, "rows": rows})
            done.append(page)

        for row in iterator:
            found = {f.name: to_json(row[i], f.dataType) for i, f in enumerate(self.schema)}
            tenant = None if self.tenant is None or found[self.tenant] is None else str(found[self.tenant])
            held.setdefault(tenant, []).append(found)
            if len(held[tenant]) >= self.page_rows:
                store(tenant)
            elif len(held) * self.page_rows > 1_000_000 and sum(map(len, held.values())) > 1_000_000:
                store(max(held, key=lambda t: len(held[t])))
        for tenant in list(held):
            store(tenant)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        system.create_dir(path, recursive=True)
        known = None if self.overwrite else _load(system, f"{path}/{MANIFEST}")
        if known is not None and T.StructType.fromJson(known["schema"]).simpleString() != self.schema.simpleString():
            raise ValueError(f"{path} holds rows of other columns")
        pages = [p for m in messages if m is not None for p in m.pages]
        before = known["pages"] if known else []
        listed = before + [p.__dict__ | {"seq": len(before) + i} for i, p in enumerate(pages)]
        _store(system, f"{path}/_{self.job}", {"schema": self.schema.jsonValue(), "pages": listed})
        system.move(f"{path}/_{self.job}", f"{path}/{MANIFEST}")
        self._clear(system, path, {p["name"] for p in listed})

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.folder)
        self._clear(system, path, set())

    def _clear(self, system, path: str, kept: set[str]) -> None:
        """Removes what this job left that isn't listed; pages of a table that was overwritten go too."""
        from pyarrow import fs

        folders = fs.FileSelector(path, allow_not_found=True)
        for folder in system.get_file_info(folders):
            name = folder.base_name
            if folder.type == fs.FileType.Directory and (name == self.job or (self.overwrite and kept and name.startswith("job-"))):
                files = system.get_file_info(fs.FileSelector(folder.path))
                if not any(f"{name}/{f.base_name}" in kept for f in files):
                    system.delete_dir(folder.path)
                else:
                    for f in files:
                        if f"{name}/{f.base_name}" not in kept:
                            system.delete_file(f.path)


class Nothing(DataSource):
    """Takes every row, gives none: for sessions without a management system."""

    @classmethod
    def name(cls) -> str:
        return "no_system"

    def schema(self) -> str:
        return "account_id string, account_name string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        class Empty(DataSourceReader):
            def read(self, partition: InputPartition | None) -> Iterator[tuple]:
                return iter(())

        return Empty()

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        class Sink(DataSourceWriter):
            def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
                for _ in iterator:
                    pass
                return WriterCommitMessage()

        return Sink()
