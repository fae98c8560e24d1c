"""Readers of documents and delimited files, and hooks for formats whose parsers aren't part of Spark."""

from __future__ import annotations

import datetime
import email
import email.policy
import email.utils
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = "path string, text string, error string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that aren't UTF-8 become the replacement character."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def parsed_files(spark: SparkSession, path: str, parser: Callable[[bytes], str]) -> DataFrame:
    """(path, text, error) by a parser of bytes; a file that it fails on gets an error, the job goes on."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((name, parser(content), None))
                except Exception as problem:  # a parser of foreign files may raise anything
                    rows.append((name, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, PARSED)


def email_fields(content: bytes) -> dict:
    """subject, sender, recipients (to and cc, addresses in lower case), date (ISO 8601, UTC), attachments (file names), body (HTML as text) of a message; what it lacks is empty or null."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = dom_text(text)
    addresses = lambda *names: [a.lower() for _, a in email.utils.getaddresses([str(v) for n in names for v in message.get_all(n, [])]) if a]
    try:
        sent = email.utils.parsedate_to_datetime(str(message["date"]))
        date = (sent.astimezone(datetime.UTC) if sent.tzinfo else sent).replace(tzinfo=None).isoformat()
    except (TypeError, ValueError):
        date = None
    return {
        "subject": str(message["subject"] or ""), "sender": (addresses("from") or [""])[0], "recipients": addresses("to", "cc"), "date": date,
        "attachments": [p.get_filename() or "" for p in message.iter_attachments()] if message.is_multipart() else [], "body": text.strip(),
    }


def email_text(content: bytes) -> str:
    """Subject, sender and body of a message; HTML bodies as text."""
    found, sender = email_fields(content), email.message_from_bytes(content, policy=email.policy.default)["from"] or ""
    return "\n".join(x for x in (f"Subject: {found['subject']}", f"From: {sender}", found["body"]) if x)


def email_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message file below ``path``: path, the fields of email_fields, and an error in place of them where a file can't be read."""
    schema = "path string, subject string, sender string, recipients array<string>, date string, attachments array<string>, body string, error string"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append({"path": name, **email_fields(bytes(content)), "error": None})
                except Exception as problem:  # a message may be broken anywhere
                    rows.append({"path": name, "error": f"{type(problem).__name__}: {problem}"})
            yield pd.DataFrame(rows, columns=["path", "subject", "sender", "recipients", "date", "attachments", "body", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def dom_text(html: str) -> str:
    """The text nodes of a page, one a line, without scripts and styles."""
    parser = _Text()
    parser.feed(html)
    return "\n".join(parser.parts)


def sniff(lines: list[str]) -> str | None:
    """The delimiter of , ; and tab that splits nine tenths of the lines alike; else None."""
    for mark in (",", ";", "\t"):
        counts = [line.count(mark) for line in lines[:20] if line.strip()]
        if counts and sum(c > 0 for c in counts) >= 0.9 * len(counts):
            return mark
    return None


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header; the delimiter is found from its first 20 lines, broken lines are dropped."""
    lines = [r.value.lstrip("﻿") for r in spark.read.text(path).limit(20).collect()]
    return spark.read.option("header", True).option("sep", sniff(lines) or ",").option("mode", "DROPMALFORMED").csv(path)


def gate(rows: DataFrame, bad: str, columns: int, most: float = 0.05) -> DataFrame:
    """(code): why a delimited table can't be used, or null. ``bad``: a flag for broken rows."""
    counted = rows.agg(F.count("*").alias("n"), F.count_if(F.col(bad)).alias("b"))
    code = F.when(F.col("n") == 0, "csv_empty").when(F.lit(columns) < 2, "csv_delimiter_undetected").when(F.col("b") / F.col("n") > most, "csv_bad_row_rate")
    return counted.select(code.alias("code"))


def benchmark(spark: SparkSession, path: str, needed: tuple[str, ...], most: int | None = None) -> DataFrame:
    """A Parquet table that has all needed columns; the first ``most`` rows."""
    df = spark.read.parquet(path)
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df if most is None else df.limit(most)
