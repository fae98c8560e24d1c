"""Documents through a language model: prompts in batches, answers parsed and joined back. Models are functions that are handed in."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]


def prompted(df: DataFrame, keys: list[str], prompt: str, model: Model, batch: int = 20, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """(keys, answer, error) of each prompt. A batch that can't reach the model is tried again, each time after twice as long; then its answers are null."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def asked(prompts: list[str]) -> tuple[list[str | None], str | None]:
        for turn in range(retries + 1):
            try:
                return list(model(prompts)), None
            except (ConnectionError, TimeoutError) as e:
                error = f"{type(e).__name__}: {e}"
                if turn < retries:
                    time.sleep(wait * 2**turn)
        return [None] * len(prompts), error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                answers, error = asked(part[prompt].fillna("").tolist())
                yield part[keys].assign(answer=answers, error=error)

    return df.select(*keys, prompt).mapInPandas(run, f"{kinds}, answer string, error string")


def parsed(answer: Column, schema: str) -> Column:
    """The object or list in an answer: as it stands, out of a code fence, or the first one in prose; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    first = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    read = lambda c: F.when(c.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"), F.from_json(c, schema, {"mode": "PERMISSIVE"}))
    return F.coalesce(read(answer), read(bare), read(first))


def chunk_batches(df: DataFrame, key: str, text: str, size: int = 500, batch: int = 8) -> DataFrame:
    """(key, batch, n_chunks, n_chars, prompt): the whole text in chunks of ``size`` characters, ``batch`` of them in a prompt, each with its number."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col(text), i * size + 1, F.lit(size)).alias("t")))
    rows = df.select(key, chunks.alias("c")).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / batch).cast("int")), lambda b: F.slice("c", b * batch + 1, F.lit(batch)))).alias("batch", "c"))
    prompt = F.array_join(F.transform("c", lambda x: F.concat(F.lit("[Chunk "), x["i"].cast("string"), F.lit("] "), x["t"])), "\n---\n")
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x["t"]))
    return rows.select(key, F.col("batch").cast("long").alias("batch"), F.size("c").cast("long").alias("n_chunks"), chars.alias("n_chars"), prompt.alias("prompt"))


def tagging_stand_in(prompts: list[str]) -> list[str]:
    """A stand-in for a tagging model: reads the language and the length from the prompt's head; answers plainly, in a fence, in prose, or with no object, by the length."""
    out = []
    for p in prompts:
        lang, length = (re.search(rf"^{k}: (.*)$", p, re.M)[1] for k in ("Language", "Length"))
        answer = json.dumps({"tags": [{"tag": f"lang:{lang}", "confidence": int(length) % 100 / 100}]})
        out.append([answer, f"```json\n{answer}\n```", f"Here it is: {answer} Good luck!", "I can't tell."][int(length) % 4])
    return out


def mail_stand_in(prompts: list[str]) -> list[str]:
    """A stand-in for an entity model: e-mail addresses, each with the number of its chunk."""
    out = []
    for p in prompts:
        chunks = re.split(r"(?:^|\n---\n)\[Chunk (\d+)\] ", p)
        found = [{"entity_type": "email", "value": m, "confidence": 0.9, "chunk_index": int(i)} for i, t in zip(chunks[1::2], chunks[2::2], strict=True) for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t, re.A)]
        out.append(json.dumps(found))
    return out


# fixed values: what a document can be, and what the answer to a summary's prompt names its parts
SUMMARY_TYPES = ("policy", "quote", "submission", "loss_run", "financial", "sov", "certificate", "application", "other")
SUMMARY_PARTS = ("DOCUMENT_TYPE", "CARRIER", "POLICY_PERIOD", "SUMMARY")


def summary_prompt(name: Column, samples: Column, n_chunks: Column, n_words: Column, most: int = 500) -> Column:
    """Asks for a document's summary; ``samples``: (i, text) of the chunks to show, ``most`` characters of each."""
    shown = F.array_join(F.transform(samples, lambda x: F.concat(F.lit("[Chunk "), x["i"].cast("string"), F.lit("]: "), F.substring(x["text"], 1, most))), "\n\n")
    ask = f"Answer with {', '.join(p + ':' for p in SUMMARY_PARTS[:-1])} (type one of {', '.join(SUMMARY_TYPES)}) and {SUMMARY_PARTS[-1]}: one paragraph."
    return F.concat(F.lit("Document: "), name, F.lit("\nTotal chunks: "), n_chunks.cast("string"), F.lit("\nTotal words: "), n_words.cast("string"), F.lit("\n\n"), shown, F.lit(f"\n\n{ask}"))


def summary_fields(answer: Column) -> Column:
    """(text, document_type, carrier, policy_period) of an answer: a line for each part, the summary to the end. An unknown type is ``other``; without a summary the whole answer is the text, of type ``other``. Null for a null or blank answer."""

    def part(name: str) -> Column:
        return F.rtrim(F.regexp_extract(answer, rf"(?i){name}:\s*(.+)", 1)).alias(name)

    own = lambda name: F.regexp_replace(F.trim(part(name)), r"\.+$", "")
    found = F.trim(F.regexp_extract(answer, r"(?is)SUMMARY:\s*(.+)", 1))
    kind = F.when((found != "") & F.lower(own("DOCUMENT_TYPE")).isin(list(SUMMARY_TYPES)), F.lower(own("DOCUMENT_TYPE"))).otherwise("other")
    said = lambda name: F.when(own(name) != "", own(name)).otherwise("unknown")
    out = F.struct(F.when(found != "", found).otherwise(answer).alias("text"), kind.alias("document_type"), said("CARRIER").alias("carrier"), said("POLICY_PERIOD").alias("policy_period"))
    return F.when(answer.isNotNull() & (F.trim(answer) != ""), out)


def summaries(chunks: DataFrame, key: str, place: str, text: str, model: Model) -> DataFrame:
    """(key, chunk_index -1, section, text, token_count, document_type, carrier, policy_period, n_chunks, n_words) of each document's summary.

    ``chunks``: (key, place, text, ...), one row a chunk; a prompt shows the first, middle and last three. A document has a
    row only if the model answers; a null text counts as empty.
    """
    from ..operators.windows import spread_sample

    own = F.coalesce(F.col(text), F.lit(""))
    rows = chunks.select(key, place, own.alias("_text"))
    words = F.size(F.filter(F.split("_text", r"\s+"), lambda x: x != ""))
    sizes = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_chunks"), F.sum(words).alias("n_words"))
    shown = spread_sample(rows, key, place).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), F.col("_text").alias("text")))).alias("samples"))  # nine at most
    asked = shown.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).select(key, "n_chunks", "n_words", summary_prompt(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("samples"), F.col("n_chunks"), F.col("n_words")).alias("prompt"))
    told = prompted(asked, [key, "n_chunks", "n_words"], "prompt", model).withColumn("f", summary_fields(F.trim("answer"))).filter("f IS NOT NULL")
    said = F.concat(F.lit("DOCUMENT SUMMARY: "), "f.text")
    return told.select(key, F.lit(-1).alias("chunk_index"), F.lit("Document Summary").alias("section"), said.alias("text"), F.expr("int(length(concat('DOCUMENT SUMMARY: ', f.text)) div 4)").alias("token_count"), "f.document_type", "f.carrier", "f.policy_period", "n_chunks", "n_words")


def summary_stand_in(prompts: list[str]) -> list[str]:
    """A stand-in for a summary model: by the number of words a full answer, one with other parts, one without a summary, or nothing."""
    out = []
    for p in prompts:
        n, w = (int(re.search(rf"^Total {k}: (\d+)$", p, re.M)[1]) for k in ("chunks", "words"))
        out.append([f"DOCUMENT_TYPE: Policy.\nCARRIER: Carrier {n}.\nPOLICY_PERIOD: 01/01/2024-01/01/2025\nSUMMARY: {w} words\nin {n} chunks.", f"document_type: memo\nSummary: {w}", f"CARRIER: none\nNothing to say of {w} words.", " "][w % 4])
    return out
