"""Ids of whole texts by a byte-level tokenizer, one distinct unit at a time.

The tokenizer cuts a text into pre-tokens by a pattern that knows contractions, runs of letters, of digits and
of other signs (each with one blank before it) and runs of white space. A text is cut here where that pattern
cuts whatever stands around: between a plain sign and white space behind it, between two plain signs of
different kinds, and behind a tab or line end that stands alone. Plain are ASCII letters, digits and signs and
the Latin-1 letters. No cut touches another character, nor an apostrophe (contractions), nor ``|`` (special
strings), so units with those are larger and the library cuts them. That holds for one pre-tokenizer without a
normaliser: files with others are refused.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import hashing

#: When a worker holds the ids of more units than so many, it forgets those that aren't in the texts at hand.
HELD = 400_000

_ODD, _SPACE, _BREAK, _LETTER, _DIGIT, _SIGN = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x20] = _SPACE
_CLASS[[0x09, 0x0A, 0x0D]] = _BREAK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[[ord("'"), ord("|")]] = _ODD
_LATIN, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7  # in UTF-8 the Latin-1 letters are this byte and another; two of them are signs


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer in a file, if units() cuts as it does; else a ValueError."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: texts are cut for a byte-level tokenizer without a normaliser and without a blank put in front")
        if any("|" not in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in said.get("added_tokens", [])):
            raise ValueError(f"{path}: a special string without | could be cut")
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def units(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(units of all texts, in order; first): those of row i are first[i] to first[i + 1]. A null text has none; else the units of a text are the text."""
    raw, at = hashing.text_bytes(texts)
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw == _LATIN)
    second = raw[latin + 1]
    kind[latin + 1] = kind[latin] = np.where((second == _TIMES) | (second == _DIVIDED), _ODD, _LETTER)
    start = np.zeros(len(raw) + 1, bool)
    start[1:-1] = (kind[:-1] >= _LETTER) & (kind[1:] != kind[:-1]) & (kind[1:] != _ODD)
    start[at] = True
    alone = start[:-2] & (kind[:-1] == _BREAK) & (kind[1:] >= _LETTER)
    start[1:-1] |= alone
    begin = np.flatnonzero(start[:-1])
    first = np.searchsorted(begin, at)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.r_[begin, len(raw)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))), first


_ids: dict[str, dict[str, bytes]] = {}  # of each vocabulary


def encoded(columns: list[pa.StringArray], path: str, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text column (ids of all texts, each with the end id behind it; where each text ends). Units that were met before are looked up, the library gets the others."""
    known = _ids.setdefault(path, {})
    cut = [units(x) for x in columns]
    code = pa.concat_arrays([found for found, _ in cut]).dictionary_encode()
    distinct = code.dictionary.to_pylist()
    found = list(map(known.get, distinct))
    if len(known) > HELD:
        known.clear()
        known.update((u, x) for u, x in zip(distinct, found, strict=True) if x is not None)
    new = [i for i, x in enumerate(found) if x is None]
    for i, e in zip(new, tokenizer(path).encode_batch_fast([distinct[i] for i in new], add_special_tokens=False), strict=True):
        found[i] = known[distinct[i]] = array("I", e.ids).tobytes()
    found.append(array("I", [end_id]).tobytes())
    sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
    flat, begins, codes, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes, dtype=np.int64) - sizes, code.indices.to_numpy(), 0
    for _, first in cut:
        own = np.insert(codes[at : at + first[-1]], first[1:], len(found) - 1)
        size, at = sizes[own], at + first[-1]
        end = np.cumsum(size, dtype=np.int64)
        ids = flat[np.arange(end[-1]) + np.repeat(begins[own] - end + size, size)]
        yield ids, end[first[1:] + np.arange(len(first) - 1)]
