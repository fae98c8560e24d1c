import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bytelevel, harmonic

TRICKY = ["don't I'LL we've 'tis", "a<|endoftext|>b <|endoftext|>", "  two  blanks \n\n lines\t\ttabs\r\n", "", None, "日本語 テキスト 123", "é × ÷ ñ ſ ́x", "x" * 9000, " ", "a|b|c", "12 345abc 6.7"]
SCHEMA = "doc_id long, text string, start long, length string, class int"


def ids(text):
    return [*bytelevel.tokenizer(bytelevel.default_vocabulary()).encode(text or "", add_special_tokens=False).ids, harmonic.END]


def test_units_give_the_librarys_ids():
    rng = random.Random(2)
    signs = [*"abAB ,.'-!19éß×÷Ñ \n\t\r<|>_\x0b\x0c\x85​", "<|endoftext|>", "'s", "'re", "日", "́", "  ", "\n\n"]
    texts = [*TRICKY, *["".join(rng.choices(signs, k=rng.randrange(50))) for _ in range(2000)]]
    ((got, ends),) = bytelevel.encoded([pa.array(texts, pa.string())], bytelevel.default_vocabulary(), harmonic.END)
    for text, begin, end in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
        assert got[begin:end].tolist() == ids(text), repr(text)
    found, first = bytelevel.units(pa.array(texts, pa.string()))
    assert ["".join(found.to_pylist()[a:b]) for a, b in zip(first, first[1:], strict=False)] == [x or "" for x in texts]


def test_other_vocabularies_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="word_bpe_49k"):
        harmonic.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path=public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize(("capacity", "slack"), [(2048, 1 / 64), (100, 0.1), (7, 0.0)])
def test_rests_fill_sequences_of_their_class(capacity, slack):
    found = harmonic.rests(capacity, slack)
    assert [sum(x) for x in found] == list(range(capacity))
    for pieces in found:
        for length in pieces[:-1]:
            k = capacity // length
            assert k * length > capacity - k  # cut pieces waste less than one token each
        assert len(pieces) <= 6


def checked(rows, docs, capacity):
    """Every id once, in its place; the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    wanted = {}
    for doc_id, text in docs:
        wanted.setdefault(doc_id, []).append(ids(text))
    assert set(pieces) == set(wanted)
    for doc_id, mine in pieces.items():
        if len(wanted[doc_id]) == 1:
            own, at = wanted[doc_id][0], 0
            for r in sorted(mine, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(own))
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : at], "<u4").tobytes())
            assert at == len(own)
        else:
            assert sum(r.length for r in mine) == sum(map(len, wanted[doc_id]))
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    return {s: sum(r.length for r in mine) for s, mine in sequences.items()}


@pytest.mark.parametrize("capacity", [2048, 64, 5])
def test_round_trip(spark, capacity):
    rng = random.Random(3)
    docs = [*enumerate(TRICKY), (0, TRICKY[0]), (None, "no id"), *[(100 + i, " ".join(rng.choices(["the", "of", "Wörter", "x9", "--", "zzyzx"], k=rng.randrange(1, 400)))) for i in range(150)]]
    given = spark.createDataFrame([(i, x, 1, "u", 2) for i, x in docs], SCHEMA).repartition(5)
    rows = harmonic.pack(given, capacity=capacity).collect()
    lengths = checked(rows, docs, capacity)
    tokens = sum(lengths.values())
    assert len(lengths) <= 1.04 * tokens / capacity + 3
    classes = Counter((r.sequence_id, capacity // r.length) for r in rows if r.sequence_id >= 0)
    assert all(n == k for (_, k), n in classes.items())  # full sequences: k pieces of class k


def test_empty_table(spark):
    assert harmonic.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_first_fit():
    assert harmonic.first_fit([3, 7, 5, 2], 10) == [(0, 7), (0, 0), (1, 0), (1, 5)]
