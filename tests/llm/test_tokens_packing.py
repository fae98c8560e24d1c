import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, tokens

TRICKY = [
    "Hello  World'S don't I'LL 12 345abc", "ﬁ İ Σας é café ß straße", "<|endoftext|> <|startoftext|>x a<|endoftext|>b", "a_b c\x1cd e f \x0b g --''--", "", None,
    "the the the", "the the the", "x" * 5000, " \n\t ", "日本語 テキスト 123", "Grün-blau! (a) [b] {c} 5% & more...",
]
SCHEMA = "doc_id long, text string, n long, unit string, length int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, 1, "u", 2) for i, x in enumerate(TRICKY)] + [(0, TRICKY[0], 1, "u", 2), (None, "no id", 1, "u", 2)], SCHEMA)


def ids(text):
    return tokens.tokenizer(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_units_give_the_librarys_ids():
    random.seed(1)
    letters = list("abcAB ,.'-!19éßÀñ \n\t<|>_") + ["<|endoftext|>", "'s", "İ", "日", "́", "\x85", "​"]
    texts = [*TRICKY, *["".join(random.choices(letters, k=60)) for _ in range(300)]]
    found, first = tokens.units(pa.array(texts))
    found = found.to_pylist()
    for text, begin, end in zip(texts, first[:-1], first[1:], strict=True):
        assert [i for u in found[begin:end] for i in ids(u)] == ids(text), repr(text)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(found, tokens.default_vocabulary())] == [ids(u) for u in found]
    assert tokens.units(pa.array([], pa.string()))[0].to_pylist() == []


def test_other_vocabularies_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="byte_bpe_50k"):
        tokens.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path=public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_vocabulary_asked_for(tmp_path):
    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        said = json.load(f)
    said["model"]["vocab"] = {k: v for k, v in said["model"]["vocab"].items()}
    a, b = said["model"]["vocab"]["the</w>"], said["model"]["vocab"]["of</w>"]
    said["model"]["vocab"] |= {"the</w>": b, "of</w>": a}
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(said, f)
    for path, expected in ((tokens.default_vocabulary(), [a, b, packing.END]), (other, [b, a, packing.END])) * 2:
        ((got, _),) = packing.encoded([pa.array(["the of"])], path)
        assert got.tolist() == expected


@pytest.mark.parametrize("head", [0, 3, 50_000])
def test_counts(docs, head):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, limit=3, head_units=head).collect())
    rows = [*enumerate(TRICKY), (0, TRICKY[0]), (-1, "no id")]
    assert got == sorted((i, len((x or "").encode()), len(ids(x)), len(ids(x)) > 3) for i, x in rows)


def test_counts_of_an_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing_holds_all_ids_without_gaps(docs, capacity):
    rows = packing.pack(docs, capacity=capacity).collect()
    texts = {i: x for i, x in enumerate(TRICKY)} | {None: "no id"}
    assert sum(r.length for r in rows) == sum(len(ids(x)) + 1 for x in TRICKY) + len(ids(TRICKY[0])) + 1 + len(ids("no id")) + 1
    places = {}
    for r in rows:
        own = np.array(ids(texts[r.doc_id]) + [packing.END], "<u4")
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length <= capacity and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == r.piece * capacity
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sweeps_are_best_fit_decreasing():
    random.seed(2)
    for _ in range(50):
        capacity = random.randint(5, 60)
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 80))]
        gaps = []
        for n in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
        count = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.sweeps(count, capacity)
        used = {}
        for length, first, end, to, offset in plan:
            for i in range(end - first):
                used.setdefault(to + i, []).append((offset, length))
        assert sum(end - first for _, first, end, _, _ in plan) == len(lengths)
        assert all(sum(n for _, n in held) <= capacity for held in used.values())
        assert len(used) == len(gaps)


def test_windows_are_packed_each_on_its_own(spark):
    random.seed(3)
    rows = [(i, "word " * random.randint(0, 30), random.choice([0, 1, 2, None])) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, run long"), capacity=40, window="run").collect()
    window, of = {i: w or 0 for i, _, w in rows}, {}
    for r in got:
        of.setdefault(r.sequence_id, set()).add(window[r.doc_id])
    assert {r.doc_id for r in got} == set(window) and all(len(x) == 1 for x in of.values())
    order = [min(of[k]) for k in sorted(of)]
    assert order == sorted(order)
    for w in (0, 1, 2):
        own = sum(r.length for r in got if window[r.doc_id] == w)
        assert sum(w in x for x in of.values()) <= own / 40 * 1.1 + 1
