import random
import re

import ahocorasick
import pytest

from tessera.llm import repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    least, words = {}, [WORD.findall(x or "") for _, x in rows]
    order = [i if i is not None else float("inf") for i, _ in rows]
    for o, w in zip(order, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(o, least.get(key, o))
    out = []
    for (i, _), o, w in zip(rows, order, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < o:
                gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def corpus():
    random.seed(3)
    word = lambda: random.choice(["a", "b", "cd", "é", " x", "y\x1c", "z"])
    text = lambda n: "".join(random.choice([" ", "\n", "  ", "\t"]) + word() for _ in range(n))
    shared = [text(n) for n in (6, 9, 14)]
    rows = [(i, text(random.randint(0, 12)) + random.choice(shared) + text(random.randint(0, 12))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (200, None), (201, ""), (202, "  \n "), (203, "a " * 400)]
    return rows


@pytest.mark.parametrize(("shard", "in_hand"), [(1, 1), (7, 20), (8000, 100_000)])
def test_as_by_hand(spark, shard, in_hand):
    rows = corpus()
    docs = spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "doc_id long, text string, n_words int, key string")
    got = repeats.remove_repeats(docs, window=5, phrase=2, shard=shard, in_hand=in_hand)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(rows, 5)


def test_long_texts_and_a_passage_that_most_share(spark):
    random.seed(8)
    text = lambda n: [f"w{random.randint(0, 5000)}" for _ in range(n)]
    passage, long = text(80), text(60_000)
    rows = [(i, " ".join(text(30) + passage[: 50 + i % 31] + text(30)) if i % 3 else " ".join(text(60))) for i in range(300)]
    rows += [(400, " ".join(long)), (401, " ".join(text(10) + long[20_000:] + text(10))), (402, "\n".join(long)), (403, " ".join(["a"] * 70)), (404, " ".join(["a"] * 90))]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard=50)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(rows, 50)


def test_automata_find_every_window_that_holds_a_phrase():
    random.seed(9)
    for _ in range(200):
        words = [random.choice(["a", "b", "é", "日", "ab"]) for _ in range(random.randint(0, 30))]
        phrases = {" ".join(random.choice(["a", "b", "é", "ab"]) for _ in range(2)) for _ in range(3)}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases:
            automaton.add_word(f" {p} ")
        automaton.make_automaton()
        starts = repeats.located(automaton, [w.encode() for w in words], 5, 2)
        assert starts.tolist() == [s for s in range(len(words) - 4) if any(" ".join(words[p : p + 2]) in phrases for p in range(s, s + 4))]


def test_untouched_texts_keep_their_blanks(spark):
    docs = spark.createDataFrame([(1, "a  b\nc", "s"), (2, None, "t")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.source) for r in repeats.remove_repeats(docs, keep=("source",), verbatim=True).collect()}
    assert got == {1: ("a  b\nc", "s"), 2: ("", "t")}


def test_an_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_columns_of_any_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["order", "copy", "found", "key", "row", "n_words", "a.b"]
    docs = spark.createDataFrame([(i, text, *[f"{n}{i}" for n in names]) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = repeats.remove_repeats(docs, keep=tuple(names))
    assert got.columns == ["doc_id", "order", "copy", "found", "key", "row", "given_n_words", "a.b", "n_words", "n_removed", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, *[f"{n}1" for n in names], 60, 0, text), (2, *[f"{n}2" for n in names], 60, 60, "")]
