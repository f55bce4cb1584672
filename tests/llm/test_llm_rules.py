"""Repetition rules against direct counting, and the edge rows that every operator must take."""

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import repetition
from tidemark.llm.common import words_of

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e " * 40), (6, "x" * 20000), (7, "a b c d e " * 40), (7, "a b c d e " * 40),
         (None, "one two three"), (9, "é ü 漢字 \U0001f600 " * 30), (10, "line one two\nline one two\n\n\nline one two")]


def brute(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if words_of(x)]
    firsts, dup, dup_chars = set(), 0, 0
    for line in lines:
        if line in firsts:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, words_of(line)))
        firsts.add(line)
    top, inside, window = {}, {}, 0
    for n in range(2, 11):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(grams)
        covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + n)}
        top[n] = max((c * sum(map(len, g)) for g, c in counts.items() if c > 1), default=0)
        inside[n] = sum(len(words[j]) for j in covered)
        if n == 8:
            window = len(covered)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, window, dup_chars, *(top[n] for n in (2, 3, 4)),
            *(inside[n] for n in range(5, 11)))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "cd", "é#", " ", "\n", "\x0b", "\x1c", "the the"]), max_size=80).map(" ".join),
                 st.text(max_size=60)))
def test_measures_match_direct_counting(text):
    got = repetition.measure(text)
    assert (*got[:5], *got[7:]) == brute(text)


def test_edges_and_other_columns(spark):
    docs = spark.createDataFrame([(i, t, True, 1.5) for i, t in EDGES], "doc_id bigint, text string, kept boolean, n_words double")
    rows = repetition.repetition_rules(docs, kept=["doc_id"]).collect()
    assert len(rows) == len(EDGES) and Counter(r.doc_id for r in rows) == Counter(i for i, _ in EDGES)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[5].base_failed and by_id[5].n_repeat_words == 200
    assert by_id[9].word_chars == 150 and by_id[10].n_dup_lines == 2
    passed = repetition.keep_passing(docs)
    assert passed.schema == docs.schema and passed.count() == 0
    assert repetition.repetition_rules(docs.limit(0), kept=["doc_id"]).count() == 0


def test_loops_go_and_prose_stays():
    prose = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    assert repetition.measure(prose)[6]
    assert not repetition.measure("der " * 200 + "die " * 200)[6]
    assert not repetition.measure(prose + "\n" + "\n".join(["the same line of eight or more words here"] * 60))[6]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    from tidemark.llm.common import IdEncoder, load_tokenizer

    return IdEncoder(*load_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


def whole(encoder, text):
    return encoder.whole(text) if text else b""


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \nb", "a\n\nb", "a\t b", "\n", "  ", "a   b\n\n  c", "it's 5 o'clock ", "x　 y",
                                  "a,b.c!?;d ... e", "é, É.\nü: x", "word" * 3000, "", "a\nb c\nd", "…. a", "a’s b", "1,2 a1,b"])
def test_ids_by_piece_equal_ids_of_the_whole(encoder, text):
    texts = [text, text * 3, "<|endoftext|>" + text, None, "plain words here"]
    assert encoder.encode(texts) == [whole(encoder, t) for t in texts]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet=["a", "B", "é", " ", "\n", "\t", "\r", "\v", ".", ",", "'", "s", "1", "\x1c", "　", "\0", "…", "漢"], max_size=40), max_size=6))
def test_ids_of_any_text(encoder, texts):
    assert encoder.encode(texts) == [whole(encoder, t) for t in texts]


def test_a_full_table_is_emptied(monkeypatch, encoder):
    from tidemark.llm import common

    monkeypatch.setattr(common, "ID_ENTRIES", 40)
    words = [f"w{i}x common" for i in range(300)]
    for start in range(0, 300, 7):
        part = [" ".join(words[start:start + 3]), " ".join(words[start + 3:start + 7]) or "x"]
        assert encoder.encode(part) == [whole(encoder, t) for t in part]


def test_table_keeps_what_it_is_given():
    import numpy as np

    from tidemark.llm.common import IdTable

    table, rng = IdTable("<u2"), np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 62, 200_000, dtype=np.uint64) | np.uint64(1))
    raws = [bytes(2 * (i % 4)) for i in range(len(keys))]
    for start in range(0, len(keys), 30_011):
        table.put(keys[start:start + 30_011], raws[start:start + 30_011])
    slots = table.slots_of(keys)
    assert (table.keys[slots] == keys).all() and (table.sizes[slots] == np.arange(len(keys)) % 4).all()
    assert (table.keys[table.slots_of(keys + np.uint64(2))] != keys + np.uint64(2)).sum() >= len(keys) - 5


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet=" \n\ta.", max_size=14), min_size=2, max_size=5))
def test_ids_around_white_space(encoder, texts):
    assert encoder.encode(texts) == [whole(encoder, t) for t in texts]
