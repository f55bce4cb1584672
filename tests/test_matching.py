"""Matching against brute force on small inputs."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.operators import matching as m, retrieval as ret


def whole_percent(a, b):
    """2 * LCS / (len a + len b) in whole percent, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return round(200.0 * row[-1] / (len(a) + len(b))) / 100.0 if a or b else 1.0


def transposing_distance(a: str, b: str) -> int:
    """Edits counting a swap of neighbours as one (Damerau 1964), unrestricted."""
    last_row: dict[str, int] = {}
    far = len(a) + len(b)
    grid = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        grid[i + 1][1] = i
    for j in range(len(b) + 1):
        grid[1][j + 1] = j
    for i, x in enumerate(a, 1):
        last_col = 0
        for j, y in enumerate(b, 1):
            k, m = last_row.get(y, 0), last_col
            same = x == y
            grid[i + 1][j + 1] = min(grid[i][j] + (not same), grid[i + 1][j] + 1, grid[i][j + 1] + 1,
                                     grid[k][m] + (i - k - 1) + 1 + (j - m - 1))
            if same:
                last_col = j
        last_row[x] = i
    return grid[-1][-1]


random.seed(5)
LETTERS = "abcd"


def word(low, high):
    return "".join(random.choice(LETTERS) for _ in range(random.randint(low, high)))


def vary(w):
    i = random.randrange(len(w))
    return random.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:], w[:i] + w[i:][::-1]]) or "a"


SHORT = sorted({word(1, 14) for _ in range(60)})
LONG = sorted({word(18, 60) for _ in range(25)})
CHOICES = SHORT + LONG
ASKED = sorted({vary(w) for w in CHOICES} | {vary(vary(w)) for w in CHOICES} | {"ABCA", "caféé"})


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_ratio_finds_every_pair(spark):
    for t in (0.8, 0.65):
        want = {(a, b) for a in ASKED for b in CHOICES if whole_percent(a.lower(), b.lower()) >= t}
        got = {(r.left_value, r.right_value) for r in m.fuzzy_match(frame(spark, ASKED * 3), frame(spark, CHOICES), "v", "v", t).collect()}
        assert got == want


def test_levenshtein_finds_every_pair(spark):
    for t in (0.8, 0.6):
        want = {(a, b) for a in ASKED for b in CHOICES
                if 1.0 - lev(a.lower(), b.lower()) / max(len(a), len(b)) >= t}
        got = {(r.left_value, r.right_value)
               for r in m.fuzzy_match(frame(spark, ASKED), frame(spark, CHOICES), "v", "v", t, "levenshtein").collect()}
        assert got == want


def test_batch_kernels_equal_the_textbook():
    rng = random.Random(11)
    pairs = [("", ""), ("", "a"), ("é" * 70, "xé" * 70), ("😀a", "a😀")]
    for longest in (6, 12, 40, 200):
        for _ in range(120):
            a = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, longest)))
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                if len(b) > 1:
                    i = rng.randrange(len(b) - 1)
                    b[i:i + 2] = rng.choice([[b[i + 1], b[i]], [b[i]], [b[i], "z", b[i + 1]]])
            pairs.append((a, rng.choice(["".join(b), "".join(rng.choice("abx") for _ in range(rng.randint(0, longest)))])))
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert similarity.whole_percents(left, right).tolist() == [whole_percent(a, b) for a, b in pairs]
    short = [(a, b) for a, b in pairs if len(a) + len(b) < 90]
    got = similarity.transposing_distances([a for a, _ in short], [b for _, b in short])
    assert got.tolist() == [transposing_distance(a, b) for a, b in short]
    assert similarity.common_lengths([], []).tolist() == [] and isinstance(got, np.ndarray)


def test_swapped_letters_count_once():
    assert transposing_distance("abcd", "abdc") == 1
    assert transposing_distance("ca", "abc") == 2
    assert transposing_distance("", "ab") == 2


def test_ngram_cosine_per_query(spark):
    asked, choices = ASKED[:25], CHOICES[:40] + CHOICES[:5]

    def grams(v):
        return Counter(v[i:i + n] for n in (2, 3) for i in range(len(v) - n + 1))

    want = set()
    for q in asked:
        docs = [grams(q.lower())] + [grams(c) for c in choices]
        n = len(docs)
        idf = lambda g: math.log((1 + n) / (1 + sum(g in d for d in docs))) + 1
        vec = [{g: tf * idf(g) for g, tf in d.items()} for d in docs]
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        for c, v in zip(choices, vec[1:]):
            if norm(v) and norm(vec[0]):
                s = sum(x * v.get(g, 0) for g, x in vec[0].items()) / norm(v) / norm(vec[0])
                if s >= 0.5:
                    want.add((q, c, round(s, 9)))
    got = m.ngram_match(frame(spark, asked), frame(spark, choices), "v", "v", 0.5).collect()
    assert {(r.left_value, r.right_value, round(r.score, 9)) for r in got} == want


def test_spelling_matches_brute_force(spark):
    entries = sorted({word(3, 9) for _ in range(60)} | {word(15, 22) for _ in range(20)})
    freq = {e: random.randint(1, 9) for e in entries}
    asked = sorted({vary(vary(e)) for e in entries} | {vary(e) for e in entries} | {"zzzzzzz", entries[0]})
    got = m.correct_spelling(spark.createDataFrame([("en", w) for w in asked], "lang string, word string"),
                             spark.createDataFrame([("en", e, f) for e, f in freq.items()], "lang string, word string, freq int")).collect()
    assert len(got) == len(asked)
    for r in got:
        if r.word in freq:
            assert r.is_known and r.corrected == r.word
            continue
        near = {e: transposing_distance(r.word, e) for e in entries}
        best = min(near.values())
        tier = [e for e in entries if near[e] == best] if best <= 2 else []
        assert r.candidates == len(tier)
        assert r.corrected == (min(tier, key=lambda e: (-freq[e], e)) if tier else r.word)


def test_messages_keep_case_and_links(spark):
    vocab = spark.createDataFrame([("revenue",), ("total",)], "term string")
    msgs = spark.createDataFrame([(1, "Totl REVENU by a@b.com  total"), (2, "http://x.y/totl")], "id int, t string")
    got = {r.id: r for r in m.correct_messages(msgs, "id", "t", vocab, 0.75).collect()}
    assert got[1].corrected == "Total REVENUE by a@b.com total" and got[1].corrections == 2 and got[1].total_words == 5
    assert got[2].corrected == "http://x.y/totl" and got[2].corrections == 0


def test_dedupe_folds_copies(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(i, text) for i in range(10)] + [(50, text + " extra"), (60, "something else here"), (70, ""), (80, None)]
    got = {r.id: r.cluster for r in m.dedupe(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert {got[i] for i in range(10)} == {0} and got[50] == 0 and got[60] == 60 and got[70] == 70 and got[80] == 80


def test_chunks_cover_the_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2750))
    got = ret.chunk(spark.createDataFrame([(1, text), (2, "ab")], "id int, t string"), "id", "t").orderBy("chunk_id").collect()
    parts = [r.chunk for r in got if r.id == 1]
    assert parts[0] + "".join(p[200:] for p in parts[1:]) == text and [r.chunk for r in got if r.id == 2] == ["ab"]


def cut_by_marks(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """The same cuts by plain recursion."""
    mark, finer = marks[0], marks[1:]
    pieces = text.split(mark) if mark else list(text)
    pieces = [p for p in pieces[:1] + [mark + p for p in pieces[1:]] if p]
    out, window = [], []
    for piece in pieces:
        if len(piece) >= size:
            out += ["".join(window)] + cut_by_marks(piece, size, overlap, finer)
            window = []
            continue
        if len("".join(window)) + len(piece) > size:
            out.append("".join(window))
            while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                del window[0]
        window.append(piece)
    return [c.strip() for c in out + ["".join(window)] if c.strip()]


def test_chunks_by_marks_match_recursion(spark):
    import random
    draw = random.Random(5)
    texts = ["", None, " ", "\n\n\n", "para one.\n\n" + "word " * 300, "x" * 333, "é😀" * 120 + "\u3000 \x1cü", "a\n\n\n\n\nb" * 30]
    texts += ["".join(draw.choice(["a", "bc", "é", "w" * 9, "z" * 41, " ", " ", "\n", "\n\n", "\t"]) for _ in range(draw.randrange(200))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, t string, chunk string")
    for size, overlap in ((100, 20), (20, 19), (7, 0), (10, 3)):
        got = {}
        for r in ret.chunk_by_marks(rows, "id", "t", size, overlap).orderBy("id", "chunk_id").collect():
            got.setdefault(r.id, []).append(r.chunk)
        for i, t in enumerate(texts):
            assert got.get(i, []) == (cut_by_marks(t, size, overlap) if t else []), (t, size, overlap)


def test_mmr_prefers_variety(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [0.6, 0.8]), (4, [-1.0, 0.0])], "id int, v array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "q int, v array<double>")
    assert [r.id for r in ret.vector_mmr(asked, corpus, "q", "id", "v", 2, 0.3).orderBy("rank").collect()] == [2, 4]


def test_intent_rules(spark):
    asked = ["show me the total by customer", "generate sql for sales", "according to the document", "hello"]
    got = {r.v: r for r in ret.classify_intent(frame(spark, asked), "v").collect()}
    assert got["generate sql for sales"].intent == "sql_generation"
    assert got["show me the total by customer"].intent == "data_analysis"
    assert got["according to the document"].intent == "document_search"
    assert (got["hello"].intent, got["hello"].confidence) == ("general_question", 0.5)
    assert ret.classify_intent(frame(spark, ["what now"]), "v", has_tables=False).filter(F.col("intent") == "general_question").count() == 1
