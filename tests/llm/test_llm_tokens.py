"""Packing, the Huffman store and piece counts against direct versions."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import huffman_store, packing, piece_counts
from tidemark.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = [(i, "the cat sat on the mat . " * (i % 9) + f"number {i}", f"s{i % 3}" if i % 7 else None) for i in range(60)]
DOCS += [(60, None, "s0"), (61, "", "s1"), (62, "long " * 30000, "s0"), (5, DOCS[5][1], DOCS[5][2]), (None, "no id", "s2"), (63, "lone", "rare")]
SCHEMA = "doc_id bigint, text string, source string, start string, length string, part string, queue string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", "y", "z", "q") for d in DOCS], SCHEMA).repartition(5)


def ids_of(text, end):
    return np.append(np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, "<u4"), end).astype("<u4")


@pytest.mark.parametrize("options", [{}, {"weights": {"s0": 0.8, "s1": 0.2}}, {"max_queues": 2}, {"window_tokens": 4096, "length": 128}])
def test_packing_places_every_token_once(docs, options):
    length = options.get("length", packing.LENGTH)
    rows = packing.pack(docs, PATH, **options).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * length + r.offset == at and r.offset + r.length <= length and len(r.ids) == 2 * r.length
        at += r.length
    assert at == sum(len(ids_of(t, 0)) for _, t, _ in DOCS)
    for i in (0, 8, 62, 60, 61, None):
        own = sorted((r.start, r.length, r.ids, r.doc_tokens) for r in rows if r.doc_id == i)
        want = ids_of(next(t for d, t, _ in DOCS if d == i), 0)
        assert np.array_equal(np.frombuffer(b"".join(bytes(x[2]) for x in own), "<u2"), want)
        assert all(x[3] == len(want) for x in own) and own[0][0] == 0


def test_schedule_equals_serving_window_by_window():
    totals, quanta, grain = [1000, 70, 0, 5000, 3], [300 << 16, 9 << 16, 1, (911 << 16) + 77, 1 << 12], 16
    schedule = packing.Schedule(totals, quanta, grain)
    stream, served, deficit = [], [0] * 5, [0] * 5
    for window in range(2000):
        for q in range(5):
            if served[q] < totals[q]:
                deficit[q] += quanta[q]
            while deficit[q] >= grain << 16 and served[q] < totals[q]:
                take = min(grain, totals[q] - served[q])
                stream += [(q, served[q] + i) for i in range(take)]
                served[q] += take
                deficit[q] -= grain << 16
    placed = {}
    for q, total in enumerate(totals):
        for at, first, count in schedule.spans(q, 0, total):
            placed.update({at + i: (q, first + i) for i in range(count)})
    assert [placed[i] for i in range(len(stream))] == stream and len(placed) == sum(totals)


def test_windows_have_the_target_shares(spark):
    docs = spark.createDataFrame([(i, "word " * 200, "ab"[i % 2]) for i in range(400)], "doc_id bigint, text string, source string")
    rows = packing.pack(docs, PATH, window_tokens=8192, weights={"a": 3, "b": 1}).collect()
    first = [r for r in rows if r.sequence_id < 40]
    share = sum(r.length for r in first if r.source == "a") / sum(r.length for r in first)
    assert abs(share - 0.75) < 0.05


def test_named_sources_keep_their_queues(spark):
    """With two queues the smallest source has its own when it is named; more names than queues are an error."""
    rows = [(i, "word " * 300, s) for s, n in (("big", 12), ("mid", 6), ("tiny", 3)) for i in range({"big": 0, "mid": 100, "tiny": 200}[s], {"big": 0, "mid": 100, "tiny": 200}[s] + n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1)
    got = packing.pack(docs, PATH, window_tokens=4096, weights={"tiny": 1}, max_queues=2).collect()
    first = sorted(got, key=lambda r: (r.sequence_id, r.offset))[:2]
    assert {r.source for r in first} == {"tiny"} and sum(r.length for r in got) == 21 * 302
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, weights={"a": 1, "b": 1}, max_queues=2)


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.filter("doc_id = 60"), PATH, digest=True).collect()[0].ids_crc32 == zlib.crc32(b"\0" * 4)


def test_store_round_trip(spark, docs):
    rows = huffman_store.round_trip(docs, PATH).collect()
    want, start = [], 0
    for i, text in sorted(((i, t) for i, t, _ in DOCS), key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = ids_of(text, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert huffman_store.round_trip(docs.limit(0), PATH).count() == 0


def test_store_files_are_in_order_and_smaller(spark, docs):
    path = scratch_path(spark, "store")
    huffman_store.write_store(docs, path, PATH, block_tokens=500)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("shard", "block").collect()
    ids = [i for b in blocks for i in b.ids]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(blocks) > 3
    assert sum(len(b.codes) for b in blocks) < 2 * sum(b.n_tokens for b in blocks)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(9, 20))
def test_codec_round_trip_within_the_limit(ids, bits):
    ids = np.array(ids)
    lengths = huffman_store.code_lengths(np.bincount(ids), bits)
    assert lengths.max() <= bits and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    raw, marks = huffman_store.Encoder(lengths).pack(ids)
    assert np.array_equal(huffman_store.Decoder(lengths).unpack(raw, marks, len(ids)), ids)


def test_lengths_under_a_tight_limit_are_best():
    counts = np.array([2 ** i for i in range(12)])
    lengths = huffman_store.code_lengths(counts, 4)
    assert lengths.max() == 4 and (2.0 ** -lengths.astype(float)).sum() == 1
    # Exhaustive over length multisets: falling lengths with rising counts.
    best = min(sum(c * n for c, n in zip(counts, [*[4] * a, *[3] * b, *[2] * c2, *[1] * d])) for a in range(13) for b in range(13 - a)
               for c2 in range(13 - a - b) for d in [12 - a - b - c2] if a / 16 + b / 8 + c2 / 4 + d / 2 <= 1)
    assert int((counts * lengths).sum()) == best


def greedy(word, first, inner):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (first | inner if at == 0 else inner)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12),
       st.text("abcd", min_size=1, max_size=14))
def test_automaton_equals_greedy_longest_match(first, inner, word):
    sets = [{x.encode() for x in s} for s in (first, inner)]
    assert piece_counts.Counter(piece_counts.build(*sets)).word(word.encode()) == greedy(word.encode(), *sets)


def test_piece_counts_on_a_table(spark, docs):
    rows = piece_counts.piece_counts(docs.withColumnRenamed("part", "n_pieces"), PATH, kept=["doc_id"]).collect()
    first, inner = piece_counts.read_vocabulary(PATH)
    texts = {i: t or "" for i, t, _ in DOCS}
    for r in rows:
        if r.doc_id != 62:
            assert (r.n_words, r.n_pieces, r.n_unknown) == (len(texts[r.doc_id].split()), sum(greedy(w.encode(), first, inner) for w in texts[r.doc_id].split()), 0)
    assert len(rows) == len(DOCS) and piece_counts.piece_counts(docs.limit(0), PATH).count() == 0
