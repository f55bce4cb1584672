"""Conversation trie against direct counting; double arrays against dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import conversation_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - c % 5, [])[:h] + turns[h:]
    return plain, out


def direct(paths):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(paths):
        path = tuple(paths[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        more = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += more
            leaves[node[:d]] += not children[node]
    return sorted((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(children[node]), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, own in members.items())


def result(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: r[:2])


def conversations(seed, n=250):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 6, 12])):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", None, ""]), rng.choice(["a", "b", "é" * 9, "", None, f"x{rng.random()}"]), "d"))
    rows += [(c, t, "user", f"same {t}", None) for c in range(1000, 1400) for t in range(7)]  # copies
    rows += [(c, t, "user", "hot" if t == 0 else f"{c}", None) for c in range(2000, 2400) for t in range(2)]  # a hot first turn
    rows += [(3000, t, "user", "long" * (t % 3), None) for t in range(700)] + [(None, 0, "user", "lost", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,limit,segment,hot", [(1, 1 << 16, 1024, 1000), (2, 64, 16, 20)])
def test_nodes_equal_direct_counting(spark, monkeypatch, seed, limit, segment, hot):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "HOT_CHILDREN", hot)
    rows = conversations(seed)
    plain, paths = rebuilt(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    turns, members = trie.ranked_turns(table)
    if segment == 1024:
        assert result(trie.prefix_trie(turns, members, limit)) == direct(plain)
    assert result(trie.prefix_trie(*trie.with_shared_heads(turns, members), limit)) == direct(paths)


def test_few_and_no_rows(spark):
    def nodes(rows):
        return result(trie.prefix_trie(*trie.ranked_turns(spark.createDataFrame(rows, SCHEMA))))
    assert nodes([]) == [] and nodes([(None, 1, "a", "b", None)]) == []
    one = [(7, None, None, None, None)]
    assert nodes(one) == direct({7: [("", "")]})


def test_double_array_holds_the_paths():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 9, 400)
    first = np.cumsum(lengths) - lengths
    ids = rng.choice([0, 1, 2, *range(300)], int(lengths.sum()))
    roots = rng.integers(0, 3, 400)
    array = trie.packed(ids, first, lengths, roots)
    slots = {}
    for a, n, root in zip(first.tolist(), lengths.tolist(), roots.tolist()):
        state = np.array([root])
        for r in range(n):
            state = array.step(state, ids[a + r:a + r + 1])
            assert slots.setdefault((root, *ids[a:a + r + 1].tolist()), int(state[0])) == state[0] >= 0
    assert len(set(slots.values())) == len(slots) == int((array.check >= 0).sum())
    assert (array.step(np.array([0]), np.array([999])) == -1).all()
