"""Token counts by greedy longest match, in time linear in the text, without building the pieces.

The vocabulary is a trie with two roots: pieces that start a word and pieces that go on in
one. Each node has a failure link, the node that remains when the longest pieces are taken
off its string, and the number of pieces taken off on the way. A word is read once, byte by
byte; when the trie has no edge, the link is followed and its number added. So a word's
count is a sum of precomputed numbers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import CACHE_ENTRIES, byte_alphabet, map_texts, words_of

#: What marks a word start in byte-level vocabularies.
WORD_START = "Ġ"


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """(pieces that start a word, pieces inside words) of a byte-level tokenizer file; the space of word starts is cut off."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    first, inner = set(), set()
    for token in tokens:
        if all(c in alphabet for c in token):
            if token.startswith(WORD_START) and len(token) > 1:
                first.add(bytes(alphabet[c] for c in token[1:]))
            elif not token.startswith(WORD_START):
                inner.add(bytes(alphabet[c] for c in token))
    return first, inner


@dataclass
class Automaton:
    """``keys``: node * 256 + byte of each edge, ``targets``: where it leads; ``links`` (-1: none) and ``counts`` per node.

    Node 0 is the root of word starts, node 1 that of inner pieces.
    """

    keys: np.ndarray
    targets: np.ndarray
    links: np.ndarray
    counts: np.ndarray


def build(first: set[bytes], inner: set[bytes]) -> Automaton:
    """Trie and links, level by level. A word start may be matched by a piece of either set."""
    edges: dict[int, int] = {}
    parent, byte, ends = [-1, -1], [0, 0], [False, False]
    for root, pieces in ((0, first | inner), (1, inner)):
        for piece in sorted(pieces):
            node = root
            for b in piece:
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    ends.append(False)
                node = edges[key]
            ends[node] = True
    depth = np.zeros(len(parent), np.int64)
    for node in range(2, len(parent)):  # children come after their parents
        depth[node] = depth[parent[node]] + 1
    links, counts = [-1] * len(parent), [0] * len(parent)
    for node in np.argsort(depth, kind="stable").tolist():
        if node < 2:
            continue
        if ends[node]:
            links[node], counts[node] = 1, 1
            continue
        at, taken, b = links[parent[node]], counts[parent[node]], byte[node]
        while at >= 0 and (at << 8 | b) not in edges:
            taken += counts[at]
            at = links[at]
        if at >= 0:
            links[node], counts[node] = edges[at << 8 | b], taken
    keys = np.fromiter(edges, np.int64, len(edges))
    return Automaton(keys, np.fromiter(edges.values(), np.int32, len(edges)), np.array(links, np.int32), np.array(counts, np.int32))


class Counter:
    """Piece counts of words, with a bounded cache of words."""

    def __init__(self, automaton: Automaton):
        self.edges = dict(zip(automaton.keys.tolist(), automaton.targets.tolist()))
        self.links, self.counts = automaton.links.tolist(), automaton.counts.tolist()
        self.known: dict[str, int] = {}

    def word(self, raw: bytes) -> int:
        """Pieces of one word; 0 when the vocabulary can't spell it."""
        edges, links, counts = self.edges.get, self.links, self.counts
        node = total = 0
        for b in raw:
            to = edges(node << 8 | b)
            while to is None:
                if links[node] < 0:
                    return 0
                total += counts[node]
                node = links[node]
                to = edges(node << 8 | b)
            node = to
        while node != 1:
            if links[node] < 0:
                return 0
            total += counts[node]
            node = links[node]
        return total

    def text(self, words: list[str]) -> tuple[int, int]:
        """(pieces, words that can't be spelled); such a word counts as one piece."""
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w.encode("utf-8", "surrogatepass"))
        pieces = list(map(known.__getitem__, words))
        unknown = pieces.count(0)
        return sum(pieces) + unknown, unknown


def piece_counts(docs: DataFrame, vocabulary_path: str, text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of ``docs`` (default: its first), ``n_words``, ``n_pieces`` and ``n_unknown``.

    Words are runs without ASCII white space, taken as UTF-8 bytes. Each is cut from the
    left into the longest pieces of the vocabulary; a word that can't be cut so counts as
    one piece and one unknown. A null or empty text has no words. Per row, without a
    shuffle; the automaton's size is that of the vocabulary.
    """
    automaton = build(*read_vocabulary(vocabulary_path))

    def start():
        counter = Counter(automaton)

        def work(texts):
            for text in texts:
                words = words_of(text or "")
                yield (len(words), *counter.text(words))

        return work

    return map_texts(docs, [text_col], kept or [docs.columns[0]], {"n_words": "bigint", "n_pieces": "bigint", "n_unknown": "bigint"}, start)
