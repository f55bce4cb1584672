"""Helpers shared by the text operators: words, worker caches, token ids, crc tests."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters that str.split() takes as white space although they belong to words here.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _bytes_but(dropped: str) -> np.ndarray:
    keep = np.ones(256, bool)
    keep[list(dropped.encode())] = False
    return keep


#: Bytes of words, and of search terms, which end at ASCII punctuation as well.
WORD_BYTES = _bytes_but(SPACES)
TERM_BYTES = _bytes_but(SPACES + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(4096, _BASE))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(text: str | None, keep: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of kept bytes of a text, in order: polynomials over a table of byte values, the same everywhere."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(keep[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
    lengths = np.diff(np.append(first, len(at)))
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _BASE))
    values = _OF_BYTE[raw[at]] * powers[np.arange(len(at)) - np.repeat(first, lengths)]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries of a worker's cache of words or pieces; it is emptied when full.
CACHE_ENTRIES = 300_000
#: Pieces whose ids a task keeps, about 60 bytes each.
ID_ENTRIES = 1_500_000
#: Rows that an operator turns into Python objects at once.
SLICE_ROWS = 500


def slices(batches):
    """The batches in parts of at most SLICE_ROWS rows, without copying; empty ones are left out.

    After the last one, memory that the worker holds but does not use goes back to the system.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that most systems have
    if trim is not None:
        trim(0)


def words_of(text: str) -> list[str]:
    """Runs of characters other than the six ASCII white-space characters."""
    return WORD.findall(text) if WIDE_SPACE.search(text) else text.split()


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def worker_store(name: str, make: Callable[[], dict]) -> dict:
    """A dict that lives as long as the Python worker, so later tasks find it filled."""
    home = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    stores = home.__dict__.setdefault("stores", {})
    if name not in stores:
        stores[name] = make()
    return stores[name]


def struct_of(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary()}


def map_texts(df: DataFrame, inputs: list[str], kept: list[str], made: dict[str, str],
              start: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Arrow map in which ``start()`` gives, once per task, a function from input lists to rows.

    The result has the columns ``kept`` of ``df`` as they are, then those of ``made``
    (name: type). The function gets the ``inputs`` columns of a batch as lists and
    gives one tuple per row, in order.
    """
    source = df.select(*dict.fromkeys([*kept, *inputs]))
    fields = {f.name: f for f in source.schema.fields}
    schema = T.StructType([fields[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in made.items()])
    types_made = [ARROW[t] for t in made.values()]
    names = [*kept, *made]

    def run(batches):
        work = start()
        for batch in slices(batches):
            rows = list(work(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types_made)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


# Token ids

def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary to byte: printable bytes are themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class IdTable:
    """Ids of pieces by the 64-bit hash of the piece, in flat arrays, so that millions of pieces fit and whole batches are looked up at once."""

    def __init__(self, kind: str):
        self.kind = kind
        self.reset(1 << 17)

    def reset(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys, self.at, self.sizes = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.used, self.count = np.zeros(1 << 16, self.kind), 0, 0

    def slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or of the free place where its search ends."""
        slots = hashes & self.mask
        open_ = np.flatnonzero((self.keys[slots] != hashes) & (self.keys[slots] != 0))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            there = self.keys[slots[open_]]
            open_ = open_[(there != hashes[open_]) & (there != 0)]
        return slots

    def put(self, hashes: np.ndarray, raws: list[bytes]) -> None:
        """Add distinct hashes that are not there yet."""
        if self.count + len(hashes) > ID_ENTRIES:
            self.reset(len(self.keys))
        while 2 * (self.count + len(hashes)) > len(self.keys):
            self.grow()
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // self.ids.itemsize
        flat = np.frombuffer(b"".join(raws), self.kind)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.kind)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.place(hashes, self.used + np.cumsum(sizes) - sizes, sizes)
        self.used += len(flat)
        self.count += len(hashes)

    def place(self, hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        left = np.arange(len(hashes))
        while len(left):
            slots = self.slots_of(hashes[left])
            self.keys[slots] = hashes[left]  # of several hashes that want one slot, the last stays
            won = self.keys[slots] == hashes[left]
            self.at[slots[won]], self.sizes[slots[won]] = at[left[won]], sizes[left[won]]
            left = left[~won]

    def grow(self) -> None:
        full = np.flatnonzero(self.keys)
        keys, at, sizes = self.keys[full], self.at[full], self.sizes[full]
        slots = 2 * len(self.keys)
        self.mask = np.uint64(slots - 1)
        self.keys, self.at, self.sizes = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.place(keys, at, sizes)


#: A word of plain letters, with a space before it or not, and one to three points after it. The pre-tokenizer cuts between the two.
_WORD_AND_POINTS = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]{1,3})?")
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
POINT = ~_bytes_but(".,;:!?")


class IdEncoder:
    """Token ids of whole texts as little-endian bytes, through the tokenizers library, which sees each piece of text once.

    A text's ids are the ids of its pieces one after another, because the pre-tokenizer
    never joins characters over a piece's edge: pieces start where white space follows a
    word, after a single line end or tab, and where points follow a plain letter. Pieces
    are known by a 64-bit hash. Texts for which the edges are not known (white space beyond
    ASCII, added tokens, another pre-tokenizer) are encoded whole.
    """

    def __init__(self, tokenizer_json: str, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.type, self.kind = f"<u{width}", {2: "H", 4: "I"}[width]
        # Parsing the vocabulary takes a fifth of a second, so a worker does it once.
        self.tokenizer = worker_store(f"tokenizer-{hash(tokenizer_json)}", lambda: {"it": Tokenizer.from_str(tokenizer_json)})["it"]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = str(self.tokenizer.pre_tokenizer)
        self.by_piece = (self.tokenizer.normalizer is None and cut.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cut
                         and str(self.tokenizer.model).startswith("BPE("))
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.space, self.model = self.letters[32], self.tokenizer.model
        self.table, self.points, self.swapped = IdTable(self.type), {}, sys.byteorder != "little"

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.type).tobytes()

    def piece(self, raw: bytes) -> bytes:
        """Ids of one piece. Plain words are one pre-token, whose bytes the model alone merges."""
        word = raw[1:] if raw[:1] == b" " else raw
        if word.isalpha():  # ASCII letters
            return self.merged(word.decode() if word is raw else self.space + word.decode())
        found = _WORD_AND_POINTS.fullmatch(raw.decode("utf-8", "surrogatepass"))
        if found is None:
            return self.whole(raw.decode("utf-8", "surrogatepass"))
        ids = self.merged(found[1].encode().decode("latin-1").translate(self.letters))
        if not found[2]:
            return ids
        if found[2] not in self.points:
            self.points[found[2]] = self.whole(found[2])
        return ids + self.points[found[2]]

    def merged(self, spelled: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(spelled)], self.type).tobytes() if self.swapped else \
            array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def simple(self, text: str) -> bool:
        """All white space is ASCII, and no added token occurs."""
        return not (WIDE_SPACE.search(text) or any(map(text.__contains__, self.added)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.by_piece and self.simple(text):
                group.append((i, text.encode()))
                size += len(group[-1][1])
                if size > 1 << 20:
                    self._encode(group, out)
                    group, size = [], 0
            else:
                out[i] = self.whole(text)
        if group:
            self._encode(group, out)
        return out

    def _encode(self, group: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Look up all pieces of some texts at once, after learning the new ones."""
        raw = b"".join([t for _, t in group])
        ends = np.cumsum([len(t) for _, t in group])
        data = np.frombuffer(raw, np.uint8)
        blank = ~WORD_BYTES[data]
        run = blank.copy()  # first of a run of white space: the pre-tokenizer always cuts before it
        run[1:] &= ~blank[:-1]
        alone = run.copy()
        alone[:-1] &= ~blank[1:]
        alone &= data != 32  # a single one but a space is a token of its own
        start = run
        start[1:] |= alone[:-1] | (POINT[data[1:]] & ASCII_LETTER[data[:-1]])
        start[0] = True
        start[ends[:-1]] = True
        first = np.flatnonzero(start)
        lengths = np.diff(np.append(first, len(data)))
        longest = int(lengths.max())
        powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _BASE))
        hashes = np.add.reduceat(_OF_BYTE[data] * powers[np.arange(len(data)) - np.repeat(first, lengths)], first)
        hashes = mixed(hashes + lengths.astype(np.uint64)) | np.uint64(1)  # never zero, the mark of a free slot
        slots = self.table.slots_of(hashes)
        new = np.flatnonzero(self.table.keys[slots] == 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            spots = first[new[where]]
            before = self.table.count
            self.table.put(distinct, [self.piece(raw[a:b]) for a, b in zip(spots.tolist(), (spots + lengths[new[where]]).tolist())])
            if self.table.count != before + len(distinct):  # the table was emptied: learn this group's other pieces again
                distinct, where = np.unique(hashes, return_index=True)
                lost = self.table.keys[self.table.slots_of(distinct)] == 0
                spots = first[where[lost]]
                self.table.put(distinct[lost], [self.piece(raw[a:b]) for a, b in zip(spots.tolist(), (spots + lengths[where[lost]]).tolist())])
            slots = self.table.slots_of(hashes)
        sizes = self.table.sizes[slots].astype(np.int64)
        stops = np.cumsum(sizes)
        ids = self.table.ids[np.repeat(self.table.at[slots] - (stops - sizes), sizes) + np.arange(int(stops[-1]))].tobytes()
        width = self.table.ids.itemsize
        edges = (stops[np.searchsorted(first, ends, side="left") - 1] * width).tolist()
        at = 0
        for (i, _), end in zip(group, edges):
            out[i], at = ids[at:end], end


def load_tokenizer(path: str) -> tuple[str, int]:
    """The vocabulary file's text and the bytes that its largest id needs (2 or 4). Read on the driver, shipped with the tasks."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    size = Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True)
    return text, 2 if size <= 1 << 16 else 4
