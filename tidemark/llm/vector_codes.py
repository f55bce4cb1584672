"""Vector codes: each part of a vector becomes the index of the nearest of 256 learned entries, in integers throughout.

1. A component x becomes floor(1024 * x). A vector is cut into equal parts, each with a
   codebook of its own, which starts as that part of the vectors with the lowest ids.
2. A round gives every part its nearest entry and moves each entry to the floored mean of
   its parts. A task sends one sum per entry and position, never a row per vector; only
   the codebooks, whose size is fixed, reach the driver.
3. To find the nearest entry, a part is first put into its cell of a coarse grid. For a
   cell the least and greatest possible distance to each entry are known. An entry whose
   least distance exceeds another one's greatest is dominated: it is nearest to no point
   of the cell. The entries left are remembered per cell, and only those are evaluated
   exactly for the parts that fall into it. The cells' width is a power of two
   taken from the spread of the codebook, so it follows the data's scale. Cells are known
   by a 64-bit hash and compared in full; the memory is emptied when full.

Nothing is rounded: sums are added as limbs in decimals, and tasks that meet components of
2^28 or more evaluate all entries in Python integers. The input is read once per round and
twice besides, so settle it first when it is dear to compute.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import mixed
from tidemark.plans.sizing import broadcast_if_small
from tidemark.session import settle

ENTRIES = 256
PARTS = 4
ROUNDS = 4
SCALE = 1024
#: Cells that a task remembers for each part.
CELLS = 50_000
#: Distances evaluated at once.
BLOCK = 1 << 16
#: Components below this are handled in 64-bit integers: their squared distances fit.
NARROW = 1 << 28
LIMB = 48
LIMBS = 4
ROWS = 4096


def usable(vector: str) -> F.Column:
    """True for vectors without null or non-finite components; what a float can't hold counts as not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38))
    return F.col(vector).isNotNull() & ~bad


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where those are too narrow."""
    floors = np.floor(values.astype(np.float64) * scale)
    if not floors.size or np.abs(floors).max() < NARROW:
        return floors.astype(np.int64)
    out = np.empty(floors.shape, object)
    out.ravel()[:] = [int(x) for x in floors.ravel().tolist()]
    return out


def part_edges(dims: int, parts: int) -> list[int]:
    return [dims * p // parts for p in range(parts + 1)]


def distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry."""
    return ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


class CellCache:
    """Nearest entries of one codebook, through the undominated entries of each grid cell."""

    def __init__(self, book: np.ndarray, cells: int = CELLS):
        self.book, self.most = book, cells
        self.narrow = book.dtype != object
        if self.narrow:
            spread = float(book.std(axis=0).mean()) if book.size else 0.0
            self.shift = max(0, int(np.log2(max(1.0, spread / 4))))
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.cells: list[np.ndarray] = []
        self.left: list[np.ndarray] = []

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries that are nearest to some point of it, ascending; a tie at the bound keeps both."""
        out = []
        step = max(1, BLOCK // max(1, len(self.book)))
        for start in range(0, len(cells), step):
            some = cells[start:start + step]
            least = np.zeros((len(some), len(self.book)), np.int64)
            greatest = least.copy()
            for j in range(some.shape[1]):
                # Distances along one axis depend on one coordinate, of which there are few.
                at, which = np.unique(some[:, j], return_inverse=True)
                low = (at << self.shift)[:, None]
                below, above = low - self.book[None, :, j], self.book[None, :, j] - (low + ((1 << self.shift) - 1))
                least += (np.maximum(np.maximum(below, above), 0) ** 2)[which]
                greatest += (np.maximum(np.abs(above), np.abs(below)) ** 2)[which]
            keep = least <= greatest.min(axis=1)[:, None]
            sizes, entry = keep.sum(axis=1), np.nonzero(keep)[1]
            out += np.split(entry, np.cumsum(sizes)[:-1])
        return out

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; ties go to the lower index."""
        if rows.dtype == object or not self.narrow or not rows.shape[1]:
            return self.direct(rows)
        cells = rows >> self.shift
        keys = np.zeros(len(rows), np.uint64)
        for j in range(cells.shape[1]):
            keys = mixed(keys * np.uint64(31) + cells[:, j].astype(np.uint64))
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.cells) + len(distinct) > self.most:
            self.clear()
        new = [i for i, k in enumerate(distinct.tolist()) if k not in self.place]
        if new:
            found = cells[where[new]]
            for i, cell, left in zip(new, found, self.undominated(found)):
                self.place[int(distinct[i])] = len(self.cells)
                self.cells.append(cell)
                self.left.append(left)
        at = np.array([self.place[k] for k in distinct.tolist()])
        index, best = self.evaluate(rows, [self.left[i] for i in at.tolist()], which)
        # Another cell with the same hash: evaluate its rows against all entries.
        strange = np.flatnonzero((np.stack([self.cells[i] for i in at.tolist()])[which] != cells).any(axis=1))
        if len(strange):
            index[strange], best[strange] = self.direct(rows[strange])
        return index, best

    def evaluate(self, rows: np.ndarray, lists: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists])
        flat, begin = np.concatenate(lists), np.cumsum(sizes) - sizes
        index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        ends = np.cumsum(sizes[which])
        start = 0
        while start < len(rows):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
            n = sizes[which[start:stop]]
            first = np.cumsum(n) - n
            owner = np.repeat(np.arange(stop - start), n)
            entry = flat[np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(begin[which[start:stop]], n)]
            away = ((rows[start:stop][owner] - self.book[entry]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(away, first)
            hits = np.flatnonzero(away == least[owner])
            best[start:stop] = least
            index[start:stop] = entry[hits[np.searchsorted(owner[hits], np.arange(stop - start))]]
            start = stop
        return index, best

    def direct(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Against all entries, in Python integers where 64 bits are too few."""
        wide = rows.dtype == object or not self.narrow
        index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), object if wide else np.int64)
        book = self.book.astype(object) if wide else self.book
        for start in range(0, len(rows), 64):
            away = distances(rows[start:start + 64].astype(object) if wide else rows[start:start + 64], book)
            if not rows.shape[1]:
                away = np.zeros((len(away), len(book)), np.int64)
            at = np.array([min(range(len(a)), key=a.__getitem__) for a in away.tolist()]) if wide else away.argmin(axis=1)
            index[start:start + 64] = at
            best[start:start + 64] = away[np.arange(len(away)), at]
        return index, best


def _vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the rows with ``dims`` components, their integers)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
    return fits.to_numpy(zero_copy_only=False), scaled(flat.reshape(-1, dims) if dims else np.zeros((pc.sum(fits).as_py() or 0, 0)), scale)


def _slices(batches, rows: int = ROWS):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


MOVED = "part int, entry int, pos int, n bigint, " + ", ".join(f"l{i} bigint" for i in range(LIMBS))


def _sums(books: list[np.ndarray], dims: int, scale: int):
    """Map that gives (part, entry, pos, rows, sum in limbs) for the entries that a task used."""
    edges = part_edges(dims, len(books))
    mask = (1 << LIMB) - 1

    def run(batches):
        caches = [CellCache(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for batch in _slices(batches):
            _, rows = _vectors(batch.column(0), dims, scale)
            for p, cache in enumerate(caches):
                part = rows[:, edges[p]:edges[p + 1]]
                if not len(part):
                    continue
                index, _ = cache.nearest(part)
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                counts[p][used] += np.diff(np.append(first, len(order)))
                sums[p][used] += np.add.reduceat(part[order], first, axis=0).astype(object)
        for p, (n, total) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(n)
            width = total.shape[1]
            values = [int(x) for x in total[used].ravel()]
            limbs = [[(v >> (LIMB * i)) & mask if i < LIMBS - 1 else v >> (LIMB * i) for v in values] for i in range(LIMBS)]
            columns = [np.full(len(values), p, np.int32), np.repeat(used, width).astype(np.int32),
                       np.tile(np.arange(width, dtype=np.int32), len(used)), np.repeat(n[used], width)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x, pa.int64()) for x in limbs)],
                                             names=["part", "entry", "pos", "n", *(f"l{i}" for i in range(LIMBS))])

    return run


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    wide = any(abs(x) >= NARROW for r in rows for x in r)
    out = np.empty((len(rows), width), object if wide else np.int64)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def _coded(books: list[np.ndarray], dims: int, scale: int):
    edges = part_edges(dims, len(books))

    def run(batches):
        caches = [CellCache(b) for b in books]
        for batch in _slices(batches):
            fits, rows = _vectors(batch.column(2), dims, scale)
            found = [c.nearest(rows[:, edges[p]:edges[p + 1]]) for p, c in enumerate(caches)] if len(rows) else []
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for i, row in enumerate(np.flatnonzero(fits).tolist()):
                codes[row] = "".join(f"{int(index[i]):02x}" for index, _ in found)
                error = sum(int(best[i]) for _, best in found)
                errors[row] = error if error < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             names=["id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, parts: int = PARTS,
              rounds: int = ROUNDS, scale: int = SCALE) -> tuple[int, list[np.ndarray]]:
    """(dimensions, one array of entries per part), fitted on all usable vectors.

    The start is the first ``entries`` vectors by id, nulls last, equal ids by vector; the
    first of them sets the number of dimensions, and vectors of another length take no
    part. Fewer vectors give fewer entries; none gives no codebook.
    """
    kept = vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    if first is None:
        return 0, [np.zeros((0, 0), np.int64)] * parts
    dims = first.n
    same = kept.filter(F.size("vector") == dims)
    start = [r.vector for r in same.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    edges = part_edges(dims, parts)
    whole = [[int(v) for v in scaled(np.array(x, np.float64), scale).tolist()] for x in start]
    books = [_book([r[a:b] for r in whole], b - a) for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        sums = same.select("vector").mapInArrow(_sums(books, dims, scale), MOVED).groupBy("part", "entry", "pos").agg(
            F.sum(F.col("n").cast("decimal(20,0)")).alias("n"), *(F.sum(F.col(f"l{i}").cast("decimal(20,0)")).alias(f"l{i}") for i in range(LIMBS)))
        lists = [b.tolist() for b in books]
        for r in sums.collect():  # at most entries x dims rows
            lists[r.part][r.entry][r.pos] = sum(int(r[f"l{i}"]) << (LIMB * i) for i in range(LIMBS)) // int(r.n)
        books = [_book(x, b - a) for x, a, b in zip(lists, edges, edges[1:])]
    return dims, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES,
             parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256), one row per usable row of ``vectors``.

    Rows whose vector is null or holds a null or non-finite component are dropped. ``code``
    has two hex digits per part, ``error`` is the squared distance to the coded vector in
    scaled units and ``label_error`` its sum over rows of one label, null labels together.
    Vectors of another length than the first one's stay with null code and error; an error
    or sum that a long can't hold is null. Repeated rows and ids are coded each; null ids
    stay. A length that the parts don't divide is cut at dims * p // parts. Empty input
    gives no rows.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must be 1 to 256, parts at least 1")
    dims, books = codebooks(vectors, id_col, vector_col, entries, parts, rounds, scale)
    rows = vectors.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = settle(rows.mapInArrow(_coded(books, dims, scale), schema), "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"),
                                                          F.count_if(F.col("code").isNotNull() & F.col("error").isNull()).alias("beyond"))
    total = total.select("of", F.expr("CASE WHEN beyond = 0 AND total <= 9223372036854775807 THEN CAST(total AS BIGINT) END").alias("label_error"))
    return coded.join(broadcast_if_small(total), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
