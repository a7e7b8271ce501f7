"""Vector code compression: product codes with memoised grid cells.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Each part's position has a
codebook; a vector's code is the place of the nearest entry (squared Euclidean distance, ties to the lower
place) for each part. Codebooks start as the parts of the first vectors by id and are moved, a round of one
job each, to the floor of their parts' mean; an entry without parts stays. A round sends one line per entry
and component from each task, whatever the rows; the codebooks are parts x entries x components integers.

Nearest entries. A part lies in a coarse cell of a grid. Across the cell's box an entry has a least and a
greatest distance; it is dominated if its least is above another's greatest, and can't be nearest to any part in
the box. What is left is kept by the cell, in a table of bounded size (full: it starts again), and only those entries
are evaluated, exactly, for every further part of the cell. The cell's width changes the work, never a code.

Defined cases: vectors that are null or hold null or non-finite components are dropped; shorter ones count as
continued by zeros, up to a length that the parts divide; fewer rows than entries give smaller codebooks; rows
of equal id are ordered by vector when codebooks start, null ids last; repeated rows are coded alike; an empty table gives an
empty result and no entries. Components beyond 2^27 after scaling raise ValueError, as distances would not be
exact. Other columns stay; names that begin with `__vc_` are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, ShortType, StructType

from .common import shared_table

LARGEST = 1 << 27
#: Cells whose entries a task remembers for each position.
TABLE_CELLS = 200_000
#: Rows of a batch whose parts are looked up at once.
SLICE = 2048


class CellTable:
    """Nearest entries of one position, by cells of `width` units."""

    def __init__(self, entries: np.ndarray, width: int, cells: int = TABLE_CELLS):
        self.entries, self.width, self.cells = entries, width, cells
        self.evaluated = 0
        self._clear()

    def _clear(self):
        self.known, self.flat, self.starts = {}, np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _add(self, cells: np.ndarray, keys: list[bytes]) -> None:
        """Keep the entries that are not dominated across each cell's box."""
        low = cells[:, None, :] * self.width
        high = low + (self.width - 1)
        e = self.entries[None]
        least = np.maximum(np.maximum(low - e, e - high), 0)
        most = np.maximum(np.abs(e - low), np.abs(high - e))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        stays = least <= most.min(axis=1, keepdims=True)
        first = len(self.starts) - 1
        self.known.update(zip(keys, range(first, first + len(keys))))
        self.flat = np.concatenate((self.flat, np.nonzero(stays)[1]))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(stays.sum(axis=1))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, squared distance) of each row's nearest entry."""
        if not len(x) or not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        cells = np.ascontiguousarray(x // self.width)
        keys = cells.view(f"V{cells.itemsize * cells.shape[1]}").ravel().tolist()
        new = {k: i for i, k in enumerate(keys) if k not in self.known}
        if len(self.known) + len(new) > self.cells:
            self._clear()
            new = {k: i for i, k in enumerate(keys)}
        if new:
            self._add(cells[list(new.values())], list(new))
        row = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        size = self.starts[row + 1] - self.starts[row]
        at = np.cumsum(size) - size
        entry = self.flat[np.arange(size.sum()) + np.repeat(self.starts[row] - at, size)]
        apart = np.repeat(x, size, axis=0) - self.entries[entry]
        # the smaller place wins among equal distances
        best = np.minimum.reduceat((apart * apart).sum(axis=1) * len(self.entries) + entry, at)
        self.evaluated += len(entry)
        return best % len(self.entries), best // len(self.entries)


def cell_width(codebook: np.ndarray) -> int:
    """About the spread of a codebook's components."""
    return max(1, int(np.abs(codebook - codebook.mean(axis=0)).mean())) if codebook.size else 1


def tables(codebooks: np.ndarray) -> list[CellTable]:
    return [CellTable(c, cell_width(c)) for c in codebooks]


def _parts(column: pa.Array, parts: int, dim: int) -> np.ndarray:
    """(rows, parts, components) of a column of lists of `dim` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, dim // parts)


def _sums(vectors: DataFrame, codebooks: np.ndarray, dim: int) -> np.ndarray:
    """Sums of the parts nearest to each entry, their number in the last column."""
    def run(batches):
        found, out = tables(codebooks), np.zeros((*codebooks.shape[:2], codebooks.shape[2] + 1), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                x = _parts(b.column(0).slice(at, SLICE), len(codebooks), dim)
                for p, table in enumerate(found):
                    place, _ = table.nearest(x[:, p])
                    np.add.at(out[p], place, np.column_stack((x[:, p], np.ones(len(x), np.int64))))
        part, entry, component = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, entry, component, out[part, entry, component])], ["part", "entry", "component", "sum"])

    sums = vectors.mapInArrow(run, "part long, entry long, component long, sum long").groupBy("part", "entry", "component").agg(F.sum("sum").alias("sum"))
    out = np.zeros((*codebooks.shape[:2], codebooks.shape[2] + 1), np.int64)
    for r in sums.collect():
        out[r.part, r.entry, r.component] = r["sum"]
    return out


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(`df` with `__vc_code` (a place for each part) and `__vc_error` (squared distances, summed), codebooks).

    Codebooks are integers (parts, entries, components)."""
    v = F.col(vec_col)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = shared_table(df.filter(fine).withColumn("__vc_vec", whole), "codes-rows")
    longest, largest = rows.agg(F.max(F.size("__vc_vec")), F.max(F.array_max(F.transform("__vc_vec", lambda x: F.greatest(x, -x))))).first()
    if (largest or 0) > LARGEST:
        raise ValueError(f"component {largest} after scaling: distances would not be exact")
    dim = -(-(longest or 0) // parts) * parts
    rows = rows.withColumn("__vc_vec", F.concat("__vc_vec", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("__vc_vec"))))
    first = rows.select(F.col(id_col).alias("id"), F.col("__vc_vec").alias("vec")).orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    codebooks = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        total = _sums(rows.select("__vc_vec"), codebooks, dim)
        n = total[:, :, -1:]
        codebooks = np.where(n > 0, total[:, :, :-1] // np.maximum(n, 1), codebooks)
    schema = StructType([f for f in rows.schema.fields if f.name != "__vc_vec"]).add("__vc_code", ArrayType(ShortType())).add("__vc_error", LongType())
    at, names = rows.columns.index("__vc_vec"), schema.names

    def run(batches):
        found = tables(codebooks)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                x = _parts(b.column(at), parts, dim)
                near = [t.nearest(x[:, p]) for p, t in enumerate(found)]
                code = np.stack([place for place, _ in near], axis=1).astype(np.int16)
                lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, parts, dtype=np.int32), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [lists, pa.array(sum(d for _, d in near))], names)

    return rows.mapInArrow(run, schema), codebooks


def decode(code: list[int], codebooks: np.ndarray) -> list[int]:
    """The integer vector that a code stands for."""
    return np.concatenate([codebooks[p, c] for p, c in enumerate(code)]).tolist()


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """`coded` with `__vc_label_error`, the errors summed over equal labels, nulls together."""
    coded = shared_table(coded, "codes-coded")
    sums = shared_table(coded.groupBy(F.col(label_col).alias("__vc_label")).agg(F.sum("__vc_error").alias("__vc_label_error")), "codes-labels")
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("__vc_label"))).drop("__vc_label")
