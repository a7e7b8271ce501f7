"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints have 64 bits, a majority vote of the hashes of a text's word shingles. Fingerprints link if they
differ in at most `radius` bits; documents of linked fingerprints make up components.

Search. Bits are put into m partitions, correlated ones together. Partition i gets a threshold T_i >= -1 with
sum T_i = radius - m + 1: two fingerprints within `radius` bits then agree up to T_i bits in some partition
(else they would differ in radius + 1). The thresholds, and m, are those of least cost: rows probed plus
candidates verified, estimated from histograms of all fingerprints (of 8 correlated bits each, combined as if
independent) and allotted by dynamic programming. A threshold of -1 leaves a partition out; with T_i > 0 a
fingerprint probes the values of its partition with any T_i bits left open. Fingerprints that meet in a bucket
are verified by their distance.

Hot buckets. Only distinct fingerprints are dealt, so copies never meet; buckets of more than `bucket` of them
are dealt again, by the same principle on the bits their key leaves open, until they are small. This ends, as
r open bits hold 2^r fingerprints at most. Within a bucket the links are reduced to a spanning forest, so no
bucket emits all its pairs, and none is cut.

Defined cases: a text without words (null, empty) has fingerprint zero and links like any other; repeated rows
are documents of their own; a null doc_id takes part, and is the smallest of its component only if all are
null; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_table
from .components import components

BITS = 64
ATOM = 8
#: Cost of a verified candidate against that of a probed row, which is shuffled and sorted.
VERIFY_COST = 0.01
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- fingerprints
def fingerprint(data: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text."""
    import xxhash
    words = data.translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


# ---------------------------------------------------------------- partitions and thresholds
def _sums(df: DataFrame, name: str, count) -> np.ndarray:
    """Sum over all tasks of a fixed-size table of counts made from fingerprints by `count`."""
    def run(batches):
        total = None
        for b in batches:
            x = count(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = x if total is None else total + x
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], ["cell", "n"])

    rows = df.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max(len(rows), 1), np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(x: np.ndarray) -> np.ndarray:
    out = np.zeros((BITS, BITS), np.int64)
    for at in range(0, len(x), 1 << 14):
        b = _bits(x[at:at + (1 << 14)]).astype(np.float32)
        out += (b.T @ b).astype(np.int64)
    return out


def correlated_atoms(together: np.ndarray, n: int) -> list[list[int]]:
    """The 64 bits in groups of 8, each grown from the most correlated bit left."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(phi, 0)
    left, atoms = set(range(BITS)), []
    while left:
        rest = sorted(left)
        atom = [max(rest, key=lambda i: phi[i, rest].sum())]
        while len(atom) < ATOM:
            atom.append(max(left - set(atom), key=lambda i: (phi[i, atom].sum(), -i)))
        left -= set(atom)
        atoms.append(atom)
    return atoms


def distance_laws(histograms: np.ndarray, radius: int) -> np.ndarray:
    """For each atom, the share of pairs of fingerprints that differ in d of its bits, d to `radius`."""
    v = np.arange(1 << ATOM)
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    p = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    return np.array([[(q[:, None] * q[None, :])[d == k].sum() for k in range(radius + 1)] for q in p])


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with the given sum and the least cost; costs[i][t + 1] is that of threshold t in partition i."""
    best = {0: (0.0, [])}
    for c in costs:
        nxt = {}
        for s, (cost, ts) in best.items():
            for k, x in enumerate(c):
                if s + k - 1 not in nxt or nxt[s + k - 1][0] > cost + x:
                    nxt[s + k - 1] = (cost + x, [*ts, k - 1])
        best = nxt
    return best[total]


def plan_masks(fps: DataFrame, n: int, radius: int) -> tuple[list[int], list[int]]:
    """(masks, order). Two fingerprints within `radius` bits agree on all bits of one of the masks; `order`
    lists the bits, correlated ones side by side."""
    atoms = correlated_atoms(_sums(fps, "pairs", _together).reshape(BITS, BITS) if n else np.zeros((BITS, BITS)), n)
    places = [np.array(a) for a in atoms]

    def histogram(x):
        b = _bits(x)
        return np.array([np.bincount(np.packbits(b[:, p], axis=1, bitorder="little").ravel(), minlength=1 << ATOM) for p in places])

    laws = distance_laws(_sums(fps, "atoms", histogram).reshape(len(atoms), -1) if n else np.ones((len(atoms), 1 << ATOM)), radius)
    found = None
    for m in range(max(2, radius), min(len(atoms), radius + 3) + 1):
        groups = [list(g) for g in np.array_split(np.arange(len(atoms)), m)]
        costs = []
        for g in groups:
            law = np.array([1.0] + [0.0] * radius)
            for a in g:
                law = np.array([sum(law[j] * laws[a][d - j] for j in range(d + 1)) for d in range(radius + 1)])
            width, near = ATOM * len(g), np.cumsum(law)
            costs.append([0.0] + [n * math.comb(width, t) + VERIFY_COST * n * n / 2 * near[t] for t in range(radius + 1)])
        cost, thresholds = allot(costs, radius - m + 1)
        if found is None or cost < found[0]:
            found = cost, thresholds, [[b for a in g for b in atoms[a]] for g in groups]
    _, thresholds, parts = found
    masks = [sum(1 << b for b in part) & ~sum(1 << b for b in gone) for part, t in zip(parts, thresholds) if t >= 0 for gone in itertools.combinations(part, t)]
    return masks, [b for part in parts for b in part]


def finer(mask: int, order: list[int], radius: int) -> list[int]:
    """Masks for a hot bucket: its own bits with one of radius + 1 parts of the bits left open. Neighbours in
    `order` go to different parts, so that each part tells fingerprints apart."""
    left = [b for b in order if not mask >> b & 1]
    return [mask | sum(1 << b for b in left[k::radius + 1]) for k in range(radius + 1)]


# ---------------------------------------------------------------- links
def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted rows, as a spanning forest of each bucket of over 16 rows."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [n])))
    of = np.cumsum(new) - 1
    a, b = [], []
    small = size[of] <= 16
    for lag in range(1, 16):
        i = np.flatnonzero(small[:-lag] & (of[:-lag] == of[lag:]))
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= radius]
        a.append(fp[i])
        b.append(fp[i + lag])
    for s, m in zip(start[size > 16], size[size > 16]):
        x = fp[s:s + m]
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        label = np.arange(m)
        while True:
            nxt = np.where(near, label[None, :], m).min(axis=1)
            nxt = nxt[nxt]
            if (nxt == label).all():
                break
            label = nxt
        i = np.flatnonzero(label != np.arange(m))
        a.append(x[i])
        b.append(x[label[i]])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, n: int, radius: int, bucket: int = 512) -> DataFrame:
    """(a, b): links between distinct fingerprints `fps` (fp) that join all within `radius` bits, transitively."""
    spark = fps.sparkSession
    masks, order = plan_masks(fps, n, radius)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    out = None
    while True:
        keyed = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = shared_table(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        met = shared_table(keyed.join(sizes, ["mask", "key"]), "simhash-met")
        found = shared_table(_verify(met.filter(F.col("n") <= bucket), radius), "simhash-links")
        out = found if out is None else out.unionByName(found)
        hot = met.filter(F.col("n") > bucket).select("fp", "mask")
        masks = [m & (1 << 64) - 1 for (m,) in hot.select("mask").distinct().collect()]  # as many as masks at most
        if not masks:
            return out
        table = spark.createDataFrame([(_signed(m), _signed(f)) for m in masks for f in finer(m, order, radius)], "mask long, fine long")
        rows = hot.join(F.broadcast(table), "mask").select("fp", F.col("fine").alias("mask")).distinct()


def _verify(met: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            # the last bucket may go on in the next batch
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            held = [x[last] for x in cols]
            yield from emit([x[~last] for x in cols])
        if held is not None:
            yield from emit(held)

    def emit(cols):
        a, b = bucket_links(*cols, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = met.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- documents
def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, shingle: int = 3, radius: int = 2, bucket: int = 512) -> DataFrame:
    """(id, row, fp, component_id, first_row, class_size), one row per row of `df`.

    row is `row_col`, or a number given here; first_row is the row that stands first in the component (by id,
    nulls last, then by row), component_id its id; class_size counts the rows with the same fingerprint."""
    kind = df.schema[id_col].dataType.simpleString()
    keyed = df.select(F.struct(F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")).alias("k"), text_col)
    docs = shared_table(fingerprints(keyed, "k", text_col, shingle).select("id.id", "id.row", "fp"), "simhash-docs")
    first = F.min(F.struct(F.isnull("id").alias("gone"), "id", "row"))
    classes = shared_table(docs.groupBy("fp").agg(first.alias("first"), F.count("*").alias("class_size")), "simhash-classes")
    fps = classes.select("fp")
    nodes = components(links(fps, classes.count(), radius, bucket))
    rooted = shared_table(classes.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "first", "class_size", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    heads = shared_table(rooted.groupBy("root").agg(F.min("first").alias("head")), "simhash-heads")
    named = shared_table(rooted.join(heads, "root").select("fp", "class_size", F.col("head.id").alias("component_id"), F.col("head.row").alias("first_row")), "simhash-named")
    return docs.join(named, "fp").select(F.col("id").cast(kind).alias("id"), "row", "fp", "component_id", "first_row", "class_size")


def keep_first(df: DataFrame, **options) -> DataFrame:
    """`df` with one document of each component."""
    row = "__simhash_row"
    table = shared_table(df.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    keep = shared_table(near_duplicates(table, row_col=row, **options).filter("row = first_row").select(F.col("row").alias(row)), "simhash-keep")
    return table.join(keep.hint("shuffle_hash"), row, "left_semi").select(*df.columns)
