"""Best-fit packing of token sequences with swap-based local search.

Documents become token ids with an end id; ids beyond the capacity are cut into full pieces and a rest. A full
piece is a sequence. The rests are dealt by a uniform hash into blocks of about `block` pieces, each packed by
one task: best fit decreasing first, then exchanges between underfull bins. The emptiest bin gives to others:
it moves a piece, swaps one of its pieces for a shorter one, or swaps two for one, always by the exchange that
raises the sum of squared fills most; an emptied bin is gone. It ends when a pass over all bins finds no exchange or
when the room left in the block would not hold another bin. More rows make more blocks, not larger ones.

Tokens. The default tokenizer lower-cases, drops white space and merges within words, numerals and runs of
marks only. Texts of ASCII and Latin letters are split so, and each distinct run is encoded once for a task,
up to a table of bounded size; other texts, other tokenizers and texts that may hold special tokens are
encoded whole. The ids are the same (held against the tokenizer in the tests).

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; ties in length are
ordered by row; an empty table gives an empty result. Extra columns are not read, and `pack` keeps them;
names that begin with `__pack_` are reserved.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shared_table

#: Entries of a worker's table of encoded runs; it starts again when full.
TABLE_ENTRIES = 1_000_000
#: The default tokenizer's split, on lower-cased texts without `_ODD` characters. All letters
#: outside ASCII that are left lie in Latin-1 and Latin Extended-A, and each lower-cases to one of them.
_LATIN = "a-zß-öø-ſ"
_RUN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ \t-\r{_LATIN}0-9]+")
_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-įı-ſ]")


def vocabulary() -> str:
    """The default tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path), {}


def encode(texts: list[str], path: str | None = None) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, without special tokens added; `path` None is
    the default tokenizer."""
    tokenizer, table = _tokenizer(path or vocabulary())
    as_bytes = lambda e: np.array(e.ids, dtype="<u4").tobytes()
    if path:
        return [as_bytes(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    odd = lambda t: "<|" in t or not t.isascii() and _ODD.search(t)
    runs = [None if odd(t) else _RUN.findall(t.lower()) for t in texts]
    new = set().union(*(r for r in runs if r)).difference(table)
    if new:
        if len(table) + len(new) > TABLE_ENTRIES:
            table.clear()
            new = set().union(*(r for r in runs if r))
        new = list(new)
        found = tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        data, of = as_bytes(found), np.array(found.word_ids)
        ends = (np.searchsorted(of, np.arange(len(new)), side="right") * 4).tolist()
        table.update(zip(new, map(data.__getitem__, map(slice, [0, *ends], ends))))
    return [as_bytes(tokenizer.encode(t, add_special_tokens=False)) if r is None else b"".join(map(table.__getitem__, r)) for t, r in zip(texts, runs)]


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str | None = None, end_id: int = 0, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each document, with the ids themselves if asked."""
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows = []
                for k, data in enumerate(encode([x or "" for x in b.column(1).to_pylist()], path)):
                    data += end
                    for piece, lo in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[lo:lo + 4 * capacity]
                        rows.append((k, piece, lo // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype(np.int32) if ids else None))
                k, *cols = zip(*rows)
                arrays = [b.column(0).take(pa.array(k)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(list(cols[4]), pa.list_(pa.int32()))] if ids else []), names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


# ---------------------------------------------------------------- one block
def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: the fullest that has room, longest pieces first."""
    bins, rooms, left, open_rooms = np.empty(len(lengths), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b, left = capacity, left, left + 1
        bins[i] = b
        if room > n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


def exchange(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from a packing; bins that end up empty have no piece."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    stuck, changed = fill >= capacity, False
    none = np.int64(-1)
    while True:
        live = (fill > 0) & (fill < capacity)
        if changed and not (live & ~stuck).any():
            # bins without an exchange may have one since others changed: once more over all of them
            stuck, changed = fill >= capacity, False
        if (capacity - fill[live]).sum() < capacity or not (live & ~stuck).any():
            return bins
        giver = int(np.argmin(np.where(live & ~stuck, fill, capacity + 1)))
        others = np.flatnonzero(live & (np.arange(len(fill)) != giver))
        pieces = np.flatnonzero(live[bins] & (bins != giver))
        m, at = lengths[pieces], bins[pieces]
        room, height = capacity - fill[at], fill[at]
        while fill[giver]:
            own = np.flatnonzero(bins == giver)
            best = (0, None, None, None)
            give = [(int(lengths[i]), (i,)) for i in own]
            # one piece of each length, and one pair of each sum: a pair has two pieces of a length at most
            give = list({n: g for n, g in give}.items())
            two = [i for _, group in itertools.groupby(own[np.argsort(lengths[own], kind="stable")].tolist(), lambda i: lengths[i]) for i in itertools.islice(group, 2)]
            pairs = {int(lengths[i] + lengths[j]): (i, j) for i, j in itertools.combinations(two, 2)}
            for n, g in give:  # move
                ok = capacity - fill[others] >= n
                gain = np.where(ok, n * (fill[others] - fill[giver] + n), 0)
                if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                    best = (int(gain[k]), g, none, int(others[k]))
            for n, g in [*give, *pairs.items()]:  # one for one, two for one
                more = n - m
                gain = np.where((more > 0) & (more <= room), more * (height - fill[giver] + more), 0)
                if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                    best = (int(gain[k]), g, int(k), int(at[k]))
            if best[1] is None:
                stuck[giver] = True
                break
            _, gone, k, to = best
            changed = True
            more = int(lengths[list(gone)].sum()) - (0 if k < 0 else int(m[k]))
            bins[list(gone)] = to
            fill[to] += more
            fill[giver] -= more
            if k >= 0:
                bins[pieces[k]] = giver
                # the first piece given stands in its place; a second, or a moved one, is added
                pieces[k], m[k], gone = gone[0], lengths[gone[0]], gone[1:]
            if len(gone):
                pieces, m, at = np.append(pieces, gone), np.append(m, lengths[list(gone)]), np.append(at, [to] * len(gone))
            stuck[to] = fill[to] >= capacity
            room, height = capacity - fill[at], fill[at]


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece of a block."""
    bins = exchange(lengths, best_fit(lengths, capacity), capacity)
    order = np.lexsort((-lengths, bins))
    ends = np.cumsum(lengths[order])
    first = np.concatenate(([True], bins[order][1:] != bins[order][:-1])) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0)) if len(order) else ends
    offset = np.empty(len(lengths), np.int64)
    offset[order] = ends - lengths[order] - base
    return bins, offset


# ---------------------------------------------------------------- all rows
def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", block: int = 8192) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; lengths from 1 to `capacity`. Lengths alone go to the packing
    tasks; what else a piece holds, such as its ids, is moved once, by row."""
    row = "__pack_row"
    table = shared_table(pieces.withColumn(row, F.monotonically_increasing_id()), "pack-pieces")
    rest = table.filter(F.col(length_col) < capacity).select(row, F.col(length_col).cast("long").alias("length"))
    blocks = max(1, -(-rest.count() // block))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(row, ignore_index=True)
        bins, offset = pack_block(group["length"].to_numpy(np.int64), capacity)
        # the first piece's row names a sequence
        return pd.DataFrame({row: group[row], "sequence_id": group.groupby(bins)[row].transform("min"), "offset": offset})

    packed = rest.withColumn("__pack_block", F.pmod(F.xxhash64(row), F.lit(blocks))).groupBy("__pack_block").applyInPandas(run, f"{row} long, sequence_id long, offset long")
    packed = shared_table(packed, "pack-places").withColumnRenamed(row, "__pack_of")
    out = table.join(packed.hint("shuffle_hash"), F.col(row) == F.col("__pack_of"), "left")
    # a full piece is a sequence
    full = {"sequence_id": F.coalesce("sequence_id", row), "offset": F.coalesce("offset", F.lit(0).cast("long"))}
    return out.withColumns(full).drop(row, "__pack_of")
