"""Language-model scores by deleted interpolation.

A word's probability after its predecessor v mixes three maximum-likelihood estimates: the bigram's
c(v w) / c(v), the word's c(w) / N, and 1 / (V + 1) for any word, one of them unseen. The three weights depend on
how often v was seen (a bucket for each power of two) and are learned by expectation-maximisation on held-out
counts: every training token is held out in turn, i.e. its estimates are (c(v w) - 1) / (c(v) - 1) and
(c(w) - 1) / (N - 1). A text ends with an end token, which is also what comes before its first word.

Counting at scale. Texts are encoded in chunks of about `chunk_tokens` tokens. A chunk asks for the counts of its
distinct words and bigrams, with what it adds to them: one message for each range of hashes it has keys in, keys
sorted and delta-coded. Each range is summed by one task, which answers every chunk in the order it asked. So
what is exchanged are a chunk's distinct n-grams, once each way; a very common word is one number per chunk.
Ranges grow in number with the text, not in size. The answers turn chunks into counts per token; EM then needs a
table of held-out estimates by bucket (half-octave cells, fixed size), and scoring reads the counts once more.
Words and bigrams are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; a null id is trained on; repeated rows count
each; without training rows every token has probability 1 / (V + 1) = 1; an empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_shared, shared_table

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = "chunk long, ids array<{kind}>, train array<boolean>, lengths array<int>, words binary, tokens binary"
#: Cells of the held-out table: context bucket, -2 log2 of the bigram's and of the word's estimate.
CELL = 128


# ---------------------------------------------------------------- packed numbers
def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed: planes of high zeros take no room."""
    import zstandard
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# ---------------------------------------------------------------- chunks
def encode_chunks(df: DataFrame, chunk_tokens: int, kind: str) -> DataFrame:
    """Rows CHUNK from (id, train, text): the sorted hashes of the chunk's words, and its tokens as places
    among them; a text's tokens end with the end token, whose hash is that of the empty word."""
    def run(batches):
        import xxhash
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId() << 32, 0
        table, tokens, ids, train, lengths = {}, [], [], [], []

        def flush():
            digest = xxhash.xxh64_intdigest
            hashes = np.fromiter((digest(w) for w in table), np.uint64, len(table))
            words, place = np.unique(hashes, return_inverse=True)
            seq = place[np.array(tokens, dtype=np.int64)]
            cols = [pa.array([part + made], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(ids_arrays())), pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())), pa.array([pack_sorted(words)], pa.binary()), pa.array([pack(seq)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "train", "lengths", "words", "tokens"])

        def ids_arrays():
            return [pa.array([x.as_py() for x in ids], type=id_type[0])]

        id_type = [None]
        for b in batches:
            id_type[0] = b.schema.field(0).type
            for i, t, x in zip(b.column(0), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                words = (x.as_py() or b"").translate(_LOWER).split()
                words.append(b"")
                tokens.extend([table.setdefault(w, len(table)) for w in words])
                ids.append(i)
                train.append(t)
                lengths.append(len(words))
                if len(tokens) >= chunk_tokens:
                    yield flush()
                    made += 1
                    table, tokens, ids, train, lengths = {}, [], [], [], []
        if ids:
            yield flush()

    return df.mapInArrow(run, CHUNK.format(kind=kind))


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of word hashes (multiply and fold, twice)."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def grams(words: bytes, tokens: bytes, train: np.ndarray, lengths: np.ndarray):
    """Of a chunk: word hashes, what it adds to their counts, bigram keys (sorted), what it adds to theirs,
    its tokens (places among the words) and the place of each token's bigram among the keys."""
    w, seq = unpack_sorted(words), unpack(tokens).astype(np.int64)
    ends = np.cumsum(lengths)
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[ends[:-1]] = before[0] = seq[-1]  # the end token
    counted = np.repeat(train, lengths)
    pairs, place = np.unique(before * len(w) + seq, return_inverse=True)
    keys = bigram_keys(w[pairs // len(w)], w[pairs % len(w)])
    order = np.argsort(keys, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    place = rank[place]
    return w, np.bincount(seq[counted], minlength=len(w)), keys[order], np.bincount(place[counted], minlength=len(keys)), seq, place


def requests(chunks: DataFrame, ranges: int) -> DataFrame:
    """(range, chunk, words, word_counts, bigrams, bigram_counts): what each chunk asks of each range of hashes."""
    borders = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def run(batches):
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                w, wn, g, gn, _, _ = grams(r["words"], r["tokens"], np.array(r["train"], bool), np.array(r["lengths"]))
                wcut, gcut = ([0, *np.searchsorted(x, borders).tolist(), len(x)] for x in (w, g))
                rows = [(k, r["chunk"], pack_sorted(w[a:c]), pack(wn[a:c]), pack_sorted(g[d:e]), pack(gn[d:e]))
                        for k, (a, c, d, e) in enumerate(zip(wcut, wcut[1:], gcut, gcut[1:])) if c > a or e > d]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["range", "chunk", "words", "word_counts", "bigrams", "bigram_counts"])

    return chunks.select("chunk", "train", "lengths", "words", "tokens").mapInArrow(run, "range long, chunk long, words binary, word_counts binary, bigrams binary, bigram_counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(range, chunk, words, bigrams, types, tokens): the counts asked for, in the order of the keys; types and
    tokens, the range's distinct and all training words, stand in its first row and are 0 in the others."""
    def totals(keys: list[bytes], adds: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        parts = [unpack_sorted(x) for x in keys]
        _, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([unpack(x) for x in adds])).astype(np.int64)
        return np.split(total[place], np.cumsum([len(p) for p in parts])[:-1]), total

    def run(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in ("words", "word_counts", "bigrams", "bigram_counts")}
        words, total = totals(cols["words"], cols["word_counts"])
        bigrams, _ = totals(cols["bigrams"], cols["bigram_counts"])
        first = lambda n: pa.array([int(n)] + [0] * (table.num_rows - 1), pa.int64())
        return pa.table([table.column("range"), table.column("chunk"), pa.array([pack(x) for x in words]), pa.array([pack(x) for x in bigrams]), first((total > 0).sum()), first(total.sum())],
                        ["range", "chunk", "words", "bigrams", "types", "tokens"])

    return asked.groupBy("range").applyInArrow(run, "range long, chunk long, words binary, bigrams binary, types long, tokens long")


# ---------------------------------------------------------------- estimates
def contexts(cw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Count of each token's predecessor, from the counts of the tokens."""
    before = np.empty_like(cw)
    before[1:] = cw[:-1]
    before[np.cumsum(lengths)[:-1]] = before[0] = cw[-1]
    return before


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.frexp(count.astype(float))[1]


def held_out(cw: np.ndarray, cb: np.ndarray, cv: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, numbers) of training tokens, each held out."""
    def half_octaves(x):
        out = np.zeros(len(x), np.int64)  # 0: the estimate is nil
        out[x > 0] = np.minimum(np.rint(-2 * np.log2(x[x > 0])), CELL - 2).astype(np.int64) + 1
        return out

    f2, f1 = (cb - 1) / np.maximum(cv - 1, 1), (cw - 1) / max(n - 1, 1)
    return np.unique((bucket(cv) * CELL + half_octaves(f2)) * CELL + half_octaves(f1), return_counts=True)


def learn(cells: dict[int, int], types: int, rounds: int = 200) -> np.ndarray:
    """Weights of bigram, word and uniform estimates for each context bucket, by EM on the held-out cells."""
    out = np.zeros((65, 3))
    key, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / 2), 0.0)
    f = np.stack([value(key // CELL % CELL), value(key % CELL), np.full(len(key), 1 / (types + 1))], axis=1) if len(key) else np.zeros((0, 3))

    def em(rows):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w * f[rows]
            new = (share / share.sum(axis=1, keepdims=True) * n[rows, None]).sum(axis=0) / n[rows].sum()
            done, w = np.abs(new - w).max() < 1e-7, new
            if done:
                break
        return w

    every = em(np.ones(len(key), bool)) if len(key) else np.array([0.0, 0.0, 1.0])
    for k in range(65):
        rows = key // (CELL * CELL) == max(k, 1)
        out[k] = em(rows) if rows.any() else every
    out[0, 0] = 0.0  # an unseen context has no bigram estimate
    out = np.maximum(out, [0.0, 0.0, 1e-9])
    return out / out.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- documents
def score(df: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 800_000, range_keys: int = 500_000) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score), one row per row of `df`."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(is_training, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 6)).first()[0] or 0
    chunks = shared_table(encode_chunks(docs, chunk_tokens, kind), "lm-chunks")
    replies = shared_table(answers(requests(chunks, max(1, size // 6 // range_keys))), "lm-answers")
    types, tokens = replies.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        right, r = right.sort_by("range"), left.slice(0, 1).to_pylist()[0]
        train, lengths = np.array(r["train"], bool), np.array(r["lengths"])
        *_, seq, place = grams(r["words"], r["tokens"], train, lengths)
        counts = [np.concatenate([unpack(x) for x in right.column(n).to_pylist()]).astype(np.int64) for n in ("words", "bigrams")]
        cw, cb = counts[0][seq], counts[1][place]
        held = np.repeat(train, lengths)
        cells, n = held_out(cw[held], cb[held], contexts(cw, lengths)[held], tokens)
        more = [pa.array([pack(cw)]), pa.array([pack(cb)]), pa.array([cells.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64()))]
        return pa.table([*(left.column(c) for c in ("ids", "train", "lengths")), *more], ["ids", "train", "lengths", "cw", "cb", "cells", "n"])

    counted = chunks.groupBy("chunk").cogroup(replies.select("range", "chunk", "words", "bigrams").groupBy("chunk"))
    counted = shared_table(counted.applyInArrow(fill, f"ids array<{kind}>, train array<boolean>, lengths array<int>, cw binary, cb binary, cells array<long>, n array<long>"), "lm-counted")
    drop_shared(spark, chunks)
    drop_shared(spark, replies)
    cells = counted.select(F.explode(F.arrays_zip("cells", "n")).alias("c")).groupBy("c.cells").agg(F.sum("c.n").alias("n")).collect()
    weights = learn({c: n for c, n in cells}, types)

    def scores(batches):
        for b in batches:
            for i in range(b.num_rows):
                train, lengths = b.column(1)[i].values.to_numpy(zero_copy_only=False), b.column(2)[i].values.to_numpy()
                cw, cb = (unpack(b.column(k)[i].as_py()).astype(np.int64) for k in (3, 4))
                cv = contexts(cw, lengths)
                w = weights[bucket(cv)]
                p = w[:, 0] * cb / np.maximum(cv, 1) + w[:, 1] * cw / max(tokens, 1) + w[:, 2] / (types + 1)
                starts = np.cumsum(lengths) - lengths
                cols = [b.column(0)[i].values, pa.array(train), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((cw > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(lengths), tokens, np.int64)), pa.array(np.add.reduceat(np.log10((cw + 1) / (tokens + types + 1)), starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("ids", "train", "lengths", "cw", "cb").mapInArrow(scores, f"id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
