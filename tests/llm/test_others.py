"""Conversations, vectors, pages and the pipeline."""
import collections
import zlib
import hashlib
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest_llm import DOCS, awkward_rows
from tessera.llm import chat, pivot_search, warc_zstd

TURNS = "conv_id long, turn long, role string, text string"


# ------------------------------------------------------------- chat
def slow_chat(rows):
    convs = collections.defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].add((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seqs = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()) or any(o == s and d < c for d, o in seqs.items()):
            continue
        out[c] = (len(s), sum(o == s for o in seqs.values()), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, _, x in s))
    return out


def chat_rows():
    rows = []
    for c in range(12):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 3}-{t}") for t in range(1 + c // 3)]
    rows += [(20, 0, "user", "0-0"), (20, 1, "assistant", None), (21, 0, "user", "0-0"), (21, 1, "assistant", ""), (22, None, None, None), (None, 0, "user", "lost"),
             (23, 5, "user", "tie b"), (23, 5, "user", "tie a"), (23, 5, "user", "tie a"), (24, 0, "user", "x" * 100_000)]
    return rows + [(30, t, "user", f"long {t}") for t in range(50)] + [(31, t, "user", f"long {t}") for t in range(41)]


@pytest.mark.parametrize("block", [1024, 8])
def test_chat(spark, block):
    df = spark.createDataFrame(chat_rows(), TURNS).withColumns({"pos": F.lit(1), "block": F.lit(2), "length": F.lit(3)})
    got = collections.defaultdict(list)
    for r in chat.render_chat(df, block).collect():
        got[r.conv_id].append((r.piece, r.n_turns, r.copies, r.rendered))
    assert {c: (v[0][1], v[0][2], "".join(x[3] for x in sorted(v))) for c, v in got.items()} == slow_chat(chat_rows())


def test_chat_empty_and_native(spark):
    out = chat.render_chat(spark.createDataFrame([], TURNS))
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------- vectors
def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    rows += [(400, None), (500, [1.0, None, 0.0]), (501, [float("nan")] * 6), (502, [float("inf")] * 6), (None, [9.0] * 6), (503, [2.0]), (600, []), (7, rows[7][1]), (600, [0.1] * 6), (700, rows[100][1]), (None, [9.0] * 6)] + [rows[100]] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "score": F.lit(1)})
    valid = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v) + (0,) * (6 - len(v))) for i, v in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(valid):
        if q is not None and q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c is None, c) for m, (c, b) in enumerate(valid) if m != n)[:10]
            want += [(q, r + 1, c, -s) for r, (s, _, c) in enumerate(best)]
    for block in (4096, 50):
        got = pivot_search.top_k(df, F.col("id") % 100 == 0, block=block, query_block=2, pivots=7)
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    few = pivot_search.top_k(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 100 == 0)
    assert few.count() == 2
    assert pivot_search.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        pivot_search.top_k(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), F.lit(True))


def test_search_leaves_candidates_out():
    """Elimination works: far candidates are not evaluated."""
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(size=(2000, 4)))
    longest = float((x * x).sum(axis=1).max())
    p, seen = x[:16], []

    class Counting(np.ndarray):
        def __getitem__(self, k):
            seen.append(np.size(k))
            return np.ndarray.__getitem__(self, k).view(np.ndarray)

    more = lambda v: np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
    dist = pivot_search.distances(x, more(x), p, more(p))
    q_dist = pivot_search.distances(x[:5], np.zeros(5), p, more(p))
    found = list(pivot_search.search(x[:5], np.arange(5), q_dist, np.full(5, -np.inf), x.view(Counting), np.arange(2000), dist, longest, 10))
    assert sum(seen) < 5 * 2000 * 0.8
    for i, place, score in found:
        s = x @ x[i]
        s[i] = -np.inf
        assert score.tolist() == sorted(s)[::-1][:10]


# ------------------------------------------------------------- WARC
PAGES = "page_id long, url string, html string"


def page_rows():
    rows = [(i, f"http://x.org/{i}", f"<html>{'p ' * (i * 7)}</html>") for i in range(60)]
    rows += [(100, None, "<b>" + "same " * 50), (101, "http://a b/ü\r\nX: y", "<b>" + "same " * 50), (99, "u", "<b>" + "same " * 50), (99, "u", "<b>" + "same " * 50), (None, "n", "<b>" + "same " * 50),
             (200, "e", ""), (201, "e", ""), (202, "z", None), (203, "short", "x" * 99), (204, "short", "x" * 99), (205, "limit", "y" * 100), (206, "limit", "y" * 100), (207, "big", "ü\r\n\r\n" * 200_000)]
    return rows


def test_warc_round_trip(spark):
    df = spark.createDataFrame(page_rows(), PAGES).withColumns({"digest": F.lit(1), "payload": F.lit(2), "value": F.lit(3)})
    got = warc_zstd.round_trip(df, archive_bytes=1 << 18).collect()
    first = {}
    for i, _, h in page_rows():
        if h is not None and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in page_rows():
        data = (h or "").encode()
        again = h in first and first[h] != i
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None, None if again else data)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert all("\r" not in r.target_uri and " " not in r.target_uri for r in got)


def test_warc_empty(spark):
    assert warc_zstd.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(n=40):
    records = [warc_zstd.build_record(i, "http://x.org", b"payload %d " % i * 20, hashlib.sha256(b"payload %d " % i * 20).hexdigest(), None, False) for i in range(n)]
    return records, list(warc_zstd.archive_frames(iter(records)))


@pytest.mark.parametrize("n", [1, 40])
def test_archive_frames(n):
    records, frames = archive(n)
    sep = warc_zstd.SEPARATOR.encode()
    assert list(warc_zstd.read_archive(sep.join(frames) + sep)) == records
    assert frames[0][:4] == (0x184D2A5D).to_bytes(4, "little") and len(frames) == n + 1
    # a plain dictionary in the leading frame is read, too
    d = zstandard.ZstdDecompressor().decompress(frames[0][8:])
    plain = (0x184D2A5D).to_bytes(4, "little") + len(d).to_bytes(4, "little") + d
    assert list(warc_zstd.read_archive(plain + b"".join(frames[1:]))) == records


def test_archive_damage():
    records, frames = archive()
    whole = b"".join(frames)
    for bad in (whole[:-3], whole + b"\x00\x01", whole[:4] + (1 << 30).to_bytes(4, "little") + whole[8:], frames[0] + b"no frame at all here"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc_zstd.read_archive(bad))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc_zstd.read_archive(b"".join(frames[1:])))  # the dictionary is gone
    r = records[3]
    for bad in (r[:-1], r.replace(b"WARC/1.1", b"WARP/1.1"), r.replace(b"payload 3", b"payload 4"), r.replace(b"WARC-Date", b"WARC-Dote"), r.replace(b"Content-Length: ", b"Content-Length: 1", 1), r + r):
        with pytest.raises(ValueError):
            warc_zstd.parse_record(bad)
    assert warc_zstd.parse_record(r)[3] == 3


# ------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C
    from test_documents import slow_components, slow_fingerprint, slow_quality, whole_ids
    from tessera.llm import mixing, quality
    spark.createDataFrame(awkward_rows(), DOCS).withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_dedup", "mix_sources", "best_fit_packing"]
    one = stage["quality_rules"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in quality.judge(docs).filter("__quality_kept").collect()}
    assert not kept & {r[0] for r in awkward_rows() if slow_quality(r[1])[0] < 10}
    rows = one.collect()
    two = stage["simhash_dedup"](spark, one, str(tmp_path))
    comp = slow_components([slow_fingerprint(r.text) for r in rows], 2)
    first = {}
    for r, c in zip(rows, comp):
        first[c] = min([x for x in (first.get(c), r.doc_id) if x is not None], default=None)
    assert sorted(map(str, first.values())) == sorted(str(r.doc_id) for r in two.collect())
    three = stage["mix_sources"](spark, two, str(tmp_path))
    copies = collections.Counter(r.doc_id for r in three.collect())
    assert copies == collections.Counter({r.doc_id: r["__mix_copies"] for r in mixing.mix_decisions(two).collect() if r["__mix_copies"]})
    four = stage["best_fit_packing"](spark, three, str(tmp_path))
    # every copy's tokens, whole, in sequences without gaps
    pieces = four.collect()
    want = collections.Counter((r.doc_id, p, tuple(ids[lo:lo + 2048])) for r in three.collect() for ids in [whole_ids(r.text)] for p, lo in enumerate(range(0, len(ids), 2048)))
    assert collections.Counter((r.doc_id, r.piece, tuple(r.ids)) for r in pieces) == want
    assert all(r.start == 2048 * r.piece and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    assert C.run(spark, str(tmp_path)).count() == four.count()


def test_pipeline_on_no_documents(spark, tmp_path):
    import corpus_pipeline as C
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
