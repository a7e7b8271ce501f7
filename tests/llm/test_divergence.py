"""The source divergence audit against a plain loop, on awkward rows and odd shapes."""
import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import LOWER, awkward_rows
from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def slow(rows, top=200, min_docs=3):
    """rows: (text, lang, source)."""
    n, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        n.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), k in docs.items() if x == lang and k >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        c = {s: [n[lang, s, w] for w in kept] for s in sources}
        c[None] = [sum(x) for x in zip(*(c[s] for s in sources))]
        p = {s: [1 + 10**9 * (x + 1) // (sum(v) + len(kept)) for x in v] for s, v in c.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[t])), t.encode(), t) for t in sources if t != s]
            terms = [(-f(a, b), w.encode(), w) for a, b, k, w in zip(p[s], p[None], c[s], kept) if k and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(items)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_a_loop(docs, clashing):
    rows = [(r[1], r[2], r[3]) for r in awkward_rows()]
    assert got(divergence.divergences(docs)) == slow(rows)
    assert got(divergence.divergences(clashing, shard_entries=50, top=7)) == slow(rows, top=7)
    assert got(divergence.divergences(docs, min_docs=1000)) == slow(rows, min_docs=1000)  # no term is kept: pairs of value 0


def test_ties_and_bytes(spark):
    """Ties go by UTF-8 bytes, which is not the order of UTF-16 units; a source may lack terms, one may be alone."""
    same = "zeta ￮ \U0001f600 ümlaut alpha Alpha"
    rows = [(same, "en", "a"), (same, "en", "b"), (same, "en", None), (None, "en", "mute"), ("only here", "fr", "z"), ("", None, None), ("\x00a\x7fb_c9d", "en", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(divergence.divergences(df)) == slow(rows)


def test_empty(no_docs):
    out = divergence.divergences(no_docs)
    assert out.columns == COLUMNS and out.count() == 0


def test_tables_leave_a_task_in_pieces(docs, monkeypatch):
    """Small tables: partial counts are merged and flushed many times."""
    monkeypatch.setattr(divergence, "TABLE_ROWS", 20)
    monkeypatch.setattr(divergence, "SLICE", 2)
    batches = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()
    want = collections.Counter()
    for b in batches:
        for r in divergence.count_terms(b).to_pylist():
            want[r["lang"], r["source"], r["term"]] += r["n"]
    merged = divergence.merge([divergence.count_terms(b.slice(k, 3)) for b in batches for k in range(0, b.num_rows, 3)])
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in merged.to_pylist()} == want


@pytest.mark.parametrize("sources", [1, 2, 9])
def test_pair_sums(sources):
    rng = np.random.default_rng(sources)
    counts = rng.integers(0, 5, (sources, 40)) * (rng.random((sources, 40)) < 0.4)
    totals = counts.sum(axis=1) + 40
    p = divergence.shares(counts, totals[:, None])
    want = [[0 if s == t else int(divergence.excess(p[s], p[t]).sum()) for t in range(sources)] for s in range(sources)]
    assert divergence.pair_sums(counts, totals).tolist() == want


def test_shares_beyond_64_bit_products():
    total = 9 * 10**15
    count = np.array([0, 10**6, 10**12, total - 1], np.int64)
    assert divergence.shares(count, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]
