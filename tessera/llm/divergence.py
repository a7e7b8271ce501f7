"""Source divergence audit: how far each source's use of terms lies from the others of its language.

Counting. Inside `mapInArrow` the texts go through Arrow compute: `ascii_lower`, `split_pattern_regex` on what is
no letter, `dictionary_encode`, and hash `group_by` twice, once by (document, term) and once by (source, term).
Tables of one task are merged by the same `group_by`, and leave it as partial counts when they hold `TABLE_ROWS`
rows: memory does not depend on the input. A common term is one row for each task and source.

Merging. Partial counts are exchanged once, by (language, term); terms in fewer than `min_docs` of a
language's documents go. The rest are dealt by a hash of the term into shards of about `shard_entries`
counts; a shard meets the totals of its language's sources and computes, in whole columns,

    p = 1 + floor(10^9 (count + 1) / (N + V)),    f = floor((p - q)^2 / q),

N being the source's sum over kept terms and V their number. Terms that neither of two sources uses are one
product, so the work is counts x sources. Shards return one sum for each pair of sources, and each
source's `top` terms (the greatest of all are among the greatest of the shards). Integers throughout.

Defined cases: null texts, languages and sources are empty strings; every row is a document, also a
repeated one; a text without terms still makes its source occur; a language without kept terms has pairs of
value 0; ties are ordered by the bytes of the item; an empty table gives an empty result. Very long texts are
counted whole. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import shared_table

#: What splits terms: ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
TABLE_ROWS = 500_000
SLICE = 512
UNIT = 1_000_000_000


# ---------------------------------------------------------------- partial counts
def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (lang, source, text)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), pattern=BETWEEN)
    doc, term = pc.list_parent_indices(lists), pc.list_flatten(lists)
    spoken = pc.not_equal(term, "")
    doc, term = doc.filter(spoken), term.filter(spoken).dictionary_encode()
    per_doc = pa.table([doc, term.indices], ["doc", "term"]).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    # a number for each (lang, source) of the batch
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    width = len(source.dictionary)
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), width), source.indices.cast(pa.int64()))
    held = pa.table([group.take(per_doc["doc"].combine_chunks()), per_doc["term"], per_doc["count_all"]], ["group", "term", "n"])
    out = held.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    g = out["group"].to_numpy()
    take = lambda column, at: column.dictionary.take(pa.array(at))
    return pa.table([take(lang, g // max(width, 1)), take(source, g % max(width, 1)), term.dictionary.take(out["term"].combine_chunks()), out["n_sum"], out["n_count"]],
                    ["lang", "source", "term", "n", "docs"])


def merge(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    out = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """Partial counts of each task, from (lang, source, text) without nulls."""
    def run(batches):
        held, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                held.append(count_terms(b.slice(at, SLICE)))
                rows += held[-1].num_rows
                if rows > TABLE_ROWS:
                    held = [merge(held)]
                    rows = held[0].num_rows
                    if rows > TABLE_ROWS // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merge(held).to_batches()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


# ---------------------------------------------------------------- one shard
def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), three digits at a time, so that no product passes 64 bits."""
    rest, out = np.broadcast_arrays(count + 1, total)[0].copy(), np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sums over terms of f for (source, other source); counts (sources, terms), totals N + V."""
    p = shares(counts, totals[:, None])
    none = shares(np.zeros(len(totals), np.int64), totals)
    used = counts > 0
    at = used.astype(np.int64)
    neither = counts.shape[1] - at.sum(axis=1)[:, None] - at.sum(axis=1)[None, :] + at @ at.T
    out = neither * excess(none[:, None], none[None, :])
    for s in range(len(totals)):
        own = np.flatnonzero(used[s])
        others = p[:, own]
        out[s] += excess(p[s, own], others).sum(axis=1)
        out[:, s] += np.where(used[:, own], 0, excess(others, p[s, own])).sum(axis=1)
    np.fill_diagonal(out, 0)
    return out


def shard_rows(terms: pa.Table, sources: pa.Table, top: int) -> pa.Table:
    """(lang, source, part, item, value) of a shard: terms (lang, shard, term, uses), sources (lang, shard,
    source, total, lang_total), totals being N + V."""
    sources = sources.sort_by("source")
    lang, names = sources["lang"][0].as_py(), sources["source"].combine_chunks()
    totals, whole = sources["total"].to_numpy(), sources["lang_total"][0].as_py()
    uses = terms["uses"].combine_chunks()
    word, flat = pc.list_parent_indices(uses).to_numpy(), pc.list_flatten(uses)
    who = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    n = flat.field("n").to_numpy()
    pairs, value = np.zeros((len(names), len(names)), np.int64), np.zeros(len(n), np.int64)
    step = max(1, 2_000_000 // len(names))
    for lo in range(0, terms.num_rows, step):
        a, b = np.searchsorted(word, [lo, lo + step])
        counts = np.zeros((len(names), min(step, terms.num_rows - lo)), np.int64)
        counts[who[a:b], word[a:b] - lo] = n[a:b]
        pairs += pair_sums(counts, totals)
        p, q = shares(n[a:b], totals[who[a:b]]), shares(counts.sum(axis=0), np.int64(whole))[word[a:b] - lo]
        value[a:b] = np.where(p > q, excess(p, q), -1)
    of, other = np.nonzero(~np.eye(len(names), dtype=bool))
    out = [(names.take(pa.array(of)), "pair", names.take(pa.array(other)), pairs[of, other])]
    term = terms["term"].combine_chunks()
    place = pc.rank(term, tiebreaker="dense").to_numpy()[word] if len(word) else word  # by bytes
    order = np.lexsort((place, -value, who))
    order = order[value[order] >= 0]
    first = np.searchsorted(who[order], who[order], side="left")
    best = order[np.arange(len(order)) - first < top]
    out.append((names.take(pa.array(who[best])), "term", term.take(pa.array(word[best])), value[best]))
    columns = ["lang", "source", "part", "item", "value"]
    return pa.concat_tables([pa.table([pa.array([lang] * len(s), pa.string()), s, pa.array([part] * len(s), pa.string()), i, pa.array(v, pa.int64())], columns) for s, part, i, v in out])


# ---------------------------------------------------------------- all documents
def divergences(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, shard_entries: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source of the language, `term`
    rows for the `top` terms that the source uses more than its language does."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = partial_counts(docs).repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("uses"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = shared_table(kept.select("lang", "term", "uses"), "divergence-terms")
    sums = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"), F.count("*").alias("entries"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "entries"])
    groups = shared_table(groups, "divergence-sources")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.ceil(F.greatest(F.sum("entries") / shard_entries, F.lit(1))).cast("long").alias("shards"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    langs = shared_table(langs, "divergence-langs")
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    left = kept.join(langs.select("lang", "shards"), "lang").select("lang", shard.alias("shard"), "term", "uses")
    right = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "source", (F.col("n") + F.col("v")).alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"))
    found = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(lambda a, b: shard_rows(a, b, top), "lang string, source string, part string, item string, value long")
    found = shared_table(found, "divergence-found")
    # a pair's value is the sum over the shards; a term is in one shard, and most leave before they are exchanged
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
