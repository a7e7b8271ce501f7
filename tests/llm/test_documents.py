"""The operators on documents: against brute force, on awkward rows, empty tables and clashing columns."""
import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import LOWER, WORD, awkward_rows, by_id, prose
from tessera.llm import interpolated_lm, license_scan, mixing, packing, quality, sharding, simhash


# ------------------------------------------------------------- SimHash
def slow_fingerprint(text, k=3):
    import xxhash
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(a) for a in range(len(values))]


def test_simhash_against_brute_force(docs, clashing):
    rows = awkward_rows()
    fps = [slow_fingerprint(r[1]) for r in rows]
    comp = slow_components(fps, 2)
    ids = [r[0] for r in rows]
    want = []
    for i, c in enumerate(comp):
        own = [ids[k] for k in range(len(rows)) if comp[k] == c and ids[k] is not None]
        want.append((ids[i], fps[i] - (1 << 64) if fps[i] >> 63 else fps[i], min(own, default=None)))
    got = by_id(simhash.near_duplicates(docs), "id", "fp", "component_id")
    assert got == sorted(want, key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))
    assert by_id(simhash.near_duplicates(clashing), "id", "fp", "component_id") == got
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted({str(w[2]) for w in want})


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_simhash_links_of_hot_buckets(spark, radius):
    rng = np.random.default_rng(radius)
    values = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    for base in list(values)[:3]:
        for _ in range(150):
            y = base
            for b in rng.choice(20, rng.integers(0, 6), replace=False):
                y ^= 1 << int(b)
            values.add(y)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    nodes = {r.node: r.root for r in simhash.components(simhash.links(df, len(values), radius, bucket=16)).collect()}
    groups = lambda roots: {frozenset(v) for v in _grouped(roots).values()}
    want = groups(dict(zip(values, slow_components(values, radius))))
    assert groups({v: nodes.get(simhash._signed(v), simhash._signed(v)) for v in values}) == want


def _grouped(roots):
    out = collections.defaultdict(set)
    for k, v in roots.items():
        out[v].add(k)
    return out


def test_thresholds_cover_the_radius():
    cost, t = simhash.allot([[0, 5, 9, 30], [0, 1, 2, 30], [0, 50, 60, 90]], 0)
    assert sum(t) == 0 and cost == min(sum(c[x + 1] for c, x in zip([[0, 5, 9, 30], [0, 1, 2, 30], [0, 50, 60, 90]], ts)) for ts in
                                       ((a, b, -a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2))


# ------------------------------------------------------------- quality rules
def test_quality_sql_has_the_same_rules(spark, tmp_path):
    """Lines that the rules tell apart by pairs, neighbours, scripts and lengths, by Spark and by DuckDB."""
    import duckdb
    from tessera.llm import queries
    long = "word " * 400
    lines = ["Il dit « oui » puis « non » et partit", "a |x| |y| b", "(|x|). |y|, z", "Home | About | Help | Contact", "Home » Shop » Shoes", "a > b > c", "a>b>c d", "one • two • three",
             long + "« quoted » and |x|", long + "| a | b |", "Нажмите кнопку Help", "Help", "  home - LOGIN / Site Map!", "»so« und »so« gesagt", "‹a› ›b‹ c", "« open | only", "| a | b | c | d |",
             "x |a b| y", "» » »", "> > >", "|x| > |y| > z", "«|x|» a", "All rights reserved.", "What!! Now!! Go!!", "a#b$c%d", "\t|x|\t|y|\r", "", "plain line of words that stays, with a mark | or so", "|a|b|c|", "·"]
    rows = [(i, "Plain words make up this line, and they say a thing or two more.\n" * k + x) for i, x in enumerate(lines) for k in (0, 1, 2)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)] + [(9000, "\n".join(lines)), (9001, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op3_quality_rules"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.QUERIES["op3_quality_rules"](spark, str(tmp_path)).select(names).collect()
    assert {r[0]: tuple(r) for r in got} == {r[0]: r for r in want} and len(got) == len(rows)


def slow_quality(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = collections.Counter((r.doc_id, *(r["__quality_" + n] for n in names), r["__quality_base_failed"]) for r in quality.judge(docs).collect())
    want = collections.Counter()
    for r in awkward_rows():
        x = slow_quality(r[1])
        want[(r[0], *x, x[0] < 10 or 100 * x[4] > 20 * x[0])] += 1
    assert got == want


def test_quality_lines(spark):
    good = "Plain words make up this line, and they say a thing or two."
    cases = [(1, "\n".join([good] * 1 + ["Another sentence of common words stands here, too."]), True, True), (2, good + "\nHome | About | Help | Contact", True, False),
             (3, "a### b$$$ c%%% d&&& e*** f### g$$$ h%%% i&&& j*** k###", False, False), (4, "BUY!! NOW!! THIS!! IS!! A!! VERY!! GOOD!! DEAL!! FOR!! YOU!! ALL!!", False, False),
             (5, good + "\nAll rights reserved.", True, False), (6, good + "\n\nSome other sentence with its own nine or ten words.", True, True)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame([c[:2] for c in cases], "doc_id int, text string")).collect()}
    for i, text, kept, whole in cases:
        assert (out[i]["__quality_kept"], out[i]["__quality_clean"] == text) == (kept, whole), i


def test_quality_separators_in_clean_text(spark):
    long = " ".join(f"Sentence {i} says thing {7 * i} of it, number {9 * i} too." for i in range(200))
    extra = [" « une citation »", " where |x| is small and |y|, too,", " • one thing • another thing", " »ein Zitat« und ‹noch eins›", " a | b | c"]
    cases = [(i, long[:900] + x + long[900:], True) for i, x in enumerate(extra)] + [(10, long + "".join(extra), True)]
    cases += [(11, "Il a dit « oui, demain » et le reste du monde a bien ri.", True), (12, "Here the value |x| is less than one, as anyone can see.", True)]
    cases += [(20, "Shop » Garden » Tools » Spades and forks for small hands of all ages", False), (21, "« Older posts of this long blog | Newer posts of this long blog »", False),
              (22, "One | Two | Three | Four | Five | Six | Seven | Eight | Nine | Ten", False), (23, "News|Sport|Weather|Travel and all the other things we have written", False)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame([c[:2] for c in cases], "doc_id int, text string")).collect()}
    for i, text, kept in cases:
        assert (out[i]["__quality_kept"], out[i]["__quality_clean"]) == (kept, text if kept else ""), i


def test_quality_menu_words_of_all_scripts_and_lengths(spark):
    rest = " и это всё что надо знать о кнопке в углу экрана"
    cases = [(1, "Нажмите кнопку Help, чтобы открыть окно" + rest, True), (2, "Πατήστε το Help για να ανοίξει το νέο παράθυρο σε αυτή την οθόνη", True),
             (3, "اضغط على زر Home ثم انتظر حتى تظهر لك الصفحة الأولى كلها", True), (4, "点击 Help 按钮 然后 等待 窗口 打开 再 选择 一个 文件 保存", True)]
    cases += [(10 + i, " ".join(["Home", "Sign in", "About", "Skip to content", "Help"] * n) + end, False) for i, (n, end) in enumerate([(4, " »"), (4, " \U0001f3e0\ufe0f"), (20_000, ""), (20_000, " •")])]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame([c[:2] for c in cases], "doc_id int, text string")).collect()}
    for i, text, whole in cases:
        assert out[i]["__quality_clean"] == (text if whole else ""), i
        assert out[i]["__quality_kept"] == whole, i


def test_quality_clean_keeps_columns(clashing, no_docs):
    out = quality.clean(clashing)
    assert out.columns == clashing.columns and all(r.n_chars == len(r.text) for r in out.collect())
    assert quality.clean(no_docs).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# ------------------------------------------------------------- mixing
def slow_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mix_targets(docs, clashing):
    sizes = collections.Counter()
    for r in awkward_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = slow_targets(sizes)
    out = mixing.mix_decisions(clashing).collect()
    assert len(out) == len(awkward_rows())
    for r in out:
        assert r["__mix_source_size"] == sizes[r.source] and math.isclose(r["__mix_target"], want[r.source], abs_tol=1e-6)
        rate = r["__mix_target"] / sizes[r.source] if sizes[r.source] else 0
        assert r["__mix_copies"] in (math.floor(rate), math.floor(rate) + 1) and r["__mix_copies"] <= 3
    again = mixing.mix_decisions(clashing.repartition(5))
    key = lambda rows: sorted((str(r.doc_id), r["__mix_copies"]) for r in rows)
    assert key(out) == key(again.collect())
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.count() == sum(r["__mix_copies"] for r in out)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "a " * (1 + i % 50), f"s{i % 4}") for i in range(4000)]
    out = mixing.mix_decisions(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum(F.col("__mix_size") * F.col("__mix_copies")).alias("taken"), F.max("__mix_target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.08 * r.target


def test_mix_empty(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["__mix_copies"] for r in mixing.mix_decisions(nothing).collect()} == {0}


# ------------------------------------------------------------- sharding
def test_shards(clashing, docs, no_docs):
    out = sharding.assign_shards(clashing, 4)
    assert out.columns == [*clashing.columns, "__shard", "__shard_slot"]
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["__shard"]].append(r["__shard_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.assign_shards(no_docs, 4).count() == 0


def test_communication_matrix():
    counts, sizes = [5, 0, 17, 1], [6, 6, 6, 5]
    seen = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
        seen += m
    assert np.allclose(seen / 400, np.outer(counts, sizes) / 23, atol=0.25)
    big = sharding.communication_matrix([3_000_000_000, 5], [1_500_000_003, 1_500_000_002], 1)
    assert big.sum(axis=1).tolist() == [3_000_000_000, 5] and big.sum(axis=0).tolist() == [1_500_000_003, 1_500_000_002]


@pytest.mark.parametrize("good,bad,n", [(3, 4, 5), (30, 50, 20), (1, 200, 7), (0, 9, 4), (9, 0, 4), (40, 40, 80), (500, 300, 250)])
def test_tabled_draw_is_the_exact_law(good, bad, n):
    """The number that u stands for is the law's own inverse, by whole numbers."""
    from fractions import Fraction
    total, below = math.comb(good + bad, n), 0
    for k in range(max(0, n - bad), min(n, good) + 1):
        weight = math.comb(good, k) * math.comb(bad, n - k)
        middle = float(Fraction(2 * below + weight, 2 * total))
        if weight / total > 1e-12:
            assert sharding.tabled_draw(middle, good, bad, n) == k
        below += weight


def test_draws_from_large_urns():
    """Beyond 10^9 rows: mean and variance of the law, and sums that hold."""
    good, bad, n = 4 * 10**11, 6 * 10**11, 10**6
    u = np.random.default_rng(2).random(3000)
    x = np.array([sharding.tabled_draw(v, good, bad, n) for v in u])
    assert abs(x.mean() - 4 * 10**5) < 6 * (240_000 / 3000) ** 0.5 and abs(x.var() / 240_000 - 1) < 0.15
    counts = [10**10, 1, 7 * 10**9, 0]
    sizes = [sum(counts) // 3 + (k < sum(counts) % 3) for k in range(3)]
    m = sharding.communication_matrix(counts, sizes, 5)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()


def test_shards_are_uniform(spark):
    df = spark.range(2000, numPartitions=5).withColumnRenamed("id", "doc_id")
    out = np.array(sorted((r.doc_id, r["__shard"]) for r in sharding.assign_shards(df, 4).collect()))
    table = np.array([[((out[:, 0] // 400 == p) & (out[:, 1] == s)).sum() for s in range(4)] for p in range(5)])
    assert table.sum() == 2000 and abs(table - 100).max() < 45


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "x"), 3)
    assert spark.read.parquet(str(tmp_path / "x")).groupBy("shard").count().count() == 3


# ------------------------------------------------------------- license scans
def test_license_scan(spark):
    apache = license_scan.TEMPLATES["apache-2"]
    cases = [(1, "Released under the MIT License. x under-the MIT license", 2, 1, 6, "mit", "mit"), (2, None, 0, None, None, "", ""), (3, "", 0, None, None, "", ""),
             (4, "CC BY-NC 4.0 and Apache License, Version 2.0", 2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (5, "apache license version two", 0, None, None, "", ""),
             (6, apache.replace("Version 2.0", "Version two").replace("obtain", "get hold of"), 0, None, None, "", "apache-2"), (6, "plain words", 0, None, None, "", ""),
             (1, "Released under the MIT License. x under-the MIT license", 2, 1, 6, "mit", "mit"), (7, license_scan.TEMPLATES["gpl-3"], 0, None, None, "", "gpl-3"), (None, "cc by nc cc by nc", 2, 0, 3, "cc-by-nc", "cc-by-nc")]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string").withColumns({"label": F.lit(1), "place": F.lit(2), "words": F.lit(3)})
    out = license_scan.label(*license_scan.scan(df))
    got = collections.Counter(tuple(r) for r in out.select("doc", "n_base", "first_word", "last_word", "base_labels", "labels").collect())
    assert got == collections.Counter((c[0], *c[2:]) for c in cases)
    assert all(0 <= r.score <= 1 for r in out.collect())
    with pytest.raises(ValueError):
        license_scan.scan(df, max_template_words=5)


def test_license_awkward(docs, no_docs):
    out = license_scan.label(*license_scan.scan(docs))
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert collections.Counter((r.doc, r.n_words) for r in out.collect()) == collections.Counter((r[0], len(word.findall((r[1] or "").translate(LOWER)))) for r in awkward_rows())
    assert license_scan.label(*license_scan.scan(no_docs)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


# ------------------------------------------------------------- packing
def whole_ids(text):
    return packing._tokenizer(packing.vocabulary())[0].encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_are_whole_text_tokens(docs):
    got = collections.defaultdict(list)
    for r in packing.token_pieces(docs, capacity=256, ids=True).collect():
        got[(r.id, r.piece)].append((r.start, r.length, r.ids_crc32, r.ids))
    want = collections.defaultdict(list)
    for r in awkward_rows():
        ids = whole_ids(r[1])
        for p, lo in enumerate(range(0, len(ids), 256)):
            cut = ids[lo:lo + 256]
            want[(r[0], p)].append((lo, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), cut))
    assert got == want


def test_encode_is_the_tokenizer():
    """On plain, accented, odd and random texts, the ids of the split texts are the tokenizer's own."""
    import random
    r = random.Random(4)
    marks = "aB éÉß İı ſŸ x's 'LL don't 1234 \t\x0b\x0c\x1c\x1f\x85\xa0\u2003 […]!? #<|endoftext|> <| ño Ñ ² ½ Ω ς Σ 漢 \u0301e\u0301 Ĳŀŉ ­-_"
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["", " ", "Ÿ" * 50, prose(1, 3000), "".join(map(chr, range(0x20, 0x180)))]
    tokenizer = packing._tokenizer(packing.vocabulary())[0]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.encode(texts) == want
    assert packing.encode(texts[:50], packing.vocabulary()) == want[:50]


def test_pack(docs, clashing, no_docs):
    out = packing.pack(packing.token_pieces(clashing, capacity=128), capacity=128, block=16).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 128
    assert len(out) == sum(-(-len(whole_ids(r[1])) // 128) for r in awkward_rows())
    assert packing.pack(packing.token_pieces(no_docs)).count() == 0


@pytest.mark.parametrize("lengths", [[], [5], [60, 60, 60, 40, 40, 40, 30, 30, 30, 30], [51] * 9 + [27] * 9 + [26] * 9 + [23] * 18])
def test_local_search(lengths):
    lengths = np.array(lengths, np.int64)
    first = packing.best_fit(lengths, 100)
    last = packing.exchange(lengths, first, 100)
    fill = np.bincount(last, weights=lengths) if len(last) else np.zeros(1)
    assert fill.max() <= 100 and fill.sum() == lengths.sum() and len(set(last.tolist())) <= len(set(first.tolist()))


@pytest.mark.parametrize("seed", range(8))
def test_local_search_ends_when_no_exchange_is_left(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(500, 900, 60) if seed % 2 else rng.integers(3, 30, 900)
    capacity = 2048 if seed % 2 else 200
    last = packing.exchange(lengths, packing.best_fit(lengths, capacity), capacity)
    again = packing.exchange(lengths, last, capacity)
    squares = lambda bins: int((np.bincount(bins, weights=lengths) ** 2).sum())
    assert squares(again) == squares(last)


@pytest.mark.parametrize("seed", range(4))
def test_no_exchange_is_overlooked(seed):
    """Bins of some hundred short pieces: by brute force over all pieces, nothing that is left raises the squares."""
    import itertools
    rng = np.random.default_rng(seed)
    capacity, lengths = 700, np.concatenate((rng.choice([3, 4, 6, 7, 9, 11], 500), rng.integers(200, 340, 4)))
    bins = rng.integers(0, 9, len(lengths))
    while np.bincount(bins, weights=lengths).max() > capacity:
        bins = rng.integers(0, 9, len(lengths))
    last = packing.exchange(lengths, bins, capacity)
    fill = np.bincount(last, weights=lengths, minlength=9).astype(int)
    live = [b for b in range(9) if 0 < fill[b] < capacity]
    assert fill.max() <= capacity and fill.sum() == lengths.sum()
    if sum(capacity - fill[b] for b in live) >= capacity:
        for g, r in itertools.permutations(live, 2):
            own, theirs = ([int(x) for x in lengths[last == b]] for b in (g, r))
            give = set(own) | {a + b for a, b in itertools.combinations(own, 2)}
            for n, m in [(n, 0) for n in set(own)] + [(n, m) for n in give for m in set(theirs)]:
                more = n - m
                assert not (0 < more <= capacity - fill[r] and more * (fill[r] - fill[g] + more) > 0)


def test_local_search_saves_bins():
    saved = 0
    for seed in range(6):
        lengths = np.random.default_rng(seed).integers(25, 70, 300)
        first = packing.best_fit(lengths, 100)
        saved += len(set(first.tolist())) - len(set(packing.exchange(lengths, first, 100).tolist()))
    assert saved > 0


# ------------------------------------------------------------- language model
def test_language_model(spark, docs):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 2
    rows = awkward_rows()
    got = interpolated_lm.score(docs, train, chunk_tokens=900, range_keys=300).collect()
    kept = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 != 2 for r in rows]
    texts = [WORD.findall((r[1] or "").translate(LOWER)) + ["\n"] for r in rows]
    c, b = collections.Counter(), collections.Counter()
    for t, k in zip(texts, kept):
        if k:
            c.update(t)
            b.update(zip(["\n", *t], t))
    n, v = sum(c.values()), len(c)
    cells = collections.Counter()
    for (x, y), m in b.items():
        key, one = interpolated_lm.held_out(np.array([c[y]]), np.array([m]), np.array([c[x]]), n)
        cells[int(key[0])] += m
    w = interpolated_lm.learn(dict(cells), v)
    want = collections.Counter()
    for r, t, k in zip(rows, texts, kept):
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
        s = 0.0
        for x, y in zip(["\n", *t], t):
            l2, l1, l0 = w[interpolated_lm.bucket(np.array([c[x]]))[0]]
            s += math.log10(l2 * (b[x, y] / c[x] if c[x] else 0) + l1 * c[y] / n + l0 / (v + 1))
        want[(r[0], k, len(t), sum(c[x] > 0 for x in t), n, round(base, 4), round(s, 4))] += 1
    assert collections.Counter((r.id, r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == want
    out = [r for r in got if not r.training and r.n_tokens > 30]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_without_rows(no_docs, docs):
    assert interpolated_lm.score(no_docs, F.lit(True)).count() == 0
    assert {r.score for r in interpolated_lm.score(docs, F.lit(False)).collect()} == {0.0}


def test_weights_are_a_distribution():
    w = interpolated_lm.learn({(3 * 128 + 5) * 128 + 20: 10, (3 * 128 + 0) * 128 + 25: 4, (1 * 128) * 128 + 0: 3}, 50)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all() and w[0, 0] < 1e-6


def test_packed_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (interpolated_lm.unpack_sorted(interpolated_lm.pack_sorted(x)) == x).all()
    assert len(interpolated_lm.unpack(interpolated_lm.pack(x[:0]))) == 0
