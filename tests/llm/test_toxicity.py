"""The factorization machine: scores and slopes by loops, held-out accuracy, pairs, awkward rows."""
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from conftest_llm import by_id, prose
from tessera.llm import toxicity
from tessera.llm.toxicity import Model, Terms, fit, learn, logistic, score, word_terms

LABELS = "doc_id long, quality int, toxic int"


def slow_raw(m, places):
    pairs = sum(float(np.dot(m.numbers[a, 1:], m.numbers[b, 1:])) for a, b in itertools.combinations(places, 2))
    return m.bias + sum(float(m.numbers[a, 0]) for a in places) + pairs


def test_scores_by_loops():
    rng = np.random.default_rng(1)
    m = Model(np.arange(30), -0.3, rng.normal(0, 0.5, (30, 4)), 4)
    rows = [rng.choice(30, n, replace=False) for n in (0, 1, 5, 0, 12, 30)]
    got = m.score(np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows]))
    assert np.allclose(got, [1 / (1 + math.exp(-slow_raw(m, r))) for r in rows], atol=1e-9)
    assert m.score(np.zeros(0, np.int64), np.zeros(0, np.int64)).size == 0


def test_a_step_follows_the_slope():
    """One batch of one round moves every number against its numerical slope."""
    term, lengths, y = np.array([0, 1, 1, 2, 3, 0, 3]), np.array([2, 3, 0, 2]), np.array([1.0, 0.0, 1.0, 0.0])
    start = np.random.default_rng(7).normal(0, 0.01, (4, 2))
    bias, after = fit(term, lengths, y, 4, factors=2, rounds=1, batch=4, rate=1e-3, l1=0.0)

    def loss(numbers):
        p = Model(np.arange(4), 0.0, numbers, 4).score(term, lengths)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    rng = np.random.default_rng(7)
    before = np.column_stack((np.zeros(4), rng.normal(0, 0.01, (4, 2))))
    assert np.allclose(before[:, 1:], start)
    for i, j in np.ndindex(4, 3):
        up, down = before.copy(), before.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        if abs(slope) > 1e-4:
            assert np.sign(after[i, j] - before[i, j]) == -np.sign(slope), (i, j)


def conjunctions(n, seed):
    """Toxic only if an insult and a group are mentioned; either alone is not."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"plain{r.randrange(40)}" for _ in range(8)] + ["vermin"] * a + ["islanders"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    return rows


def test_pairs_are_learned(spark):
    rows = conjunctions(1200, 3)
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], 1, x[2]) for x in rows], LABELS)
    model = learn(docs, labels, F.col("id") < 800, rounds=25)
    out = {r.doc_id: r["__tox_score"] for r in score(docs, model).collect()}
    held = [(out[i], y) for i, _, y in rows if i >= 800]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.97
    places = Terms(4, dict(zip(model.terms.tolist(), range(len(model.terms)))))
    of = lambda text: logistic(np.array([slow_raw(model, sorted(places.of(text)))]))[0]
    assert of("vermin plain1") < 0.5 and of("islanders plain1") < 0.5 < of("vermin of islanders")
    # the pair adds what the two weights do not: logit(both) - logit(a) - logit(b) + w0
    raw = lambda text: slow_raw(model, sorted(places.of(text)))
    assert raw("vermin islanders") - raw("vermin") - raw("islanders") + model.bias > 2


def test_held_out_stems(spark):
    """Insults that share a stem but seldom a word, in texts of many lengths."""
    r = random.Random(9)
    rows = []
    for i in range(900):
        toxic = i % 8 == 0
        text = prose(i, r.choice([5, 40, 200, 800]), 5000)
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), "GROBZU" + "".join(r.choice("aeiouklm") for _ in range(6)))
            text = " ".join(words)
        rows.append((i, text, int(toxic)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], 0, x[2]) for x in rows], LABELS)
    model = learn(docs, labels, F.col("id") % 3 != 0)
    out = {x.doc_id: x["__tox_score"] for x in score(docs, model).collect()}
    for i, _, y in rows:
        assert (out[i] >= 0.5) == (y == 1), (i, y, out[i])


def test_awkward_rows(docs, clashing, spark):
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(20)] + [(3, 1, 0), (3, 1, 0), (100, 1, 1), (101, None, None), (None, 0, 1), (102, 0, 7), (5000, 1, 1)], LABELS)
    model = learn(docs, labels, F.lit(True), min_ratio=2.0, min_rows=2)
    out = score(docs, model)
    scores = by_id(out, "doc_id", "__tox_score")
    assert len(scores) == docs.count() and all(0 <= s <= 1 for _, s in scores)
    empty = [s for i, s in scores if i in (100, 101, 102)]
    assert len(set(empty)) == 1 and abs(empty[0] - logistic(np.array([model.bias]))[0]) < 1e-12
    more = score(clashing, model)
    assert more.columns == [*clashing.columns, "__tox_score"] and by_id(more, "doc_id", "__tox_score") == scores
    again = learn(docs.repartition(3), labels.repartition(5), F.lit(True), min_ratio=2.0, min_rows=2)
    assert again.bias == model.bias and (again.numbers == model.numbers).all()


def test_one_class_or_none(docs, no_docs, spark):
    only = lambda y: spark.createDataFrame([(i, 0, y) for i in range(9)], LABELS)
    assert {s for _, s in by_id(score(docs, learn(docs, only(1), F.lit(True))), "doc_id", "__tox_score")} == {1.0}
    for model in (learn(docs, only(0), F.lit(True)), learn(no_docs, only(1), F.lit(True)), learn(docs, only(1), F.lit(False))):
        assert max(s for _, s in by_id(score(docs, model), "doc_id", "__tox_score")) < 1e-9
        assert score(no_docs, model).count() == 0


def test_the_sample_is_bounded(docs, spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(20)] * 3, LABELS)
    rows = toxicity.labelled_rows(docs, labels, F.lit(True), 7, "doc_id", "text", "toxic")
    assert {r.row for r in rows.collect()} <= {r.h for r in docs.select(F.xxhash64("doc_id").alias("h")).collect()}
    assert 3 <= rows.select("row").distinct().count() <= 7


def test_term_counts_by_loops(docs, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNT_ROWS", 50)
    rows = docs.filter("doc_id < 20").withColumn("label", (F.col("doc_id") % 2).cast("double"))
    want = {}
    for r in rows.collect():
        for t in Terms(4).of(r.text):
            a, b = want.get(t, (0, 0))
            want[t] = (a + int(r.label), b + 1)
    got = {r.term: (r.toxic, r.rows) for r in toxicity.term_counts(rows, 4).collect()}
    assert got == want
    assert len(word_terms("ab", 4)) == 2 and len(word_terms("ab", 9)) == 1 and len(word_terms("words", 4)) == 5


def test_the_ratio(spark):
    cases = [(a, b) for b in range(0, 13) for a in range(0, b + 1) if a <= 5 and b - a <= 9]
    df = spark.createDataFrame(cases, "toxic long, rows long")
    for r in df.withColumn("g", toxicity.ratio(F.col("toxic"), F.col("rows"), 5, 14)).collect():
        cells = {(1, 1): r.toxic, (1, 0): r.rows - r.toxic, (0, 1): 5 - r.toxic, (0, 0): 9 - r.rows + r.toxic}
        rows, cols = {1: r.rows, 0: 14 - r.rows}, {1: 5, 0: 9}
        want = 2 * sum(o * math.log(o * 14 / (rows[i] * cols[j])) for (i, j), o in cells.items() if o)
        assert abs(r.g - want) < 1e-9
