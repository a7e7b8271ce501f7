"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and its words' distinct character n-grams (`<` and `>` mark a word's
ends), by 32-bit hashes: n-grams know an insult by its stem, whatever its ending. A factorization machine scores

    w0 + sum of w_i + sum over pairs of <v_i, v_j>    (i, j: the text's terms, each once, whatever the length)

in time linear in the terms, as the pairs' sum is half of |sum v_i|^2 - sum |v_i|^2. The factors v learn what two
terms mean together, such as an insult with the mention of a group: no additive weights can.

Fitting. The labelled rows that may be learned from are a bounded sample: all of them up to `max_rows`, beyond
that those with the smallest hashes. The sample's ids and labels, not the texts, go to all tasks. These
take out the terms, and their counts among rows of either label give each term's likelihood ratio (G^2); terms in
`min_rows` rows or more whose ratio is `min_ratio` or more, at most the `max_terms` highest, make the model.
Terms that count only together are found so as well, as rows that hold both raise either's ratio. One
task fits the machine to the sample's rows, now a few numbers each, by AdaGrad on the logistic loss with soft
thresholds, in rounds in a seeded order. The model is `max_terms` x (factors + 1) numbers at most; it goes to
all tasks, which score every row's whole text.

Defined cases: a null or empty text has no terms, its score is that of w0; labels that are neither 0 nor 1,
null ids and ids without a document are not learned from; repeated labels and repeated rows count each; without rows of
both classes the score is their share (0 without any); an empty table gives an empty result. Very long texts
are read whole. Other columns stay and are not read; names that begin with `__tox_` are reserved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import shared_table

TERM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words whose terms a task remembers; the table starts again when full.
TABLE_WORDS = 500_000
#: Terms of rows that a task counts at once.
COUNT_ROWS = 2_000_000
#: Rows scored at once.
SLICE = 512


def word_terms(word: str, gram: int) -> set[int]:
    """Hashes of a word and its n-grams."""
    import xxhash
    marked = f"<{word}>"
    return {xxhash.xxh32_intdigest(g) for g in (word, *(marked[i:i + gram] for i in range(len(marked) - gram + 1)))}


class Terms:
    """Distinct terms of texts; with `places`, a model's terms by hash, the places of those that the model has."""

    def __init__(self, gram: int, places: dict[int, int] | None = None):
        self.gram, self.places, self.known = gram, places, {}

    def of(self, text: str | None) -> set[int]:
        words = set(TERM_WORD.findall((text or "").translate(LOWER)))
        new = words.difference(self.known)
        if len(self.known) + len(new) > TABLE_WORDS:
            self.known.clear()
            new = words
        for w in new:
            found = word_terms(w, self.gram)
            if self.places is not None:
                found = {self.places[h] for h in found if h in self.places}
            self.known[w] = found or None
        return set().union(*filter(None, map(self.known.__getitem__, words)))


# ---------------------------------------------------------------- the model
@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    numbers: np.ndarray  # of each term its weight, then its factors
    gram: int

    def score(self, term: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities of rows of `lengths` places each."""
        return logistic(_forward(self.bias, self.numbers[term], lengths)[0])


def _row_sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive rows, which may be empty."""
    out = np.zeros((len(lengths), *x.shape[1:]), x.dtype)
    some = lengths > 0
    if some.any():
        starts = np.cumsum(lengths) - lengths
        out[some] = np.add.reduceat(x, starts[some], axis=0)
    return out


def _forward(bias: float, own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw scores, sums of factors) of rows, from their terms' numbers."""
    own = own.astype(float)
    sums, f = _row_sums(own, lengths), own[:, 1:]
    return bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - _row_sums((f * f).sum(axis=1), lengths)), sums[:, 1:]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700, dtype=float)))


def fit(term: np.ndarray, lengths: np.ndarray, label: np.ndarray, terms: int, factors: int = 4, rounds: int = 15, batch: int = 64, rate: float = 0.1, l1: float = 1e-4, seed: int = 7):
    """(bias, weights, factors) of a machine for rows of places below `terms`; `label` is 0 or 1.

    A term whose numbers have all been shrunk to nil is left out of the rounds that follow."""
    rng = np.random.default_rng(seed)
    share = label.mean()
    bias = float(np.log(share / (1 - share)))
    all_numbers, alive = np.zeros((terms, 1 + factors), np.float32), np.arange(terms)  # weight, then factors
    numbers = np.column_stack((np.zeros(terms), rng.normal(0, 0.01, (terms, factors)))).astype(np.float32)
    squares = np.full(numbers.shape, 1e-8, np.float32)
    for turn in range(rounds):
        order, ends = rng.permutation(len(label)), np.cumsum(lengths)
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            n = lengths[rows]
            t = np.concatenate([term[ends[i] - lengths[i]:ends[i]] for i in rows])
            by = np.argsort(t, kind="stable")
            used, first = np.unique(t[by], return_index=True)
            own = numbers[t]
            raw, sums = _forward(bias, own, n)
            off = (logistic(raw) - label[rows]) / len(rows)
            bias -= rate * float(off.sum())
            if not len(t):
                continue
            slope = np.repeat(np.column_stack((np.ones(len(n)), sums)), n, axis=0)
            slope[:, 1:] -= own[:, 1:]
            step = np.add.reduceat((slope * np.repeat(off, n)[:, None])[by], first, axis=0).astype(np.float32)
            squares[used] += step * step
            pace = rate / np.sqrt(squares[used])
            numbers[used] = shrink(numbers[used] - pace * step, pace * l1)
        live = (numbers != 0).any(axis=1)
        if turn and live.mean() < 0.8:
            stays, place = live[term], np.cumsum(live) - 1
            lengths = _row_sums(stays.astype(np.int64), lengths)
            term, numbers, squares, alive = place[term[stays]], numbers[live], squares[live], alive[live]
    all_numbers[alive] = numbers
    return bias, all_numbers


def shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


# ---------------------------------------------------------------- rows
def labelled_rows(df: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(row, label, text) of the sample; `may_learn` is a condition on `id`."""
    kind = df.schema[id_col].dataType
    one = labels.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id is not null and label in (0, 1)").filter(may_learn)
    one = shared_table(one.withColumn("row", F.xxhash64("id")).orderBy("row", "id", "label").limit(max_rows), "toxic-labels")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(one), "id").select("row", "label", "text")  # max_rows rows of three numbers


def term_counts(rows: DataFrame, gram: int) -> DataFrame:
    """(term, toxic, rows): the sample rows that hold each term."""
    def run(batches):
        terms, held, size = Terms(gram), [], 0
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1)):
                # the label is the lowest bit
                held.append(np.fromiter(terms.of(x.as_py()), np.int64) * 2 + int(y))
                size += len(held[-1])
                if size > COUNT_ROWS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(np.where(key & 1, n, 0)), pa.array(n)], ["term", "toxic", "rows"])

    found = rows.select("label", "text").mapInArrow(run, "term long, toxic long, rows long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))


def ratio(toxic: Column, rows: Column, all_toxic: int, all_rows: int) -> Column:
    """G^2 of a term's presence and the label."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    t, n = F.lit(float(all_toxic)), F.lit(float(all_rows))
    return 2 * (part(toxic, rows * t / n) + part(rows - toxic, rows * (n - t) / n) + part(t - toxic, (n - rows) * t / n) + part(n - t - rows + toxic, (n - rows) * (n - t) / n))


def places_of(rows: DataFrame, gram: int, places: dict[int, int]) -> DataFrame:
    """(row, label, places) of the sample: the model's terms in each."""
    def run(batches):
        terms = Terms(gram, places)
        for b in batches:
            found = [sorted(terms.of(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["row", "label", "places"])

    return rows.mapInArrow(run, "row long, label double, places array<int>")


def learn(df: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = 20_000, max_terms: int = 1 << 16, min_rows: int = 5, min_ratio: float = 15.0,
          gram: int = 4, factors: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **fit_options) -> Model:
    """The machine learned from `labels` (id, label) of rows of `df`; `may_learn` is a condition on `id`."""
    rows = labelled_rows(df, labels, may_learn, max_rows, id_col, text_col, label_col)
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    toxic = toxic or 0.0
    if toxic in (0, n):
        share = toxic / n if n else 0.0
        return Model(np.zeros(0, np.int64), float("inf") if share else float("-inf"), np.zeros((0, 2), np.float32), gram)
    score = ratio(F.col("toxic"), F.col("rows"), int(toxic), n)
    best = term_counts(rows, gram).filter(F.col("rows") >= min_rows).withColumn("ratio", score).filter(F.col("ratio") >= min_ratio)
    terms = np.array(sorted(r.term for r in best.orderBy(F.desc("ratio"), "term").limit(max_terms).select("term").collect()), np.int64)
    held = shared_table(places_of(rows, gram, dict(zip(terms.tolist(), range(len(terms))))), "toxic-places")

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("places").combine_chunks()
        flat, sizes = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
        row, y = table.column("row").to_numpy(), table.column("label").to_numpy()
        # rows in an order that does not depend on the tasks
        starts = np.cumsum(sizes) - sizes
        keys = [flat[a:a + k].tobytes() for a, k in zip(starts, sizes)]
        order = sorted(range(len(row)), key=lambda i: (row[i], y[i], keys[i]))
        cut = [flat[starts[i]:starts[i] + sizes[i]] for i in order]
        bias, numbers = fit(np.concatenate(cut), sizes[order].astype(np.int64), y[order], len(terms), factors, **fit_options)
        return pa.table([pa.array([bias]), pa.array([numbers.tobytes()], pa.binary())], ["bias", "numbers"])

    made = held.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(run, "bias double, numbers binary").first()  # max_rows rows
    return Model(terms, made.bias, np.frombuffer(made.numbers, np.float32).reshape(len(terms), factors + 1), gram)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with `__tox_score`, from 0 to 1."""
    schema = StructType([*df.schema.fields]).add("__tox_score", DoubleType())
    at, names = df.columns.index(text_col), schema.names

    def run(batches):
        terms = Terms(model.gram, dict(zip(model.terms.tolist(), range(len(model.terms)))))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                found = [sorted(terms.of(x.as_py())) for x in b.column(at)]
                lengths = np.array([len(x) for x in found], np.int64)
                flat = np.concatenate([np.array(x, np.int64) for x in found])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(flat, lengths), pa.float64())], names)

    return df.mapInArrow(run, schema)
