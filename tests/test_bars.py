import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.bars import dollar_bars, tick_bars, tick_rule, volume_bars


def loop_bars(v, thr):
    out, cur, last = [], 0.0, 0
    for i, x in enumerate(v):
        cur += x
        if cur >= thr:
            out.append((last, i))
            cur, last = 0.0, i + 1
    return out


def test_tick_bars_drop_last_full_bar(make_trades):
    t = make_trades([("A", i, i, i + 1, 1) for i in range(6)])
    b = tick_bars(t, 2).orderBy("bar").collect()
    assert [(r.open, r.close) for r in b] == [(1.0, 2.0), (3.0, 4.0)]


def test_dollar_bars_fixture(make_trades):
    t = make_trades([("A", i, i, 10, v) for i, v in enumerate([1, 2, 1, 3])])
    b = dollar_bars(t, 25).orderBy("bar").collect()
    assert [r.volume for r in b] == [3.0, 4.0]
    assert b[0].time is None or b[0].time.minute == 0  # time = tick before the closing tick
    assert b[1].time.minute == 2


def test_threshold_bars_match_loop_across_days(spark, make_trades):
    rng = np.random.default_rng(3)
    rows = []
    for sym in ["A", "B"]:
        for i in range(600):
            rows.append((sym, i * 7, i, float(rng.uniform(1, 50)), float(rng.integers(1, 20)), i // 40))
    t = make_trades(rows)
    for thr in [300.0, 2500.0, 40000.0]:
        for parts in [1, 8]:
            got = dollar_bars(t.repartition(parts), thr).orderBy("symbol", "bar").toPandas()
            for sym in ["A", "B"]:
                pdf = pd.DataFrame([r for r in rows if r[0] == sym], columns=["s", "i", "seq", "p", "v", "d"])
                exp = loop_bars((pdf.p * pdf.v).to_numpy(), thr)
                g = got[got.symbol == sym]
                assert len(g) == len(exp)
                assert list(g.ticks) == [b - a + 1 for a, b in exp]


def test_volume_bars_single_row_and_empty(make_trades, spark):
    t = make_trades([("A", 0, 0, 5, 10)])
    assert volume_bars(t, 5).count() == 1
    assert volume_bars(t.where(F.lit(False)), 5).count() == 0


def test_tick_rule_fixture(make_trades):
    t = make_trades([("A", i, i, p, 1) for i, p in enumerate([5, 5, 6, 6, 4])])
    r = [x.price_diff for x in tick_rule(t).orderBy("seq").collect()]
    assert r == [1, 1, 1, 1, -1]


def test_cusum_day_split_matches_loop(spark, make_trades):
    from tessera.operators.filters import cusum_events
    rng = np.random.default_rng(5)
    rows = []
    for sym in ["A", "B"]:
        p = 100.0
        for i in range(800):
            p += float(rng.normal())
            rows.append((sym, i * 20, i, p, 1.0, i // 70))
    t = make_trades(rows).select("symbol", F.col("ts").alias("time"), "seq", F.col("price").alias("close"))
    for h in [0.7, 3.0, 25.0]:
        got = cusum_events(t.repartition(3), h).orderBy("symbol", "time").toPandas()
        for sym in ["A", "B"]:
            x = np.diff([r[3] for r in rows if r[0] == sym])
            pos = neg = 0.0
            exp = []
            for i, dx in enumerate(x):
                pos, neg = max(0.0, pos + dx), min(0.0, neg + dx)
                if neg < -h:
                    neg = 0.0
                    exp.append((i + 1, -1))
                elif pos > h:
                    pos = 0.0
                    exp.append((i + 1, 1))
            g = got[got.symbol == sym]
            assert list(g.side) == [s for _, s in exp]


def test_imbalance_bars_daily_reset_stays_in_day(make_trades):
    from tessera.operators.bars import imbalance_bars
    rng = np.random.default_rng(8)
    rows = [("A", i * 30, i, float(50 + rng.normal()), float(rng.integers(1, 9)), i // 48) for i in range(480)]
    t = make_trades(rows)
    whole = imbalance_bars(t, 10.0).toPandas()
    daily = imbalance_bars(t, 10.0, daily_reset=True).toPandas()
    assert whole.tick_count.sum() == 480 and daily.tick_count.sum() == 480
    days = t.select(F.to_date("ts").alias("d")).distinct().count()
    assert len(daily) >= days  # every day closes its own bars (the last one as a tail)


def _imbalance_loop(rows, start, needs):
    """Bars of one key, tick by tick; rows (ts, price, size, x)."""
    out, bar, length, total = [], None, float(start), 0.0
    for (t, px, sz, x), need in zip(rows, needs):
        if bar is None:
            bar = [t, px, px, px, px, 0.0, 0]
        bar = [t, bar[1], px, max(bar[3], px), min(bar[4], px), bar[5] + sz, bar[6] + 1]
        total += x
        if bar[6] > 2 and abs(total) >= need * length:
            out.append(bar)
            length, total, bar = 0.1 * length + 0.9 * bar[6], 0.0, None
    return out + ([bar] if bar else [])


@pytest.mark.parametrize("warm", [0, 16, 128])
def test_imbalance_bars_over_many_chunks(spark, make_trades, warm):
    """One symbol of ten chunks and more, another of one: the bars of a single pass, whatever the warm rows."""
    from tessera.operators.bars import ORDER, imbalance_bars, imbalance_thresholds
    from tessera.plans import ewm as E
    rng = np.random.default_rng(3)
    t = make_trades([(s, i, i, float(np.round(20 + rng.normal(0, 0.3), 2)), float(rng.integers(1, 9))) for s, n in (("A", 1350), (None, 1350), ("B", 60), ("C", 128)) for i in range(n)])
    got = {}
    for r in imbalance_bars(t, 5.0, chunk_rows=128, warm_rows=warm).collect():
        got.setdefault(r.symbol, []).append((r.group, r.time, r.open, r.close, r.high, r.low, r.volume, r.tick_count))
    d = E.ewm(imbalance_thresholds(t, ewm=True), ["symbol"], list(ORDER), "log_dollars_exchanged", out_std="_sd", alpha=0.01).toPandas().sort_values(["ts", "seq"])
    assert set(got) == {"A", "B", "C", None}
    for s, bars in got.items():
        own = d[d.symbol.isna()] if s is None else d[d.symbol == s]
        x = own.log_dollars_exchanged.fillna(0.0)
        need = own.expected_log_dollars_exchanged.fillna(0.0).abs() + 0.1 * own["_sd"].fillna(0.0)
        want = _imbalance_loop(list(zip(own.ts, own.price, own["size"], x)), 5.0, list(need))
        assert [b[0] for b in sorted(bars)] == list(range(len(want)))
        assert [tuple(b[1:]) for b in sorted(bars)] == [tuple(w) for w in want] and len(want) > (20 if s in ("A", None) else 0)


def test_a_chunk_carries_bars_on():
    """A run of ticks cut anywhere, state handed on, gives the bars of one run."""
    from tessera.operators.bars import _imbalance_chunk
    rng = np.random.default_rng(8)
    cols = [rng.uniform(5, 9, 700), rng.integers(1, 5, 700).astype(float), rng.normal(0, 1, 700), rng.uniform(0, 0.4, 700)]
    fresh = (6.0, 0.0, 0.0, np.inf, np.inf, np.inf, 0.0)
    whole = _imbalance_chunk(*cols, fresh)
    for cuts in ([1, 2, 3], [350], [10, 200, 201, 699], list(range(1, 700, 7))):
        ends, closed, state = [], [], fresh
        for a, b in zip([0, *cuts], [*cuts, 700]):
            e, c, state = _imbalance_chunk(*(x[a:b] for x in cols), state)
            ends += [a + k for k in e]
            closed += c
        assert (ends, closed, state) == whole
