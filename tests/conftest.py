import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-test-ckpt-")})
    yield s


def ts(i, day=0, base="2024-01-02 10:00:00"):
    import datetime as dt
    b = dt.datetime.fromisoformat(base)
    return b + dt.timedelta(days=day, minutes=int(i))


@pytest.fixture
def make_trades(spark):
    """rows: (symbol, minute offset, seq, price, size[, day])"""
    def make(rows):
        data = []
        for r in rows:
            sym, i, seq, px, sz = r[:5]
            day = r[5] if len(r) > 5 else 0
            data.append((sym, ts(i, day), int(seq), float(px), float(sz)))
        return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, seq long, price double, size double")
    return make
