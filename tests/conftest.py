from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from eventframe.session import local_session  # noqa: E402

EVENT_SCHEMA = "event string, _time bigint, seq bigint, _cpu int, _pid bigint, _tid bigint"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """events([(event, time, tid[, cpu]), ...]): arrival number is the position."""
    def events(rows):
        data = [(r[0], r[1], i, r[3] if len(r) > 3 else 0, r[2], r[2]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, EVENT_SCHEMA)
    return events


def random_events(seed: int, n: int, names: str, keys: int, hot: float = 0.4, span: int | None = None):
    """Random (event, time, tid, cpu) with ties in time; key 0 holds a large share of the rows."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(span or n) for _ in range(n))
    return [(rng.choice(names), t, 0 if rng.random() < hot else rng.randrange(keys), rng.randrange(3)) for t in times]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))
