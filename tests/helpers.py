"""Small random series and comparison of results."""

import random
from datetime import datetime, timedelta

import pandas as pd

BAR_SCHEMA = (
    "symbol string, instrument_token long, start timestamp_ntz, open double, high double, "
    "low double, close double, avg_sd double"
)


def random_bars(spark, symbols=3, bars=120, seed=7, gap_days=4.0, avg_sd=1.0):
    """Prices walk; gaps between bars run from minutes to days."""
    rng = random.Random(seed)
    rows = []
    for token in range(symbols):
        at, price = datetime(2024, 1, 1, 9, 15), 100.0
        for _ in range(rng.randint(bars // 2, bars)):
            at += timedelta(minutes=1) if rng.random() < 0.6 else timedelta(days=rng.random() * gap_days)
            at = at.replace(second=0, microsecond=0) + timedelta(minutes=1)
            first = price
            price += rng.gauss(0, 2)
            rows.append(
                (f"S{token}", token, at, first, max(first, price) + rng.random(),
                 min(first, price) - rng.random(), price, avg_sd)
            )
    rng.shuffle(rows)
    return spark.createDataFrame(rows, BAR_SCHEMA)


def frame(df, keys=("symbol", "start")) -> pd.DataFrame:
    rows = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    return rows.sort_values(list(keys)).reset_index(drop=True)


def assert_same(left, right, keys=("symbol", "start")) -> None:
    a, b = frame(left, keys), frame(right, keys)
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False, rtol=1e-9)
