"""The queries over series again, cut into blocks of a few days: same SQL, so the same rows."""

from tickloom.testbed import batch_queries, state_queries, stream_queries
from tickloom.testbed import tables as t
from tickloom.testbed.registry import ORACLE, QUERIES

assert batch_queries and state_queries and stream_queries  # imported for their registrations

DAYS = 7

CUT = [
    "rolling_std", "rolling_mean", "rolling_sum", "running_sum", "lag_prev", "countdown", "forward_fill",
    "ema_fold", "swing_segments", "reversal_signal", "reversal_signal_gaps", "signals_bar_by_bar",
    "breakout_scan", "trailing_stop", "position_lifecycle",
]


def _cut(name: str):
    whole = QUERIES[name]

    def build(spark, folder):
        with t.days_per_block(DAYS):
            if t.blocks(spark, folder).is_single:
                raise ValueError("the data fits one block")
            return whole(spark, folder)

    return build


for _name in CUT:
    QUERIES[f"{_name}_in_blocks"] = _cut(_name)
    ORACLE[f"{_name}_in_blocks"] = ORACLE[_name]
