"""The adaptive trailing stop of one position, one bar at a time.

`pull` is the price that drags the stop along (a short's high, a long's low), `extreme` the one
the position hopes for (a short's low, a long's high). The controller is a moving average of
the pull; the further the extremes lie from it, measured in the instrument's usual deviation,
the faster the stop follows.
"""

import math
from dataclasses import astuple, dataclass, replace
from typing import NamedTuple

import numpy as np
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tickloom.operators.affine import Arrays, composed


class Bar(NamedTuple):
    start: object
    high: float
    low: float
    close: float
    trigger: bool
    position_type: str
    initial_stop_loss: float
    initial_controller: float
    avg_sd: float


@dataclass(frozen=True)
class Position:
    position_type: str
    position_time: object
    bars: int
    controller: float
    stop_loss: float
    constant: float
    squares: tuple[float, ...]

    def is_hit(self, close: float) -> bool:
        return close > self.stop_loss if self.position_type == "short" else close < self.stop_loss


class Columns(NamedTuple):
    """Bars of one series as lists of numbers."""

    high: list[float]
    low: list[float]
    close: list[float]
    avg_sd: list[float]


class Outcome(NamedTuple):
    position: Position | None
    exited: bool
    entered: bool


def _pull_and_extreme(kind: str, bar: Bar) -> tuple[float, float]:
    return (bar.high, bar.low) if kind == "short" else (bar.low, bar.high)


@dataclass(frozen=True)
class StopRule:
    """How a stop follows its position."""

    # Terms of the deviation, weight of a bar in the controller, the deviation
    # (in units of the usual one) from which the stop moves at the fast rate, and that rate.
    terms: int = 10
    controller_rate: float = 2 / 11
    ratio_limit: float = 9
    fast_rate: float = 0.9

    def lag_number(self, position: Position) -> int:
        return max(self.terms - position.bars, 0)

    def controller_sd(self, position: Position) -> float:
        """Deviation over always `terms` terms: bars not yet seen count as the first one did."""
        total = self.lag_number(position) * position.constant + sum(position.squares)
        return math.sqrt(total / self.terms)

    def rate(self, controller_sd: float, avg_sd: float | None) -> float:
        """How much of the distance to the pull the stop covers on a bar."""
        if avg_sd is None or avg_sd == 0 or math.isnan(avg_sd) or math.isnan(controller_sd):
            return self.fast_rate
        ratio = controller_sd / avg_sd
        if not ratio < self.ratio_limit:
            return self.fast_rate
        span = self.terms / ratio if ratio else math.inf
        return 0.0 if math.isinf(span) else 2 / (round(span) + 1)

    def open(self, kind: str, bar: Bar) -> Position:
        _, extreme = _pull_and_extreme(kind, bar)
        square = (extreme - bar.initial_controller) ** 2
        return Position(
            kind, bar.start, 1, bar.initial_controller, bar.initial_stop_loss, square, (square,)
        )

    def follow(self, position: Position, bar: Bar) -> Position:
        pull, extreme = _pull_and_extreme(position.position_type, bar)
        controller = position.controller + self.controller_rate * (pull - position.controller)
        moved = replace(
            position,
            bars=position.bars + 1,
            controller=controller,
            squares=(*position.squares, (controller - extreme) ** 2)[-self.terms :],
        )
        rate = self.rate(self.controller_sd(moved), bar.avg_sd)
        return replace(moved, stop_loss=position.stop_loss + rate * (pull - position.stop_loss))

    def run(self, position: Position, bars: "Columns", i: int, exits: bool) -> tuple[Position, int, list]:
        """Follow a position from bar i on, to the last bar or to the one that hits the stop (`exits`).

        The position after it, the bar that was not followed, and (controller, lag number,
        deviation, stop) of each bar that was: `follow` bar by bar, on plain numbers.
        """
        short = position.position_type == "short"
        pulls, extremes = (bars.high, bars.low) if short else (bars.low, bars.high)
        close, usual, n = bars.close, bars.avg_sd, len(pulls)
        controller, stop, seen = position.controller, position.stop_loss, position.bars
        constant, squares = position.constant, list(position.squares)
        terms, out = self.terms, []
        while i < n:
            if exits and (close[i] > stop if short else close[i] < stop):
                break
            pull = pulls[i]
            controller += self.controller_rate * (pull - controller)
            squares.append((controller - extremes[i]) ** 2)
            if len(squares) > terms:
                del squares[0]
            seen += 1
            lag = terms - seen if seen < terms else 0
            deviation = math.sqrt((lag * constant + sum(squares)) / terms)
            stop += self.rate(deviation, usual[i]) * (pull - stop)
            out.append((controller, lag, deviation, stop))
            i += 1
        moved = replace(
            position, bars=seen, controller=controller, stop_loss=stop, squares=tuple(squares)
        )
        return moved, i, out

    def rates(self, controller_sd: np.ndarray, avg_sd: np.ndarray) -> np.ndarray:
        """`rate` of many bars; NaN stands for what is missing."""
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = controller_sd / avg_sd
            span = self.terms / ratio
            moved = np.where(np.isinf(span), 0.0, 2 / (np.rint(span) + 1))
        return np.where((avg_sd != 0) & (ratio < self.ratio_limit), moved, self.fast_rate)

    def scan(self, bars: Arrays, place: np.ndarray, handed: Arrays | None) -> tuple[Arrays, Arrays]:
        """Controller, deviation and stop of every bar of many positions, as `follow` has them.

        `place` is a bar's place in its position; a position's first bar brings the initial values.
        The first position may have begun in the batch before, which handed over its end.
        """
        first = place == 0
        pull, extreme = bars["pull"], bars["extreme"]

        def scanned(step: np.ndarray | float, start: np.ndarray, last: str) -> np.ndarray:
            a = np.where(first, 0.0, 1 - step)
            b = np.where(first, start, step * pull)
            steps, value = composed(a, b, place)
            if handed:  # only rows of the position that goes on still depend on it
                value = value + np.where(steps == 0, 0.0, steps * handed[last])
            return value

        controller = scanned(self.controller_rate, bars["initial_controller"], "controller")
        square = (controller - extreme) ** 2
        constant, squares, deviation = self._deviations(square, place, handed)
        stop = scanned(self.rates(deviation, bars["avg_sd"]), bars["initial_stop_loss"], "stop_loss")
        out = {
            "controller": controller, "controller_constant": constant,
            "lag_number": np.maximum(self.terms - 1 - place, 0), "controller_sd": deviation, "stop_loss": stop,
        }
        return out, {c: out[c][-1] for c in ("controller", "controller_constant", "stop_loss")} | {"squares": squares}

    def _deviations(
        self, square: np.ndarray, place: np.ndarray, handed: Arrays | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each position's first square, the last squares of the batch, and `controller_sd` of each bar."""
        n, ahead = len(square), self.terms - 1
        earlier = handed["squares"] if handed else np.zeros(ahead)
        both = np.concatenate([earlier, square])
        begins = np.arange(n) - place  # of the bar's position, in this batch or before it
        known = handed["controller_constant"] if handed else 0.0
        constant = np.where(begins < 0, known, square[np.maximum(begins, 0)])
        total = np.maximum(self.terms - 1 - place, 0) * constant
        for k in range(ahead, -1, -1):  # oldest first, as the loop adds them
            total = total + np.where(place >= k, both[ahead - k : ahead - k + n], 0.0)
        return constant, both[len(both) - ahead :], np.sqrt(total / self.terms)

    def next_bar(self, position: Position | None, bar: Bar) -> Outcome:
        """Exit against the last stop, then entry if flat, then the stop's step if still open."""
        exited = position is not None and position.is_hit(bar.close)
        held = None if exited else position
        if held is not None:
            return Outcome(self.follow(held, bar), exited, False)
        if bar.trigger:
            return Outcome(self.open(bar.position_type, bar), exited, True)
        return Outcome(None, exited, False)


def position_state(time_type) -> StructType:
    """A position as a row; its size does not depend on how long the position is held."""
    return StructType(
        [
            StructField("position_type", StringType()),
            StructField("position_time", time_type),
            StructField("bars", LongType()),
            StructField("controller", DoubleType()),
            StructField("stop_loss", DoubleType()),
            StructField("constant", DoubleType()),
            StructField("squares", ArrayType(DoubleType())),
        ]
    )


def to_state(position: Position | None) -> dict | None:
    if position is None:
        return None
    names = [f.name for f in position_state(StringType())]
    return dict(zip(names, astuple(position))) | {"squares": list(position.squares)}


def from_state(state: dict | None) -> Position | None:
    if state is None:
        return None
    return Position(**(state | {"bars": int(state["bars"]), "squares": tuple(state["squares"])}))
