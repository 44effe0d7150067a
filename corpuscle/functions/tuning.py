"""Acceptance tuning of a step width: a ring buffer of outcomes, an adjustment each time that it wraps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def advance(state: dict, outcome: float) -> dict:
    """One outcome: stored in the ring; on the wrap, too high a mean widens the step and too low a one narrows it."""
    history, i = list(state["history"]), state["idx"]
    history[i] = outcome
    i = (i + 1) % len(history)
    value = state["value"]
    if i == 0:
        mean = sum(history) / len(history)
        if abs(mean - state["target"]) > state["tolerance"]:
            value = value * state["multiplicity"] if mean > state["target"] else value / state["multiplicity"]
            value = min(max(value, state["lower"]), state["upper"])
    return state | {"history": history, "idx": i, "value": value}


def initial(value: float = 1.0, length: int = 100, multiplicity: float = 1.1, target: float = 0.5, tolerance: float = 0.02, lower: float = 1e-6, upper: float = 1e6) -> dict:
    return {"value": value, "multiplicity": multiplicity, "target": target, "tolerance": tolerance, "lower": lower, "upper": upper, "history": [0.0] * length, "idx": 0}


def tuned(outcomes: DataFrame, length: int = 100, value: float = 1.0) -> DataFrame:
    """Width after each outcome (system_id, step, acceptance): one system's series is one task's group, in step order."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, widths = initial(value, length), []
        for x in pdf.sort_values("step").acceptance:
            state = advance(state, float(x))
            widths.append(state["value"])
        return pd.DataFrame({"system_id": pdf.system_id.to_numpy(), "step": pdf.step.sort_values().to_numpy(), "width": widths})

    return outcomes.select("system_id", "step", "acceptance").groupBy("system_id").applyInPandas(run, "system_id long, step long, width double")


def stream_tuner(length: int = 100, value: float = 1.0):  # noqa: ANN201
    """The same for a stream: a function for ``applyInPandasWithState``; rows of a batch are taken in step order."""
    def run(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.exists:
            v, i, history = state.get
            now = initial(value, length) | {"value": v, "idx": i, "history": list(history)}
        else:
            now = initial(value, length)
        rows = pd.concat(list(batches)).sort_values("step")
        widths = []
        for x in rows.acceptance:
            now = advance(now, float(x))
            widths.append(now["value"])
        state.update((now["value"], now["idx"], now["history"]))
        yield pd.DataFrame({"system_id": key[0], "step": rows.step.to_numpy(), "width": widths})

    return run


STATE = "value double, idx int, history array<double>"
WIDTHS = "system_id long, step long, width double"
