"""Small builders for the oracle SQL."""

from __future__ import annotations

STATS = {"mean": "avg", "min": "min", "max": "max", "median": "median", "std": "stddev_samp"}
KEYS = "experiment, participant_id"


def five(metric: str, expression: str, suffix: str = "", factor: str = "") -> str:
    tail = f"_{suffix}" if suffix else ""
    return ", ".join(f"round({fn}({expression}){factor}, 6) + 0.0::double as {metric}_{stat}{tail}" for stat, fn in STATS.items())


def rounded(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0::double as {c}" for c in columns)


def query(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select.strip()}"
