"""Pass/fail gates over aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateledger.operators.metrics import percentiles

_RULE = re.compile(r"p(\d{1,3})\s*=\s*(\d+(?:\.\d+)?)\s*(ms|us|μs|s)", re.IGNORECASE)
_SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "μs": 1e-6}


@dataclass(frozen=True)
class GateRule:
    percent: int
    seconds: float


def parse_gate(spec: str) -> list[GateRule]:
    """``p95=10ms,p99=0.02s``; the unit is required, the percentile is 1..99."""
    rules = []
    for token in filter(None, (t.strip() for t in (spec or "").split(","))):
        match = _RULE.fullmatch(token)
        if not match:
            raise ValueError(f"invalid gate rule {token!r}")
        percent = int(match[1])
        if not 1 <= percent <= 99:
            raise ValueError(f"percentile out of range in {token!r}")
        rules.append(GateRule(percent, float(match[2]) * _SECONDS[match[3].lower()]))
    return rules


def apply_gate(samples: DataFrame, value: str, rules: list[GateRule]) -> DataFrame:
    """(percent, limit_seconds, observed, passed), one row per rule."""
    wanted = sorted({r.percent for r in rules})
    seen = percentiles(samples, [], value, wanted)
    rows = F.array(*[
        F.struct(
            F.lit(r.percent).alias("percent"), F.lit(r.seconds).alias("limit_seconds"),
            F.col(f"p{r.percent}").alias("observed"),
            (F.col(f"p{r.percent}") <= r.seconds).alias("passed"),
        )
        for r in rules
    ])
    return seen.select(F.inline(rows))


def integrity_gate(breaks: DataFrame) -> bool:
    """Fails as soon as one break exists."""
    return breaks.isEmpty()


def scanner_gate(quality: DataFrame) -> bool:
    """Fails when an attack got through or a benign text was refused."""
    return quality.where("caught < attacks or false_positives > 0").isEmpty()
