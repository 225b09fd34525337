"""Derived metrics: one declarative table, one envelope.

Each metric is a formula over named inputs. Missing is not zero: a missing
required input or a zero denominator gives NULL; only inputs declared optional
count as zero, with a caveat. The envelope carries formula, inputs, caveats and
what is missing, so every derived number can be traced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """``plus`` and ``minus`` are summed, then divided by ``over`` (if any).

    ``instead`` is another way to the same metric, taken where the first input is missing.
    """

    name: str
    formula: str
    plus: tuple[str, ...]
    minus: tuple[str, ...] = ()
    over: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    instead: Metric | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.plus + self.minus + self.over))


# The metrics and their formulas.
METRICS = (
    Metric("gross_margin", "gross_profit / revenue", ("gross_profit",), (), ("revenue",), (), Metric("gross_margin", "(revenue - cogs) / revenue", ("revenue",), ("cogs",), ("revenue",))),
    Metric("operating_margin", "operating_income / revenue", ("operating_income",), (), ("revenue",)),
    Metric("net_margin", "net_income / revenue", ("net_income",), (), ("revenue",)),
    Metric("ebitda_margin", "(operating_income + dna) / revenue", ("operating_income", "dna"), (), ("revenue",)),
    Metric("roe", "net_income / equity", ("net_income",), (), ("equity",)),
    Metric("roa", "net_income / assets", ("net_income",), (), ("assets",)),
    Metric("asset_turnover", "revenue / assets", ("revenue",), (), ("assets",)),
    Metric("current_ratio", "assets_current / liabilities_current", ("assets_current",), (), ("liabilities_current",)),
    Metric("quick_ratio", "(assets_current - inventory) / liabilities_current", ("assets_current",), ("inventory",), ("liabilities_current",), ("inventory",)),
    Metric("debt_to_equity", "(debt + short_term_debt) / equity", ("debt", "short_term_debt"), (), ("equity",)),
    Metric("debt_to_ebitda", "(debt + short_term_debt) / (operating_income + dna)", ("debt", "short_term_debt"), (), ("operating_income", "dna")),
    Metric("net_debt", "debt + short_term_debt - cash", ("debt", "short_term_debt"), ("cash",)),
    Metric("fcf", "operating_cash_flow - capex", ("operating_cash_flow",), ("capex",)),
    Metric("fcf_margin", "(operating_cash_flow - capex) / revenue", ("operating_cash_flow",), ("capex",), ("revenue",)),
    Metric("ebitda", "operating_income + dna", ("operating_income", "dna")),
    Metric("tangible_book_value", "equity - goodwill - intangibles", ("equity",), ("goodwill", "intangibles"), (), ("goodwill", "intangibles")),
    Metric("working_capital", "assets_current - liabilities_current", ("assets_current",), ("liabilities_current",)),
    Metric("bvps", "equity / shares", ("equity",), (), ("shares",)),
    Metric("fcf_per_share", "(operating_cash_flow - capex) / shares", ("operating_cash_flow",), ("capex",), ("shares",)),
    Metric("sales_per_share", "revenue / shares", ("revenue",), (), ("shares",)),
)
BY_NAME = {m.name: m for m in METRICS}


def value(metric: Metric, columns: dict[str, Column] | None = None) -> Column:
    """The metric's value from columns named as its inputs (or given by name)."""

    def of(name: str) -> Column:
        col = (columns or {}).get(name, F.col(name))
        return F.coalesce(col, F.lit(0.0)) if name in metric.optional else col

    def total(plus: tuple[str, ...], minus: tuple[str, ...] = ()) -> Column:
        out = of(plus[0])
        for name in plus[1:]:
            out = out + of(name)
        for name in minus:
            out = out - of(name)
        return out

    top = total(metric.plus, metric.minus)
    got = F.try_divide(top, total(metric.over)) if metric.over else top
    return F.when(of(metric.plus[0]).isNull(), value(metric.instead, columns)).otherwise(got) if metric.instead else got


def envelope(metric: Metric) -> Column:
    """struct metric, value, formula, inputs, caveats, missing_inputs."""
    if metric.instead:
        first = replace(metric, instead=None)
        return F.when(F.col(metric.plus[0]).isNull(), envelope(metric.instead)).otherwise(envelope(first))
    inputs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in metric.inputs])
    lacks = lambda n, text: F.when(F.col(n).isNull(), F.lit(text))
    required = [n for n in metric.inputs if n not in metric.optional]
    missing = F.array_compact(F.array(*[lacks(n, n) for n in required]))
    caveats = F.array_compact(F.array(*[lacks(n, f"{n} not reported; taken as 0") for n in metric.optional])) if metric.optional else F.array().cast("array<string>")
    return F.struct(
        F.lit(metric.name).alias("metric"), value(metric).cast("double").alias("value"), F.lit(metric.formula).alias("formula"),
        inputs.alias("inputs"), caveats.alias("caveats"), missing.alias("missing_inputs"),
    )
