"""The factor library: ten price factors and seventeen fundamental ones.

A price factor is a column over a symbol's ordered bars; a fundamental factor a column over an as-of
row.  All are higher-is-better except volatility_20d.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, div, full_frame, mean_available

def by_symbol():
    """A symbol's rows in order; made when asked, since it needs a session."""
    return Window.partitionBy("symbol").orderBy("date")


@dataclass(frozen=True)
class Factor:
    name: str
    family: str
    lookback: int
    sign: int = 1


#: Name, family, rows of history.
PRICE = [
    Factor("momentum_20d", "momentum", 20), Factor("momentum_60d", "momentum", 60), Factor("volatility_20d", "volatility", 20, -1),
    Factor("risk_adjusted_momentum", "momentum", 60), Factor("reversal_5d", "reversal", 5), Factor("reversal_20d", "reversal", 20),
    Factor("low_volatility_score", "volatility", 20), Factor("growth_price_proxy", "growth", 60), Factor("quality_price_proxy", "quality", 60), Factor("value_price_proxy", "value", 120),
]
FUNDAMENTAL = [Factor(n, f, 20) for n, f in [
    ("pe_value_factor", "value"), ("pb_value_factor", "value"), ("ev_ebitda_factor", "value"), ("fundamental_value_score", "value"),
    ("roe_quality_factor", "quality"), ("roa_quality_factor", "quality"), ("gross_margin_factor", "quality"), ("net_margin_factor", "quality"), ("fundamental_quality_score", "quality"),
    ("revenue_growth_factor", "growth"), ("eps_growth_factor", "growth"), ("fundamental_growth_score", "growth"),
    ("debt_to_equity_factor", "health"), ("current_ratio_factor", "health"), ("quick_ratio_factor", "health"), ("fundamental_health_score", "health"), ("fundamental_composite_score", "composite"),
]]
REGISTRY = {f.name: f for f in PRICE + FUNDAMENTAL}
_added: dict[str, Callable[[], Column]] = {}


def register(factor: Factor, build: Callable[[], Column], replace: bool = False) -> None:
    """Make a price factor of one's own known to every step that takes a factor by name.

    ``build`` gives a column over the columns of the bars and ``ret``, the return since the row before; windows
    are ``by_symbol()``, which all factors share.  A name of the library's own is refused; one added before, unless ``replace``.
    """
    name = factor.name.strip()
    if name != factor.name.lower() or not name.isidentifier():
        raise ValueError(f"{factor.name!r} is no lower-case name")
    if factor.sign not in (1, -1) or factor.lookback < 0:
        raise ValueError(f"{name}: sign is 1 or -1, lookback not below 0")
    if name in REGISTRY and not (replace and name in _added):
        raise ValueError(f"factor {name} is known already")
    REGISTRY[name], _added[name] = factor, build


def unregister(name: str) -> None:
    """Forget an added factor; the library's own stay."""
    if name not in _added:
        raise ValueError(f"{name} is no added factor")
    del _added[name], REGISTRY[name]


def lag_return(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(by_symbol()) - 1


def price_factors(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """bars (symbol, date, close > 0) -> with one column a factor, added ones too; all windows share one shuffle."""
    names = names or [f.name for f in PRICE]
    d = bars.withColumn("ret", lag_return(1))
    vol20 = full_frame(F.stddev_samp("ret"), "ret", 20, by_symbol())
    m20, m60 = lag_return(20), lag_return(60)
    vol = F.when(vol20 > 0, vol20)
    frame60 = by_symbol().rowsBetween(-59, 0)
    up = F.avg((F.col("close") > F.lag("close", 1).over(by_symbol())).cast("double"))
    # the running peak and the deepest fall of the last 60 closes, in one fold
    closes = F.collect_list("close").over(frame60)
    fall = F.aggregate(closes, F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("low")), lambda a, c: F.struct(F.greatest(a["peak"], c).alias("peak"), F.least(a["low"], c / F.greatest(a["peak"], c) - 1).alias("low")), lambda a: a["low"])
    std60, mean60 = F.stddev_samp("ret").over(frame60), F.avg("ret").over(frame60)
    have60 = F.lag("close", 60).over(by_symbol()).isNotNull()
    if "growth_price_proxy" in names:
        d = d.withColumn("up", (F.col("ret") > 0).cast("double"))
        up = F.avg("up").over(by_symbol().rowsBetween(-19, 0))
    if "quality_price_proxy" in names:
        d = d.withColumn("pos", (F.col("ret") > 0).cast("double"))
    build = {
        "momentum_20d": lambda: m20, "momentum_60d": lambda: m60, "volatility_20d": lambda: vol,
        "risk_adjusted_momentum": lambda: div(m60, vol), "reversal_5d": lambda: -lag_return(5), "reversal_20d": lambda: -m20,
        "low_volatility_score": lambda: -vol,
        "growth_price_proxy": lambda: F.when(have60, 0.35 * m20 + 0.45 * m60 + 0.20 * up),
        "quality_price_proxy": lambda: F.when(have60 & (std60 > 0), div(mean60, std60) + F.avg("pos").over(frame60) + fall),
        "value_price_proxy": lambda: F.when(std60 > 0, div(-lag_return(120), std60)),
        **_added,
    }
    return d.select("symbol", "date", "close", *[build[n]().alias(n) for n in names])


def yield_of(c: str) -> Column:
    return F.when(F.col(c) > 0, 1 / F.col(c))


def liquidity_score(c: str, target: float) -> Column:
    """0 within one of the target, falling beyond; NULL unless positive."""
    gap = F.abs(F.col(c) - target)
    return F.when(F.col(c) > 0, F.when(gap <= 1, 0.0).otherwise(-(gap - 1)))


def fundamental_columns() -> dict[str, Column]:
    c = F.col
    value = [yield_of("pe_ratio"), yield_of("pb_ratio"), yield_of("ev_to_ebitda")]
    quality = [c("roe"), c("roa"), c("gross_margin"), c("net_margin")]
    growth = [clip(c("revenue_growth"), -1.0, 2.0), clip(c("eps_growth"), -1.0, 2.0)]
    health = [F.when(c("debt_to_equity") >= 0, -c("debt_to_equity")), liquidity_score("current_ratio", 2.0), liquidity_score("quick_ratio", 1.0)]
    scores = [mean_available(value, 2), mean_available(quality, 2), mean_available(growth, 2), mean_available(health, 2)]
    names = [f.name for f in FUNDAMENTAL]
    return dict(zip(names, [*value, scores[0], *quality, scores[1], *growth, scores[2], *health, scores[3], mean_available(scores, 3)]))


def fundamental_factors(known: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows that hold an as-of fundamental row -> with one column a factor."""
    cols = fundamental_columns()
    return known.select("symbol", "date", *[cols[n].alias(n) for n in names or cols])
