"""Cross-sectional features, percentiles, component scores, classification and the balance-sheet model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.exprs import clamp, codes, flag, ladder, rounded, safe_div, weighted_mean

from .ranks import average_rank

# Bounds of each feature (valid from, valid to, winsorised from, winsorised to).
BOUNDS = {
    "return_30d": (-1.0, 5.0, -0.75, 2.0),
    "return_90d": (-1.0, 10.0, -0.85, 3.0),
    "annualized_volatility": (0.0, 5.0, 0.0, 2.0),
    "max_drawdown_1y": (-1.0, 0.0, -1.0, 0.0),
    "earnings_yield": (-5.0, 5.0, -0.5, 0.5),
    "sales_yield": (0.0, 20.0, 0.0, 5.0),
    "liabilities_to_assets": (0.0, 10.0, 0.0, 2.0),
    "revenue_growth": (-5.0, 10.0, -1.0, 3.0),
    "net_margin": (-10.0, 10.0, -2.0, 2.0),
    "net_margin_trend": (-10.0, 10.0, -1.0, 1.0),
}
# Features and weights of each component.
WEIGHTS = {
    "value": {"earnings_yield": 0.60, "sales_yield": 0.40},
    "quality": {"net_margin": 0.45, "revenue_growth": 0.30, "net_margin_trend": 0.25},
    "momentum": {"return_90d": 0.60, "return_30d": 0.40},
    "market_risk": {"max_drawdown_1y": 0.55, "annualized_volatility": 0.45},
    "balance_risk": {"liabilities_to_assets": 1.0},
}
#: A higher value of these is better although the component measures risk.
INVERTED = {"max_drawdown_1y"}


def winsorized(f: str) -> Column:
    return F.round(clamp(f, *BOUNDS[f][2:]), 8)


def range_warnings() -> Column:
    """Names of the features outside their valid range."""
    return F.array_compact(F.array(*[F.when(~F.col(f).between(lo, hi), F.lit(f)) for f, (lo, hi, _, _) in BOUNDS.items()]))


def percentiles(features: DataFrame, key: str = "ticker", within: tuple[str, ...] = ()) -> DataFrame:
    """(key, within, feature, value, winsor, pct) in long form: each feature of each ``within`` (few, as dates are) is ranked apart, none by one task."""
    long = features.select(key, *within, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), winsorized(f).alias("winsor")) for f in BOUNDS])))
    return average_rank(long, "winsor", [*within, "feature"], "pct")


def wide_percentiles(features: DataFrame, key: str = "ticker", within: tuple[str, ...] = ()) -> DataFrame:
    """Features and their percentiles (p_ columns), both folded back from the long form."""
    wide = percentiles(features, key, within).groupBy(key, *within).agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(n) for f in BOUNDS for c, n in (("value", f), ("pct", f"p_{f}"))])
    return wide


def component(name: str, weights: dict | None = None) -> Column:
    """Weighted mean of the component's percentiles in 0..100, over those present."""
    w = (weights or WEIGHTS)[name]
    parts = [(1 - F.col(f"p_{f}") if f in INVERTED else F.col(f"p_{f}"), x) for f, x in w.items()]
    return rounded(clamp(weighted_mean(parts) * 100, 0, 100), 4)


def coverage(name: str) -> Column:
    w = WEIGHTS[name]
    return F.round(sum((F.when(F.col(f"p_{f}").isNotNull(), x).otherwise(0.0) for f, x in w.items()), F.lit(0.0)) / sum(w.values()), 4)


def confidence() -> Column:
    n = F.col("available")
    return ladder([(n >= 9, "High"), (n >= 7, "Medium"), (n >= 5, "Low")], "Insufficient")


def classify(level: str = "confidence") -> Column:
    """Ordered rules; a null score never passes a test but for risks, where unknown counts as low."""
    low = lambda c: F.col(c).isNull() | (F.col(c) < 70)
    return ladder([
        (F.col(level) == "Insufficient", "insufficient-evidence"),
        ((F.col("value") >= 65) & (F.col("balance_risk") >= 70), "value-trap-risk"),
        (F.col("momentum_risk") >= 70, "momentum-risk"),
        ((F.col("value") >= 70) & (F.col("quality") >= 50) & low("market_risk") & low("balance_risk"), "potentially-undervalued"),
        ((F.col("quality") >= 70) & low("balance_risk"), "quality-watchlist"),
    ], "neutral")


def score(features: DataFrame, weights: dict | None = None) -> DataFrame:
    """Adds the component scores, momentum_risk, available, confidence and signal to rows with p_ columns."""
    # a generator, so that what follows refers to plain columns and not to the sums again
    df = features.select("*", F.inline(F.array(F.struct(*[component(c, weights).alias(c) for c in WEIGHTS]))))
    df = df.withColumn("momentum_risk", rounded(clamp(100 - F.col("momentum"), 0, 100), 4))
    df = df.withColumn("available", sum((F.col(f).isNotNull().cast("int") for f in BOUNDS), F.lit(0)))
    df = df.withColumn("confidence", confidence())
    return df.withColumn("signal", classify())


def reason_codes() -> Column:
    return codes([
        (F.col("confidence") == "Insufficient", "EVIDENCE_SPARSE"), (F.col("confidence").isin("Low", "Medium"), "EVIDENCE_PARTIAL"), (F.col("confidence") == "High", "EVIDENCE_COMPLETE"),
        (F.col("value") >= 70, "VALUE_STRONG"), (F.col("value") <= 30, "VALUE_WEAK"), (F.col("quality") >= 70, "QUALITY_STRONG"), (F.col("quality") <= 30, "QUALITY_WEAK"),
        (F.col("momentum_risk") >= 70, "MOMENTUM_RISK_HIGH"), (F.col("market_risk") >= 70, "MARKET_RISK_HIGH"), (F.col("balance_risk") >= 70, "BALANCE_SHEET_RISK_HIGH")])


#: What a reason code says.
EXPLANATIONS = {
    "EVIDENCE_SPARSE": "Fewer than five inputs are available.", "EVIDENCE_PARTIAL": "Some inputs are missing.", "EVIDENCE_COMPLETE": "Nine inputs or more are available.",
    "VALUE_STRONG": "Value ranks in the top part of the universe.", "VALUE_WEAK": "Value ranks in the bottom part of the universe.", "QUALITY_STRONG": "Quality ranks in the top part of the universe.", "QUALITY_WEAK": "Quality ranks in the bottom part of the universe.",
    "MOMENTUM_RISK_HIGH": "Recent prices are weak against the universe.", "MARKET_RISK_HIGH": "Drawdown and volatility are high.", "BALANCE_SHEET_RISK_HIGH": "Liabilities are high against assets.",
}


def explanations(codes_column: Column) -> Column:
    """The texts of the codes that have one, in order."""
    names = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    return F.array_compact(F.transform(codes_column, lambda c: F.try_element_at(names, c)))


def contributions() -> Column:
    """One entry per feature that counted: component, feature, weight after renormalising, points."""
    out = []
    for name, w in WEIGHTS.items():
        total = sum((F.when(F.col(f"p_{f}").isNotNull(), x).otherwise(0.0) for f, x in w.items()), F.lit(0.0))
        for f, x in w.items():
            directed = 1 - F.col(f"p_{f}") if f in INVERTED else F.col(f"p_{f}")
            out.append(F.when(F.col(f"p_{f}").isNotNull(), F.struct(F.lit(name).alias("component"), F.lit(f).alias("feature"), F.round(F.lit(x) / total, 6).alias("weight"), F.round(directed * F.lit(x) / total * 100, 4).alias("points"))))
    return F.array_compact(F.array(*out))


def sensitivity(features: DataFrame, key: str = "ticker") -> DataFrame:
    """(component, feature, multiplier, changed): labels that change when one weight is scaled by 0.8 or 1.2; one pass, a column per scenario."""
    base = score(features).withColumn("base_signal", F.col("signal"))
    varied = []
    for name, w in WEIGHTS.items():
        for f in w:
            for m in (0.8, 1.2):
                weights = {k: {x: y * (m if (k, x) == (name, f) else 1) for x, y in v.items()} for k, v in WEIGHTS.items()}
                varied.append(F.struct(F.lit(name).alias("component"), F.lit(f).alias("feature"), F.lit(m).alias("multiplier"), component(name, weights).alias("varied")))
    rows = base.select("confidence", "base_signal", "momentum_risk", *WEIGHTS, F.inline(F.array(*varied)))
    rows = rows.withColumns({c: F.when(F.col("component") == c, F.col("varied")).otherwise(F.col(c)) for c in WEIGHTS})
    rows = rows.withColumn("momentum_risk", F.when(F.col("component") == "momentum", rounded(clamp(100 - F.col("varied"), 0, 100), 4)).otherwise(F.col("momentum_risk")))
    return rows.withColumn("changed", (classify() != F.col("base_signal")).cast("int")).groupBy("component", "feature", "multiplier").agg(F.sum("changed").alias("changed"))


# ---- balance sheet -------------------------------------------------------------------------------------------------

# Ladders of (healthy, acceptable, risk) limits; "up" means higher is better.
BANDS = {
    "current_ratio": ("up", 1.5, 1.0, 0.75),
    "quick_ratio": ("up", 1.0, 0.75, 0.5),
    "cash_ratio": ("up", 0.5, 0.25, 0.1),
    "equity_ratio": ("up", 0.50, 0.30, 0.20),
    "cash_to_debt": ("up", 0.50, 0.20, 0.10),
    "debt_to_equity": ("down", 0.5, 1.5, 3.0),
    "debt_to_assets": ("down", 0.30, 0.50, 0.70),
    "short_debt_share": ("down", 0.20, 0.40, 0.60),
    "goodwill_share": ("down", 0.25, 0.40, 0.60),
}
# Points of a status, weights of the sub-scores, penalties of the gates.
POINTS = {"healthy": 90.0, "acceptable": 70.0, "caution": 55.0, "risk": 35.0, "severe_risk": 10.0}
SUB = {
    "liquidity": {"current_ratio": 0.35, "quick_ratio": 0.30, "cash_ratio": 0.20, "working_capital": 0.15},
    "leverage": {"debt_to_equity": 0.35, "debt_to_assets": 0.30, "cash_to_debt": 0.20, "short_debt_share": 0.15},
    "solvency": {"equity_ratio": 0.40, "debt_to_assets": 0.30, "net_debt": 0.15, "book_value": 0.15},
    "asset_quality": {"goodwill_share": 0.50, "retained_earnings": 0.25, "book_value": 0.25},
}
QUALITY = {"liquidity": 0.30, "leverage": 0.30, "solvency": 0.30, "asset_quality": 0.10}
PENALTY = {"negative_equity": 30, "severe_liquidity": 25, "severe_leverage": 25, "debt_maturity": 15, "asset_quality_warning": 10, "incomplete": 10}


def ratios(b: DataFrame) -> DataFrame:
    """Ratios of a balance snapshot (assets, current_assets, cash, investments, receivables, goodwill, intangibles, liabilities,
    current_liabilities, short_debt, long_debt, equity, retained_earnings); null without a positive denominator.

    With columns ``shares`` and ``market_cap`` also what depends on them."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    debt = F.when(F.col("short_debt").isNotNull() | F.col("long_debt").isNotNull(), F.round(zero("short_debt") + zero("long_debt"), 6))
    b = b.withColumn("total_debt", debt)
    r6 = lambda c: F.round(c, 6)
    quick = F.when(F.col("cash").isNotNull(), F.col("cash") + zero("investments") + zero("receivables"))
    priced = {"shares": ("book_value_per_share", "equity", "shares"), "market_cap": ("price_to_book", "market_cap", "equity")}
    return b.withColumns({name: r6(safe_div(num, den)) for c, (name, num, den) in priced.items() if c in b.columns} | {
        "current_ratio": r6(safe_div("current_assets", "current_liabilities")),
        "quick_ratio": r6(safe_div(quick, "current_liabilities")),
        "cash_ratio": r6(safe_div("cash", "current_liabilities")),
        "working_capital": r6(F.col("current_assets") - F.col("current_liabilities")),
        "debt_to_equity": r6(safe_div("total_debt", "equity")),
        "debt_to_assets": r6(safe_div("total_debt", "assets")),
        "equity_ratio": r6(safe_div("equity", "assets")),
        "cash_to_debt": r6(safe_div("cash", "total_debt")),
        "net_debt": r6(F.col("total_debt") - F.col("cash")),
        "goodwill_share": r6(safe_div(zero("goodwill") + zero("intangibles"), "assets")),
        "short_debt_share": r6(safe_div("short_debt", "total_debt")),
        "book_value": F.col("equity"),
    })


def band(metric: str) -> Column:
    """Status of a ratio: healthy, acceptable, risk, severe_risk or unavailable."""
    v = F.col(metric)
    if metric in BANDS:
        way, a, b, c = BANDS[metric]
        steps = [(v >= a, "healthy"), (v >= b, "acceptable"), (v >= c, "risk")] if way == "up" else [(v < a, "healthy"), (v <= b, "acceptable"), (v <= c, "risk")]
        rest = "severe_risk"
    elif metric == "working_capital":
        steps, rest = [(v >= 0, "healthy"), ((F.col("current_ratio") < 0.75) & (F.col("quick_ratio") < 0.5), "severe_risk")], "risk"
    elif metric == "net_debt":
        steps, rest = [(v <= 0, "healthy"), ((F.col("debt_to_assets") > 0.6) & (F.col("current_ratio") < 1.0), "risk")], "acceptable"
    else:  # book value, retained earnings
        steps, rest = [(v >= 0, "healthy")], "risk"
    return ladder([(v.isNull(), "unavailable"), *steps], rest)


def gates() -> dict[str, Column]:
    """Eight conditions; a null input doesn't trigger."""
    c = F.col
    core = ["assets", "liabilities", "equity", "current_assets", "current_liabilities"]
    out = {
        "liquidity": flag(c("current_ratio") < 1.0) | flag(c("quick_ratio") < 0.75) | flag(c("cash_ratio") < 0.10) | flag(c("working_capital") < 0),
        "severe_liquidity": (c("current_ratio") < 0.75) & (c("quick_ratio") < 0.50),
        "high_leverage": flag(c("debt_to_equity") > 2.0) | flag(c("debt_to_assets") > 0.60),
        "severe_leverage": flag(c("debt_to_equity") > 3.0) | flag(c("debt_to_assets") > 0.70),
        "negative_equity": c("equity") <= 0,
        "debt_maturity": (c("short_debt_share") > 0.40) & (c("cash_to_debt") < 0.20),
        "asset_quality_warning": c("goodwill_share") > 0.50,
        "incomplete": sum((c(x).isNull().cast("int") for x in core), F.lit(0)) > 0,
    }
    return {k: flag(v) for k, v in out.items()}


def _points(status: Column) -> Column:
    return ladder([(status == k, v) for k, v in POINTS.items()]).cast("double")


def _status(points: Column) -> Column:
    return ladder([(points.isNull(), "unavailable"), (points >= 80, "healthy"), (points >= 60, "acceptable"), (points >= 40, "caution"), (points >= 20, "risk")], "severe_risk")


def balance_scores(r: DataFrame) -> DataFrame:
    """Gates, sub-scores, quality (from re-banded sub-scores) and the risk penalty of rows with ratios."""
    r = r.withColumns({f"g_{k}": v for k, v in gates().items()})
    r = r.withColumns({f"b_{m}": band(m) for m in dict.fromkeys(m for w in SUB.values() for m in w)})
    r = r.withColumns({f"s_{n}": F.round(weighted_mean([(_points(F.col(f"b_{m}")), x) for m, x in w.items()]), 6) for n, w in SUB.items()})
    cap = lambda c, g, x: F.when(F.col(g), F.least(F.when(F.col(c).isNull() | (F.col(c) == 0), float(x)).otherwise(F.col(c)), F.lit(float(x)))).otherwise(F.col(c))
    r = r.withColumn("s_leverage", cap("s_leverage", "g_negative_equity", 15)).withColumn("s_solvency", cap("s_solvency", "g_negative_equity", 15))
    r = r.withColumn("s_liquidity", cap("s_liquidity", "g_severe_liquidity", 20)).withColumn("s_leverage", cap("s_leverage", "g_severe_leverage", 20))
    quality = F.round(weighted_mean([(_points(_status(F.col(f"s_{n}"))), x) for n, x in QUALITY.items()]), 6)
    r = r.withColumn("balance_quality", quality)
    extra = sum((F.when(F.col(f"g_{g}"), float(p)).otherwise(0.0) for g, p in PENALTY.items()), F.lit(0.0))
    r = r.withColumn("balance_penalty", F.round(F.least(F.lit(100.0), 100 - F.col("balance_quality") + extra), 6))
    return r.withColumn("confidence_adjustment", confidence_adjustment())


#: Fields of a snapshot that may be missing.
FIELDS = ["assets", "current_assets", "cash", "liabilities", "current_liabilities", "short_debt", "long_debt", "equity", "retained_earnings", "goodwill"]
#: Severity of each gate (fixed values).
SEVERITY = {"liquidity": "moderate", "severe_liquidity": "severe", "high_leverage": "high", "severe_leverage": "severe", "negative_equity": "severe", "debt_maturity": "high", "asset_quality_warning": "warning", "incomplete": "warning"}


def confidence_adjustment() -> Column:
    """-15 without any field; else 5 for a whole snapshot, less for missing fields, within -20 and 5."""
    missing = lambda cols: sum((F.col(x).isNull().cast("int") for x in cols), F.lit(0))
    some, core, current = missing(FIELDS) > 0, missing(["assets", "liabilities", "equity"]) > 0, missing(["current_assets", "current_liabilities"]) > 0
    adjust = F.when(some, 0).otherwise(5) - F.when(core, 10).otherwise(0) - F.when(current, 5).when(some, 3).otherwise(0) - F.when(F.col("g_incomplete"), 5).otherwise(0)
    return F.when(missing(FIELDS) == len(FIELDS), F.lit(-15)).otherwise(F.greatest(F.lit(-20), F.least(F.lit(5), adjust)))


def triggered() -> Column:
    """(name, severity) of the gates that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.col(f"g_{g}"), F.struct(F.lit(g).alias("name"), F.lit(v).alias("severity"))) for g, v in SEVERITY.items()]))


def severe_gates() -> Column:
    return sum((F.col(f"g_{g}").cast("int") for g, v in SEVERITY.items() if v == "severe"), F.lit(0))


def snapshot_state() -> Column:
    """unavailable without any field, available with all, else partial."""
    n = sum((F.col(x).isNull().cast("int") for x in FIELDS), F.lit(0))
    return ladder([(n == len(FIELDS), "unavailable"), (n == 0, "available")], "partial")


_LEVELS = ["Insufficient", "Low", "Medium", "High"]


def adjusted_confidence(level: Column, adjustment: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(x) for x in _LEVELS]), level).cast("int") - 1
    moved = rank + F.when(adjustment >= 5, 1).when(adjustment <= -10, -2).when(adjustment < 0, -1).otherwise(0)
    return F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.greatest(F.lit(0), F.least(F.lit(3), moved)) + 1).cast("int"))


# Why the balance model would change a signal.
TRAP, VALUE_WEAK, QUALITY_WEAK, SUPPORT = (
    "Strong value evidence is paired with elevated balance-sheet risk.",
    "Balance-sheet quality is not acceptable enough for a clean undervaluation signal.",
    "Balance-sheet weakness complicates the quality watchlist case.",
    "Balance-sheet evidence supports quality, but official signal remains pipeline-controlled.",
)
MODES = ("off", "shadow", "experimental", "official")


def experimental(scored: DataFrame) -> DataFrame:
    """Adds experimental_signal, would_change and change_reason to scored rows joined with their balance model."""
    severe, current = severe_gates() > 0, F.col("signal")
    weak = severe | flag(F.col("balance_quality") < 60)
    trap = flag(F.col("value") >= 65) & (severe | flag(F.col("balance_penalty") >= 70))
    steps = [(trap, "value-trap-risk", TRAP), ((current == "potentially-undervalued") & weak, "neutral", VALUE_WEAK), ((current == "quality-watchlist") & weak, "neutral", QUALITY_WEAK)]
    support = flag(F.col("quality") >= 70) & flag(F.col("balance_quality") >= 60) & (current == "neutral")
    signal, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, label, why in reversed(steps):
        signal, reason = F.when(test, F.lit(label)).otherwise(signal), F.when(test, F.lit(why)).otherwise(reason)
    any_step = steps[0][0] | steps[1][0] | steps[2][0]
    out = scored.withColumn("experimental_signal", F.coalesce(signal, current)).withColumn("change_reason", F.when(~any_step & support, F.lit(SUPPORT)).otherwise(reason))
    return out.withColumn("would_change", F.col("experimental_signal") != current)


def balance_mode(scored: DataFrame, mode: str = "official") -> DataFrame:
    """Scored rows with their balance model under a mode: ``off`` leaves them, ``shadow`` and ``experimental`` add what
    would change, ``official`` changes it; an unknown mode is official."""
    mode = mode.strip().lower()
    if mode == "off":
        return scored.withColumn("previous_signal", F.col("signal"))
    marked = experimental(scored).withColumn("previous_signal", F.col("signal"))
    if mode in ("shadow", "experimental"):
        return marked
    return official(marked).drop("prior_signal")


def scoring_changes(rows: DataFrame) -> DataFrame:
    """One row: how many companies each gate family marks, and how many signals the balance model changes."""
    g = lambda *names: F.count_if(sum((F.col(f"g_{n}").cast("int") for n in names), F.lit(0)) > 0)
    changed = F.col("would_change") | (F.col("signal") != F.col("previous_signal"))
    return rows.agg(F.count(F.lit(1)).alias("companies"), g("liquidity", "severe_liquidity").alias("liquidity_risk"), g("high_leverage", "severe_leverage").alias("high_leverage"),
                    g("negative_equity").alias("negative_equity"), g("debt_maturity").alias("debt_maturity"), F.count_if(changed).alias("changed"), F.count_if(~changed).alias("stable"))


def official(scored: DataFrame) -> DataFrame:
    """Blend of a scored row with its balance model: risk, quality, confidence and the final signal."""
    s = scored.withColumn("prior_signal", F.col("signal"))
    s = s.withColumn("_severe", severe_gates()).withColumn("_value", F.col("value")).withColumn("_quality", F.col("quality"))
    s = s.withColumn("balance_risk", F.when(F.col("balance_penalty").isNotNull(), F.round(clamp(F.when(F.col("balance_risk").isNotNull(), F.col("balance_risk") * 0.5 + F.col("balance_penalty") * 0.5).otherwise(F.col("balance_penalty")), 0, 100), 4)).otherwise(F.col("balance_risk")))
    s = s.withColumn("quality", F.when(F.col("balance_quality").isNotNull() & F.col("quality").isNotNull(), F.round(clamp(F.col("quality") * 0.85 + F.col("balance_quality") * 0.15, 0, 100), 4)).otherwise(F.col("quality")))
    s = s.withColumn("confidence", adjusted_confidence(F.col("confidence"), F.col("confidence_adjustment")))
    s = s.withColumn("confidence", F.when((F.col("confidence") != "Insufficient") & (F.col("_severe") >= 2), adjusted_confidence(F.col("confidence"), F.lit(-10))).otherwise(F.col("confidence")))
    trap = flag((F.col("value") >= 65) & ((F.col("_severe") > 0) | flag(F.col("balance_penalty") >= 70)))
    stays = F.col("prior_signal") == "value-trap-risk"
    return s.withColumn("signal", F.when(trap | stays, F.lit("value-trap-risk")).otherwise(classify())).drop("_severe", "_value", "_quality")
