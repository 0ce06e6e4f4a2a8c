"""Analyst briefs: a template by signal, claims with their sources, what is missing, what to ask next, and the same as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.exprs import flag, rounded

# Title and summary of each signal.
TEMPLATES = {
    "potentially-undervalued": ("Potential value evidence for review", "Relative value and quality thresholds are present, subject to the risk gates and missing evidence shown below."),
    "quality-watchlist": ("Quality evidence for continued monitoring", "Quality measures rank comparatively well, while valuation and risk evidence still require independent review."),
    "value-trap-risk": ("Apparent value with a material risk flag", "Relative value evidence is accompanied by elevated balance-sheet risk, so the low-valuation appearance requires additional scrutiny."),
    "momentum-risk": ("Weak price behavior warrants context", "Recent relative price behavior is weak enough to trigger the momentum-risk rule; this is context rather than a forecast."),
    "neutral": ("Mixed evidence without a stronger classification", "The current rule set does not identify a dominant positive or risk classification."),
    "insufficient-evidence": ("Evidence is insufficient for classification", "Too few validated inputs are available to support a stronger research classification."),
}
# Name and label of each score, and the texts that don't depend on a row.
LABELS = {"value": "Value", "quality": "Quality", "momentum": "Momentum", "market_risk": "Market risk", "balance_risk": "Balance-sheet risk"}
NO_SIGNAL = "Signal classification and score facts are unavailable."
NO_COHORT = "No matching 90-session backtest cohort is available."
NO_BACKTEST = "Point-in-time backtest context is unavailable."
NO_EVIDENCE = "No cited filing passages are available from the current search index."
QUESTIONS = ("What changed in the latest filing compared with the prior annual or quarterly filing?", "Do source filings support the inputs, dates, and units used in the quantitative record?")
MORE = "Which missing risk inputs should be collected before relying on this screen?"
DISCLAIMER = "For research and educational use only. Verify every source independently; this brief is not an investment instruction."
EVIDENCE = 3


def _claim(id_, text, kind: str, ref) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(id_).alias("id"), lit(text).alias("text"), F.lit(kind).alias("source_type"), lit(ref).alias("source_ref"))


def briefs(rows: DataFrame, cohorts: DataFrame | None) -> DataFrame:
    """A brief for each of ``rows(ticker, signal, confidence, the five scores)``; a null signal means that none is known.

    ``cohorts(signal, n, mean_excess, win_rate)`` are the 90-session cohorts of all regimes, a row a signal; None: there is no
    complete backtest. A column ``evidence``, an array of (form, item, filed, text, url), gives the passages; three are kept."""
    known = F.col("signal").isNotNull()
    r = rows if "evidence" in rows.columns else rows.withColumn("evidence", F.lit(None).cast("array<struct<form:string,item:string,filed:string,text:string,url:string>>"))
    r = r.withColumn("evidence", F.slice(F.coalesce("evidence", F.array().cast(r.schema["evidence"].dataType)), 1, EVIDENCE))
    if cohorts is None:
        r = r.withColumns({"n": F.lit(None).cast("long"), "mean_excess": F.lit(None).cast("double"), "win_rate": F.lit(None).cast("double")})
    else:
        r = r.join(F.broadcast(cohorts.select("signal", "n", "mean_excess", "win_rate")), "signal", "left")  # a row a signal
    template = F.coalesce(F.when(F.col("signal").isin(*TEMPLATES), F.col("signal")), F.lit("insufficient-evidence"))
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v[i])]), template)
    words = F.regexp_replace(F.coalesce("signal", F.lit("insufficient-evidence")), "-", " ")
    ticker = F.col("ticker").cast("string")
    valid = {c: flag(F.col(c).between(0, 100)) for c in LABELS}
    context = F.when(F.col("n").isNotNull(), F.format_string("The 90-session %s cohort contains %d observations, with mean excess return %s%.1f%% and win rate %.1f%%. This descriptive result is not a forecast.", words, F.col("n"), F.when(F.col("mean_excess") >= 0, "+").otherwise("-"), F.abs(rounded(F.col("mean_excess") * 100, 1)), rounded(F.col("win_rate") * 100, 1)))
    said = F.concat(F.lit("The current rules classify "), ticker, F.lit(" as "), words, F.lit(" with "), F.lower("confidence"), F.lit(" confidence."))
    claims = [F.when(known, _claim("signal", said, "signal", F.concat(F.lit("signals:"), ticker)))]
    claims += [F.when(known & valid[c], _claim(f"score-{c}", F.format_string(f"{n}: %.1f out of 100.", rounded(c, 1)), "score", F.concat(F.lit("signals:"), ticker, F.lit(f":scores.{c}")))) for c, n in LABELS.items()]
    claims.append(F.when(F.col("n").isNotNull(), _claim("backtest-90", context, "backtest", F.concat(F.lit("backtest:"), F.col("signal"), F.lit(":90")))))
    missing = [F.when(~known, NO_SIGNAL), *[F.when(known & ~valid[c], f"{n} score is unavailable.") for c, n in LABELS.items()], F.when(~known | F.lit(cohorts is None), NO_BACKTEST).when(F.col("n").isNull(), NO_COHORT), F.when(F.size("evidence") == 0, NO_EVIDENCE)]
    questions = [F.concat(F.lit("Which operating or industry conditions could invalidate the current "), words, F.lit(" classification?")), *map(F.lit, QUESTIONS), F.when(known & ~(valid["market_risk"] & valid["balance_risk"]), MORE)]
    return r.select("ticker", template.alias("template_id"), of(0).alias("title"), of(1).alias("summary"), F.array_compact(F.array(*claims)).alias("claims"), context.alias("backtest_context"), "evidence",
                    F.array_distinct(F.array_compact(F.array(*missing))).alias("missing"), F.array_compact(F.array(*questions)).alias("questions"), F.lit(DISCLAIMER).alias("disclaimer"))


def markdown() -> Column:
    """A brief's columns as one Markdown text."""
    bullets = lambda a, f: F.transform(a, lambda x: F.concat(F.lit("- "), f(x)))
    one = lambda *texts: F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])
    cited = bullets("evidence", lambda e: F.concat(e["form"], F.lit(" "), e["item"], F.lit(", filed "), e["filed"].cast("string"), F.lit(": “"), e["text"], F.lit("” [SEC citation]("), e["url"], F.lit(")")))
    return F.array_join(F.concat(
        one(F.concat(F.lit("# "), F.col("ticker").cast("string"), F.lit(": "), F.col("title")), "", F.col("summary"), "", "## Validated facts"),
        bullets("claims", lambda c: F.concat(c["text"], F.lit(" [Source: "), c["source_ref"], F.lit("]"))), one("", "## Retrieved filing evidence"),
        F.when(F.size("evidence") > 0, cited).otherwise(one("- No cited filing passages are available.")), one("", "## Missing sections"), bullets("missing", lambda m: m),
        one("", "## Research next"), bullets("questions", lambda q: q), one("", F.col("disclaimer"))), "\n")
