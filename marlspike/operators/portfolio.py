"""The application's rules: who sees what, what a position is worth under a projection, which input is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import flag, ladder, money

# States of a subscription, baseline models, limits of the free tier.
STATUSES = ["incomplete", "trialing", "active", "past_due", "paused", "canceled", "unpaid", "incomplete_expired"]
BASELINES = ["zero-return baseline", "historical-mean baseline", "market-return baseline"]
FREE_UNDERVALUED = FREE_GROWTH = 3


def subscription_status(value: Column) -> Column:
    return F.when(value.isin(STATUSES), value).otherwise("none")


def pro_access(status: Column, period_end: Column, livemode: Column, now: Column, current_livemode: bool | None = None) -> Column:
    """Active and trialing subscriptions, and canceled ones until their period ends; in the mode asked for, if one is."""
    allowed = F.lit(True) if current_livemode is None else flag(livemode == current_livemode)
    return allowed & (status.isin("active", "trialing") | flag((status == "canceled") & (period_end > now)))


def accessible(stocks: DataFrame, tier: str) -> DataFrame:
    """Rows of ``stocks(ticker, place, preview, signal, trend, ...)`` that a tier shows, with ``shown_as``.

    Pro sees all, public the preview; free the preview, then the first three undervalued and the first three trend teasers not shown yet."""
    if tier == "pro":
        return stocks.withColumn("shown_as", F.lit("all"))
    preview = stocks.where("preview").withColumn("shown_as", F.lit("preview"))
    if tier == "public":
        return preview
    rest = stocks.where("not preview")
    value = rest.where("signal = 'potentially-undervalued'").orderBy("place").limit(FREE_UNDERVALUED).withColumn("shown_as", F.lit("undervalued"))
    growth = rest.join(F.broadcast(value.select("ticker")), "ticker", "left_anti").where("trend in ('detected', 'emerging')").select(*stocks.columns)  # three rows
    growth = growth.orderBy("place").limit(FREE_GROWTH).withColumn("shown_as", F.lit("growth"))
    return preview.unionByName(value).unionByName(growth)


def ticker_format(ticker: Column) -> Column:
    return F.coalesce(F.upper(F.trim(ticker)).rlike(r"^[A-Z0-9.-]{1,12}$"), F.lit(False))


# The limits and the texts of the rules below (input errors, reasons without a value, outcome or target).
def input_error(p: DataFrame) -> Column:
    """The first rule that a position's input breaks, or null. Columns: ticker, quantity_type, shares, dollar_amount, average_cost, return_30, return_90; NaN stands for text that is no number."""
    c = F.col
    bad = lambda x, ok: c(x).isNotNull() & ~(flag(ok) & ~flag(F.isnan(x)))
    dollars = F.coalesce(c("quantity_type") == "dollar_amount", F.lit(False))
    return ladder([
        (F.coalesce(F.trim("ticker"), F.lit("")) == "", "Ticker is required."), (bad("shares", c("shares") > 0), "Shares must be greater than zero."), (bad("dollar_amount", c("dollar_amount") > 0), "Dollar amount must be greater than zero."),
        (bad("average_cost", c("average_cost") >= 0), "Average cost cannot be negative."), (bad("return_30", c("return_30").between(-1, 10)), "30-day return estimate must be between -100% and +1000%."), (bad("return_90", c("return_90").between(-1, 10)), "90-day return estimate must be between -100% and +1000%."),
        (~dollars & c("shares").isNull(), "Share-based positions require shares."), (dollars & c("dollar_amount").isNull(), "Dollar-based positions require a dollar amount.")])


def _price(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def _return(c: str) -> Column:
    return F.when(F.col(c) > -1, F.col(c))


def position_value(p: DataFrame, price: str = "current_price") -> DataFrame:
    """Adds held, position_value, cost_basis, unrealized and reason to positions (quantity_type, shares, dollar_amount, average_cost) with a price."""
    by_shares = F.col("quantity_type") == "shares"
    amount = F.when(by_shares, F.when(F.col("shares") > 0, F.col("shares"))).otherwise(F.when(F.col("dollar_amount") > 0, F.col("dollar_amount")))
    out = p.withColumn("_amount", amount).withColumn("_price", _price(price))
    out = out.withColumn("reason", F.when(F.col("_amount").isNull(), "Position amount is required").when(F.col("_price").isNull(), "Current stock price unavailable"))
    out = out.withColumn("held", F.when(by_shares, F.col("_amount")).otherwise(F.col("_amount") / F.col("_price"))).withColumn("position_value", F.when(by_shares, F.col("_amount") * F.col("_price")).otherwise(F.col("_amount")))
    out = out.withColumn("cost_basis", F.when(by_shares & (F.col("average_cost") >= 0), F.col("_amount") * F.col("average_cost")))
    return out.withColumn("unrealized", F.col("position_value") - F.col("cost_basis")).drop("_amount", "_price")


def projected(p: DataFrame) -> DataFrame:
    """Adds outcome columns to positions with a value and one horizon (horizon_status, lower_return, base_return, upper_return, estimated_price).

    status, unavailable_reason, gain_per_share, gain, outcome_value, lower_value, upper_value; money is rounded to cents."""
    c = F.col
    complete = _return("base_return").isNotNull() & _return("lower_return").isNotNull() & _return("upper_return").isNotNull()
    reason = F.coalesce(c("reason"), ladder([
        (c("horizon_status").isNull(), "Projection source unavailable"), (c("horizon_status") == "insufficient_data", "Not enough historical data"),
        ((c("horizon_status") == "stale") & ~(complete & _price("estimated_price").isNotNull()), "Historical scenario is stale"), (~complete, "Projection return unavailable")]))
    p = p.withColumn("unavailable_reason", reason).withColumn("_ok", reason.isNull())
    sell = F.coalesce(_price("estimated_price"), c("current_price") * (1 + c("base_return")))
    ok = lambda x: F.when(c("_ok"), x)
    return p.withColumns({
        "status": F.when(c("_ok"), "available").otherwise("unavailable"), "gain_per_share": ok(money(sell - c("current_price"))), "gain": ok(money(c("held") * (sell - c("current_price")))), "outcome_value": ok(money(c("held") * sell)),
        "lower_value": ok(money(c("position_value") * (1 + c("lower_return")))), "upper_value": ok(money(c("position_value") * (1 + c("upper_return")))),
    }).drop("_ok")


def projection_source(f: DataFrame) -> Column:
    """forecast_model where both models are approved and complete, the scenario where its price is valid, else unavailable."""
    c = F.col
    approved = ~F.coalesce(c("model_30").isin(BASELINES), F.lit(False)) & ~F.coalesce(c("model_90").isin(BASELINES), F.lit(False))
    return F.when(approved & c("complete_30") & c("complete_90"), "forecast_model").when(flag(c("scenario_price") > 0), "conservative_historical_scenario").otherwise("unavailable")


def target_reason() -> Column:
    """Why a target (target_status, target_mean, target_price, target_days) can't be used, or null."""
    c = F.col
    return ladder([
        (c("target_status").isNull() | (c("target_status") == "unsupported"), "Analyst target data is not currently available."), (c("target_status") == "stale", "Analyst target is stale"),
        (c("target_status") == "horizon_unknown", "Analyst target horizon not supplied"), (c("target_status") == "insufficient_data", "Analyst target unavailable for this stock"), (_price("target_mean").isNull(), "Analyst target unavailable for this stock"),
        (_price("target_price").isNull(), "Current stock price unavailable"), (~flag(c("target_days") > 0), "Analyst target horizon not supplied")])


def scaled_return(days: int) -> Column:
    """The target's whole return scaled to ``days`` of its own horizon."""
    whole = _price("target_mean") / _price("target_price") - 1
    return F.when((whole > -1) & (F.col("target_days") > 0), F.pow(1 + whole, F.lit(float(days)) / F.col("target_days")) - 1)


def share_quantity(value: Column) -> Column:
    """Whole numbers with thousands marks; else 4, 3 or at most 2 digits by size."""
    size = F.abs(value)
    two = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(value.isNull(), "Unavailable").when(value == F.floor(value), F.format_number(value, 0)).when(size < 1, F.format_string("%.4f", value)).when(size < 10, F.format_string("%.3f", value)).otherwise(two)


def display_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit("Unavailable"))


def subscription_change(events: DataFrame) -> DataFrame:
    """Billing events (event_id, type, body JSON) as subscription rows: user, status, period end; each event id counts once, other types and users unknown are left out."""
    body = F.from_json("body", "id string, customer string, subscription string, client_reference_id string, status string, payment_status string, current_period_end double, cancel_at_period_end boolean, period_end double, user string")
    first = events.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("received"))).where("_n = 1").withColumn("b", body)
    kind, b = F.col("type"), F.col("b")
    checkout = kind.isin("checkout.session.completed", "checkout.session.async_payment_succeeded")
    refused = kind == "checkout.session.async_payment_failed"
    of_customer = kind.startswith("customer.subscription.")
    status = (F.when(refused, "unpaid").when(checkout, F.when(b["payment_status"] == "paid", "active").when(b["payment_status"] == "unpaid", "unpaid").otherwise("incomplete"))
              .when(kind == "invoice.paid", "active").when(kind == "invoice.payment_failed", "past_due").when(of_customer & kind.isin("customer.subscription.created", "customer.subscription.updated", "customer.subscription.deleted"), subscription_status(b["status"])))
    end = F.when(of_customer, b["current_period_end"]).when(kind.startswith("invoice."), b["period_end"])
    user = F.when(checkout | refused, F.coalesce(b["user"], b["client_reference_id"])).otherwise(b["user"])
    rows = first.select("event_id", "received", user.alias("user"), F.when(checkout | refused, b["subscription"]).when(of_customer, b["id"]).otherwise(b["subscription"]).alias("subscription"), status.alias("status"),
                        F.when(end > 0, F.timestamp_seconds(end)).alias("period_end"), (of_customer & flag(b["cancel_at_period_end"])).alias("cancel_at_period_end"))
    return rows.where("status is not null and user is not null")
