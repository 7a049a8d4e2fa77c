"""Ledger: first-in-first-out lots, charges, reconciliation, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fifo_trades(fills: DataFrame, key: list[str], order: list[str], side: str, quantity: str, price: str, charges: str | None = None) -> DataFrame:
    """Closed pieces of trades: every sell meets the oldest open buys.

    Buys and sells each lie on a line of cumulative quantity; pieces are where their intervals overlap. Overlaps are found without pairing
    all: the two lines' cuts are swept together, and each stretch between two cuts belongs to the buy and the sell begun last.
    Gives key, buy_at, sell_at, quantity, buy_price, sell_price, pnl and, with charges, the pro-rata share of both sides'.
    """
    fills = fills.repartition(*key)  # once: sides, cuts and the sweep all lie within a key
    at = F.struct(*order)
    line = W.partitionBy(*key, side).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cost = F.col(charges).cast("double") if charges else F.lit(0.0)
    laid = fills.withColumn("_end", F.sum(quantity).over(line)).withColumn("_start", F.col("_end") - F.col(quantity))
    piece = F.struct(at.alias("at"), F.col(price).cast("double").alias("price"), F.try_divide(cost, F.col(quantity)).alias("cost"), F.col("_end").alias("end"))
    cuts = laid.where(F.col(quantity) > 0).select(*key, F.col("_start").alias("_at"), F.when(F.col(side) == "buy", piece).alias("_buy"), F.when(F.col(side) == "sell", piece).alias("_sell"))
    at_cut = cuts.groupBy(*key, "_at").agg(F.max("_buy").alias("_buy"), F.max("_sell").alias("_sell"))
    sweep = W.partitionBy(*key).orderBy("_at")
    so_far = sweep.rowsBetween(W.unboundedPreceding, 0)
    swept = at_cut.select(*key, "_at", F.last("_buy", ignorenulls=True).over(so_far).alias("b"), F.last("_sell", ignorenulls=True).over(so_far).alias("s"), F.lead("_at").over(sweep).alias("_next"))
    end = F.least("b.end", "s.end", "_next")
    pieces = swept.withColumn("quantity", (end - F.col("_at")).cast("double")).where("b is not null and s is not null and quantity > 0")
    out = pieces.select(*key, F.col("b.at").alias("buy_at"), F.col("s.at").alias("sell_at"), "quantity", F.col("b.price").alias("buy_price"), F.col("s.price").alias("sell_price"), ((F.col("b.cost") + F.col("s.cost")) * F.col("quantity")).alias("charges"))
    return out.withColumn("pnl", (F.col("sell_price") - F.col("buy_price")) * F.col("quantity") - F.col("charges"))


def covered(fills: DataFrame, key: list[str], order: list[str], side: str, quantity: str) -> DataFrame:
    """The same fills; reading them raises if a sell goes beyond what its key holds at that moment."""
    held = F.sum(F.when(F.col(side) == "buy", F.col(quantity)).otherwise(-F.col(quantity))).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    refused = F.raise_error(F.concat(F.lit("sold more than held: "), F.concat_ws("/", *(F.col(k).cast("string") for k in key))))
    return fills.withColumn("_held", held).withColumn(quantity, F.when(F.col("_held") < 0, refused.cast(fills.schema[quantity].dataType)).otherwise(F.col(quantity))).drop("_held")


def oversold(fills: DataFrame, key: list[str], order: list[str], side: str, quantity: str) -> DataFrame:
    """Keys that were sold short, the first moment of it and how far it went."""
    held = F.sum(F.when(F.col(side) == "buy", F.col(quantity)).otherwise(-F.col(quantity))).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    short = fills.withColumn("_held", held).where("_held < 0")
    return short.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"), (-F.min("_held")).alias("most"))


def open_lots(fills: DataFrame, key: list[str], order: list[str], side: str, quantity: str, price: str, charges: str | None = None) -> DataFrame:
    """What is left of each buy after all sells have met the oldest ones: key, buy_at, open_quantity, price, and the pro-rata share of the buy's charges."""
    buys, sells = fills.where(F.col(side) == "buy"), fills.where(F.col(side) == "sell")
    sold = sells.groupBy(*key).agg(F.sum(quantity).alias("_sold"))
    line = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    laid = buys.withColumn("_end", F.sum(quantity).over(line)).join(sold, key, "left")
    left = F.least(F.col(quantity), F.col("_end") - F.coalesce("_sold", F.lit(0)))
    cost = F.try_divide(F.col(charges) * F.col("open_quantity"), F.col(quantity)) if charges else F.lit(0.0)
    return laid.withColumn("open_quantity", left).where("open_quantity > 0").select(*key, F.struct(*order).alias("buy_at"), "open_quantity", F.col(price).alias("price"), cost.alias("charges"))


def net_positions(fills: DataFrame, key: list[str], side: str, quantity: str) -> DataFrame:
    """Net open quantity of each key; negative where more was sold than bought."""
    signed = F.sum(F.when(F.col(side) == "buy", F.col(quantity)).otherwise(-F.col(quantity)))
    return fills.groupBy(*key).agg(signed.alias("open_quantity"))


def cash_check(fills: DataFrame, trades: DataFrame, lots: DataFrame, key: list[str], side: str, quantity: str, price: str, charges: str) -> DataFrame:
    """Per key the cash that the fills moved, what closed trades and open lots say that it should be, and the gap between the two."""
    signed = F.when(F.col(side) == "buy", -F.col(price) * F.col(quantity)).otherwise(F.col(price) * F.col(quantity)) - F.col(charges)
    moved = fills.groupBy(*key).agg(F.sum(signed).alias("cash"))
    earned = trades.groupBy(*key).agg(F.sum("pnl").alias("pnl"))
    held = lots.groupBy(*key).agg(F.sum(F.col("price") * F.col("open_quantity") + F.col("charges")).alias("cost"))
    both = moved.join(earned, key, "left").join(held, key, "left").withColumn("said", F.coalesce("pnl", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0)))
    return both.select(*key, "cash", "said", (F.col("cash") - F.col("said")).alias("gap"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: list[str], quantity: str) -> DataFrame:
    """Keys where the two books differ; a missing one counts as zero."""
    o, t = ours.select(*key, F.col(quantity).alias("ours")), theirs.select(*key, F.col(quantity).alias("theirs"))
    both = o.join(t, key, "full_outer").select(*key, F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))
    return both.where("ours <> theirs")


def capacity(fills: DataFrame, by: list[str], volume: str, quantity: str, participation: float) -> DataFrame:
    """Nearest-rank lower quartile of how many times the size could have been traded within a share of the volume."""
    sized = fills.where(F.col(quantity) > 0).withColumn("_multiple", F.try_divide(participation * F.col(volume), F.col(quantity)))
    return sized.groupBy(*by).agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY _multiple)").alias("capacity"))


def charges(value: Column, product: Column, side: Column, first_sell: Column, rates: dict) -> Column:
    """A struct of a fill's charges.

    rates: per product (delivery, intraday) brokerage {per_order, cap}, and per component {product: {side: rate}}; stt_step rounds that
    component to whole steps, halves up; dp for a delivery sell that is the first of its scrip and day; gst {rate, base: {product: components}}.
    """

    def by(table: dict) -> Column:
        out = F.lit(0.0)
        for p, sides in table.items():
            for s, rate in sides.items():
                out = F.when((product == p) & (side == s), F.lit(float(rate))).otherwise(out)
        return out

    brokerage = F.lit(0.0)
    for p, rule in rates["brokerage"].items():
        amount = F.lit(float(rule["per_order"]))
        brokerage = F.when(product == p, F.least(amount, value * rule["cap"]) if rule.get("cap") else amount).otherwise(brokerage)
    parts = {"brokerage": brokerage}
    for name, table in rates["components"].items():
        amount = value * by(table)
        step = rates.get("steps", {}).get(name)
        parts[name] = F.floor(amount / step + 0.5) * step if step else amount
    parts["dp"] = F.when((product == "delivery") & (side == "sell") & first_sell, F.lit(float(rates["dp"]))).otherwise(F.lit(0.0))
    gst = F.lit(0.0)
    for p, base in rates["gst"]["base"].items():
        gst = F.when(product == p, sum((parts[b] for b in base[1:]), parts[base[0]]) * rates["gst"]["rate"]).otherwise(gst)
    parts["gst"] = gst
    named = [v.cast("double").alias(k) for k, v in parts.items()]
    return F.struct(*named, sum(list(parts.values())[1:], list(parts.values())[0]).cast("double").alias("total"))


def round_trip_fraction(entry: Column, exit_: Column, notional: float, product: Column, rates: dict, slip_bp: float = 0.0) -> Column:
    """Charges and slippage of buying and selling a position of about the notional, as a fraction of its value at entry."""
    quantity = F.greatest(F.lit(1.0), F.floor(F.try_divide(F.lit(notional), entry)))
    buy = charges(quantity * entry, product, F.lit("buy"), F.lit(True), rates)["total"]
    sell = charges(quantity * exit_, product, F.lit("sell"), F.lit(True), rates)["total"]
    return F.try_divide(buy + sell, quantity * entry) + 2 * slip_bp / 1e4


# fixed values: the latest rates of the cost model, fractions of traded value
LATEST_RATES = {
    "brokerage": {"delivery": {"per_order": 20.0}, "intraday": {"per_order": 20.0, "cap": 0.001}},
    "components": {
        "stt": {"delivery": {"buy": 0.001, "sell": 0.001}, "intraday": {"buy": 0.0, "sell": 0.00025}},
        "exchange_transaction": {"delivery": {"buy": 0.000030699, "sell": 0.000030699}, "intraday": {"buy": 0.000030699, "sell": 0.000030699}},
        "ipft": {"delivery": {"buy": 0.000000001, "sell": 0.000000001}, "intraday": {"buy": 0.000000001, "sell": 0.000000001}},
        "sebi_fee": {"delivery": {"buy": 0.000001, "sell": 0.000001}, "intraday": {"buy": 0.000001, "sell": 0.000001}},
        "stamp_duty": {"delivery": {"buy": 0.00015, "sell": 0.0}, "intraday": {"buy": 0.00003, "sell": 0.0}},
    },
    "steps": {"stt": 1.0},
    "dp": 20.0,
    "gst": {"rate": 0.18, "base": {"delivery": ["brokerage", "exchange_transaction", "dp", "ipft"], "intraday": ["brokerage", "exchange_transaction", "ipft"]}},
}
