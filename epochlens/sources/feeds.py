"""Exchange and broker payloads as typed rows.

Every reader takes payloads (a DataFrame with the text in ``payload``; its other columns are carried along) and gives a row for each record. JSON is
parsed into maps from name to text inside the plan; fields are picked whatever their case.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.functions import actions
from epochlens.functions.scalars import clean_text, display_size, exchange_date, folded, once, parse_date, parse_exchange_time, pick, picked, signed_duration, to_number, to_whole
from epochlens.sources.tabular import RECORDS

#: Rows of a page of the exchange's announcement search.
PAGE_ROWS = 50
ISIN = "^IN[A-Z0-9]{9}[0-9]$"


def _carried(payloads: DataFrame) -> list[str]:
    return [c for c in payloads.columns if c != "payload"]


def _listed(payloads: DataFrame, records: Column, *more: Column) -> DataFrame:
    """A row for each record, with its place."""
    return payloads.select(*_carried(payloads), *more, F.posexplode(records).alias("place", "r"))


def _folded(rows: DataFrame) -> DataFrame:
    """The same with the keys of the records folded, once for all fields that are picked."""
    return rows.withColumn("r", folded(F.col("r")))


def _either(payload: Column) -> Column:
    """Records of a list, or of the list under ``data``."""
    inner = F.from_json(payload, f"data {RECORDS}")["data"]
    return F.when(F.ltrim(payload).startswith("["), F.from_json(payload, RECORDS)).otherwise(inner)


def paged_announcements(payloads: DataFrame, *, attachment_base: str) -> DataFrame:
    """Announcements that come in numbered pages: records without an id are left out; an event is dated by dissemination, else by the news' own time, else by submission."""
    read = payloads.select(*_carried(payloads), F.from_json("payload", f"Table {RECORDS}, Table1 {RECORDS}").alias("_b"))
    told = once(pick(F.try_element_at(F.col("_b.Table"), F.lit(1)), "TotalPageCnt"), to_whole)
    counted = F.greatest(F.lit(1).cast("long"), F.ceil(once(pick(F.try_element_at(F.col("_b.Table1"), F.lit(1)), "ROWCNT"), to_whole) / PAGE_ROWS))
    pages = read.withColumn("total_pages", F.coalesce(told, counted))
    carried = [*_carried(payloads), "total_pages"]
    rows, r = _folded(pages.select(*carried, F.explode("_b.Table").alias("r"))), F.col("r")
    texts = {"source_id": "NEWSID", "scrip_code": "SCRIP_CD", "company": "SLONGNAME", "category": "CATEGORYNAME", "subcategory": "SUBCATNAME", "subject": "NEWSSUB", "details": "HEADLINE", "_named": "ATTACHMENTNAME"}
    found = rows.select(
        *carried, *(picked(r, key).alias(name) for name, key in texts.items()), to_whole(picked(r, "Fld_Attachsize")).alias("_size"),
        parse_exchange_time(picked(r, "News_submission_dt")).alias("submitted_ts"), parse_exchange_time(picked(r, "DissemDT")).alias("disseminated_ts"), parse_exchange_time(picked(r, "NEWS_DT", "DT_TM")).alias("_told_ts"),
    )
    return found.where("source_id is not null").select(
        *carried, *(c for c in texts if c != "_named"), F.concat(F.lit(attachment_base), "_named").alias("attachment_url"), F.when(F.col("_named").isNotNull() & (F.col("_size") != 0), F.col("_size")).alias("attachment_size"),
        "submitted_ts", "disseminated_ts", F.coalesce("disseminated_ts", "_told_ts", "submitted_ts").alias("event_ts"),
    )


def row_id(r: Column) -> Column:
    """The folded record's own id, else one made of what it says."""
    said = F.concat_ws("|", *(F.coalesce(picked(r, k), F.lit("")) for k in ("symbol", "an_dt", "desc", "attchmntFile")))
    return F.coalesce(picked(r, "seq_id"), F.concat(F.lit("h:"), F.substring(F.sha1(said), 1, 20)))


def listed_announcements(payloads: DataFrame) -> DataFrame:
    """Announcements that come as one list: an id of their own or one made of their content; drift tells a stated difference that the two times don't have."""
    rows, r = _folded(_listed(payloads, _either(F.col("payload")))), F.col("r")
    texts = {"symbol": "symbol", "isin": "sm_isin", "company": "sm_name", "subject": "desc", "details": "attchmntText", "attachment_url": "attchmntFile"}
    found = rows.select(
        *_carried(payloads), row_id(r).alias("source_id"), picked(r, "seq_id").isNull().alias("made_id"), *(picked(r, key).alias(name) for name, key in texts.items()), once(picked(r, "attFileSize", "fileSize"), display_size).alias("attachment_size"),
        parse_exchange_time(picked(r, "an_dt", "sort_date")).alias("submitted_ts"), parse_exchange_time(picked(r, "exchdisstime")).alias("disseminated_ts"), once(picked(r, "difference"), signed_duration).alias("_stated"),
    )
    gap = F.unix_seconds("disseminated_ts") - F.unix_seconds("submitted_ts")
    return found.select(
        *_carried(payloads), "source_id", "made_id", *texts, "attachment_size", "submitted_ts", "disseminated_ts", F.coalesce("disseminated_ts", "submitted_ts").alias("event_ts"), F.coalesce(F.col("_stated") != gap, F.lit(False)).alias("drift")
    )


def only_rows(payloads: DataFrame, known: DataFrame) -> DataFrame:
    """Each payload again as a list of those of its records whose id isn't in known (source_id), in their order: what is worth storing of a list that comes whole each time."""
    rows = _listed(payloads, _either(F.col("payload"))).withColumn("_f", folded(F.col("r"))).withColumn("source_id", row_id(F.col("_f"))).drop("_f")
    new = rows.join(known.select("source_id").distinct(), "source_id", "left_anti")
    kept = new.groupBy(*_carried(payloads)).agg(F.sort_array(F.collect_list(F.struct("place", F.to_json("r").alias("r")))).alias("rs"))
    return kept.select(*_carried(payloads), F.concat(F.lit("["), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit("]")).alias("payload"))


def daily_prices(files: DataFrame, *, records: str = "records", day: str = "day") -> DataFrame:
    """files (day asked for, records): rows with a symbol and a series. Rows dated another day have other_day set; they are for counting only."""
    rows = files.select(day, F.posexplode(records).alias("place", "r"))
    r = F.col("r")
    number = lambda k: to_number(F.try_element_at(r, F.lit(k)))
    text = lambda k: clean_text(F.try_element_at(r, F.lit(k)))
    dated = parse_date(F.try_element_at(r, F.lit("DATE1")))
    return rows.select(
        day, text("SYMBOL").alias("symbol"), text("SERIES").alias("series"), dated.alias("dated"), (dated.isNotNull() & (dated != F.col(day))).alias("other_day"), number("PREV_CLOSE").alias("prev_close"), number("OPEN_PRICE").alias("open"),
        number("HIGH_PRICE").alias("high"), number("LOW_PRICE").alias("low"), number("LAST_PRICE").alias("last"), number("CLOSE_PRICE").alias("close"), number("AVG_PRICE").alias("avg_price"), to_whole(F.try_element_at(r, F.lit("TTL_TRD_QNTY"))).alias("volume"),
        number("TURNOVER_LACS").alias("turnover_lacs"), to_whole(F.try_element_at(r, F.lit("NO_OF_TRADES"))).alias("trades"), to_whole(F.try_element_at(r, F.lit("DELIV_QTY"))).alias("delivered"), number("DELIV_PER").alias("delivered_pct"),
    ).where("symbol is not null and series is not null")


def index_closes(files: DataFrame, *, records: str = "records", day: str = "day") -> DataFrame:
    """As daily_prices, of index values by name."""
    rows, r = files.select(day, F.posexplode(records).alias("place", "r")), F.col("r")
    number = lambda k: to_number(F.try_element_at(r, F.lit(k)))
    dated = parse_date(F.try_element_at(r, F.lit("INDEX DATE")))
    return rows.select(
        day, clean_text(F.try_element_at(r, F.lit("INDEX NAME"))).alias("index_name"), dated.alias("dated"), (dated.isNotNull() & (dated != F.col(day))).alias("other_day"), number("OPEN INDEX VALUE").alias("open"), number("HIGH INDEX VALUE").alias("high"), number("LOW INDEX VALUE").alias("low"),
        number("CLOSING INDEX VALUE").alias("close"), number("POINTS CHANGE").alias("points_change"), number("CHANGE(%)").alias("pct_change"), to_whole(F.try_element_at(r, F.lit("VOLUME"))).alias("volume"), number("P/E").alias("pe"), number("P/B").alias("pb"), number("DIV YIELD").alias("div_yield"),
    ).where("index_name is not null")


def file_outcomes(rows: DataFrame, *, day: str = "day") -> DataFrame:
    """Per day: records kept, records of other days, the days seen, and what that makes: loaded, other_day or not_published."""
    kept = F.count_if(~F.col("other_day"))
    found = rows.groupBy(day).agg(kept.alias("kept"), F.count_if("other_day").alias("dropped"), F.array_sort(F.collect_set("dated")).alias("dates_seen"))
    return found.withColumn("outcome", F.when(F.col("kept") > 0, "loaded").when(F.col("dropped") > 0, "other_day").otherwise("not_published"))


def bands(files: DataFrame, *, records: str = "records") -> DataFrame:
    keep = [c for c in files.columns if c != records]
    rows, text = files.select(*keep, F.explode(records).alias("r")), lambda k: clean_text(F.try_element_at(F.col("r"), F.lit(k)))
    return rows.select(*keep, text("SYMBOL").alias("symbol"), text("SERIES").alias("series"), text("BAND").alias("band"), text("REMARKS").alias("remarks")).where("symbol is not null and series is not null")


def instruments(files: DataFrame, *, records: str = "records") -> DataFrame:
    keep, r = [c for c in files.columns if c != records], F.col("r")
    at = lambda k: F.try_element_at(r, F.lit(k))
    rows = files.select(*keep, F.explode(records).alias("r"))
    return rows.select(*keep, clean_text(at("SYMBOL")).alias("symbol"), clean_text(at("SERIES")).alias("series"), clean_text(at("ISIN NUMBER")).alias("isin"), clean_text(at("NAME OF COMPANY")).alias("name"), parse_date(at("DATE OF LISTING")).alias("listed_on"), to_number(at("FACE VALUE")).alias("face_value"), to_whole(at("MARKET LOT")).alias("market_lot")).where("symbol is not null and series is not null")


def holidays(payloads: DataFrame) -> DataFrame:
    """Segment, day and description; a payload without the cash segment CM is no holiday list."""
    body = F.from_json("payload", f"map<string,{RECORDS}>")
    known = payloads.withColumn("_b", body).where(F.map_contains_key("_b", "CM"))
    rows = _folded(known.select(*_carried(payloads), F.explode("_b").alias("segment", "rs")).select("*", F.explode("rs").alias("r")).drop("rs"))
    return rows.select(*_carried(payloads), "segment", parse_date(picked(F.col("r"), "tradingDate")).alias("day"), picked(F.col("r"), "description").alias("description")).where("day is not null")


def symbol_changes(files: DataFrame, *, rows: str = "rows") -> DataFrame:
    """Lines without a header: name, old symbol, new symbol, date; lines of another width or without a date or symbol are left out."""
    keep = [c for c in files.columns if c != rows]
    lines = files.select(*keep, F.explode(rows).alias("r")).where("size(r) = 4")
    cell = lambda k: clean_text(F.col("r")[k])
    return lines.select(*keep, F.upper(cell(1)).alias("old_symbol"), F.upper(cell(2)).alias("new_symbol"), parse_date(F.col("r")[3]).alias("effective"), cell(0).alias("company")).where("effective is not null and old_symbol is not null and new_symbol is not null")


def scrips(payloads: DataFrame) -> DataFrame:
    """The first record of each code; an ISIN of another shape is null."""
    rows, r = _folded(_listed(payloads, F.from_json("payload", RECORDS))), F.col("r")
    isin = F.upper(picked(r, "ISIN_NUMBER"))
    found = rows.withColumn("code", picked(r, "SCRIP_CD")).where("code is not null")
    first = found.groupBy(*_carried(payloads), "code").agg(F.min_by("r", "place").alias("r"))
    return first.select(*_carried(payloads), "code", picked(r, "scrip_id").alias("symbol"), picked(r, "Scrip_Name").alias("name"), F.when(isin.rlike(ISIN), isin).alias("isin"), picked(r, "Status").alias("status"), picked(r, "GROUP").alias("scrip_group"), to_number(picked(r, "FACE_VALUE")).alias("face_value"))


def corporate_actions(payloads: DataFrame) -> DataFrame:
    rows, r = _folded(_listed(payloads, F.from_json("payload", RECORDS))), F.col("r")
    found = rows.select(*_carried(payloads), F.upper(picked(r, "symbol")).alias("symbol"), picked(r, "series").alias("series"), picked(r, "isin").alias("isin"), picked(r, "subject").alias("subject"), parse_date(picked(r, "exDate")).alias("ex_date"), parse_date(picked(r, "recDate")).alias("record_date"), to_number(picked(r, "faceVal")).alias("face_value"))
    found = found.where("symbol is not null and subject is not null and ex_date is not null").withColumn("_a", actions.classify(F.col("subject")))
    return found.select("*", "_a.*").drop("_a")


def surveillance(payloads: DataFrame, lists: dict[str, tuple[str, str, str]]) -> DataFrame:
    """lists: name to (path of its records, field of the stage, field of the time). Records without a symbol are left out."""

    def one(name: str, path: str, stage: str, time: str) -> DataFrame:
        records = F.from_json("payload", RECORDS) if not path else F.from_json(F.get_json_object("payload", f"$.{path}"), RECORDS)
        rows, r = _folded(_listed(payloads, records)), F.col("r")
        since = F.coalesce(exchange_date(parse_exchange_time(picked(r, time))), parse_date(picked(r, time)))
        return rows.select(*_carried(payloads), F.lit(name).alias("list_name"), F.upper(picked(r, "symbol")).alias("symbol"), picked(r, "isin").alias("isin"), picked(r, stage).alias("stage"), picked(r, "survCode").alias("code"), since.alias("since")).where("symbol is not null")

    found = [one(n, *x) for n, x in lists.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# fixed values: where each surveillance list keeps its records, stage and time
LONG_AND_SHORT = {"LTASM": ("longterm.data", "asmSurvIndicator", "asmTime"), "STASM": ("shortterm.data", "asmSurvIndicator", "asmTime")}
GRADED = {"GSM": ("", "gsmStage", "gsmTime")}


def _link(x: Column) -> Column:
    """A URL; the placeholders of records without a file are null."""
    url = clean_text(x)
    return F.when(~F.lower(F.substring_index(url, "/", -1)).isin("-", "null", ""), url)


def _says(x: Column, word: str) -> Column:
    return F.coalesce(F.lower(clean_text(x)) == word, F.lit(False))


def results_index(payloads: DataFrame) -> DataFrame:
    """Quarterly results of the older regime (a list, of which cumulative statements are left out) and of the newer one (under data, public from the later of two times)."""
    text = F.col("payload")
    old, new = payloads.where(F.ltrim(text).startswith("[")), payloads.where(~F.ltrim(text).startswith("["))
    r = F.col("r")
    at = lambda k: F.try_element_at(r, F.lit(k))
    common = lambda end, seq: [clean_text(at("symbol")).alias("symbol"), parse_date(at(end)).alias("period_end"), _says(at("consolidated"), "consolidated").alias("consolidated"), _says(at("audited"), "audited").alias("audited"), _link(at("xbrl")).alias("xbrl_url"), clean_text(at(seq)).alias("seq")]
    first = _listed(old, F.from_json("payload", RECORDS)).where(_says(at("cumulative"), "non-cumulative"))
    first = first.select(*_carried(payloads), *common("toDate", "seqNumber"), parse_exchange_time(at("exchdisstime")).alias("disseminated_ts"), F.lit("legacy").alias("regime"), F.lit(False).alias("revised"))
    second = _listed(new, F.from_json("payload", f"data {RECORDS}")["data"])
    second = second.select(*_carried(payloads), *common("qe_Date", "seq_Id"), F.greatest(parse_exchange_time(at("broadcast_Date")), parse_exchange_time(at("creation_Date"))).alias("disseminated_ts"), F.lit("integrated").alias("regime"), (~_says(at("type_Sub"), "original")).alias("revised"))
    return first.unionByName(second).where("symbol is not null and period_end is not null")


def first_facts(text: str | None, context: str, names: list[str], bounds: list[str]) -> list[str | None]:
    """Text of the first fact of each name in a context, and of the first element of each bound within the contexts of that id; a file is parsed once. Null for an empty file; one that is no XML raises."""
    if not text:
        return [None] * (len(names) + len(bounds))
    found: dict[str, str] = {}
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    for e in ElementTree.fromstring(text.encode("utf-8")).iter():
        name = local(e)
        if e.get("contextRef") == context and name in names and name not in found:
            found[name] = "".join(e.itertext())
        if name == "context" and e.get("id") == context:
            for x in e.iter():
                if x is not e and local(x) in bounds and local(x) not in found:
                    found[local(x)] = "".join(x.itertext())
    return [found.get(n) for n in (*names, *bounds)]


def xbrl_facts(payloads: DataFrame, *, context: str = "OneD") -> DataFrame:
    """What a results file states for its reporting quarter: the first fact of each name in the context."""
    names = ["Symbol", "ISIN", "DateOfStartOfReportingPeriod", "DateOfEndOfReportingPeriod", "NatureOfReportStandaloneConsolidated", "RevenueFromOperations"]
    bounds = ["startDate", "endDate"]

    @F.pandas_udf(", ".join(f"{n} string" for n in [*names, *bounds]))
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([first_facts(t, context, names, bounds) for t in texts], columns=[*names, *bounds], dtype=object)

    carried, parsed = _carried(payloads), payloads.withColumn("_x", parse("payload"))
    fact = bound = lambda name: clean_text(F.col(f"_x.{name}"))
    nature = F.lower(fact("NatureOfReportStandaloneConsolidated"))
    return parsed.select(
        *carried, fact("Symbol").alias("symbol"), fact("ISIN").alias("isin"), parse_date(F.coalesce(fact("DateOfStartOfReportingPeriod"), bound("startDate"))).alias("period_start"),
        parse_date(F.coalesce(fact("DateOfEndOfReportingPeriod"), bound("endDate"))).alias("period_end"), (nature == "consolidated").alias("consolidated"), to_number(fact("RevenueFromOperations")).alias("revenue"),
    )


def broker_instruments(payloads: DataFrame, segments: list[str]) -> DataFrame:
    """Instruments of the wanted segments whose key has its two halves."""
    rows = _listed(payloads, F.from_json("payload", "array<struct<instrument_key:string,segment:string,instrument_type:string,trading_symbol:string,name:string,isin:string,exchange_token:string,lot_size:double,tick_size:double>>"))
    return rows.select(*_carried(payloads), "r.*").where(F.col("segment").isin(segments) & F.col("instrument_key").contains("|")).withColumn("lot_size", F.col("lot_size").cast("int"))


def candles(payloads: DataFrame) -> DataFrame:
    """Bars of replies that say success: instants with an offset, four prices, volume and open interest; reject tells why a candle doesn't count."""
    body = F.from_json("payload", "status string, data struct<candles:array<array<string>>>")
    good = payloads.withColumn("_b", body).where("_b.status = 'success'")
    rows = good.select(*_carried(payloads), F.posexplode("_b.data.candles").alias("place", "c"))
    number = lambda k: F.try_element_at(F.col("c"), F.lit(k)).try_cast("double")
    rows = rows.select(
        *_carried(payloads), "place", F.size("c").alias("n"), F.when(F.col("c")[0].rlike(r"([+-]\d\d:?\d\d|Z)$"), F.try_to_timestamp(F.col("c")[0])).alias("ts"), number(2).alias("open"), number(3).alias("high"), number(4).alias("low"), number(5).alias("close"),
        number(6).cast("long").alias("volume"), F.coalesce(number(7), F.lit(0.0)).cast("long").alias("open_interest"),
    )
    shaped = (F.col("n") >= 6) & F.col("ts").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & F.col("volume").isNotNull()
    agrees = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high")) & (F.col("low") > 0)
    return rows.withColumn("reject", F.when(~shaped, "shape").when(~agrees, "prices")).drop("n")


# fixed values: where a broker's reply has each charge
CHARGES = {"brokerage": "brokerage", "stt": "taxes.stt", "stamp_duty": "taxes.stamp_duty", "gst": "taxes.gst", "exchange_transaction": "other_charges.transaction", "ipft": "other_charges.ipft", "sebi_fee": "other_charges.sebi_turnover", "clearing": "other_charges.clearing", "total": "total"}


def charges(payloads: DataFrame) -> DataFrame:
    """The charges of replies that say success and have a total."""
    at = lambda path: F.get_json_object("payload", f"$.data.charges.{path}").try_cast("double")
    found = payloads.where(F.get_json_object("payload", "$.status") == "success").select(*_carried(payloads), *(at(p).alias(n) for n, p in CHARGES.items()))
    return found.where("total is not null")


def latest_labels(lines: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """lines (value: a JSON text, and where it stands): the last record of each key."""
    rows = lines.withColumn("r", F.from_json("value", "map<string,string>")).where("r is not null")
    found = rows.select(*(F.col("r")[k].alias(k) for k in keys), "r", *at)
    return found.groupBy(*keys).agg(F.max_by("r", F.struct(*at)).alias("record"))
