"""The reference dimensions at work: decoding, tier assignment and GL rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import is_true, or_zero, total
from ledgerloom.quality.rules import CUSIP, ISIN
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.refdata import FEE_TIERS, decode, gl_label, in_range, ref


def loans_by_naics(lake: Lake) -> DataFrame:
    loans = lake.silver("loans").groupBy("naics_code").agg(
        F.count(F.lit(1)).alias("loan_count"), total("current_balance").alias("total_balance"))
    names = ref(lake.spark, "naics_codes").withColumnRenamed("naics_code", "ref_code")
    return decode(loans, names, "naics_code", "ref_code")


def wires_by_country(lake: Lake) -> DataFrame:
    wires = lake.silver("wire_transfers").groupBy("beneficiary_country").agg(
        F.count(F.lit(1)).alias("wire_count"), total("amount").alias("total_amount"))
    return decode(wires, ref(lake.spark, "country_codes"), "beneficiary_country", "country_code")


def wires_by_currency(lake: Lake) -> DataFrame:
    """Amounts rounded to the minor unit of their currency before they are added up."""
    wires = decode(
        lake.silver("wire_transfers").select("currency", "amount"), ref(lake.spark, "currency_codes"),
        "currency", "currency_code")
    minor = F.when(F.col("decimals") == 0, F.round("amount", 0)).otherwise(F.round("amount", 2))
    return wires.groupBy("currency", "currency_name", "symbol", "decimals").agg(
        F.count(F.lit(1)).alias("wire_count"), F.sum(minor).alias("total_amount"))


ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _value(c: Column) -> Column:
    """Digits count as themselves, letters from 10 on; -1 for anything else."""
    return F.call_function("instr", F.lit(ALPHANUMERIC), c) - 1


def _digit_sum(values: Column, doubled: int) -> Column:
    """Sum of the digits of the values, every second one doubled from place `doubled` (0 or 1) on."""
    weighed = F.transform(values, lambda v, i: F.when(i % 2 == doubled, v * 2).otherwise(v))
    return F.aggregate(weighed, F.lit(0), lambda s, v: s + F.floor(v / 10).cast("int") + v % 10)


def cusip_check(cusip: Column) -> Column:
    """Whether the ninth character of a well-formed CUSIP is its check digit; NULL for other texts."""
    values = F.transform(F.split(F.substring(cusip, 1, 8), ""), _value)
    return F.when(cusip.rlike(CUSIP), (10 - _digit_sum(values, 1) % 10) % 10 == F.substring(cusip, 9, 1).try_cast("int"))


def isin_check(isin: Column) -> Column:
    """Whether the last digit of a well-formed ISIN is its check digit; NULL for other texts."""
    digits = F.array_join(F.transform(F.split(F.substring(isin, 1, 11), ""), lambda c: _value(c).cast("string")), "")
    values = F.transform(F.reverse(F.split(digits, "")), lambda d: d.cast("int"))
    return F.when(isin.rlike(ISIN), (10 - _digit_sum(values, 0) % 10) % 10 == F.substring(isin, 12, 1).cast("int"))


def cusip_master(lake: Lake) -> DataFrame:
    """One row per CUSIP of the securities: what it stands for, and whether it is well formed and checks."""
    return lake.silver("securities").groupBy("cusip").agg(
        F.min("security_name").alias("issuer_name"), F.min("security_type").alias("security_type"), F.min("country").alias("country"),
        F.count(F.lit(1)).alias("securities"),
    ).withColumns({"well_formed": is_true(F.col("cusip").rlike(CUSIP)), "check_digit_ok": cusip_check(F.col("cusip"))})


def isin_mapping(lake: Lake) -> DataFrame:
    """ISIN to CUSIP of the securities, and whether the ISIN holds the CUSIP and checks."""
    return lake.silver("securities").select("isin", "cusip").distinct().select(
        "isin", "cusip", F.substring("isin", 1, 2).alias("country_code"),
        is_true(F.substring("isin", 3, 9) == F.col("cusip")).alias("holds_cusip"), isin_check(F.col("isin")).alias("check_digit_ok"))


def lei_registry(lake: Lake) -> DataFrame:
    """Legal entities behind the counterparties, with what is exposed to them."""
    return lake.silver("counterparties").groupBy("lei").agg(
        F.min("counterparty_name").alias("legal_name"), F.min("country").alias("jurisdiction"), F.min("status").alias("status"),
        F.count(F.lit(1)).alias("counterparties"), total("total_exposure").alias("total_exposure"))


def accounts_by_district(lake: Lake) -> DataFrame:
    """Deposits by Federal Reserve district of the routing number."""
    accounts = (
        lake.silver("accounts").groupBy(F.substring("routing_number", 1, 2).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("account_count"), total("current_balance").alias("total_balance"))
    )
    return decode(accounts, ref(lake.spark, "fed_district_codes"), "prefix", "routing_prefix")


def products_held(lake: Lake) -> DataFrame:
    """Holdings of every catalogued product across deposits, loans, cards and wealth."""
    sources = (
        ("accounts", "account_type", "current_balance"), ("loans", "loan_type", "current_balance"),
        ("credit_cards", "card_type", "current_balance"), ("portfolios", "account_type", "market_value"))
    held = None
    for table, kind, amount in sources:
        part = lake.silver(table).groupBy(F.col(kind).alias("code")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"))
        held = part if held is None else held.unionByName(part)
    return (
        decode(held, ref(lake.spark, "product_catalog"), "code", "product_code")
        .groupBy("code", "product_name", "category", "division")
        .agg(F.sum("n").alias("holdings"), F.round(F.sum("amount"), 2).alias("total_amount"))
        .withColumnRenamed("code", "product_code")
    )


def fee_tier_assignment(lake: Lake) -> DataFrame:
    """Fee tier of each wealth client by assets under management."""
    aum = F.col("total_aum")

    def field(i: int):
        return in_range(aum, [(row[1], row[2], row[i]) for row in FEE_TIERS])

    return lake.silver("wm_clients").select(
        "wm_client_id", "total_aum", field(0).alias("tier_name"), field(3).cast("int").alias("advisory_fee_bps"),
        field(4).cast("int").alias("management_fee_bps"))


def posted_lines(lake: Lake, *keys) -> DataFrame:
    """GL postings summed by account (and extra keys) and labelled with their hierarchy row.

    Postings are reduced to one row per account first, so the join carries accounts, not entries.
    """
    entry, amount = F.col("entry_type"), F.col("amount")
    posted = lake.silver("gl_entries").groupBy("gl_account_id", *keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.when(entry == "Debit", amount)).alias("debits"),
        F.sum(F.when(entry == "Credit", amount)).alias("credits"),
    )
    numbered = posted.join(lake.silver("gl_accounts").select("gl_account_id", "account_number"), "gl_account_id")
    number = F.col("account_number")
    return numbered.select(
        *[c for c in numbered.columns if c != "account_number"],
        gl_label(number, 0).alias("l1_type"), gl_label(number, 1).alias("l2_category"),
        gl_label(number, 3).alias("call_report_line"))


def gl_hierarchy_rollup(lake: Lake) -> DataFrame:
    return posted_lines(lake).groupBy("l1_type", "l2_category", "call_report_line").agg(
        F.count(F.lit(1)).alias("gl_accounts"), F.sum("entries").alias("entry_count"),
        F.sum(or_zero("debits")).alias("total_debits"), F.sum(or_zero("credits")).alias("total_credits"))


REFERENCE = {
    "ref_naics_codes": loans_by_naics,
    "ref_country_codes": wires_by_country,
    "ref_currency_codes": wires_by_currency,
    "ref_cusip_master": cusip_master,
    "ref_isin_mapping": isin_mapping,
    "ref_lei_registry": lei_registry,
    "ref_fed_district_codes": accounts_by_district,
    "ref_product_catalog": products_held,
    "fee_tier_assignment": fee_tier_assignment,
    "gl_hierarchy_rollup": gl_hierarchy_rollup,
}
