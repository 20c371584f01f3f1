"""Reference dimensions: fixed code tables of at most a few dozen rows, and how they decode the data.

The tables are literal, so broadcasting them is bounded by what is written here.
Ranges are turned into a CASE expression, which needs no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values ----------------------------------------------------------------------------------
NAICS = (
    ("11", "Agriculture, Forestry, Fishing and Hunting"),
    ("21", "Mining, Quarrying, and Oil and Gas Extraction"),
    ("22", "Utilities"),
    ("23", "Construction"),
    ("31", "Manufacturing - Food, Beverage, Textile"),
    ("32", "Manufacturing - Wood, Paper, Chemical"),
    ("33", "Manufacturing - Metal, Machinery, Electronics"),
    ("42", "Wholesale Trade"),
    ("44", "Retail Trade - Motor Vehicle, Furniture, Electronics"),
    ("45", "Retail Trade - General, Food, Health"),
    ("48", "Transportation and Warehousing"),
    ("49", "Transportation - Postal, Warehousing"),
    ("51", "Information"),
    ("52", "Finance and Insurance"),
    ("53", "Real Estate and Rental and Leasing"),
    ("54", "Professional, Scientific, and Technical Services"),
    ("55", "Management of Companies and Enterprises"),
    ("56", "Administrative and Support Services"),
    ("61", "Educational Services"),
    ("62", "Health Care and Social Assistance"),
    ("71", "Arts, Entertainment, and Recreation"),
    ("72", "Accommodation and Food Services"),
    ("81", "Other Services"),
    ("92", "Public Administration"),
)
COUNTRIES = (
    ("US", "United States", "USD"),
    ("GB", "United Kingdom", "GBP"),
    ("DE", "Germany", "EUR"),
    ("FR", "France", "EUR"),
    ("JP", "Japan", "JPY"),
    ("CA", "Canada", "CAD"),
    ("AU", "Australia", "AUD"),
    ("CH", "Switzerland", "CHF"),
    ("CN", "China", "CNY"),
    ("MX", "Mexico", "MXN"),
    ("BR", "Brazil", "BRL"),
    ("IN", "India", "INR"),
    ("KR", "South Korea", "KRW"),
    ("SG", "Singapore", "SGD"),
    ("HK", "Hong Kong", "HKD"),
    ("SE", "Sweden", "SEK"),
    ("NO", "Norway", "NOK"),
    ("NL", "Netherlands", "EUR"),
    ("IE", "Ireland", "EUR"),
    ("IT", "Italy", "EUR"),
)
CURRENCIES = (
    ("USD", "US Dollar", "$", 2),
    ("EUR", "Euro", "€", 2),
    ("GBP", "British Pound", "£", 2),
    ("JPY", "Japanese Yen", "¥", 0),
    ("CHF", "Swiss Franc", "CHF", 2),
    ("CAD", "Canadian Dollar", "C$", 2),
    ("AUD", "Australian Dollar", "A$", 2),
    ("CNY", "Chinese Yuan", "¥", 2),
    ("MXN", "Mexican Peso", "Mex$", 2),
    ("BRL", "Brazilian Real", "R$", 2),
    ("INR", "Indian Rupee", "₹", 2),
    ("KRW", "South Korean Won", "₩", 0),
    ("SGD", "Singapore Dollar", "S$", 2),
    ("HKD", "Hong Kong Dollar", "HK$", 2),
    ("SEK", "Swedish Krona", "kr", 2),
    ("NOK", "Norwegian Krone", "kr", 2),
)
FED_DISTRICTS = (
    (1, "Boston", "01"),
    (2, "New York", "02"),
    (3, "Philadelphia", "03"),
    (4, "Cleveland", "04"),
    (5, "Richmond", "05"),
    (6, "Atlanta", "06"),
    (7, "Chicago", "07"),
    (8, "St. Louis", "08"),
    (9, "Minneapolis", "09"),
    (10, "Kansas City", "10"),
    (11, "Dallas", "11"),
    (12, "San Francisco", "12"),
)
PRODUCTS = (
    ("CHECKING", "Personal Checking", "Deposit", "Retail"),
    ("SAVINGS", "Personal Savings", "Deposit", "Retail"),
    ("MONEY_MARKET", "Money Market Account", "Deposit", "Retail"),
    ("CD", "Certificate of Deposit", "Deposit", "Retail"),
    ("IRA", "Individual Retirement Account", "Deposit", "Retail"),
    ("MORTGAGE", "Residential Mortgage", "Loan", "Lending"),
    ("AUTO", "Auto Loan", "Loan", "Lending"),
    ("PERSONAL", "Personal Loan", "Loan", "Lending"),
    ("HELOC", "Home Equity Line of Credit", "Loan", "Lending"),
    ("COMMERCIAL", "Commercial Loan", "Loan", "Commercial"),
    ("SBA", "SBA Loan", "Loan", "Commercial"),
    ("VISA_PLATINUM", "Visa Platinum Card", "Card", "Cards"),
    ("MC_GOLD", "Mastercard Gold", "Card", "Cards"),
    ("VISA_SIGNATURE", "Visa Signature Card", "Card", "Cards"),
    ("MC_WORLD", "Mastercard World", "Card", "Cards"),
    ("VISA_CLASSIC", "Visa Classic Card", "Card", "Cards"),
    ("BROKERAGE", "Brokerage Account", "Investment", "Wealth"),
    ("IRA_WM", "IRA - Wealth Managed", "Investment", "Wealth"),
    ("ROTH_IRA", "Roth IRA", "Investment", "Wealth"),
    ("401K", "401(k) Plan", "Investment", "Wealth"),
    ("TRUST", "Trust Account", "Investment", "Wealth"),
)
# tier, lowest and highest assets under management (both included), advisory and management fee in basis points
FEE_TIERS = (
    ("Standard", 0, 249999, 150, 75),
    ("Preferred", 250000, 999999, 125, 60),
    ("Premier", 1000000, 4999999, 100, 50),
    ("Private Banking", 5000000, 24999999, 75, 40),
    ("Ultra HNW", 25000000, 999999999, 50, 25),
)
# account type, category, account number range, call-report line
GL_HIERARCHY = (
    ("Asset", "Cash and Due From", "1000-1099", "RC-B1"),
    ("Asset", "Investment Securities", "1100-1299", "RC-B2"),
    ("Asset", "Loans and Leases", "1300-1599", "RC-C1"),
    ("Asset", "Allowance for Loan Losses", "1600-1699", "RC-C2"),
    ("Asset", "Fixed Assets", "1700-1799", "RC-6"),
    ("Asset", "Other Assets", "1800-1999", "RC-11"),
    ("Liability", "Deposits - Domestic", "2000-2199", "RC-E1"),
    ("Liability", "Deposits - Foreign", "2200-2299", "RC-E2"),
    ("Liability", "Borrowed Funds", "2300-2499", "RC-14"),
    ("Liability", "Other Liabilities", "2500-2999", "RC-20"),
    ("Equity", "Common Stock", "3000-3099", "RC-26"),
    ("Equity", "Retained Earnings", "3100-3199", "RC-26a"),
    ("Revenue", "Interest Income", "4000-4499", "RI-1"),
    ("Revenue", "Noninterest Income", "4500-4999", "RI-5"),
    ("Expense", "Interest Expense", "5000-5499", "RI-2"),
    ("Expense", "Provision for Loan Losses", "5500-5599", "RI-4"),
    ("Expense", "Noninterest Expense", "5600-5999", "RI-7"),
)

SCHEMAS = {
    "naics_codes": (NAICS, "naics_code string, description string"),
    "country_codes": (COUNTRIES, "country_code string, country_name string, currency string"),
    "currency_codes": (CURRENCIES, "currency_code string, currency_name string, symbol string, decimals int"),
    "fed_district_codes": (FED_DISTRICTS, "district_number int, district_name string, routing_prefix string"),
    "product_catalog": (PRODUCTS, "product_code string, product_name string, category string, division string"),
    "fee_tiers": (
        FEE_TIERS,
        "tier_name string, min_aum bigint, max_aum bigint, advisory_fee_bps int, management_fee_bps int",
    ),
    "gl_account_hierarchy": (
        GL_HIERARCHY, "l1_type string, l2_category string, account_range string, call_report_line string"),
}


def ref(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = SCHEMAS[name]
    return spark.createDataFrame(list(rows), schema)


def decode(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join a literal code table; unknown codes keep NULL labels."""
    return df.join(F.broadcast(dim), F.col(key) == F.col(dim_key), "left").drop(dim_key)


def in_range(value: Column, ranges: Sequence[tuple[object, object, object]]) -> Column:
    """Label of the closed range (low, high, label) that holds `value`; NULL in a gap."""
    out: Column | None = None
    for low, high, label in ranges:
        hit = value.between(F.lit(low), F.lit(high))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    assert out is not None
    return out


def gl_label(account_number: Column, field: int) -> Column:
    """Field 0..3 of the GL hierarchy row whose account range holds the number."""
    number = account_number.cast("int")
    bounds = [(tuple(int(x) for x in row[2].split("-")), row[field]) for row in GL_HIERARCHY]
    return in_range(number, [(low, high, label) for (low, high), label in bounds])
