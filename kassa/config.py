"""One frozen configuration object for every cleaning, enrichment and KPI rule.

Nothing in the operators is tied to the 14 transaction columns: every column
name, edge, label and token they use comes from here, so another table can be
cleaned by passing another ``CleanConfig``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for identical results; they
# are stated plainly, in their natural order, and kept together.
# ---------------------------------------------------------------------------

# Columns whose null (or NaN) drops the row.
CRITICAL_COLUMNS = ("transaction_id", "customer_id", "price", "quantity",
                    "category", "status", "region")

# Constants written into nulls of non-critical columns.
FILL_VALUES = {"product_name": "Unknown Product", "discount": 0.0}

# Revenue bands: left-closed edges, the last band is open to the right.
BAND_EDGES = (0, 50, 200, 500, 1000)
BAND_LABELS = ("micro", "low", "medium", "high", "premium")

# Text timestamps, second precision.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Missing-value tokens of a CSV file (the default NA list of pandas.read_csv).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
             "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null")

# CSV files: a header, double quotes, a quote inside a quoted field doubled,
# blanks around a field belong to it.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Quantile that marks a high-value transaction, and the median.
HIGH_VALUE_QUANTILE = 0.9
MEDIAN_QUANTILE = 0.5

# Status values turned into rates.
CANCELLED_STATUS = "cancelled"
REFUNDED_STATUS = "refunded"

# Digits of reported values.
MONEY_DIGITS = 2
RATE_DIGITS = 2
AVG_DISCOUNT_DIGITS = 4
NULL_RATE_DIGITS = 4

# Number of customers in the top-customer report.
TOP_CUSTOMERS = 10

# Money is exact: every per-row amount is a decimal with 6 places. A price is
# read with 18 digits before the point; a larger one is rejected like a
# non-finite one, and price * quantity then always fits the amount's type.
PRICE_TYPE = "decimal(24,6)"
PRICE_LIMIT = 1e18
RATE_TYPE = "decimal(7,6)"
MONEY_TYPE = "decimal(38,6)"

# Synthetic transactions: value lists, draws and named scales.
CATEGORIES = ("Electronics", "Clothing", "Books", "Home & Kitchen", "Sports", "Toys",
              "Grocery", "Automotive", "Health", "Beauty")
PAYMENT_METHODS = ("credit_card", "debit_card", "paypal", "upi", "net_banking", "cod")
STATUSES = ("completed", "pending", "cancelled", "refunded")
REGIONS = ("North", "South", "East", "West", "Central")
DEVICE_TYPES = ("mobile", "desktop", "tablet")
CUSTOMER_ID_RANGE = (1000, 99998)          # inclusive
PRODUCT_ID_RANGE = (100, 9998)             # inclusive
PRICE_EXP_SCALE, PRICE_OFFSET = 150.0, 5.0  # round(Exp(150) + 5, 2)
QUANTITY_RANGE = (1, 10)                   # inclusive
DISCOUNT_SHARE = 0.3                       # share of rows with a discount
DISCOUNT_RANGE = (0.05, 0.40)              # uniform, rounded to 2 places
MISSING_NAME_SHARE = 0.02                  # product name written as the text "None"
DUPLICATE_FLAG_SHARE = 0.01
TIMESTAMP_RANGE = ("2022-01-01 00:00:00", "2024-12-31 00:00:00")  # [start, end)
SCALES = {"small": (10_000, "10K"), "medium": (100_000, "100K"),
          "large": (1_000_000, "1M"), "extra_large": (10_000_000, "10M")}


@dataclass(frozen=True)
class CleanConfig:
    """Parameters of the cleaning, enrichment and KPI stages."""

    key: str = "transaction_id"
    # Order inside one key: the first row after sorting survives.
    order_by: tuple[str, ...] = ("timestamp",)
    # Explicit tie-breakers after ``order_by``; None means every other column,
    # which leaves ties only between identical rows.
    tie_breakers: tuple[str, ...] | None = None
    # Helper columns that exist only to break ties; dropped after dedup.
    drop_after_dedup: tuple[str, ...] = ()
    critical: tuple[str, ...] = CRITICAL_COLUMNS
    fills: tuple[tuple[str, object], ...] = tuple(FILL_VALUES.items())
    price: str = "price"
    quantity: str = "quantity"
    discount: str = "discount"
    timestamp: str = "timestamp"
    status: str = "status"
    customer: str = "customer_id"
    product: str = "product_id"
    category: str = "category"
    payment: str = "payment_method"
    region: str = "region"
    discount_range: tuple[float, float] = (0.0, 1.0)
    band_edges: tuple = BAND_EDGES
    band_labels: tuple[str, ...] = BAND_LABELS
    timestamp_format: str = TIMESTAMP_FORMAT
    na_tokens: tuple[str, ...] = NA_TOKENS
    high_value_quantile: float = HIGH_VALUE_QUANTILE
    # "sunday" -> Sunday=1..Saturday=7 ; "monday" -> Monday=0..Sunday=6
    week_start: str = "sunday"
    # None -> exact quantiles; a float -> approximate with that rank error.
    quantile_error: float | None = None
    drop_null_keys: bool = False
    top_customers: int = TOP_CUSTOMERS


DEFAULT = CleanConfig()
