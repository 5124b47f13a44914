"""Values that define the reports; changing one changes the published figures."""

from __future__ import annotations

# Order statuses the reports distinguish.
DELIVERED = "Delivered"
RETURNED = "Returned"
CANCELLED = "Cancelled"

# Rows kept by the top lists, and bins of the histograms.
TOP_CUSTOMERS = 20
TOP_PRODUCTS = 10
HISTOGRAM_BINS = 30

# RFM scores. A customer scores 5, 4, 3, 2 for the first limit met
# (days since the last order at most, orders at least), and 1 otherwise. The
# monetary score is one of five tiles.
RECENCY_LIMITS = (30, 90, 180, 365)
FREQUENCY_LIMITS = (20, 10, 5, 2)
MONETARY_TILES = 5

# RFM segments. The least score totals of the first three, then
# the least recency or frequency score of the next two; the last takes the rest.
SEGMENT_TOTALS = (13, 10, 7)
RECENT_SCORE = 4
AT_RISK_SCORE = 4
SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "Recent Customers",
    "At Risk",
    "Churned",
)

# A customer is churned more than this many days after an order.
CHURN_DAYS = 180

# Stock levels and their labels.
LOW_STOCK = 50
CRITICAL_STOCK = 20
STOCK_LABELS = ("OUT OF STOCK", "CRITICAL", "LOW", "OK")

# Model inputs in order, and the coded ones among them.
FEATURES = (
    "recency",
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_shipping",
    "returns",
    "cancellations",
    "avg_discount",
    "age",
    "gender",
    "region",
    "loyalty_tier",
    "tenure_days",
)
CATEGORIES = ("gender", "region", "loyalty_tier")

# Forest, split and evaluation.
TREES = 200
DEPTH = 8
MIN_LEAF = 5
SEED = 42
TEST_PARTS = 5  # one row in five is a test row
FOLDS = 5
TOP_FEATURES = 3
CLASS_NAMES = ("Active", "Churned")

# Churn probabilities above these limits make the first two bands.
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
RISK_BANDS = ("High Risk", "Medium Risk", "Low Risk")
PROBABILITY_DIGITS = 4
