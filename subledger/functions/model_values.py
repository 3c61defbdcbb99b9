"""Values of the subscription model.

Fixed values: results are only comparable with published ones when every number
and label below stays as it is.
"""

# Enrolment score
ENROLL_BASE = 0.16
ENROLL_PER_REPEAT_ORDER = 0.07
ENROLL_REPEAT_ORDERS_COUNTED = 3
ENROLL_PER_DELAY_DAY = 0.006
ENROLL_SPEND_WEIGHT = 0.04
ENROLL_MIN = 0.08
ENROLL_MAX = 0.65

# Renewal score
RENEW_BASE = 0.58
RENEW_PER_REPEAT_ORDER = 0.045
RENEW_REPEAT_ORDERS_COUNTED = 4
RENEW_PER_DELAY_DAY = 0.008
RENEW_SPEND_WEIGHT = 0.16
RENEW_CADENCE_WEIGHT = 0.05
RENEW_CADENCE_SPAN_DAYS = 90.0
RENEW_PER_LATE_CYCLE = 0.025
RENEW_FREE_CYCLES = 2
RENEW_MIN = 0.30
RENEW_MAX = 0.92

# Spend signal
SPEND_LOG_SCALE = 8.0

# Cadence
CADENCE_DEFAULT_DAYS = 60
CADENCE_MIN_DAYS = 30
CADENCE_MAX_DAYS = 120

# Billing
MAX_CYCLES = 6
MIN_BILLING_AMOUNT = 5.0
SUBSCRIPTION_PREFIX = "sub_"

# Segments, lowest spend first
VALUE_SEGMENTS = ["value_1", "value_2", "value_3", "value_4"]
QUARTILES = [0.25, 0.5, 0.75]
UNKNOWN_STATE = "UNKNOWN"

# Hash tags
TAG_ENROLL = "enroll"
TAG_RENEW = "renew"
TAG_CATALOG = "catalog"

# Modelled marketing spend
SPEND_FIRST_MONTH = "2016-09-01"
SPEND_LAST_MONTH = "2018-10-01"
SPEND_STATES = ["SP", "RJ", "MG", "RS", "PR", "SC", "BA", "DF"]
CHANNEL_BASE_SPEND = {"paid_search": 8000, "social": 5000, "affiliate": 3500, "email": 1800}
SPEND_FLOOR_SHARE = 0.75
SPEND_RANDOM_SHARE = 0.5
IMPRESSIONS_FLOOR = 50000
IMPRESSIONS_RANDOM = 150000
CLICKS_FLOOR = 1000
CLICKS_RANDOM = 9000

# Modelled catalog attributes
TIER_PREMIUM_ABOVE = 0.82
TIER_STANDARD_ABOVE = 0.28
ELIGIBLE_ABOVE = 0.18
MARGIN_HIGH_ABOVE = 0.70
MARGIN_MID_ABOVE = 0.32

# Order states
ORDER_STATUSES = [
    "approved",
    "canceled",
    "created",
    "delivered",
    "invoiced",
    "processing",
    "shipped",
    "unavailable",
]
DELIVERED = "delivered"

# Reporting
RETENTION_CYCLE = 3
MIN_COHORT_SIZE = 50
MIN_ORDER_ROWS = 90000
