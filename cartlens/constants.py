"""Fixed values that define the results."""

# Weight of each shopper action; any other action weighs 0.
ACTION_WEIGHTS = {
    "view": 1,
    "search": 1,
    "wishlist": 2,
    "add_to_cart": 3,
    "remove_from_cart": -1,
    "purchase": 5,
}

# Dwell bonus of 0.1 per 30 s, at most 10 steps.
DWELL_STEP_SEC = 30
DWELL_MAX_STEPS = 10
DWELL_STEP_BONUS = 0.1

# Collaborative filtering.
MIN_INTERACTIONS = 5
MAX_RANK = 50
CV_FOLDS = 3
COSINE_EPSILON = 1e-9

# Basket rules.
MIN_SUPPORT = 0.003
MIN_CONFIDENCE = 0.1
MIN_LIFT = 1.0

# Customer segments.
NO_ORDER_RECENCY_DAYS = 9999
UNKNOWN_ACCOUNT_AGE_DAYS = 1
SEGMENT_FEATURES = [
    "total_orders",
    "total_spent",
    "avg_order_value",
    "days_since_last_order",
    "purchase_frequency",
]
K_SWEEP = [2, 3, 4, 5, 6]
KMEANS_RESTARTS = 10
SEED = 42

# Segment display names by rule, the names of clusters without
# members by cluster id, and the description text.
SEGMENT_NAMES = {
    "potential": "Khách hàng tiềm năng",
    "loyal": "Khách hàng trung thành",
    "inactive": "Khách hàng không hoạt động",
    "vip": "Khách hàng VIP",
}
EMPTY_CLUSTER_CODES = {0: "potential", 1: "loyal", 2: "inactive", 3: "vip"}
OTHER_CLUSTER_NAME = "Nhóm %d"
SEGMENT_DESCRIPTION = "Cụm %d - tự động phân loại bởi K-Means"

# Repurchase model.
MIN_GAP_DAYS = 1
MAX_GAP_DAYS = 365
FALLBACK_CYCLE_DAYS = 30.0
FALLBACK_QUANTITY = 1.0
FOREST_TREES = 100
CONFIDENCE_FLOOR = 0.3
CONFIDENCE_CEILING = 0.95
DEFAULT_CONFIDENCE = 0.75

# Reminder text.
REMINDER_TYPE = "repurchase_reminder"
REMINDER_TITLE = "Nhắc mua lại sản phẩm"
REMINDER_MESSAGE = "Sản phẩm '%s' của bạn sắp hết. Dự kiến bạn cần mua lại vào ngày %s."

# Least data each training run asks for.
MIN_MATRIX_SIDE = 2
MIN_BASKETS = 10
MIN_SEGMENT_USERS = 4
MIN_GAPS = 20

# Parameter defaults and ranges of the read operators.
HOMEPAGE_TOP_N, HOMEPAGE_RANGE = 10, (1, 50)
PRODUCT_TOP_N, PRODUCT_RANGE = 5, (1, 20)
DAYS_AHEAD, DAYS_AHEAD_RANGE = 7, (1, 30)
REMINDER_DAYS_AHEAD = 3
