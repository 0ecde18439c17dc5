"""Declared schemas of the shop tables and of the result tables."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()
_TIME, _DATE, _BOOL, _INT = T.TimestampNTZType(), T.DateType(), T.BooleanType(), T.IntegerType()

BEHAVIOR = _struct(
    user_id=_LONG, product_id=_LONG, action=_STRING, duration_sec=_DOUBLE, created_at=_TIME
)
ORDERS = _struct(
    order_id=_LONG, user_id=_LONG, order_status=_STRING, order_total=_DOUBLE, created_at=_TIME
)
# ``line_no, tie_1, tie_2, quantity`` together identify a line within its order.
ORDER_ITEMS = _struct(
    order_id=_LONG, line_no=_INT, product_id=_LONG, quantity=_DOUBLE, tie_1=_LONG, tie_2=_LONG
)
PRODUCTS = _struct(product_id=_LONG, name=_STRING, is_consumable=_BOOL, weight_gram=_DOUBLE)
USERS = _struct(user_id=_LONG, role=_STRING, is_active=_BOOL, created_at=_TIME)

ASSOCIATION_RULES = _struct(
    antecedent_id=_LONG, consequent_id=_LONG, support=_DOUBLE, confidence=_DOUBLE, lift=_DOUBLE
)
CUSTOMER_SEGMENTS = _struct(segment_id=_INT, name=_STRING, description=_STRING)
USER_SEGMENTS = _struct(user_id=_LONG, segment_id=_INT)
PREDICTIONS = _struct(
    user_id=_LONG, product_id=_LONG, predicted_date=_DATE, confidence=_DOUBLE, notified=_BOOL
)
RECOMMENDATIONS = _struct(user_id=_LONG, product_id=_LONG, score=_DOUBLE, rec_type=_STRING)
NOTIFICATIONS = _struct(
    user_id=_LONG, type=_STRING, title=_STRING, message=_STRING, ref_id=_LONG
)
