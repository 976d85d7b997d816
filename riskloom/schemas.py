"""The columns of every table as DDL; nothing is inferred."""

RAW_USERS = (
    "id bigint, age int, gender string, state string, country string, created_at timestamp_ntz"
)

RAW_ORDERS = (
    "order_id bigint, user_id bigint, status string, created_at timestamp_ntz, num_of_item bigint"
)

REFINED_USERS = (
    "user_id bigint, age int, gender string, state string, account_created_at timestamp_ntz, "
    "total_orders bigint, total_cancelled_orders bigint, total_returned_orders bigint, "
    "total_items_purchased double, last_order_date timestamp_ntz, is_bad_payer int"
)

REFINED_ORDERS = (
    "order_id bigint, user_id bigint, status string, order_timestamp timestamp_ntz, "
    "order_hour int, order_hour_formatted string, turno_pedido string, is_cancelled int, "
    "is_returned int, total_items_purchased bigint, total_order_value double"
)

USER_MONTHS = (
    "user_id bigint, mes date, total_orders bigint, total_cancelled_orders bigint, "
    "total_returned_orders bigint, total_items_purchased double, last_order_date timestamp_ntz, "
    "value double, valued_orders bigint"
)

FEATURES_MODELING = (
    "user_id bigint, age int, gender string, state string, account_created_at timestamp_ntz, "
    "is_bad_payer int, customer_lifetime_value double, customer_ticket_medio double, "
    "total_cancelled_orders bigint, total_returned_orders bigint, total_orders_calculated bigint"
)

ORDERS_MODELING = (
    "order_id bigint, user_id bigint, order_timestamp timestamp_ntz, order_hour int, "
    "order_hour_formatted string, turno_pedido string, is_cancelled int, is_returned int, "
    "total_order_value double, is_bad_payer int, account_created_at timestamp_ntz, "
    "dias_conta_ate_compra bigint, faixa_tempo_conta string"
)

SCORED = "user_id bigint, y int, score double"

ORDER_FLAGS = (
    "order_id bigint, user_id bigint, order_timestamp timestamp_ntz, score double, "
    "is_high_risk int"
)

# The supplied test tables, restricted to the columns in use.
TEST_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": "l_orderkey bigint",
}
