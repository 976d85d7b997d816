"""Fixed values of the data model: every label, bound and constant that results depend on."""

COUNTRY = "United States"
CANCELLED = "Cancelled"
RETURNED = "Returned"

# Constant price of an item, a double so that no DECIMAL arithmetic sneaks in.
UNIT_PRICE = 45.5

# A customer is a bad payer from this many orders on, at this share of lost orders.
BAD_PAYER_MIN_ORDERS = 2
BAD_PAYER_MIN_SHARE = 0.5

NIGHT_SHIFT = "Noite/Madrugada (18h-5h)"
DAY_SHIFT = "Manhã/Tarde (5h-18h)"
NIGHT_FROM_HOUR = 18
NIGHT_UNTIL_HOUR = 5

# Bands: (inclusive upper bounds, labels); the last label has no bound.
ACCOUNT_AGE_BANDS = (
    (-1, 30, 90, 365),
    ("0. Inconsistente", "1. < 30 dias", "2. 30-90 dias", "3. 90-365 dias", "4. +365 dias"),
)
AGE_BANDS = (
    (25, 35, 45, 60),
    ("1. 18-25", "2. 26-35", "3. 36-45", "4. 46-60", "5. 60+"),
)
CLV_BANDS = (
    (100, 300, 600, 1000),
    ("1. Até R$100", "2. R$100-300", "3. R$300-600", "4. R$600-1000", "5. Acima de R$1000"),
)

CONCLUDED = "Concluídas"
NOT_CONCLUDED = "Não Concluídas"

MIN_SAMPLE = 200

FEATURES = [
    "age",
    "customer_lifetime_value",
    "customer_ticket_medio",
    "total_orders_calculated",
]
TARGET = "is_bad_payer"
CLASS_NAMES = ("Bom Pagador (0)", "Mau Pagador (1)")

TEST_FRACTION = 0.2
SEED = 42
DEFAULT_THRESHOLD = 0.5
F1_EPSILON = 1e-9
FOREST_TREES = 100
FOREST_DEPTH = 5
FOREST_MIN_LEAF = 5
