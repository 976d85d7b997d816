from __future__ import annotations

import pytest

from riskloom import schemas
from riskloom.operators import features, hourly, refine, segments
from riskloom.functions import labels as L
from tests.frames import at, orders, users, values


@pytest.fixture()
def empty(spark):
    return users(spark), orders(spark)


def test_empty_input(empty):
    raw_users, raw_orders = empty
    clients = features.features_from_raw(raw_users, raw_orders)
    row = segments.kpis(clients).first()
    assert (row.total_pedidos, row.total_clientes, row.receita_total) == (0, 0, 0.0)
    assert (row.taxa_inadimplencia_geral, row.taxa_conversao) == (None, None)
    breakdown = segments.conversion_breakdown(segments.kpis(clients))
    assert sorted(values(breakdown, "qtd", "share")) == [(0, None), (0, None)]

    table = features.orders_modeling(
        refine.order_facts(raw_orders), refine.refined_users(raw_users, raw_orders)
    )
    assert segments.order_kpis(table).first().taxa_conversao is None
    profile = hourly.hourly_profile(table)
    for figure in (
        hourly.detractors_by_shift,
        hourly.shift_gap,
        hourly.rate_by_hour,
        hourly.hours_above_average,
        hourly.value_at_risk_by_hour,
        hourly.peak_value_at_risk_hour,
    ):
        assert figure(profile).count() == 0
    assert segments.rate_by_account_age(table).count() == 0
    assert segments.rate_by_state(clients).count() == 0


def profile_of(spark, *rows):
    schema = (
        "order_hour int, order_hour_formatted string, turno_pedido string, orders bigint, "
        "bad_orders bigint, value double, bad_value double"
    )
    return spark.createDataFrame(list(rows), schema)


def test_shift_gap_needs_both_shifts(spark):
    day = (10, "10hs", L.DAY_SHIFT, 5, 3, 10.0, 5.0)
    night = (20, "20hs", L.NIGHT_SHIFT, 5, 1, 10.0, 1.0)
    calm_night = (20, "20hs", L.NIGHT_SHIFT, 5, 0, 10.0, None)
    assert values(hourly.shift_gap(profile_of(spark, day, night)), "diff_pct") == [(0.5,)]
    assert hourly.shift_gap(profile_of(spark, day, calm_night)).count() == 0
    assert values(
        hourly.detractors_by_shift(profile_of(spark, day, calm_night)), "detratores"
    ) == [(3,)]


def test_hour_without_value_or_risk(spark):
    profile = profile_of(
        spark,
        (1, "01hs", L.NIGHT_SHIFT, 5, 2, 0.0, 0.0),
        (2, "02hs", L.NIGHT_SHIFT, 5, 0, 10.0, None),
        (3, "03hs", L.NIGHT_SHIFT, 5, 1, 10.0, 4.0),
    )
    risks = values(hourly.value_at_risk_by_hour(profile), "hora", "valor_em_risco")
    assert risks == [(1, None), (2, 0.0), (3, 0.4)]
    assert hourly.peak_value_at_risk_hour(profile).first().hora == 3
    assert values(hourly.hours_above_average(profile), "hora") == [(1,)]


def test_missing_hour_counts_for_the_shift_but_has_no_rate(spark):
    raw_users = users(spark, (1, at("2020-01-01")))
    raw_orders = orders(
        spark, (1, 1, "Cancelled", None, 1), (2, 1, "Returned", at("2020-02-01T20:00:00"), 1)
    )
    profile = hourly.hourly_profile_from_raw(raw_users, raw_orders)
    assert values(hourly.rate_by_hour(profile), "hora") == [(20,)]
    found = dict(values(hourly.detractors_by_shift(profile), "turno_pedido", "detratores"))
    assert found == {L.DAY_SHIFT: 1, L.NIGHT_SHIFT: 1}


def clients_of(spark, *rows):
    """Rows of (user_id, age, gender, state, is_bad_payer, clv)."""
    full = [
        (user, age, gender, state, at("2020-01-01"), bad, clv, clv, 0, 0, 1)
        for user, age, gender, state, bad, clv in rows
    ]
    return spark.createDataFrame(full, schemas.FEATURES_MODELING)


def test_rates_leave_out_missing_keys(spark):
    clients = features.client_bands(
        clients_of(
            spark,
            (1, 20, "F", "A", 1, 50.0),
            (2, 20, None, "A", 0, 50.0),
            (3, None, "M", None, 0, 2000.0),
        )
    )
    assert values(segments.rate_by_state(clients), "state", "qtd_clientes", "taxa") == [
        ("A", 2, 0.5)
    ]
    assert values(
        segments.rate_by_age_gender(clients), "Faixa_Etaria", "gender", "n", "taxa"
    ) == [("1. 18-25", "F", 1, 1.0), ("5. 60+", "M", 1, 0.0)]
    assert values(segments.rate_by_clv(clients), "Faixa_CLV", "n", "taxa") == [
        ("1. Até R$100", 2, 0.5),
        ("5. Acima de R$1000", 1, 0.0),
    ]


def test_states_are_sorted_by_rate_and_filtered_by_sample(spark):
    clients = clients_of(
        spark,
        (1, 20, "F", "B", 0, 1.0),
        (2, 20, "F", "B", 1, 1.0),
        (3, 20, "F", "A", 0, 1.0),
        (4, 20, "F", "A", 1, 1.0),
        (5, 20, "F", "C", 1, 1.0),
    )
    assert values(segments.rate_by_state(clients), "state") == [("C",), ("A",), ("B",)]
    assert values(segments.rate_by_state(clients, 2), "state") == [("A",), ("B",)]
    assert segments.rate_by_state(clients, L.MIN_SAMPLE).count() == 0
