"""Key figures and bad-payer rates by segment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import labels as L


def kpis(clients: DataFrame, revenue: Column | None = None) -> DataFrame:
    """All key figures in one row, from one row per customer.

    Every order belongs to one customer and is cancelled, returned or neither, so the order
    figures are sums over customers and no distinct count is needed. Empty input gives counts
    of 0 and unknown rates. Revenue is the sum of unrounded values: ``clients`` must hold such,
    as ``customers_from_raw`` does, or ``revenue`` gives the sum, from the orders.
    """

    def total(*names: str):
        return F.coalesce(F.sum(sum(map(F.col, names[1:]), F.col(names[0]))), F.lit(0))

    counted = clients.agg(
        total("total_orders_calculated").alias("total_pedidos"),
        F.count("*").alias("total_clientes"),
        F.count_if(F.col("total_orders_calculated") > 0).alias("clientes_com_pedido"),
        (
            F.coalesce(F.sum("customer_lifetime_value"), F.lit(0.0))
            if revenue is None
            else F.first(revenue)
        ).alias("receita_total"),
        F.avg("is_bad_payer").alias("taxa_inadimplencia_geral"),
        total("total_cancelled_orders", "total_returned_orders").alias("ordens_nao_concluidas"),
    )
    lost = F.try_divide(F.col("ordens_nao_concluidas"), F.col("total_pedidos"))
    return counted.withColumn("taxa_conversao", 1 - lost)


def order_kpis(orders: DataFrame) -> DataFrame:
    """The order figures in one row, from an orders table."""
    lost = (F.col("is_cancelled") == 1) | (F.col("is_returned") == 1)
    counted = orders.agg(
        F.count("*").alias("total_pedidos"),
        F.coalesce(F.sum("total_order_value"), F.lit(0.0)).alias("receita_total"),
        F.count_if(lost).alias("ordens_nao_concluidas"),
    )
    share = F.try_divide(F.col("ordens_nao_concluidas"), F.col("total_pedidos"))
    return counted.withColumn("taxa_conversao", 1 - share)


def conversion_breakdown(figures: DataFrame) -> DataFrame:
    """Concluded and not concluded orders, two rows, from either table of key figures."""
    lost = F.col("ordens_nao_concluidas")
    rows = F.stack(
        F.lit(2), F.lit(L.CONCLUDED), F.col("total_pedidos") - lost, F.lit(L.NOT_CONCLUDED), lost
    )
    return figures.select("total_pedidos", rows.alias("status", "qtd")).select(
        "status", "qtd", F.try_divide(F.col("qtd"), F.col("total_pedidos")).alias("share")
    )


def rate_by(
    df: DataFrame, keys: Sequence[str], min_sample: int = 0, volume: str = "n"
) -> DataFrame:
    """Bad-payer rate per segment with its sample size; rows without a segment are left out."""
    known = df.dropna(subset=list(keys))
    rates = known.groupBy(*keys).agg(
        F.count("*").alias(volume), F.avg("is_bad_payer").alias("taxa")
    )
    return rates.where(F.col(volume) >= min_sample) if min_sample else rates


def rate_by_account_age(orders: DataFrame) -> DataFrame:
    return rate_by(orders, ["faixa_tempo_conta"]).orderBy("faixa_tempo_conta")


def rate_by_age_gender(clients: DataFrame) -> DataFrame:
    return rate_by(clients, ["Faixa_Etaria", "gender"]).orderBy("Faixa_Etaria", "gender")


def rate_by_state(clients: DataFrame, min_sample: int = 0) -> DataFrame:
    """Riskiest states first; states with too few clients to judge can be left out."""
    rates = rate_by(clients, ["state"], min_sample, volume="qtd_clientes")
    return rates.orderBy(F.desc("taxa"), "state")


def rate_by_clv(clients: DataFrame) -> DataFrame:
    return rate_by(clients, ["Faixa_CLV"]).orderBy("Faixa_CLV")


def rate_by_age_x_account_age(orders_with_age: DataFrame) -> DataFrame:
    """Rate by client age and account age, from an orders table that carries ``age``."""
    keys = ["Faixa_Etaria", "faixa_tempo_conta"]
    banded = orders_with_age.withColumn("Faixa_Etaria", C.age_band(F.col("age")))
    return rate_by(banded, keys).orderBy(*keys)


def rate_labels(rates: DataFrame, segment: str, decimals: int) -> DataFrame:
    """Rates as text, one row per segment, in a shape that can be united across dimensions."""
    return rates.select(
        F.lit(segment).alias("dimensao"),
        F.col(segment).alias("segmento"),
        C.percent_label(F.col("taxa"), decimals).alias("rotulo"),
    )


def all_rate_labels(clients: DataFrame, orders: DataFrame) -> DataFrame:
    """Rates as text by account age, state and customer value, from banded clients and orders."""
    parts = [
        rate_labels(rate_by(orders, ["faixa_tempo_conta"]), "faixa_tempo_conta", 1),
        rate_labels(rate_by(clients, ["state"]), "state", 2),
        rate_labels(rate_by(clients, ["Faixa_CLV"]), "Faixa_CLV", 1),
    ]
    return reduce(DataFrame.unionByName, parts)
