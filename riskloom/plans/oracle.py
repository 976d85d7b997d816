"""The same queries as plain SQL over the test tables, for checking results."""

from __future__ import annotations

# Common table expressions; each may use the ones above it.
CTES = {
    "raw_users": """
        SELECT c_custkey AS id,
               CAST(18 + c_custkey % 60 AS INTEGER) AS age,
               CASE WHEN (c_custkey * 13) % 7 < 4 THEN 'F' ELSE 'M' END AS gender,
               n_name AS state,
               CASE WHEN n_regionkey < 3 THEN 'United States' ELSE 'Other' END AS country,
               TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * ((c_custkey * 37) % 400)
                   + INTERVAL 1 HOUR * (c_custkey % 24) AS created_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "items": "SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey",
    "raw_orders": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 10 <= o_custkey % 10 THEN o_custkey
                    ELSE o_custkey - o_custkey % 10 + 9 END AS user_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled'
                    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Returned'
                    WHEN o_orderstatus = 'F' THEN 'Complete'
                    WHEN o_orderstatus = 'O' THEN 'Shipped'
                    ELSE 'Processing' END AS status,
               o_orderdate + INTERVAL 1 HOUR * ((o_orderkey * 7) % 24)
                   + INTERVAL 1 MINUTE * (o_orderkey % 60) AS created_at,
               CAST(coalesce(k, 0) AS BIGINT) AS num_of_item
        FROM orders LEFT JOIN items ON l_orderkey = o_orderkey""",
    "history": """
        SELECT user_id,
               count(order_id) AS total_orders,
               count(*) FILTER (WHERE status = 'Cancelled') AS total_cancelled_orders,
               count(*) FILTER (WHERE status = 'Returned') AS total_returned_orders,
               CAST(sum(num_of_item) AS DOUBLE) AS total_items_purchased,
               max(created_at) AS last_order_date
        FROM raw_orders GROUP BY user_id""",
    "refined_users": """
        SELECT u.id AS user_id, u.age, u.gender, u.state, u.created_at AS account_created_at,
               coalesce(h.total_orders, 0) AS total_orders,
               coalesce(h.total_cancelled_orders, 0) AS total_cancelled_orders,
               coalesce(h.total_returned_orders, 0) AS total_returned_orders,
               coalesce(h.total_items_purchased, 0) AS total_items_purchased,
               h.last_order_date,
               CAST(coalesce(h.total_orders >= 2
                    AND 2 * (h.total_cancelled_orders + h.total_returned_orders)
                        >= h.total_orders, FALSE) AS INTEGER) AS is_bad_payer
        FROM raw_users u LEFT JOIN history h ON h.user_id = u.id
        WHERE u.country = 'United States'""",
    "refined_orders": """
        SELECT order_id, user_id, status, created_at AS order_timestamp,
               CAST(extract(hour FROM created_at) AS INTEGER) AS order_hour,
               strftime(created_at, '%Hhs') AS order_hour_formatted,
               CASE WHEN extract(hour FROM created_at) BETWEEN 6 AND 17
                    THEN 'Manhã/Tarde (5h-18h)' ELSE 'Noite/Madrugada (18h-5h)'
               END AS turno_pedido,
               CAST(status = 'Cancelled' AS INTEGER) AS is_cancelled,
               CAST(status = 'Returned' AS INTEGER) AS is_returned,
               num_of_item AS total_items_purchased,
               num_of_item * CAST(45.5 AS DOUBLE) AS total_order_value
        FROM raw_orders
        WHERE user_id IN (SELECT user_id FROM refined_users)""",
    "behavior": """
        SELECT user_id,
               sum(total_order_value) AS customer_lifetime_value,
               avg(total_order_value) AS customer_ticket_medio,
               CAST(sum(is_cancelled) AS BIGINT) AS total_cancelled_orders,
               CAST(sum(is_returned) AS BIGINT) AS total_returned_orders,
               count(order_id) AS total_orders_calculated
        FROM refined_orders GROUP BY user_id""",
    "features": """
        SELECT u.user_id, u.age, u.gender, u.state, u.account_created_at, u.is_bad_payer,
               round_even(coalesce(b.customer_lifetime_value, 0), 2) AS customer_lifetime_value,
               round_even(coalesce(b.customer_ticket_medio, 0), 2) AS customer_ticket_medio,
               coalesce(b.total_cancelled_orders, 0) AS total_cancelled_orders,
               coalesce(b.total_returned_orders, 0) AS total_returned_orders,
               coalesce(b.total_orders_calculated, 0) AS total_orders_calculated
        FROM refined_users u LEFT JOIN behavior b USING (user_id)""",
    "dated_orders": """
        SELECT o.order_id, o.user_id, o.order_timestamp, o.order_hour, o.order_hour_formatted,
               o.turno_pedido, o.is_cancelled, o.is_returned, o.total_order_value,
               coalesce(u.is_bad_payer, 0) AS is_bad_payer, u.account_created_at, u.age,
               CAST(floor((epoch_us(o.order_timestamp) - epoch_us(u.account_created_at))
                    / 86400000000) AS BIGINT) AS dias_conta_ate_compra
        FROM refined_orders o LEFT JOIN refined_users u USING (user_id)""",
    "orders_modeling": """
        SELECT *, CASE WHEN dias_conta_ate_compra < 0 THEN '0. Inconsistente'
                       WHEN dias_conta_ate_compra <= 30 THEN '1. < 30 dias'
                       WHEN dias_conta_ate_compra <= 90 THEN '2. 30-90 dias'
                       WHEN dias_conta_ate_compra <= 365 THEN '3. 90-365 dias'
                       ELSE '4. +365 dias' END AS faixa_tempo_conta
        FROM dated_orders""",
    "clients": """
        SELECT *, CASE WHEN age <= 25 THEN '1. 18-25' WHEN age <= 35 THEN '2. 26-35'
                       WHEN age <= 45 THEN '3. 36-45' WHEN age <= 60 THEN '4. 46-60'
                       ELSE '5. 60+' END AS Faixa_Etaria,
               CASE WHEN customer_lifetime_value <= 100 THEN '1. Até R$100'
                    WHEN customer_lifetime_value <= 300 THEN '2. R$100-300'
                    WHEN customer_lifetime_value <= 600 THEN '3. R$300-600'
                    WHEN customer_lifetime_value <= 1000 THEN '4. R$600-1000'
                    ELSE '5. Acima de R$1000' END AS Faixa_CLV
        FROM features""",
    "kpis": """
        SELECT * FROM
            (SELECT count(*) AS total_pedidos,
                    count(DISTINCT user_id) AS clientes_com_pedido,
                    sum(total_order_value) AS receita_total,
                    count(*) FILTER (WHERE is_cancelled = 1 OR is_returned = 1)
                        AS ordens_nao_concluidas,
                    1 - count(*) FILTER (WHERE is_cancelled = 1 OR is_returned = 1)
                        / CAST(count(*) AS DOUBLE) AS taxa_conversao
             FROM orders_modeling),
            (SELECT count(*) AS total_clientes, avg(is_bad_payer) AS taxa_inadimplencia_geral
             FROM features)""",
    "detractors": """
        SELECT turno_pedido, count(*) AS detratores
        FROM orders_modeling WHERE is_bad_payer = 1 GROUP BY turno_pedido""",
    "hour_risk": """
        SELECT order_hour_formatted, order_hour AS hora,
               avg(is_bad_payer) AS taxa,
               sum(total_order_value * is_bad_payer) / sum(total_order_value) AS valor_em_risco,
               count(*) AS n
        FROM orders_modeling GROUP BY order_hour_formatted, order_hour""",
    "hashed": """
        SELECT user_id, is_bad_payer,
               row_number() OVER (PARTITION BY is_bad_payer
                                  ORDER BY substr(md5('42:' || CAST(user_id AS VARCHAR)), 1, 15),
                                           user_id) AS rk
        FROM features""",
    "class_counts": """
        SELECT is_bad_payer, n, total - ceil(total * CAST(0.2 AS DOUBLE)) AS n_train_all,
               n * (total - ceil(total * CAST(0.2 AS DOUBLE))) / total AS exact
        FROM (SELECT is_bad_payer, count(*) AS n,
                     CAST(sum(count(*)) OVER () AS DOUBLE) AS total
              FROM features GROUP BY is_bad_payer)""",
    "quotas": """
        SELECT is_bad_payer, n,
               CAST(floor(exact) + CAST(
                   row_number() OVER (ORDER BY exact - floor(exact) DESC, is_bad_payer)
                       <= n_train_all - sum(floor(exact)) OVER () AS INTEGER) AS BIGINT) AS n_train
        FROM class_counts""",
    "scored": """
        SELECT user_id, is_bad_payer AS y,
               ((user_id * 7919 + total_orders_calculated * 31) % 1000) / CAST(1000 AS DOUBLE)
                   AS score
        FROM features""",
    "points": """
        SELECT score, sum(y) AS pos, sum(1 - y) AS neg,
               CAST(sum(sum(y)) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
               CAST(sum(sum(1 - y)) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
               CAST(sum(sum(y)) OVER () AS DOUBLE) AS all_pos,
               CAST(sum(sum(1 - y)) OVER () AS DOUBLE) AS all_neg
        FROM scored GROUP BY score""",
    "ratios": """
        SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / all_pos AS recall
        FROM points""",
    "curve": """
        SELECT *, 2 * precision * recall / (precision + recall + CAST(1e-9 AS DOUBLE)) AS f1
        FROM ratios""",
    "best": """
        SELECT score AS threshold, f1, precision, recall
        FROM curve ORDER BY f1 DESC, score LIMIT 1""",
    "predictions": """
        SELECT user_id, y, score, CAST(score >= 0.5 AS INTEGER) AS pred_default,
               CAST(score >= (SELECT threshold FROM best) AS INTEGER) AS pred_tuned
        FROM scored""",
    "long_predictions": """
        SELECT 'pred_default' AS prediction, y, pred_default AS p FROM predictions
        UNION ALL SELECT 'pred_tuned', y, pred_tuned FROM predictions""",
    "confusion": """
        SELECT prediction, c,
               CASE c WHEN 0 THEN 'Bom Pagador (0)' ELSE 'Mau Pagador (1)' END AS class_name,
               CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS hits,
               CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS predicted,
               CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS actual
        FROM long_predictions, (VALUES (0), (1)) AS classes(c)
        GROUP BY prediction, c""",
    "span": """
        SELECT min(epoch(created_at)) AS low,
               CAST(max(epoch(created_at)) - min(epoch(created_at)) + 1 AS BIGINT) AS length
        FROM raw_orders""",
    "delivered": """
        SELECT order_id, user_id, created_at,
               CAST(floor((epoch(created_at) - low) * 3 / length) AS INTEGER)
                   + CASE WHEN order_id % 17 = 0 THEN 2 ELSE 0 END + again AS delivery
        FROM raw_orders, span, (VALUES (0), (1)) AS times(again)
        WHERE again = 0 OR order_id % 13 = 0""",
    "newest": """
        SELECT d.delivery, max(e.created_at) - INTERVAL 1 SECOND * (SELECT length // 6 FROM span) AS mark
        FROM (SELECT DISTINCT delivery FROM delivered) d LEFT JOIN delivered e ON e.delivery < d.delivery
        GROUP BY d.delivery""",
    "judged": """
        SELECT *, CAST(coalesce(created_at <= mark, FALSE) AS INTEGER) AS late
        FROM delivered JOIN newest USING (delivery)""",
    "received": """
        SELECT *, late = 0 AND row_number() OVER (PARTITION BY order_id, late ORDER BY delivery) = 1 AS is_new
        FROM judged""",
    "per_class": """
        SELECT prediction, class_name, hits, actual,
               CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
               CASE WHEN actual = 0 THEN 0 ELSE hits / actual END AS recall,
               CASE WHEN predicted + actual = 0 THEN 0
                    ELSE 2 * hits / (predicted + actual) END AS f1_score
        FROM confusion""",
}

ORDER_COLUMNS = """order_id, user_id, order_timestamp, order_hour, order_hour_formatted,
    turno_pedido, is_cancelled, is_returned, total_order_value, is_bad_payer, account_created_at,
    dias_conta_ate_compra, faixa_tempo_conta"""

ORDERS = f"SELECT {ORDER_COLUMNS} FROM orders_modeling"

SELECTS = {
    "user_order_aggregates": "SELECT * FROM history",
    "refined_users": "SELECT * FROM refined_users",
    "refined_orders": "SELECT * FROM refined_orders",
    "behavior_features": "SELECT * FROM behavior",
    "features_modeling": "SELECT * FROM features",
    "orders_modeling": ORDERS,
    "client_bands": "SELECT * FROM clients",
    "kpis": "SELECT * FROM kpis",
    "conversion_breakdown": """
        SELECT 'Concluídas' AS status, total_pedidos - ordens_nao_concluidas AS qtd,
               (total_pedidos - ordens_nao_concluidas) / CAST(total_pedidos AS DOUBLE) AS share
        FROM kpis
        UNION ALL
        SELECT 'Não Concluídas', ordens_nao_concluidas,
               ordens_nao_concluidas / CAST(total_pedidos AS DOUBLE)
        FROM kpis""",
    "rate_by_account_age": """
        SELECT faixa_tempo_conta, count(*) AS n, avg(is_bad_payer) AS taxa
        FROM orders_modeling GROUP BY ALL ORDER BY 1""",
    "rate_by_age_gender": """
        SELECT Faixa_Etaria, gender, count(*) AS n, avg(is_bad_payer) AS taxa
        FROM clients GROUP BY ALL ORDER BY 1, 2""",
    "rate_by_state": """
        SELECT state, count(*) AS qtd_clientes, avg(is_bad_payer) AS taxa
        FROM features GROUP BY ALL ORDER BY taxa DESC, state""",
    "rate_by_state_min_sample": """
        SELECT state, count(*) AS qtd_clientes, avg(is_bad_payer) AS taxa
        FROM features GROUP BY ALL HAVING count(*) >= 60 ORDER BY taxa DESC, state""",
    "rate_by_clv": """
        SELECT Faixa_CLV, count(*) AS n, avg(is_bad_payer) AS taxa
        FROM clients GROUP BY ALL ORDER BY 1""",
    "rate_by_age_x_account_age": """
        SELECT c.Faixa_Etaria, o.faixa_tempo_conta, count(*) AS n, avg(o.is_bad_payer) AS taxa
        FROM orders_modeling o JOIN clients c USING (user_id) GROUP BY ALL ORDER BY 1, 2""",
    "rate_labels": """
        SELECT 'faixa_tempo_conta' AS dimensao, faixa_tempo_conta AS segmento,
               printf('%.1f%%', avg(is_bad_payer) * 100) AS rotulo
        FROM orders_modeling GROUP BY faixa_tempo_conta
        UNION ALL
        SELECT 'state', state, printf('%.2f%%', avg(is_bad_payer) * 100)
        FROM features GROUP BY state
        UNION ALL
        SELECT 'Faixa_CLV', Faixa_CLV, printf('%.1f%%', avg(is_bad_payer) * 100)
        FROM clients GROUP BY Faixa_CLV""",
    "detractors_by_shift": "SELECT * FROM detractors",
    "shift_gap": """
        SELECT CAST(max(detratores) - min(detratores) AS DOUBLE) / sum(detratores) AS diff_pct
        FROM detractors HAVING count(*) >= 2""",
    "rate_by_hour": "SELECT order_hour_formatted, taxa, hora, n FROM hour_risk ORDER BY hora",
    "hours_above_average": """
        SELECT order_hour_formatted, hora, taxa, taxa_geral
        FROM hour_risk, (SELECT avg(is_bad_payer) AS taxa_geral FROM orders_modeling)
        WHERE taxa > taxa_geral ORDER BY hora""",
    "value_at_risk_by_hour": """
        SELECT order_hour_formatted, hora, valor_em_risco, n FROM hour_risk ORDER BY hora""",
    "peak_value_at_risk_hour": """
        SELECT order_hour_formatted, hora, valor_em_risco, n
        FROM hour_risk ORDER BY valor_em_risco DESC, hora LIMIT 1""",
    "shift_hour_index": """
        SELECT order_id, order_hour, turno_pedido,
               CASE WHEN order_hour >= 18 THEN order_hour - 18 ELSE order_hour + 6 END
                   AS shift_hour_index
        FROM refined_orders""",
    "training_frame": """
        SELECT user_id, age, customer_lifetime_value, customer_ticket_medio,
               total_orders_calculated, is_bad_payer
        FROM features""",
    "stratified_split": """
        SELECT user_id, is_bad_payer, CAST(rk <= n - n_train AS INTEGER) AS is_test
        FROM hashed JOIN quotas USING (is_bad_payer)""",
    "forest_checks": """
        SELECT is_bad_payer, n - n_train AS n_scored, CAST(0 AS BIGINT) AS out_of_range,
               CAST(0 AS BIGINT) AS wrong_flags, CAST(0 AS BIGINT) AS changed_after_reload
        FROM quotas""",
    "forest_walk": """
        SELECT is_bad_payer, n, n - n_train AS n_held_out, CAST(0 AS BIGINT) AS wrong_scores,
               CAST(0 AS BIGINT) AS wrong_held_out, CAST(0 AS BIGINT) AS wrong_flags
        FROM quotas""",
    "forest_fit": "SELECT "
    + ", ".join(
        f"CAST(0 AS BIGINT) AS {name}"
        for name in (
            "wrong_trees", "orphans", "small_nodes", "lost_rows", "lost_weight", "wrong_impurity",
            "wrong_gain", "useless_splits", "unknown_features",
        )
    ),
    "utc_times": "SELECT order_id, created_at AS from_text, created_at AS from_zone FROM raw_orders",
    "split_counts": "SELECT is_bad_payer, n_train, n - n_train AS n_test FROM quotas",
    "class_weights": """
        SELECT is_bad_payer, count(*) AS n,
               CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
        FROM features GROUP BY is_bad_payer""",
    "pr_curve": "SELECT score, tp, fp, precision, recall, f1 FROM curve",
    "average_precision": """
        SELECT round(sum(pos / all_pos * precision), 9) AS average_precision FROM curve""",
    "roc_auc": """
        SELECT round(sum(neg * (tp - pos / CAST(2 AS DOUBLE))) / max(all_pos) / max(all_neg), 9)
                   AS roc_auc
        FROM curve""",
    "best_f1_threshold": "SELECT * FROM best",
    "threshold_predictions": "SELECT * FROM predictions",
    "classification_report": """
        SELECT prediction, class_name, round(precision, 9) AS precision,
               round(recall, 9) AS recall, round(f1_score, 9) AS f1_score,
               CAST(actual AS BIGINT) AS support
        FROM per_class
        UNION ALL
        SELECT prediction, 'accuracy', NULL, NULL, round(sum(hits) / sum(actual), 9),
               CAST(sum(actual) AS BIGINT)
        FROM per_class GROUP BY prediction
        UNION ALL
        SELECT prediction, 'macro avg', round(avg(precision), 9), round(avg(recall), 9),
               round(avg(f1_score), 9), CAST(sum(actual) AS BIGINT)
        FROM per_class GROUP BY prediction
        UNION ALL
        SELECT prediction, 'weighted avg',
               round(sum(precision * actual) / sum(actual), 9),
               round(sum(recall * actual) / sum(actual), 9),
               round(sum(f1_score * actual) / sum(actual), 9), CAST(sum(actual) AS BIGINT)
        FROM per_class GROUP BY prediction""",
    "csv_roundtrip": "SELECT * FROM features",
    "csv_roundtrip_orders": ORDERS,
    "parquet_roundtrip": ORDERS,
    "bucketed_orders": ORDERS,
    "bucketed_refined_orders": "SELECT * FROM refined_orders",
    "client_estimates": """
        SELECT period, turno_pedido, faixa_tempo_conta, count(*) AS n,
               count(DISTINCT user_id) AS clients, TRUE AS holds
        FROM orders_modeling, (VALUES ('all'), ('odd')) AS periods(period)
        WHERE period = 'all' OR month(order_timestamp) % 2 = 1
        GROUP BY period, turno_pedido, faixa_tempo_conta""",
    "csv_records": """
        SELECT CASE WHEN order_id % 40 = 0 THEN 'column order_id: no bigint'
                    WHEN order_id % 41 = 0 THEN 'column created_at: no timestamp_ntz'
                    ELSE 'none' END AS reason,
               count(*) AS n,
               CAST(sum(CASE WHEN order_id % 40 <> 0 AND order_id % 41 <> 0 THEN CAST('0x' || substr(md5(
                    order_id || ':' || status || ',' || chr(10) || '"' || user_id || '":'
                    || strftime(created_at, '%Y-%m-%d %H:%M:%S')), 1, 8) AS BIGINT) END) AS BIGINT) AS digests
        FROM raw_orders GROUP BY 1""",
    "monthly_user_months": """
        SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS mes,
               count(order_id) AS total_orders,
               count(*) FILTER (WHERE status = 'Cancelled') AS total_cancelled_orders,
               count(*) FILTER (WHERE status = 'Returned') AS total_returned_orders,
               CAST(sum(num_of_item) AS DOUBLE) AS total_items_purchased,
               max(created_at) AS last_order_date,
               sum(num_of_item * CAST(45.5 AS DOUBLE)) AS value, count(num_of_item) AS valued_orders
        FROM raw_orders GROUP BY ALL""",
    "monthly_refined_users": "SELECT * FROM refined_users",
    "monthly_refined_orders": "SELECT * FROM refined_orders",
    "monthly_features": "SELECT * FROM features",
    "monthly_orders": ORDERS,
    "streaming_intake": """
        SELECT delivery, count(*) AS received, CAST(sum(late) AS BIGINT) AS late,
               count(*) FILTER (is_new) AS flagged,
               count(*) FILTER (late = 0 AND NOT is_new) AS repeated,
               count(*) FILTER (is_new AND CASE WHEN delivery < 3 THEN score ELSE 1 - score END >= 0.5)
                   AS high_risk
        FROM received LEFT JOIN scored USING (user_id) GROUP BY delivery""",
    "streaming_flags": """
        SELECT order_id, user_id, created_at AS order_timestamp, score,
               CAST(coalesce(score >= (SELECT threshold FROM best), FALSE) AS INTEGER)
                   AS is_high_risk
        FROM raw_orders LEFT JOIN scored USING (user_id)""",
}


def statements() -> dict[str, str]:
    """One self-contained statement per query; unused expressions cost nothing."""
    shared = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())
    return {name: f"WITH {shared}\n{select}" for name, select in SELECTS.items()}
