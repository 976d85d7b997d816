"""Loads of single months against a full build, and what they write."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest

from riskloom import schemas
from riskloom.__main__ import main
from riskloom.operators import features, histories
from riskloom.plans import jobs, monthly
from riskloom.plans.queries import Tables
from riskloom.session import shared_dir
from riskloom.sources import files
from tests.frames import assert_equal, at, orders, users

TABLES = ("refined_users", "refined_orders", "features_modeling", "orders_modeling")


def people(spark):
    return users(spark, *((i, at("2023-12-01")) for i in range(1, 9)), (9, at("2023-12-01"), 30, "F", "X", "Other"))


def month_of_orders(month: int, statuses: dict[int, str], base: int | None = None):
    start = 1000 * month if base is None else base
    return [(start + u, u, s, at(f"2024-{month:02d}-10 08:00:00"), u % 4 + 1) for u, s in statuses.items()]


JANUARY = month_of_orders(1, {1: "Complete", 2: "Cancelled", 3: "Complete", 9: "Complete"})
FEBRUARY = month_of_orders(2, {1: "Complete", 2: "Complete", 4: "Returned"})
MARCH = month_of_orders(3, {5: "Complete", 6: "Complete"})
FLIPS = month_of_orders(4, {3: "Cancelled"})  # half of customer 3's orders are lost now


def first(month: int) -> date:
    return date(2024, month, 1)


def assert_as_built(spark, raw_users, raw_orders, path, tmp_path):
    full = str(tmp_path / f"full-{len(list(tmp_path.iterdir()))}")
    jobs.build_tables(raw_users, raw_orders, full)
    built, loaded = jobs.load_tables(spark, full), jobs.load_tables(spark, path)
    for name in TABLES:
        columns = monthly_columns(name)
        assert_equal(loaded[name].select(*columns), built[name].select(*columns))
    stored = files.read_parquet(spark, f"{path}/user_months", schemas.USER_MONTHS)
    assert_equal(stored.drop("mes"), histories.by_user_and_month(raw_orders).drop("mes"))


def monthly_columns(name):
    return [column.split()[0] for column in jobs.STORED[name].split(", ")]


def written(path, name):
    """Files of each month's folder."""
    return {
        folder.name: sorted(f.name for f in folder.glob("part-*"))
        for folder in Path(path, name).glob("mes=*")
    }


def test_months_one_by_one_equal_a_full_build(spark, tmp_path):
    path, raw_users, everything = str(tmp_path / "t"), people(spark), []
    for month, rows in enumerate((JANUARY, FEBRUARY, MARCH, FLIPS), 1):
        everything += rows
        monthly.load_months(raw_users, orders(spark, *everything), path, [first(month)])
        assert_as_built(spark, raw_users, orders(spark, *everything), path, tmp_path)


def test_a_new_month_writes_one_folder(spark, tmp_path):
    path, raw_users = str(tmp_path), people(spark)
    monthly.load_months(raw_users, orders(spark, *JANUARY, *FEBRUARY), path)
    before = {name: written(path, name) for name in ("user_months", "refined_orders", "orders_modeling")}
    done = monthly.load_months(raw_users, orders(spark, *JANUARY, *FEBRUARY, *MARCH), path, [first(3)])
    assert set(map(tuple, done.values())) == {(first(3),)}
    for name, folders in before.items():
        after = written(path, name)
        assert {k: v for k, v in after.items() if k in folders} == folders
        assert set(after) - set(folders) == {"mes=2024-03-01"}


def test_a_changed_label_rewrites_the_months_of_its_customer(spark, tmp_path):
    path, raw_users, rows = str(tmp_path / "t"), people(spark), [*JANUARY, *FEBRUARY, *MARCH]
    monthly.load_months(raw_users, orders(spark, *rows), path)
    before = written(path, "orders_modeling")
    done = monthly.load_months(raw_users, orders(spark, *rows, *FLIPS), path, [first(4)])
    assert done == {
        "user_months": [first(4)], "refined_orders": [first(4)], "orders_modeling": [first(1), first(4)],
    }
    after = written(path, "orders_modeling")
    assert after["mes=2024-01-01"] != before["mes=2024-01-01"]
    assert after["mes=2024-02-01"] == before["mes=2024-02-01"]
    assert_as_built(spark, raw_users, orders(spark, *rows, *FLIPS), path, tmp_path)


def test_the_same_load_twice_changes_nothing(spark, tmp_path):
    path, raw_users, raw_orders = str(tmp_path / "t"), people(spark), orders(spark, *JANUARY, *FEBRUARY)
    monthly.load_months(raw_users, raw_orders, path, [first(1)])
    monthly.load_months(raw_users, raw_orders, path, [first(2)])
    done = monthly.load_months(raw_users, raw_orders, path, [first(2)])
    assert set(map(tuple, done.values())) == {(first(2),)}
    assert_as_built(spark, raw_users, raw_orders, path, tmp_path)


def test_corrections_and_emptied_months(spark, tmp_path):
    path, raw_users = str(tmp_path / "t"), people(spark)
    monthly.load_months(raw_users, orders(spark, *JANUARY, *FEBRUARY, *MARCH), path)
    corrected = [(o, u, "Complete", t, 7) for o, u, _, t, _ in FEBRUARY[:2]]
    now = orders(spark, *JANUARY, *corrected)
    monthly.load_months(raw_users, now, path, [first(2), first(3)])
    assert set(written(path, "user_months")) == {"mes=2024-01-01", "mes=2024-02-01"}
    assert_as_built(spark, raw_users, now, path, tmp_path)


def test_customers_that_come_and_go(spark, tmp_path):
    path, rows = str(tmp_path / "t"), orders(spark, *JANUARY, *FEBRUARY)
    few = people(spark).where("id IN (1, 2)")
    monthly.load_months(few, rows, path)
    assert_as_built(spark, few, rows, path, tmp_path)
    # Customer 3 was active in January and 4 in February; customer 2 leaves.
    other = people(spark).where("id IN (1, 3, 4)")
    done = monthly.load_months(other, rows, path, [])
    assert done["user_months"] == [] and done["refined_orders"] == [first(1), first(2)]
    assert_as_built(spark, other, rows, path, tmp_path)


def test_orders_without_a_time_have_a_folder_of_their_own(spark, tmp_path):
    path, raw_users = str(tmp_path), people(spark)
    rows = [*JANUARY, (1, 1, "Complete", None, 2)]
    monthly.load_months(raw_users, orders(spark, *rows), path)
    done = monthly.load_months(raw_users, orders(spark, *rows, (2, 2, "Cancelled", None, 3)), path, [None])
    assert done["user_months"] == [None]
    stored = files.read_parquet(spark, f"{path}/orders_modeling", schemas.ORDERS_MODELING)
    assert stored.where("order_timestamp IS NULL").count() == 2 and stored.count() == 5
    monthly.load_months(raw_users, orders(spark, *JANUARY), path, [None])
    assert stored.sparkSession.read.parquet(f"{path}/user_months").where("mes IS NULL").count() == 0


@pytest.mark.parametrize("step", ["refined_orders", "orders_modeling", "features_modeling"])
def test_a_load_that_was_cut_off_is_repeated(spark, tmp_path, monkeypatch, step):
    path, raw_users, rows = str(tmp_path / "t"), people(spark), [*JANUARY, *FEBRUARY]
    monthly.load_months(raw_users, orders(spark, *rows), path)
    now = orders(spark, *rows, *FLIPS)

    def breaks(plain):
        def write(df, where, *more):
            if where.endswith(step):
                raise RuntimeError("lost")
            return plain(df, where, *more)

        return write

    with monkeypatch.context() as patch:
        for name in ("replace_months", "write_parquet"):
            patch.setattr(monthly.files, name, breaks(getattr(files, name)))
        with pytest.raises(RuntimeError, match="lost"):
            monthly.load_months(raw_users, now, path, [first(4)])
    monthly.load_months(raw_users, now, path, [first(4)])
    assert_as_built(spark, raw_users, now, path, tmp_path)


def test_histories_add_up_in_any_cut(spark, folder):
    t = Tables(spark, folder)
    months = histories.by_user_and_month(t.raw_orders)
    rolled = histories.rolled_up(months)
    direct = features.customers_from_raw(t.raw_users, t.raw_orders)
    names = [c for c in rolled.columns if c != "last_order_date"]
    assert_equal(
        direct.join(rolled.select("user_id"), "user_id", "left_semi").select(*names),
        rolled.join(direct.select("user_id"), "user_id", "left_semi").select(*names),
    )
    assert months.count() > rolled.count()


def test_only_the_months_asked_for_are_read(spark, tmp_path):
    orders(spark, *JANUARY, *FEBRUARY, *FLIPS).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.schema(schemas.RAW_ORDERS).parquet(str(tmp_path / "raw"))
    some = monthly.in_months(raw, "created_at", [first(1), first(2), first(4)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,2024-01-01T00:00)" in plan
    assert "LessThan(created_at,2024-03-01T00:00)" in plan  # January and February are one range
    assert some.count() == raw.count()
    assert monthly.in_months(raw, "created_at", []).count() == 0
    assert monthly.in_months(raw, "created_at", None).count() == raw.count()


def test_loads_leave_no_intermediate_tables(spark, tmp_path):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    monthly.load_months(people(spark), orders(spark, *JANUARY), str(tmp_path), [first(1)])
    assert set(shared.iterdir()) == before


def test_command_line(spark, tmp_path, capsys):
    raw_users, raw_orders, tables = (str(tmp_path / name) for name in ("users", "orders", "tables"))
    people(spark).write.parquet(raw_users)
    orders(spark, *JANUARY, *FEBRUARY).write.parquet(raw_orders)
    main(["load", raw_users, raw_orders, tables])
    main(["load", raw_users, raw_orders, tables, "--months", "2024-02"])
    assert "orders_modeling 2024-02-01" in capsys.readouterr().out
    assert_as_built(spark, people(spark), spark.read.parquet(raw_orders), tables, tmp_path)


def test_a_load_reads_each_month_of_the_source_once(spark, tmp_path):
    path, raw_users = str(tmp_path), people(spark)
    monthly.load_months(raw_users, orders(spark, *JANUARY, *FEBRUARY, *MARCH), path)
    seen = spark.sparkContext.accumulator(0)
    rows = orders(spark, *JANUARY, *FEBRUARY, *MARCH, *FLIPS)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    # April is loaded, and January is written again for the customer whose label changed.
    source = rows.mapInArrow(count, rows.schema)
    done = monthly.load_months(raw_users, source, path, [first(4)])
    assert done["orders_modeling"] == [first(1), first(4)]
    assert seen.value == 2 * rows.count()  # one pass for what is loaded and one for the rest
