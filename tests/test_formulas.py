"""Two formulas scored on the same orders, whatever their status."""

import datetime

import duckdb
import numpy as np
import pytest

from catalog import mixed_queries

STATUSES = ["O", "F", "P", None]
ORDERS, CUSTOMERS = 240, 30


@pytest.fixture(scope="module")
def orders_of_all_statuses(spark, tmp_path_factory):
    """Folder of orders of all statuses, one without, and their customers."""
    rng = np.random.default_rng(7)
    at = str(tmp_path_factory.mktemp("orders"))
    balance = rng.uniform(-1000, 9000, CUSTOMERS).tolist()
    rows = [
        (i, i % CUSTOMERS, STATUSES[i // CUSTOMERS % len(STATUSES)], float(rng.uniform(0, 450000)), datetime.datetime(2020, int(rng.integers(1, 13)), 3))
        for i in range(ORDERS)
    ]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp")
    orders.write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(list(enumerate(balance)), "c_custkey long, c_acctbal double").write.parquet(f"{at}/customer.parquet")
    return at


def by_sql(name, at):
    con = duckdb.connect()
    for table in ("orders", "customer"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet/*.parquet'")
    found = con.execute(mixed_queries.ORACLE[name])
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def same_rows(got, wanted, keys):
    got, wanted = ({tuple(r[k] for k in keys): r for r in rows} for rows in (got, wanted))
    assert got.keys() == wanted.keys()
    for k, row in wanted.items():
        assert got[k] == {c: pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for c, v in row.items()}


def test_formulas_are_compared_on_orders_of_every_status(spark, orders_of_all_statuses):
    """Only orders of status O, a part of the table, were compared."""
    got = [r.asDict() for r in mixed_queries.compare_mixed_formulas(spark, orders_of_all_statuses).collect()]
    assert {r["model"]: r["observations"] for r in got} == {"level": ORDERS, "season": ORDERS}
    same_rows(got, by_sql("compare_mixed_formulas", orders_of_all_statuses), ["model"])


def test_orders_of_every_status_have_scores(spark, orders_of_all_statuses):
    """Orders of other statuses than O had no scores."""
    got = [r.asDict() for r in mixed_queries.smoothed_scores(spark, orders_of_all_statuses).collect()]
    assert sorted((r["model"], r["order_id"]) for r in got) == [(m, i) for m in ("level", "season") for i in range(ORDERS)]
    same_rows(got, by_sql("smoothed_scores", orders_of_all_statuses), ["model", "order_id"])
