from __future__ import annotations

import datetime as dt

import pytest

from tillroll.schema import RAW, SALES
from tillroll.session import local_session

SMALL = "/root/testdata/sf0.001"

LINE = {
    "order_id": "1",
    "order_date": dt.date(2000, 5, 17),
    "ship_date": dt.date(2000, 5, 20),
    "ship_mode": "First",
    "customer_id": "c1",
    "customer_name": "Ann",
    "segment": "Consumer",
    "region": "East",
    "state": "S1",
    "category": "Tables",
    "sub_category": "Low",
    "product_name": "P",
    "sales": 10,
    "quantity": 1,
    "discount": 0,
    "profit": 2,
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _rows(lines, schema):
    for line in lines:
        row = LINE | line
        yield tuple(row[f.name] for f in schema.fields)


@pytest.fixture
def sales(spark):
    """Reporting rows from partial dicts; money is given as text or whole numbers."""
    from decimal import Decimal

    def make(lines):
        money = ("sales", "discount", "profit")
        full = [
            {k: Decimal(str(v)) if k in money and v is not None else v for k, v in (LINE | x).items()}
            for x in lines
        ]
        return spark.createDataFrame(list(_rows(full, SALES)), SALES)

    return make


@pytest.fixture
def raw(spark):
    """Cleaning rows from partial dicts."""

    def make(lines):
        numbers = ("sales", "quantity", "discount", "profit")
        full = [
            {k: float(v) if k in numbers and v is not None else v for k, v in (LINE | x).items()}
            for x in lines
        ]
        return spark.createDataFrame(list(_rows(full, RAW)), RAW)

    return make


def column(df, name):
    return [row[name] for row in df.collect()]
