"""All registered queries and all comparison SQL."""

from __future__ import annotations

from checks import (
    oracle_boosting,
    oracle_cleaning,
    oracle_eda,
    oracle_forecast,
    oracle_models,
    oracle_reports,
    query_cleaning,
    query_eda,
    query_forecast,
    query_reports,
)

QUERIES = {
    **query_reports.QUERIES,
    **query_cleaning.QUERIES,
    **query_eda.QUERIES,
    **query_forecast.QUERIES,
}
ORACLES = {
    **oracle_reports.ORACLES,
    **oracle_cleaning.ORACLES,
    **oracle_eda.ORACLES,
    **oracle_forecast.ORACLES,
    **oracle_models.ORACLES,
    **oracle_boosting.ORACLES,
}
