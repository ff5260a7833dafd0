"""Retail-sales analytics on Spark: clean, report, explore, forecast."""
