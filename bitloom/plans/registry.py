"""Registered queries, each (spark, sf_dir) -> DataFrame, and the DuckDB statement of each."""

from bitloom.plans import dataset_queries, rule_queries, tensor_queries

QUERIES: dict = {**tensor_queries.QUERIES, **dataset_queries.QUERIES, **rule_queries.QUERIES}
ORACLES: dict = {**tensor_queries.ORACLES, **dataset_queries.ORACLES, **rule_queries.ORACLES}
