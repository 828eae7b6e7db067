import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connected  # noqa: E402

from bitloom.llm import registry  # noqa: E402

BASE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_statement(spark, name):
    con = connected(BASE)
    assert compare(registry.QUERIES[name](spark, BASE), con, registry.ORACLES[name]) == 1000
    seen = {"op8_substring_dedup": "n_removed > 0", "op9_decontamination": "contaminated"}[name]
    assert con.execute(f"SELECT count(*) FROM ({registry.ORACLES[name]}) WHERE {seen}").fetchone()[0] > 10
