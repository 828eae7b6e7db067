import pytest
from oracle import compare, connected

from bitloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_statement(spark, con, name):
    assert compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) > 0


@pytest.mark.parametrize("name", ["codec_sizes", "compressed_pages", "stream_containers"])
def test_every_page_is_exact(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(r.exact for r in rows)
