"""Every query of the catalogue against its oracle, on the smallest tables; those with ties and rounding on larger ones too."""

import pytest

from loglathe import catalogue

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_oracle(spark, db, name):
    assert oracle.difference(spark, db, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", ["label_affinities", "density_share_rank", "contrast_lift", "softmax_source", "counterbalanced_margin", "cold_positions", "binomial_tail", "projection_change", "common_prefix_len"])
def test_rounded_query_equals_oracle_on_larger_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(spark, oracle.database(sf), catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_oracles_have_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES
