"""Every panel query against its SQL, and the contract of __spark_entry__."""

import subprocess
import sys

import pytest

import __spark_entry__
from longpanel.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_without_corpus_operators():
    """Nothing outside the subpackage needs it."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("longpanel.llm", "corpus_pipeline"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
import longpanel.operators.models, longpanel.sources.tables, longpanel.streaming.incremental
assert not any(m.startswith("longpanel.llm.") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0])


def test_resampling_takes_the_references_draws(spark, sf_dir):
    """2,000 bootstraps, 500 shifts, 5,000 AR(1) series and 1,000 of each block length, so p can go below 0.0125."""
    assert QUERIES["bootstrap_ci_portable"](spark, sf_dir).first()["draws"] == 2000
    assert 1 / (1 + QUERIES["circular_shift_portable"](spark, sf_dir).count()) == 1 / 501 < 0.0125
    assert QUERIES["ar1_null"](spark, sf_dir).count() == 5000
    blocks = {r["block"]: r["count"] for r in QUERIES["block_null"](spark, sf_dir).groupBy("block").count().collect()}
    assert blocks == {8: 1000, 16: 1000, 32: 1000}
