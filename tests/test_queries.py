"""Every core query runs on the smallest tables; those with SQL agree with it."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.harness import compare

MODULES = [importlib.import_module(f"tallyloom.plans.{m}") for m in entry.CORE]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in MODULES for n, s in getattr(m, "ORACLE", {}).items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE[name], SMALL) == ""


#: Columns that are never NULL and a bound on the rows, for what SQL does not say.
SHAPES = {
    "chunk_dedup_fuzzy": (("text_record_id", "text"), 1),
    "fractional_logit": (("term", "estimate", "se", "n"), 3),
    "neg_binomial": (("term", "estimate", "theta"), 4),
    "ols_hc3": (("term", "estimate", "se", "p_value", "r2"), 3),
    "ols_robustness": (("model", "term", "estimate", "se"), 12),
    "p5_formats": (("record_table", "n_records", "n_readable", "n_several"), 12),
    "p5_found": (("record_table", "record_id", "epoch_ms"), 300),
    "vector_pictures": (("vec_id", "phash_hex", "sharpness"), 500),
    "tfidf_logreg": (("tp", "fp", "fn", "tn", "accuracy"), 1),
    "tfidf_svm": (("tp", "fp", "fn", "tn", "accuracy"), 1),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    filled, least = SHAPES.get(name, ((), 1))
    rows = QUERIES[name](spark, SMALL).collect()
    assert len(rows) >= least and all(r[c] is not None for r in rows for c in filled)
    assert len({tuple(map(repr, r)) for r in rows}) == len(rows)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
