"""The driver contract in __spark_entry__.py."""

import inspect
import re

import __spark_entry__ as entry
from retention.plans.catalog import load_all


def test_oracles_are_a_subset_of_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 58 and len(o) >= 49
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())


def test_every_query_is_documented_and_named_plainly():
    for name, spec in load_all().items():
        assert spec.doc, f"{name} has no docstring"
        assert "pipeline" not in name and not re.match(r"op\d", name)


def test_queries_take_spark_and_data_dir():
    for name, fn in entry.queries().items():
        params = list(inspect.signature(fn).parameters)
        assert params[:2] == ["spark", "sf_dir"], name
        assert "sf_dir" in inspect.getsource(fn), f"{name} ignores the data directory"
