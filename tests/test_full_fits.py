"""The registered fits are whole: the library's defaults, no smaller forest or search."""
import inspect

import pytest

from txrisk.operators import models as MD
from txrisk.plans import catalog  # noqa: F401
from txrisk.plans.registry import QUERIES


class _Asked(Exception):
    pass


def asked(monkeypatch, spark, sf, query, fit):
    signature = inspect.signature(getattr(MD, fit))

    def stop(*args, **kw):
        call = signature.bind(*args, **kw)
        call.apply_defaults()
        raise _Asked(call.arguments)
    monkeypatch.setattr(MD, fit, stop)
    with pytest.raises(_Asked) as e:
        QUERIES[query](spark, sf)
    return e.value.args[0]


@pytest.mark.parametrize("query", ["train_forest", "feature_drivers", "forest_repeatable"])
def test_forests(spark, sf_small, monkeypatch, query):
    got = asked(monkeypatch, spark, sf_small, query, "train_forest")
    assert (got["num_trees"], got["max_depth"], got["kw"]) == (100, 30, {})


@pytest.mark.parametrize("query", ["tune_forest", "cv_results"])
def test_searches(spark, sf_small, monkeypatch, query):
    got = asked(monkeypatch, spark, sf_small, query, "tune_forest")
    assert got["candidates"] == MD.sample_candidates() and len(got["candidates"]) == 15
    assert got["num_folds"] == got["train_with_folds"].select("fold").distinct().count() == 5
