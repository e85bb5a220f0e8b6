import inspect

import pytest

from gaitspark.operators import interaction, models, stats, tracking
from gaitspark.plans import catalog

DATA = "/root/testdata/sf0.001"


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    "name, module, operator, argument, value",
    [("permutation_contrast", stats, "permutation_contrast", "shuffles", 200), ("distance_response_null", interaction, "ant_contrast", "shuffles", 200), ("motif_clusters", models, "kmeans", "iterations", 100), ("atlas_slim", models, "kmeans", "iterations", 100), ("chaos_guard", tracking, "chaos_guard", "most", 40)],
)
def test_queries_run_with_the_surveyed_values(spark, monkeypatch, name, module, operator, argument, value):
    takes = inspect.signature(getattr(module, operator))

    def stub(*args, **named):
        bound = takes.bind(*args, **named)
        bound.apply_defaults()
        raise Reached(bound.arguments[argument])

    monkeypatch.setattr(module, operator, stub)
    with pytest.raises(Reached) as got:
        catalog.queries()[name](spark, DATA)
    assert got.value.args == (value,)
