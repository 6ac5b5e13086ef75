"""The named queries run the whole published search."""

import pytest

from keepwell.operators import train
from keepwell.plans import catalog


class Stop(Exception):
    pass


@pytest.mark.parametrize("name", ["tuning_results", "train_job"])
def test_budget(monkeypatch, name):
    seen = []

    def stop(budget):
        seen.append(budget)
        raise Stop

    monkeypatch.setattr(catalog, "_training", lambda spark, sf_dir, budget: stop(budget))
    monkeypatch.setattr(catalog.jobs, "train_job", lambda spark, raw, store, budget: stop(budget))
    monkeypatch.setattr(catalog.base, "raw", lambda *a: None)
    monkeypatch.setattr(catalog.scratch, "scratch_path", lambda *a: "/tmp/none")
    with pytest.raises(Stop):
        catalog.QUERIES[name](None, "")
    assert seen == [train.Budget()] and (seen[0].folds, seen[0].settings, seen[0].trees) == (5, 15, (100, 200, 300))
