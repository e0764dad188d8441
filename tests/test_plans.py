"""Plans that must not gather a table in one task or join it by a nested loop."""

from __future__ import annotations

import pytest

from tessera.operators import packing
from tessera.plans import catalogue

NAMES = ["w02_average_rank", "a15_spearman", "v01_metrics_by_prefix", "v02_analogies", "v03_whole_vocabulary", "a24_subword_fertility", "m19_speech", "v26_line_crops", "v04_donors_and_refusals", "m11_whole_alignment", "x29_informal_spelling"]
#: A single row of another side is joined by a nested loop; these queries compare languages with one of them.
ONE_ROW = {"a24_subword_fertility"}


@pytest.mark.parametrize("name", NAMES)
def test_no_table_is_gathered(name, spark, sf_dir, monkeypatch):
    # orders of few rows have one cell
    monkeypatch.setattr(packing, "CELL_ROWS", 2_000)
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    gathered = ["\n".join(lines[i + 1 : i + 4]) for i, x in enumerate(lines) if "SinglePartition" in x]
    # the sums of an order's cells, a few thousand at most, may meet in one task
    assert all("_cell" in below for below in gathered) and "CartesianProduct" not in plan
    assert name in ONE_ROW or "NestedLoopJoin" not in plan
