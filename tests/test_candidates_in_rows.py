"""Candidates are finished inside the profile's row."""

import pytest

from siftworks.experience import candidates, rules
from siftworks.plans import experience as plans


@pytest.mark.parametrize("kind", ["tabular", "text", "image", "audio"])
def test_rows_give_the_joined_candidates_without_a_shuffle(spark, kind):
    p = plans.profiles(spark, "/root/testdata/sf0.001", kind).localCheckpoint()
    r = rules.RULE_SETS[kind]
    made = candidates.candidates(p, r)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    want = candidates.finish(candidates.constrain(candidates.propose(p, r), p, r), p, r)
    assert made.columns == want.columns and [f.dataType for f in made.schema] == [f.dataType for f in want.schema]
    assert made.count() == want.count() and made.exceptAll(want).isEmpty()


def test_evaluations_stay_in_their_profile_rows(spark):
    ev = plans.evaluations(spark, "/root/testdata/sf0.001")
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hash") <= 1  # the profiles' own grouping
    assert ev.groupBy("dataset").agg({"rank": "max"}).count() == ev.select("dataset").distinct().count() > 0
