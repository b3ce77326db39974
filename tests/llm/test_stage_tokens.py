"""The pipeline's last stage encodes on the lattice as a relation: joins and folds, no search in a helper inside tasks."""

import corpus_pipeline as cp
from spikeloom.llm import pieces


def test_tokens_are_relational(shared, frame):
    made = cp.tokens(shared, frame, "")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "collect_list" in plan and "_piece" in plan
    assert sorted(map(str, made.collect())) == sorted(map(str, pieces.encoded(frame).collect()))
