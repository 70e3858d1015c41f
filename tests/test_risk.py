import pytest

import toys
from millwatch.operators import reconcile, risk


@pytest.fixture(scope="module")
def scored(spark):
    return toys.scored(spark, toys.RISK_Y, toys.RISK_PROBA)


def test_confidence_is_one_minus_p_no_failure(scored):
    found = [r[1] for r in risk.confidence_scores(scored).orderBy("udi").collect()]
    assert found == pytest.approx([0.08, 0.15, 0.25, 0.35, 0.70, 0.55, 0.80])


@pytest.mark.parametrize("rank_rows", [1, 200_000])
def test_threshold_sits_just_past_the_room(scored, rank_rows):
    choice = risk.choose_threshold(scored, 0.6, rank_rows=rank_rows)
    assert choice.threshold == pytest.approx(0.15)
    assert (choice.budget, choice.room) == (3, 2)


def test_tiers_follow_the_rule_and_the_boundary_stays_low(scored):
    threshold = risk.choose_threshold(scored, 0.6).threshold
    rows = risk.assign_tiers(scored, threshold).orderBy("udi").collect()
    assert "".join(r["risk_tier"][0] for r in rows) == "lleeheh"
    assert rows[1]["confidence_score"] == threshold
    counts = risk.flag_counts(risk.assign_tiers(scored, threshold)).first()
    assert tuple(counts) == (3, 0)


@pytest.mark.parametrize(("budget", "message"), [(0.1, "takes 1 healthy rows, more than the 0"), (1.0, "fit into a review of 5")])
def test_impossible_budgets_are_rejected(scored, budget, message):
    with pytest.raises(ValueError, match=message):
        risk.choose_threshold(scored, budget)


def test_label_and_score_counts_must_match(scored):
    with pytest.raises(ValueError, match="5 labels but 7"):
        reconcile.require_aligned(scored.select("udi"), scored.where("udi < 106").select("udi"))


def test_a_score_shared_by_a_third_of_the_rows(spark):
    """Ties at the threshold: strict > keeps the budget, no row is dropped."""
    proba = [[0.8, 0.2, 0, 0, 0]] * 400 + [[1 - i / 2000, i / 2000, 0, 0, 0] for i in range(800)]
    scored = toys.scored(spark, [0] * 1200, [[float(p) for p in row] for row in proba])
    for budget in (0.02, 0.3, 0.5):
        expected = sorted((1.0 - row[0] for row in proba), reverse=True)[int(budget * 1200)]
        choice = risk.choose_threshold(scored, budget, rank_rows=5)
        assert choice.threshold == expected
        flagged = risk.flag_counts(risk.assign_tiers(scored, choice.threshold)).first()[0]
        assert flagged <= choice.budget
