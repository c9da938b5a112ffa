"""Breakdowns add up to the whole."""

import pytest
from pyspark.sql import functions as F

from gameline.operators import decisions
from gameline.plans import views


@pytest.fixture(scope="module")
def bets(spark, data):
    df = views.bets(spark, data).persist()
    yield df
    df.unpersist()


def test_groups_add_up(bets):
    whole = decisions.overall(bets).first()
    for by in ("prop", "direction"):
        parts = decisions.breakdown(bets, by).agg(F.sum("total_bets"), F.sum("wins"), F.sum("total_profit")).first()
        assert parts[0] == whole.total_bets and parts[1] == whole.wins
        assert parts[2] == pytest.approx(whole.total_profit)


def test_sweep_starts_at_the_whole(bets):
    whole = decisions.overall(bets).first()
    zero = decisions.threshold_sweep(bets).where("threshold = 0").first()
    assert zero.bets == whole.total_bets and zero.roi == pytest.approx(whole.roi)


def test_sweep_against_filters(bets):
    for r in decisions.threshold_sweep(bets).collect():
        one = decisions.overall(bets.where(F.col("edge") >= r.threshold)).first()
        assert (r.bets, r.profit) == (one.total_bets, pytest.approx(one.total_profit))


def test_running_ends_at_the_total(bets):
    last = decisions.running(bets).orderBy(F.desc("cumulative_bets")).first()
    whole = decisions.overall(bets).first()
    assert last.cumulative_bets == whole.total_bets and last.cumulative_profit == pytest.approx(whole.total_profit)
    day = decisions.daily(bets).orderBy(F.desc("game_date")).first()
    assert day.cumulative_profit == pytest.approx(whole.total_profit)
