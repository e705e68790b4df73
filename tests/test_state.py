"""A stored history answers for new orders as one table of all orders would."""

import pytest
from pyspark.sql import functions as F

from leadlane.operators import features as FT
from leadlane.operators import scoring as SCO
from leadlane.operators.statistics import HistoryState
from leadlane.plans import catalog  # noqa: F401  (registers all queries)
from leadlane.plans.q_extra import _history_and_new
from tests.conftest import SMOKE


def rows(df, cols):
    return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("production_number", *cols).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_appended_state_equals_one_table(spark, tmp_path, kind):
    hist, new = _history_and_new(spark, SMOKE)
    if kind == "timestamp":
        at = lambda c: F.timestamp_seconds(F.unix_date(c) * 86400 + F.col("production_number") * 7919 % 86400)
        hist, new = (d.withColumns({c: at(c) for c in ("created_date", "planned_start_date")}) for d in (hist, new))
    lineless = F.when(F.col("production_number") % 9 != 0, F.col("production_line"))
    hist, new = hist.withColumn("production_line", lineless), new.withColumn("production_line", lineless)
    new = new.where("production_number % 3 = 0")
    part = F.col("production_number") % 5 < 2
    state = SCO.build_state(hist.where(part)).append(FT.time_features(SCO.E.lead_time_target(hist.where(~part))))
    state.save(str(tmp_path / "s"))
    got = FT.features_v4(new, training=False, state=HistoryState.load(spark, str(tmp_path / "s")))
    cols = [c for c in FT.feature_columns(got)]
    assert len(cols) > 40 and rows(got, cols) == rows(SCO.score_features(hist, new), cols)
