"""What a query shuffles and writes: the steps that the larger tables made too dear."""

from __future__ import annotations

import datetime as dt

from shopflow.operators.clean import add_session_clock, clean_base
from shopflow.operators.features import session_features
from shopflow.plans.context import ShopContext
from shopflow.session import SMALL_TASKS, settings, write_stage
from shopflow.sources import fixtures
from tests.conftest import SF001
from tests.frames import events, ts


def _rows(n=400):
    out = []
    for i in range(n):
        session = "hot" if i % 3 == 0 else f"s{i % 29}"
        out.append((None if i % 7 == 0 else i % 11, session, ["view", "cart", "purchase", None][i % 4], None if i % 13 == 0 else i % 17,
                    None if i % 5 == 0 else f"B{i % 4}", None if i % 6 == 0 else f"c.{i % 9}", None if i % 19 == 0 else i / 4,
                    None if i % 23 == 0 else ts(1) + dt.timedelta(seconds=i * 37 % 1000)))
    return out


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_long_sessions_fold_like_short_ones(spark):
    e = clean_base(events(spark, _rows()))
    short = session_features(e)
    assert session_features(e, long=0).columns == short.columns
    assert session_features(e, long=0).schema.simpleString() == short.schema.simpleString()
    assert _sorted(session_features(e, long=0)) == _sorted(session_features(e, long=20)) == _sorted(short)


def test_usual_sessions_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "events")
    clean_base(events(spark, _rows())).write.parquet(path)
    found = session_features(spark.read.parquet(path))
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The count of the sessions' events found no long one and is gone from the plan.
    assert final.count("ShuffleQueryStage") == 1, final


def test_fixture_joins_its_lines_once(spark):
    plan = fixtures.shop_events_from_orders(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_clock_adds_time_parts_after_its_shuffle(spark):
    base = clean_base(events(spark, _rows()))
    out = add_session_clock(base, 3)
    assert set(base.columns) < set(out.columns)
    assert _sorted(out.select(*base.columns)) == _sorted(base)
    some = add_session_clock(base.drop("month", "event_period"), 3)
    assert "hour" in some.columns and "month" not in some.columns and "event_period" not in some.columns


def test_clean_events_are_written_once(spark):
    ctx = ShopContext(spark, lambda: events(spark, _rows()))
    files = ctx.events_clean.inputFiles()
    assert files and all("/shopflow/ordered/" in f for f in files)


def test_stage_tables_are_written_in_small_tasks(spark, tmp_path):
    seen = {}
    df = events(spark, _rows())
    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    with settings(spark, SMALL_TASKS):
        seen.update({k: spark.conf.get(k) for k in SMALL_TASKS})
    assert seen == SMALL_TASKS and {k: spark.conf.get(k, None) for k in SMALL_TASKS} == before
    write_stage(df.dropDuplicates(), str(tmp_path / "t"))
    assert _sorted(spark.read.parquet(str(tmp_path / "t"))) == _sorted(df.dropDuplicates())
