"""IO11: an incremental run equals a full one and rewrites only what new files touch."""

import glob
import os
import shutil

import pytest

import shopflow.plans.incremental as I
from shopflow.plans.pipeline import PipelineConfig, run_cleaning, run_features

_COLUMNS = "event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price string, user_id string, user_session string"


def _row(time, kind, product, brand, user, session, price="2.50", category="a.b"):
    return (time and f"{time} UTC", kind, product, "1", category, brand, price, user, session)


_FIRST = [
    _row("2020-01-01 10:00:00", "view", "1", "x", "7", "s1"), _row("2020-01-01 10:05:00", "purchase", "1", "x", "7", "s1"),
    _row("2020-01-02 23:59:00", "view", "2", "y", "8", "s2"), _row("2020-01-03 00:01:00", "cart", "2", "y", "8", "s2"),
    _row("2020-01-05 09:00:00", "view", "3", None, "9", "s3"), _row(None, "view", "4", "x", "9", "s4"),
    _row("2020-01-05 09:00:00", "view", "3", None, "9", None)]
_SECOND = [
    _FIRST[0],                                                                  # already there: touches nothing
    _row("2020-01-02 23:00:00", "view", "5", "z", "6", "s2"),                   # a new first event, of another user
    _row("2020-01-03 00:01:00", "cart", "2", "y", "8", "s2"),                   # already there
    _row("2020-01-07 12:00:00", "purchase", "2", "y", None, "s5", category=None)]


def _write(spark, rows, path, name):
    part = f"{path}-part"
    spark.createDataFrame(rows, _COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).csv(part)
    os.makedirs(path, exist_ok=True)
    shutil.copy(glob.glob(f"{part}/*.csv")[0], f"{path}/{name}.csv")


def _tables(spark, base):
    paths = {"events": f"{base}/data/cleaned/events", **{n: f"{base}/data/features/{n}" for n in ("session_features", *I._KEYS)}}
    rows = {n: spark.read.parquet(p).drop("row_digest") for n, p in paths.items()}
    return {n: sorted(map(str, df.select(*sorted(df.columns)).collect())) for n, df in rows.items()}


def _config(base):
    return PipelineConfig(base_path=base, output=f"{base}/out", tag="t")


@pytest.fixture
def whole(spark, tmpdir_run):
    base = f"{tmpdir_run}/inc_full"
    for name, rows in (("a", _FIRST), ("b", _SECOND)):
        _write(spark, rows, f"{base}/data/raw/events.csv", name)
    run_cleaning(spark, _config(base))
    run_features(spark, _config(base))
    return _tables(spark, base)


def test_new_files_rewrite_only_their_dates_and_equal_a_full_run(spark, tmpdir_run, whole, monkeypatch):
    base = f"{tmpdir_run}/inc_two"
    raw, cfg = f"{base}/data/raw/events.csv", _config(base)
    _write(spark, _FIRST, raw, "a")
    assert I.update_tables(spark, cfg) == 1
    files = lambda: {f for f in glob.glob(f"{base}/data/cleaned/events/event_date=*/*.parquet")}
    before = files()
    _write(spark, _SECOND, raw, "b")
    # The run breaks off while its features are put in place: the next call carries it through.
    put, calls = I.write_features, []

    def broken(tables, where):
        calls.append(where)
        if where == base:
            raise OSError("lost")
        put(tables, where)
    monkeypatch.setattr(I, "write_features", broken)
    with pytest.raises(OSError):
        I.update_tables(spark, cfg)
    monkeypatch.setattr(I, "write_features", put)
    assert I.update_tables(spark, cfg) == 0
    day = lambda f: os.path.basename(os.path.dirname(f)).split("=")[1]
    assert {day(f) for f in before - files()} == {"2020-01-02", "2020-01-03"}
    assert {day(f) for f in files() - before} == {"2020-01-02", "2020-01-03", "2020-01-07"}
    assert _tables(spark, base) == whole
    # A processed file that changes needs a full run.
    _write(spark, _FIRST[:3], raw, "a")
    with pytest.raises(ValueError, match="full run"):
        I.update_tables(spark, cfg)
