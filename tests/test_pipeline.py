"""IO round trips: staged pipeline, summary JSON, report sheets, snapshots, streaming ingest."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from shopflow.plans.pipeline import PipelineConfig, run_pipeline
from shopflow.sources.features import read_features, require_columns
from shopflow.sources.fixtures import shop_events_from_orders
from shopflow.sources.snapshot import load_snapshot, snapshot_status, write_snapshot
from shopflow.sources.summary import read_summary, write_report
from tests.conftest import SF001


def _write_raw_csv(spark, path):
    raw = shop_events_from_orders(spark, SF001).withColumn(
        "event_time", F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
    raw.write.option("header", True).mode("overwrite").csv(path)
    return raw.count()


def test_pipeline_round_trip(spark, tmpdir_run):
    base = os.path.join(tmpdir_run, "proj")
    _write_raw_csv(spark, f"{base}/data/raw/events.csv")
    cfg = PipelineConfig(base_path=base, output=f"{tmpdir_run}/out", tag="t1")
    path = run_pipeline(spark, cfg)
    s = read_summary(spark, path).first()
    assert s.tag == "t1"
    assert s.summary.funnel.total_sessions == 1458
    assert len(s.summary.insights) > 0
    # second run: skip stages, compare with the first as baseline
    cfg2 = PipelineConfig(base_path=base, output=f"{tmpdir_run}/out", tag="t2", skip_clean=True,
                          skip_features=True, baseline=path)
    s2 = read_summary(spark, run_pipeline(spark, cfg2)).first()
    assert s2.summary.funnel == s.summary.funnel
    tables = read_features(spark, base)
    require_columns(tables["session_features"], ["user_session", "view_to_purchase_rate"], "session_df")
    try:
        require_columns(tables["user_features"], ["nope"], "user_df")
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "nope" in str(e)
    cleaned = spark.read.parquet(f"{base}/data/cleaned/events")
    assert "event_date" in cleaned.columns and cleaned.count() == 5933


def test_raw_dedupe_keeps_rows_that_differ_anywhere(spark, tmpdir_run):
    """Two events that differ in a column no analysis reads, or in the third decimal, both stay."""
    from shopflow.operators.clean import clean_events
    from shopflow.sources.events import read_distinct_events
    cols = "event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price string, user_id string, user_session string"
    t = "2020-09-24 11:57:06 UTC"
    rows = [(t, "view", "1", c, "a.b", "x", p, "7", "s") for c, p in (("1", "1.001"), ("2", "1.001"), ("1", "1.002"), ("1", "1.001"))]
    spark.createDataFrame(rows, cols).write.option("header", True).csv(f"{tmpdir_run}/wide")
    out = clean_events(read_distinct_events(spark, f"{tmpdir_run}/wide"), dedupe=False).collect()
    assert len(out) == 3 and all(str(r.event_time) == "2020-09-24 11:57:06" for r in out)


def test_event_time_types(spark):
    import datetime as dt

    import pytest

    from shopflow.operators.clean import coerce_event_time
    day = dt.datetime(2024, 2, 3)
    for value, kind in ((day.date(), "date"), (int((day - dt.datetime(1970, 1, 1)).total_seconds()), "bigint"), (day, "timestamp_ntz"), ("2024-02-03 00:00:00 UTC", "string")):
        assert coerce_event_time(spark.createDataFrame([(value,)], f"event_time {kind}")).first()[0] == day
    with pytest.raises(TypeError):
        coerce_event_time(spark.createDataFrame([(1.5,)], "event_time double"))


def test_baseline_without_funnel_and_broken_snapshot(spark, tmpdir_run):
    import pytest

    from shopflow.sources.summary import baseline_funnel
    for i, (text, n) in enumerate((('{"tag": "x"}', 0), ('{"summary": {}}', 0), ('{"summary": {"funnel": {"view_to_cart": 0.5}}}', 1))):
        with open(f"{tmpdir_run}/s{i}.json", "w") as f:
            f.write(text)
        rows = baseline_funnel(read_summary(spark, f"{tmpdir_run}/s{i}.json")).collect()
        assert len(rows) == n and (not n or (rows[0].view_to_cart, rows[0].cart_to_purchase) == (0.5, 0.0))
    version = write_snapshot({"users": spark.range(3)}, f"{tmpdir_run}/snap")
    for part in glob.glob(f"{tmpdir_run}/snap/versions/{version}/users/*.parquet"):
        with open(part, "w") as f:
            f.write("not parquet")
    with pytest.raises(Exception):
        load_snapshot(spark, f"{tmpdir_run}/snap")


def test_report_and_snapshot(spark, tmpdir_run):
    from shopflow.plans.context import ShopContext
    from shopflow.operators import report
    ctx = ShopContext.for_source(spark, SF001)
    paths = write_report({"📋 Executive Summary": report.report_brands(ctx.brands),
                          "👥 User Analysis": report.report_users(ctx.users)}, tmpdir_run, "r1", fmt="csv")
    back = spark.read.option("header", True).csv(paths["👥 User Analysis"])
    assert back.count() == 150
    snap = f"{tmpdir_run}/snap"
    write_snapshot({"sessions": ctx.sessions.withColumn("session_started_at", F.col("session_started_at").cast("string")),
                    "users": ctx.users}, snap)
    loaded = load_snapshot(spark, snap)
    assert list(loaded) == ["sessions", "users"]
    with pytest.raises(ValueError, match="lacks tables: \\['brands'\\]"):
        load_snapshot(spark, snap, require=["users", "brands"])
    assert dict(loaded["sessions"].dtypes)["session_started_at"] == "timestamp_ntz"
    st = snapshot_status(loaded["sessions"], loaded["users"]).first()
    assert st.total_sessions == 1458 and st.total_users == 150 and len(st.created_at) == 10


def test_streaming_ingest(spark, tmpdir_run):
    from shopflow.streaming import start_ingest
    src = f"{tmpdir_run}/incoming"
    _write_raw_csv(spark, src)
    q = start_ingest(spark, src, f"{tmpdir_run}/cleaned", f"{tmpdir_run}/ckpt", trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmpdir_run}/cleaned")
    assert out.where(F.col("user_session").isNull()).count() == 0
    assert out.distinct().count() == out.count()  # no copies inside a batch
    assert out.drop("batch_id").distinct().count() == 5933
    assert out.where("user_id is null or event_type not in ('view', 'cart', 'purchase')").count() == 0
    # a replayed batch changes nothing
    before = out.count()
    q = start_ingest(spark, src, f"{tmpdir_run}/cleaned", f"{tmpdir_run}/ckpt2", trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmpdir_run}/cleaned").count() == before


def test_full_report_round_trip(spark, tmpdir_run):
    from shopflow.plans.context import ShopContext
    from shopflow.plans.report import SHEETS, build_report, write_full_report
    ctx = ShopContext.for_source(spark, SF001)
    sheets = build_report(ctx)
    assert list(sheets) == [s for s, _, _ in SHEETS]
    paths = write_full_report(ctx, tmpdir_run, "full")
    for name, df in sheets.items():
        assert spark.read.parquet(paths[name]).count() == df.count() > 0, name
    scores = [r.efficiency_score for r in sheets["🏆 Top Brands"].collect()]
    assert scores == sorted(scores, reverse=True)


def test_date_filter_prunes_folders(spark, tmpdir_run):
    from shopflow.operators.clean import clean_base
    from shopflow.operators.explore import apply_filters
    from shopflow.sources.events import read_clean, write_clean
    events = clean_base(shop_events_from_orders(spark, SF001))
    write_clean(events, f"{tmpdir_run}/dated")
    got = apply_filters(read_clean(spark, f"{tmpdir_run}/dated"), ("1997-01-01", "1997-03-31"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert got.count() == apply_filters(events, ("1997-01-01", "1997-03-31")).count()


def test_kpis_of_an_empty_filter_are_zero(spark):
    from shopflow.operators.explore import filtered_kpis
    from shopflow.plans.context import ShopContext
    row = filtered_kpis(ShopContext.for_source(spark, SF001).events.where("false")).first()
    assert all(v == 0 for v in row)


def test_a_half_written_snapshot_is_never_read(spark, tmpdir_run):
    from shopflow.plans.context import ShopContext
    from shopflow.plans.summary import build_summary
    snap = f"{tmpdir_run}/snap"
    with pytest.raises(ValueError, match="No finished snapshot"):
        load_snapshot(spark, snap)
    ctx = ShopContext.for_source(spark, SF001)
    tables = {"sessions": ctx.sessions, "users": ctx.users, "brands": ctx.brands, "categories": ctx.categories, "cleaned": ctx.events,
              "summary": build_summary(ctx, tag="snap", generated_at="1970-01-01T00:00:00Z")}
    write_snapshot(tables, snap, "v1")
    write_snapshot({"users": ctx.users.limit(7)}, snap, "v2")
    ctx.users.limit(1).write.parquet(f"{snap}/versions/v3/users")  # its writer stopped before the manifest
    assert load_snapshot(spark, snap)["users"].count() == 7
    first = load_snapshot(spark, snap, "v1", require=tables)
    assert set(first) == set(tables) and first["users"].count() == ctx.users.count()
    assert first["summary"].first().summary.funnel.total_sessions == ctx.sessions.count()
    with pytest.raises(ValueError):
        load_snapshot(spark, snap, "v3")
    with pytest.raises(ValueError, match="Not tables"):
        write_snapshot({"orders": ctx.users}, snap)


def test_rows_without_time_end_in_balanced_files(spark, tmpdir_run):
    from shopflow.operators.clean import clean_base
    from shopflow.sources.events import read_clean, write_clean
    raw = shop_events_from_orders(spark, SF001)
    events = clean_base(raw.withColumn("event_time", F.when(F.hash("user_session", "product_id") % 3 != 0, F.col("event_time"))))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        write_clean(events.repartition(24), f"{tmpdir_run}/sink")
    finally:
        for k in conf:
            spark.conf.unset(k)
    sizes = [n for n in (spark.read.parquet(f).count() for f in glob.glob(f"{tmpdir_run}/sink/event_date=__HIVE*/*.parquet"))]
    none = events.where("event_time is null").count()
    assert sum(sizes) == none > events.count() / 4
    assert len(sizes) >= 4 and max(sizes) <= 3 * none / len(sizes)
    assert read_clean(spark, f"{tmpdir_run}/sink").count() == events.count()


def test_brand_filter_reads_fewer_row_groups(spark, tmpdir_run):
    import pyarrow.parquet as pq

    from shopflow.operators.clean import clean_base
    from shopflow.sources.events import write_clean
    events = clean_base(shop_events_from_orders(spark, SF001)).withColumn("event_date", F.lit("2020-01-01"))
    small = {"parquet.block.size": "8192", "parquet.page.size": "2048", "parquet.block.size.row.check.min": "50", "parquet.page.size.row.check.min": "50"}
    write_clean(events, f"{tmpdir_run}/clustered", options=small)
    events.write.options(**small).parquet(f"{tmpdir_run}/plain")

    def admitted(folder):
        """(row groups whose brand range admits one brand, all row groups)"""
        hit = total = 0
        for f in glob.glob(f"{tmpdir_run}/{folder}/**/*.parquet", recursive=True):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                column = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "brand")
                total += 1
                hit += column.statistics.min <= "Brand#13" <= column.statistics.max
        return hit, total
    clustered, plain = admitted("clustered"), admitted("plain")
    assert clustered[1] >= 8 and plain[0] == plain[1] and clustered[0] <= clustered[1] / 3
    got = spark.read.parquet(f"{tmpdir_run}/clustered").where("brand = 'Brand#13'").count()
    assert got == events.where("brand = 'Brand#13'").count()


def test_feature_tables_have_fixed_types(spark, tmpdir_run):
    from shopflow.plans.context import ShopContext
    from shopflow.schema import FEATURE_COLUMNS
    from shopflow.sources.features import write_features
    ctx = ShopContext.for_source(spark, SF001)
    loose = {"session_features": ctx.sessions.withColumn("session_started_at", F.col("session_started_at").cast("string"))
                                    .withColumn("view_count", F.col("view_count").cast("int")).withColumn("signup_unique", F.lit(1)),
             "user_features": ctx.users, "brand_features": ctx.brands, "category_features": ctx.categories}
    write_features(loose, tmpdir_run)
    for name, df in read_features(spark, tmpdir_run).items():
        types = dict(df.dtypes)
        assert all(types[c] == t for c, t in FEATURE_COLUMNS[name].items()), name
        assert types.get("signup_unique", "bigint") == "bigint"
        assert df.count() == loose[name].count()
    write_features({"user_features": ctx.users.drop("user_total_spending")}, tmpdir_run)
    with pytest.raises(ValueError, match="user_total_spending"):
        read_features(spark, tmpdir_run)
