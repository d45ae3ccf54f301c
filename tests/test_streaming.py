from datetime import datetime

from pyspark.sql import functions as F

from tabloom.operators import catalog
from tabloom.streaming import jobs, ledger as ledgers, silence, state as states


def test_catalog_stream_is_versioned_and_idempotent(spark, tmp_path):
    source, root, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    schema = "item_id string, price double, synced_at timestamp"
    for day, rows in ((1, [("a", 1.0), ("b", 2.0)]), (2, [("b", 3.0)])):
        df = spark.createDataFrame([(*r, datetime(2026, 1, day)) for r in rows], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.sync_stream(spark.readStream.schema(schema).parquet(source), root, mark).awaitTermination(120)
    assert states.state_versions(spark, root) == [0, 1]
    state = {r["item_id"]: r for r in states.latest_state(spark, root).collect()}
    assert not state["a"]["active"] and state["b"]["price"] == 3.0 and state["b"]["first_seen_at"] == datetime(2026, 1, 1)
    again = spark.createDataFrame([("b", 3.0, datetime(2026, 1, 2))], schema)
    states.sync_batch(again, 1, root)
    assert {r["item_id"]: r for r in states.latest_state(spark, root).collect()} == state


def test_windowed_stream_equals_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = jobs.windowed(events, "ts", "value", ["event_type"], "1 hour")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = jobs.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "value", ["event_type"], "1 hour", late="3650 days")
    stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("hourly")) == key(batch)


def test_stale(spark):
    df = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 3)), ("a", datetime(2026, 1, 2))], "s string, t timestamp")
    got = catalog.stale_sources(df, "s", "t", F.lit(datetime(2026, 1, 3, 3)), 26).collect()
    assert [r["source"] for r in got] == ["a"]


def test_waiting_snapshots_are_merged_in_order(spark, tmp_path):
    source, root, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    schema = "item_id string, price double, synced_at timestamp"
    for day, rows in ((2, [("a", 2.0)]), (1, [("a", 1.0), ("b", 5.0)])):
        spark.createDataFrame([(*r, datetime(2026, 1, day)) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
    jobs.sync_stream(spark.readStream.schema(schema).parquet(source), root, mark).awaitTermination(120)
    state = {r["item_id"]: r for r in states.latest_state(spark, root).collect()}
    assert state["a"]["price"] == 2.0 and state["a"]["first_seen_at"] == datetime(2026, 1, 1) and not state["b"]["active"]
    changes = spark.read.parquet(f"{root}/version=0/price_changes").collect()
    assert [(r["item_id"], r["old_price"], r["new_price"]) for r in changes] == [("a", 1.0, 2.0)]


def test_same_content_is_taken_in_once(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b")
    (tmp_path / "y.csv").write_text("a,b")
    ledger, seen = str(tmp_path / "ledger"), []
    work = lambda f: seen.append(f) or f"r{len(seen)}"
    take = lambda source, f: ledgers.take_in(spark, ledger, source, str(tmp_path / f), work)
    assert [take("s", "x.csv"), take("s", "y.csv"), take("t", "y.csv")] == [("r1", True), ("r1", False), ("r2", True)]
    assert ledgers.content_ledger(spark, ledger).count() == 2


def test_late_snapshots_change_nothing(spark, tmp_path):
    """A snapshot older than the state is kept aside: neither prices nor times go back."""
    from datetime import datetime

    root = str(tmp_path / "state")
    of = lambda day, price: spark.createDataFrame([("a", price, datetime(2026, 1, day))], "item_id string, price double, synced_at timestamp")
    states.sync_batch(of(2, 5.0), 0, root)
    states.sync_batch(of(1, 4.0), 1, root)
    states.sync_batch(of(3, 6.0).unionByName(of(2, 9.0)), 2, root)
    row = states.latest_state(spark, root).first()
    assert row["price"] == 6.0 and row["first_seen_at"] == datetime(2026, 1, 2) and row["last_seen_at"] == datetime(2026, 1, 3)
    assert states.state_versions(spark, root) == [0, 2]
    assert spark.read.parquet(f"{root}/version=1/late").first()["price"] == 4.0 and spark.read.parquet(f"{root}/version=2/late").first()["price"] == 9.0


def test_state_of_changes_equals_merges(spark, tmp_path):
    """Random snapshots, full and partial, columns that come and go: the state merged on reading is the state merged whole."""
    import random

    draw, root, whole = random.Random(5), str(tmp_path / "state"), None
    for day in range(1, 8):
        mode = "delta" if day in (3, 6) else "full"
        name = "colour" if day < 4 else "a.b"
        rows = [(f"k{i}", float(draw.randrange(3)), draw.choice(["x", "y", None]), datetime(2026, 1, day)) for i in range(40) if draw.random() < 0.7]
        items = spark.createDataFrame(rows, f"item_id string, price double, `{name}` string, synced_at timestamp")
        states.sync_batch(items, day, root, mode, buckets=4)
        whole = catalog.merge(whole, catalog.accept(items.drop("synced_at"), mode), F.lit(datetime(2026, 1, day)), mode)
        got = states.latest_state(spark, root)
        table = lambda df: sorted(map(repr, df.select(sorted(map("`{}`".format, got.columns))).collect()))  # noqa: E731, B023
        assert table(got) == table(whole.state)
        if day > 1 and not whole.price_changes.isEmpty():
            changes = spark.read.parquet(f"{root}/version={day}/price_changes")
            assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, whole.price_changes.select(changes.columns).collect()))
        whole = spark.createDataFrame(whole.state.collect(), whole.state.schema)
    before = table(states.latest_state(spark, root))
    assert states.forget(spark, root, 1) and states.state_versions(spark, root) == [7]
    assert table(states.latest_state(spark, root)) == before


def test_a_version_writes_what_changed(spark, tmp_path):
    root = str(tmp_path / "state")
    of = lambda rows, day: spark.createDataFrame([(*r, datetime(2026, 1, day)) for r in rows], "item_id string, price double, synced_at timestamp")
    all_ = [(f"k{i}", 1.0) for i in range(2000)]
    states.sync_batch(of(all_, 1), 0, root)
    states.sync_batch(of([(f"k{i}", 2.0) for i in range(10)], 2), 1, root, "delta")
    states.sync_batch(of([(k, 2.0 if i < 12 else 1.0) for i, (k, _) in enumerate(all_)], 3), 2, root)
    written = lambda v: spark.read.parquet(f"{root}/version={v}/step=0/rows").count()
    assert (written(0), written(1), written(2)) == (2000, 10, 2)
    state = states.latest_state(spark, root)
    assert state.count() == 2000 and state.select("last_seen_at").distinct().collect() == [(datetime(2026, 1, 3),)]
    files = sorted(p.name for p in (tmp_path / "state").rglob("*.parquet"))
    states.sync_batch(of(all_, 3), 2, root)  # replayed
    assert files == sorted(p.name for p in (tmp_path / "state").rglob("*.parquet"))


def test_an_unfinished_version_is_written_anew(spark, tmp_path):
    root = str(tmp_path / "state")
    of = lambda rows, day: spark.createDataFrame([(*r, datetime(2026, 1, day)) for r in rows], "item_id string, price double, synced_at timestamp")
    states.sync_batch(of([("a", 1.0)], 1), 0, root)
    states.sync_batch(of([("a", 5.0)], 2), 1, root)
    (tmp_path / "state" / "version=1" / "manifest.json").unlink()  # as if the writer had been lost before its last step
    assert states.latest_state(spark, root).first()["price"] == 1.0
    states.sync_batch(of([("a", 5.0)], 2), 1, root)
    assert states.latest_state(spark, root).first()["price"] == 5.0
    assert spark.read.parquet(f"{root}/version=1/price_changes").count() == 1


def test_two_writers_work_once(spark, tmp_path):
    import time
    from concurrent.futures import ThreadPoolExecutor

    (tmp_path / "x.csv").write_text("a,b")
    ran = []

    def work(f):
        ran.append(f)
        time.sleep(0.5)
        return f"r{len(ran)}"

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: ledgers.take_in(spark, str(tmp_path / "ledger"), "s", str(tmp_path / "x.csv"), work), range(4)))
    assert len(ran) == 1 and sorted(got) == [("r1", False)] * 3 + [("r1", True)]


def test_abandoned_claims_are_taken_over(spark, tmp_path):
    import pytest

    (tmp_path / "x.csv").write_text("a,b")
    take = lambda ledger, work, **k: ledgers.take_in(spark, str(tmp_path / ledger), "s", str(tmp_path / "x.csv"), work, **k)
    with pytest.raises(ZeroDivisionError):
        take("failed", lambda f: str(1 // 0))
    assert take("failed", lambda f: "ok") == ("ok", True) and take("failed", lambda f: "no") == ("ok", False)
    # a writer that was lost leaves a claim without a result: the inner call finds the outer one's claim, older than its lease
    assert take("lost", lambda f: take("lost", lambda g: "inner", lease=0)[0] + "?") == ("inner", True)
    assert ledgers.content_ledger(spark, str(tmp_path / "lost")).count() == 1


def test_silences_of_a_stream_are_those_of_its_table(spark, tmp_path):
    """One alert for a silence, one for the recovery, then again; in one batch or in several."""
    at = lambda h: datetime(2026, 1, 1 + h // 24, h % 24)
    parts = [[("a", 0), ("b", 0), ("a", 5), (None, 1)], [("b", 20), ("b", 40)], [("a", 60), ("b", 60)], [("b", 80), ("b", 100)], [("b", 101), ("c", 101)]]
    schema, inbox = "s string, t timestamp", str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame([(s, at(h)) for s, h in rows], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = silence.silence_stream(spark.readStream.schema(schema).parquet(inbox), "s", "t", 26, "10 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(180)
    one = silence.silence_stream(spark.readStream.schema(schema).parquet(inbox), "s", "t", 26, "10 minutes")
    one.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "mark2")).trigger(availableNow=True).start().awaitTermination(180)
    batch = silence.silences(spark.read.schema(schema).parquet(inbox), "s", "t", F.lit(at(101)))
    key = lambda df: sorted(map(tuple, df.select("source", "kind", "since", "at").collect()))
    want = [("a", "recovered", at(5), at(60)), ("a", "silent", at(5), at(31)), ("a", "silent", at(60), at(86))]
    assert key(batch) == want
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want
    assert key(spark.table("told")) == want
