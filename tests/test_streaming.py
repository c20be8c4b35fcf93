"""Fuses over streams: grants run out, repeats burn nothing, expiry holds."""

import pytest

from stratalog.streaming import fuses


@pytest.fixture
def attempts(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, 100 * k + i, t0 + dt.timedelta(hours=i)) for k in (1, 2) for i in range(5)] + [(1, 100, t0)]
    spark.createDataFrame(rows, "key long, attempt_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("key long, attempt_id long, ts timestamp").parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path, name, mode="append"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_fuses(spark, attempts, tmp_path):
    got = run(spark, fuses.consume(attempts, fuses=3), tmp_path, "fuses_out")
    by_id = {}
    for r in got:
        by_id.setdefault(r.attempt_id, []).append((r.decision, r.remaining))
    assert by_id[100] == [("granted", 2)] * 2 and by_id[102] == [("granted", 0)] and by_id[104] == [("exhausted", 0)]
    assert sum(r.decision == "granted" for r in got) == 3 + 3 + 1


def test_expiry(spark, attempts, tmp_path):
    got = run(spark, fuses.consume(attempts, fuses=9, valid_until=1), tmp_path, "expiry_out")
    assert {r.attempt_id % 100: r.decision for r in got} == {0: "granted", 1: "granted", 2: "expired", 3: "expired", 4: "expired"}


def test_epochs(spark, attempts, tmp_path):
    got = run(spark, fuses.epoch_counts(attempts, late="0 seconds"), tmp_path, "epochs_out")
    assert {r["count"] for r in got} <= {1, 2} and len(got) >= 6
