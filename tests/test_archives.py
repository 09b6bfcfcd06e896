"""Archives written and read by tasks."""

import numpy as np
import pytest

from eventloom.sources import archives


def test_layouts_ranges_and_pruned_runs(spark, tmp_path):
    rng = np.random.default_rng(1)
    t, unit = np.sort(rng.uniform(0, 100, 1000)), rng.integers(0, 9, 1000)
    t[7] = np.nan
    np.savez(tmp_path / "a_trace.npz", spiketimes=np.stack([t, unit.astype(float)]))
    np.savez_compressed(tmp_path / "b.npz", spike_times=t[:300], spike_ids=unit[:300])
    np.savez(tmp_path / "c.npz", spike_times=np.zeros(0), spike_ids=np.zeros(0, int))
    np.savez(tmp_path / "analysis_of_a.npz", x=1)
    df = archives.read_recordings(spark, str(tmp_path), 170)
    got = sorted((r["run_id"], r["t"], r["unit"]) for r in df.collect())
    want = [("a", float(x), int(u)) for x, u in zip(t, unit) if np.isfinite(x)] + [("b", float(x), int(u)) for x, u in zip(t[:300], unit[:300]) if np.isfinite(x)]
    assert got == sorted(want) and df.columns == ["run_id", "unit", "t"]
    assert df.rdd.getNumPartitions() == 8
    assert df.where("run_id = 'b'").rdd.getNumPartitions() == 2 and df.where("run_id = 'b'").count() == 300 - 1
    assert df.where("run_id = 'none'").count() == 0


def test_rates_and_wrong_folders(spark, tmp_path):
    x = np.arange(35.0).reshape(7, 5)
    np.savez(tmp_path / "r.npz", rates=x)
    got = {(r["bin"], r["cluster"]): r["x"] for r in archives.read_recordings(spark, f"file://{tmp_path}", 2).collect()}
    assert got == {(b, c): x[b, c] for b in range(7) for c in range(5)}
    np.savez(tmp_path / "s.npz", spike_times=np.ones(2), spike_ids=np.ones(2))
    with pytest.raises(Exception, match="holds events"):
        archives.read_recordings(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="no recording"):
        archives.read_recordings(spark, str(tmp_path / ".."  / "nothing.txt")).count()


def test_what_tasks_write_is_read_back(spark, tmp_path):
    rows = [(f"run{k % 3}", k % 11, k / 7) for k in range(2000)]
    df = spark.createDataFrame(rows, "run_id string, unit long, t double").repartition(5)
    archives.write_recordings(df, f"file://{tmp_path}/out", 100)
    assert len(list((tmp_path / "out").glob("*.npz"))) >= 15 and not list((tmp_path / "out").glob("*.part"))
    back = archives.read_recordings(spark, f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select("run_id", "unit", "t").collect())) == sorted(rows)
