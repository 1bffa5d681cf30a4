"""Synthetic telemetry, plan comparison and the store of records."""

from evq.compare import compare
from evq.engine import Engine
from evq.replay import Run
from evq.sources import store, synthetic
from tests.core import lab

LEAK = lab.PROGRAM


def test_synthetic_incidents_are_found(spark, tmp_path):
    synthetic.save(synthetic.catalog(spark, hosts=5, processes=400, incidents=4, seed=3), f"{tmp_path}/s")
    found = synthetic.load(spark, f"{tmp_path}/s")
    rows = Engine(found).run(LEAK).frame("leak").select("packers.pid").distinct().collect()
    assert {100_000, 100_001, 100_002, 100_003} <= {r[0] for r in rows}
    out = compare(spark, LEAK.replace("select pid, ppid, name, path, user", "select pid"), found)
    assert out["bytes_saved_percent"] > 80 and out["records_saved_percent"] > 80 and out["optimized"]["records"] < out["naive"]["records"]


def test_store(spark, tmp_path):
    folder = tmp_path / "lab"
    folder.mkdir()
    from evq.sources.manifest import Dataset

    found = Dataset(spark, str(lab.write(folder))).catalog()
    run = Run(spark, LEAK, found, bytes(32))
    for _ in range(2):  # again replaces
        store.put(run, f"{tmp_path}/store")
    other = Run(spark, LEAK, found, bytes(32))
    store.put(other, f"{tmp_path}/store")
    own = store.evidence(spark, f"{tmp_path}/store", run.body["run"], "Process").collect()
    assert len(own) == 5 and own == sorted(own, key=lambda r: r["time"])
    assert store.evidence(spark, f"{tmp_path}/store", host="depot", limit=3).count() == 3
    assert store.findings(spark, f"{tmp_path}/store", other.body["run"]).count() == 3 and store.findings(spark, f"{tmp_path}/store").count() == 6
