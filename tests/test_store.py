"""The store of findings: what a refresh touches, what counts after it, and which plans it has."""

import pytest

from tests.conftest import duck, sparked
from wattscan.operators.incremental import config_fingerprint
from wattscan.operators.scan import scan
from wattscan.operators.store import ScanStore

STAR, SQL = "from a import *\n", "q = 'SELECT * FROM t'\n"


def table(spark, *files):
    return spark.createDataFrame([(p, t, m, len(t or "")) for p, t, m in files], "path string, text string, mtime_ns long, size long")


def rows(df):
    return sorted((r.file, r.rule, r.line) for r in df.collect())


def test_refreshes(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "s"), 4)
    assert store.findings().count() == 0
    first = [("a.py", STAR, 1), ("b.py", SQL, 1), ("c.yml", "cron: '* * * * *'\n", 1), ("d.py", "x = 1\n", 1)]
    assert sorted(map(tuple, store.refresh(table(spark, *first)).collect())) == [(p, "scan") for p, *_ in first]
    found = [("a.py", "GL028", 1), ("b.py", "GL005", 1), ("c.yml", "GL003", 1)]
    assert rows(store.findings()) == found and store.refresh(table(spark, *first)).count() == 0
    # Touched, edited, deleted, new; and a row without a path, and one that comes twice.
    second = [("a.py", STAR, 2), ("b.py", "\n" + SQL, 2), ("d.py", "x = 1\n", 1), ("e.py", STAR, 1), ("e.py", STAR, 1), (None, STAR, 1), ("f.py", None, 1)]
    assert sorted(map(tuple, store.refresh(table(spark, *second)).collect())) == [("a.py", "hash"), ("b.py", "scan"), ("c.yml", "gone"), ("e.py", "scan"), ("f.py", "scan")]
    found = [("a.py", "GL028", 1), ("b.py", "GL005", 2), ("e.py", "GL028", 1)]
    assert rows(store.findings()) == found
    # Opened again, compacted, opened again.
    store.close()
    store = ScanStore(spark, str(tmp_path / "s"), 4)
    assert rows(store.findings()) == found and store.refresh(table(spark, *second)).count() == 0
    store.compact()
    assert rows(store.findings()) == found and store.manifest().count() == 5
    assert sorted(x.name for x in (tmp_path / "s").iterdir()) == ["found-1", "manifest-1"]
    store.close()
    store = ScanStore(spark, str(tmp_path / "s"), 4)
    assert store.refresh(table(spark, *second)).count() == 0
    # Back under its old time and text, after a tombstone; and other options make every row stale.
    assert [tuple(r) for r in store.refresh(table(spark, *second, first[2])).collect()] == [("c.yml", "scan")]
    config = config_fingerprint(["GL028"])
    assert {r.how for r in store.refresh(table(spark, *second), config, disable=("GL028",)).collect()} == {"scan", "gone"}
    assert rows(store.findings()) == [("b.py", "GL005", 2)]
    assert store.refresh(table(spark, *second), config, disable=("GL028",)).count() == 0
    store.close()


def test_a_refresh_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = ScanStore(spark, str(tmp_path / "s"), 4)
    store.refresh(table(spark, ("a.py", STAR, 1)))
    plain = ScanStore._append

    def breaks(self, kind, new):
        if kind == "manifest":
            raise RuntimeError("lost")
        plain(self, kind, new)

    monkeypatch.setattr(ScanStore, "_append", breaks)
    with pytest.raises(RuntimeError):
        store.refresh(table(spark, ("a.py", SQL, 2), ("b.py", STAR, 1)))
    monkeypatch.undo()
    assert rows(store.findings()) == [("a.py", "GL028", 1)]
    store.refresh(table(spark, ("a.py", SQL, 2), ("b.py", STAR, 1)))
    assert rows(store.findings()) == [("a.py", "GL005", 1), ("b.py", "GL028", 1)]
    store.close()


def test_plans_move_no_stored_rows_and_scan_what_changed(spark, tmp_path, monkeypatch):
    files = [(f"f{i}.py", STAR * (i % 2), 1) for i in range(400)]
    store = ScanStore(spark, str(tmp_path / "s"), 4)
    store.refresh(table(spark, *files))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(store.findings()) and "SortMergeJoin" in plan(store.findings())
        listing = table(spark, *files).select("path", "mtime_ns", "size")
        # The listing is moved to its buckets; the manifest isn't.
        text = plan(store.decided(listing))
        manifest = text[text.rindex("Scan parquet") - 1500 :] if "Scan parquet" in text else text
        assert "SelectedBucketsCount: 4 out of 4" in text, text
        assert manifest.count("Exchange") <= text.count("Exchange") <= 2, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # A hundredth of the files changes: a hundredth is scanned.
    from wattscan.operators import store as module

    seen = []
    monkeypatch.setattr(module, "scan", lambda f, **o: seen.append(f.count()) or scan(f, **o))
    edited = [(p, t + SQL if i % 100 == 7 else t, 2 if i % 100 == 7 else m) for i, (p, t, m) in enumerate(files)]
    assert store.refresh(table(spark, *edited)).count() == 4 and seen == [4]
    assert rows(store.findings()) == rows(scan(table(spark, *edited)))
    store.close()


@pytest.mark.parametrize("name", ["store_findings", "store_changes"])
def test_queries_equal_sql(spark, name):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    assert sparked(__spark_entry__.queries()[name](spark, sf)) == duck(sf, __spark_entry__.oracle_sql()[name])
