import datetime as dt
from pathlib import Path

from tapegrid.operators import tables


def test_compacting_keeps_folders_and_rows(spark, tmp_path):
    rows = [(kind, f"S{k}", dt.datetime(year, 3, 1 + k), 1.0 + k, year) for kind in ("stock", "index") for year in (2023, 2024) for k in range(6)]
    bars = spark.createDataFrame(rows, "kind string, symbol string, ts timestamp_ntz, close double, year int")
    for name, keys in (("by_year", ("year",)), ("by_kind", ("kind", "year"))):
        path = str(tmp_path / name)
        tables.write_minute(bars, path, files_per_year=4, keys=keys)
        before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "year=2023" in str(p)}
        tables.compact(spark, path, 2024)
        found = spark.read.parquet(path)
        assert sorted(map(tuple, found.select(*bars.columns).collect())) == sorted(rows)
        for folder in {p.parent for p in Path(path).rglob("*.parquet") if "year=2024" in str(p)}:
            assert len(list(folder.glob("*.parquet"))) == 1
        assert {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "year=2023" in str(p)} == before
        tables.compact(spark, path, 1999)
        assert found.count() == len(rows)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["by_kind", "by_year"]
