from pyspark.sql import functions as F

from hauldeck.sources import exports, scans


def test_latin1_fallback(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("a,b\nJosé,1\n".encode("latin1"))
    (tmp_path / "u.csv").write_bytes("a,b\nJosé,1\n".encode())
    assert scans.trip_csv_scan(spark, str(tmp_path / "t.csv")).first()["a"] == "José"
    assert scans.trip_csv_scan(spark, str(tmp_path / "u.csv")).first()["a"] == "José"


def test_charset_is_decided_per_file_and_rows_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("a,b\nJosé,1\n".encode("latin1"))
    (tmp_path / "u.csv").write_bytes("a,b\nJosé,2\n3,4,5\n6\n".encode())
    rows = scans.trip_csv_scan(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect()), key=str) == [("3", "4"), ("6", None), ("José", "1"), ("José", "2")]
    assert rows.count() == rows.select("a").count() == rows.select("b").count() == 4
    kept = scans.trip_csv_scan(spark, str(tmp_path), skip_bad_lines=True)
    assert sorted(r["a"] for r in kept.select("a").collect()) == ["6", "José", "José"] and kept.count() == 3


def test_charset_is_decided_by_the_bytes(spark, tmp_path):
    """A real U+FFFD is no reason for Latin-1, and one bad byte far from the first accent is one."""
    (tmp_path / "u.csv").write_bytes("a,b\nJosé,\ufffd\n".encode())
    (tmp_path / "t.csv").write_bytes("a,b\nÃ©t,1\n".encode() + b"x,2\n" * 50 + b"Jos\xe9,3\n")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b\n\xc3\xbc,4\n")
    got = {r["b"]: r["a"] for r in scans.trip_csv_scan(spark, str(tmp_path)).collect()}
    assert got["\ufffd"] == "José" and got["3"] == "José" and got["1"] == "Ã©t".encode().decode("latin1") and got["4"] == "ü"
    assert {r["a"] for r in scans.multi_file_scan(spark, str(tmp_path)).collect()} == set(got.values())


def test_cells_and_lines_of_all_kinds(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n"x, y",2,"say ""hi"""\n\n1,,3\na,b,c\n4,5,6,7\n8\n')
    (tmp_path / "head_only.csv").write_text("a,b,c\n")
    (tmp_path / "empty.csv").write_text("")
    rows = sorted((tuple(r) for r in scans.multi_file_scan(spark, str(tmp_path)).collect()), key=str)
    # a line like the header, further down, is a row
    assert rows == sorted([("x, y", "2", 'say "hi"'), ("1", None, "3"), ("a", "b", "c"), ("4", "5", "6"), ("8", None, None)], key=str)
    assert scans.trip_csv_scan(spark, str(tmp_path), skip_bad_lines=True).count() == 4
    (tmp_path / "none").mkdir()
    assert scans.multi_file_scan(spark, str(tmp_path / "none")).count() == 0


def test_thousands_of_small_files(spark, tmp_path):
    """5,000 files of three wordings and two charsets are one scan, whatever their number."""
    for i in range(5000):
        text = ("name,n\nJosé {0},{0}\n", "n,name\n{0},José {0}\n", "n,extra,name\n{0},x,José {0}\n")[i % 3].format(i)
        (tmp_path / f"f{i}.csv").write_bytes(text.encode("latin1" if i % 5 == 0 else "utf8"))
    df = scans.multi_file_scan(spark, str(tmp_path))
    assert df.columns == ["n", "extra", "name"]
    assert df.filter(F.col("name") == F.concat(F.lit("José "), F.col("n"))).agg(F.count(F.lit(1)), F.sum(F.col("n").cast("int")), F.count("extra")).first()[0:3] == (5000, 5000 * 4999 // 2, 1666)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 1 and "Union" not in plan


def test_files_are_aligned_by_name(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("s_origin,n\nA,1\n")
    (tmp_path / "2.csv").write_text("n,s_org_node_name\n2,B\n")
    (tmp_path / "3.csv").write_text("n,s_org_node_name\n3,C\n4,D\n")
    rows = scans.multi_file_scan(spark, str(tmp_path)).collect()
    assert {r["n"]: (r["s_origin"], r["s_org_node_name"]) for r in rows} == {"1": ("A", None), "2": (None, "B"), "3": (None, "C"), "4": (None, "D")}


def test_column_variants(spark):
    df = spark.createDataFrame([("", "7", "A", "", "2024"), (None, None, "A", None, "x"), ("5", "8", "A", "keep", "y")],
                               "s_dispatch_entry_no string, i_trip_no string, s_org_node_name string, dt_ata_in string, dt_trip_ata string")
    rows = scans.column_variant_resolve(df).collect()
    assert [r["dispatch_entry_no"] for r in rows] == ["7", None, "5"]
    assert [r["origin"] for r in rows] == ["A"] * 3
    assert [r["ata_in"] for r in rows] == ["2024", None, "keep"]


def test_waypoint_headers_and_new_vehicles(spark, tmp_path):
    (tmp_path / "Waypoint_MH12.csv").write_text("Date Time,Dist,Status,LAT,Lng,Location\n05-01-2024 10:00:00,1.5,Moving 65,18.5,73.8, Pune \n,2,Stopped,1,2,x\n")
    (tmp_path / "Waypoint_KA01.csv").write_text("datetime,distance,status\n2024-01-06 11:00:00,3,Stopped\n")
    rows = {r["asset_id"]: r for r in scans.waypoint_scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"MH12", "KA01"} and rows["MH12"]["speed_kmph"] == 65.0 and rows["MH12"]["location_text"] == "Pune" and rows["MH12"]["longitude"] == 73.8
    assert rows["KA01"]["speed_kmph"] == 0.0 and rows["KA01"]["latitude"] is None
    known = spark.createDataFrame([("KA01",)], "asset_id string")
    assert [r[0] for r in scans.new_vehicles(scans.waypoint_scan(spark, str(tmp_path)), known).collect()] == ["MH12"]


def test_dead_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "a"), (2, None, "x", None)], "a int, b string, c string, d string")
    assert sorted(r[0] for r in scans.dead_columns(df).collect()) == ["b", "c", "d"]
    assert scans.drop_dead_columns(df).columns == ["a"]


def test_bulk_file_marks_nulls(spark, fleet, tmp_path):
    out = str(tmp_path / "bulk")
    exports.bulk_export(fleet.trips, out)
    lines = [r[0] for r in spark.read.text(out).collect()]
    cells = lines[0].split("\t")
    assert len(lines) == fleet.trips.count() and len(cells) == len(exports.BULK_COLUMNS) and cells[exports.BULK_COLUMNS.index("ata_out")] == "\\N"


def test_quoted_file(spark, tmp_path):
    exports.quoted_export(spark.createDataFrame([('say "hi"', 1)], "a string, b int"), str(tmp_path / "q"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "q")).collect()]
    assert '"a","b"' in text and spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "q")).first()["b"] == "1"


def test_table_counts_of_missing_table(spark):
    rows = {r[0]: r[1] for r in scans.table_counts(spark, {"a": spark.range(3), "gone": lambda: spark.read.parquet("/nowhere/x")}).collect()}
    assert rows == {"a": 3, "gone": -1}


def test_waypoint_files_are_spread_over_tasks(spark, monkeypatch):
    """Many small files cost as much as their number: no task writes more than its share of vehicles, however few bytes they have."""
    import collections
    import glob
    import os

    from hauldeck.plans import cat_loading
    from hauldeck.plans.store import Fleet

    monkeypatch.setattr(cat_loading, "FILES_PER_TASK", 3)
    fleet = Fleet(spark, "/root/testdata/sf0.001")
    files = glob.glob(f"{cat_loading.waypoint_export(fleet).removeprefix('file:')}/*/part-*")
    per_task = collections.Counter(os.path.basename(x).split("-")[1] for x in files)
    assert len(files) > 10 and max(per_task.values()) <= 12 and len(per_task) > 2
