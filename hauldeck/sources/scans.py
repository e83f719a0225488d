"""Reading exports: text columns only, names resolved once, typed later."""

import csv
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean_str, parse_datetime, safe_float
from ..functions.trips import status_speed
from ..operators.staging import stage

# Spark's reader drops each file's first line as a header and splits at this text, which no export holds: so it gives whole lines.
NO_SEPARATOR = "\u0001\u0002\u0003"


@dataclass
class Wording:
    """One distinct header: its number and the columns in file order."""

    number: int
    columns: list[str]


def file_headers(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(file, header, latin1) of every CSV file, stored.

    The first line that is not blank is the one with the lowest row id in the
    split that starts at byte 0. A file is Latin-1 if some line's bytes are no
    UTF-8, whatever characters it decodes to. One narrow row per file comes
    out of a map-side combined aggregation; the files are not listed on the driver.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    lines = (reader.option("pathGlobFilter", "*.csv") if recursive else reader).text(path)
    seen = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).withColumn("row", F.monotonically_increasing_id())
    first = F.min_by(F.when((F.col("start") == 0) & (F.trim("value") != ""), F.col("value")), F.when((F.col("start") == 0) & (F.trim("value") != ""), F.col("row")))
    found = seen.groupBy("file").agg(first.alias("header"), F.max(~F.is_valid_utf8("value")).alias("latin1")).filter("header IS NOT NULL")
    text = F.when(F.col("latin1"), F.decode(F.col("header").cast("binary"), "ISO-8859-1")).otherwise(F.ltrim("header", F.lit("\ufeff")))
    return stage(found.select("file", text.alias("header"), "latin1"), "headers")


def column_names(header: str) -> list[str]:
    """The header's names; blank ones are called by their place, repeated ones get it as a suffix."""
    names = [n.strip() or f"_c{i}" for i, n in enumerate(next(csv.reader([header])))]
    return [f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names)]


def exported_rows(spark: SparkSession, path: str, recursive: bool, charset: str = "auto", skip_bad_lines: bool = False) -> tuple[DataFrame, list[Wording]]:
    """Cells by place (c0, c1, …, all text), _file and _wording of every line, and the distinct headers.

    The files are read twice, once for headers and charsets and once for the
    rows, and each line is parsed once, whatever its header. Only the distinct
    headers come to the driver. Short lines end in nulls, cells beyond the
    header's are not given out; `skip_bad_lines` drops lines that have such cells.
    Quotes inside a quoted cell are doubled.
    """
    files = file_headers(spark, path, recursive)
    headers = [r["header"] for r in files.select("header").distinct().orderBy("header").collect()]
    wordings = [Wording(n, column_names(h)) for n, h in enumerate(headers)]
    if not wordings:
        return spark.createDataFrame([], "_file string, _wording int"), []
    numbers = F.create_map(*[F.lit(x) for n, h in enumerate(headers) for x in (h, n)])
    widths = F.array(*[F.lit(len(w.columns)) for w in wordings])
    known = files.select("file", "latin1", numbers[F.col("header")].alias("_wording"))
    reader = spark.read.schema("line string").option("header", True).option("enforceSchema", True).option("encoding", "ISO-8859-1").option("sep", NO_SEPARATOR).option("quote", "").option("recursiveFileLookup", recursive)
    lines = (reader.option("pathGlobFilter", "*.csv") if recursive else reader).csv(path).select("line", F.col("_metadata.file_path").alias("_file"))
    raw = F.encode("line", "ISO-8859-1")  # one byte per character, so nothing was lost
    if charset == "auto":
        text = F.when(F.col("latin1"), F.col("line")).otherwise(F.decode(raw, "UTF-8"))
    else:
        text = F.decode(raw, charset)
    rows = lines.join(known, lines["_file"] == known["file"]).select(text.alias("_line"), "_file", "_wording")
    if skip_bad_lines:
        bare = F.regexp_replace("_line", r'"[^"]*"', "")
        rows = rows.filter(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) < F.get(widths, F.col("_wording")))
    cells = ", ".join(f"c{k} string" for k in range(max(len(w.columns) for w in wordings)))
    return rows.select("_file", "_wording", F.from_csv("_line", cells, {"escape": '"'}).alias("_cells")).select("_file", "_wording", "_cells.*"), wordings


def aligned(rows: DataFrame, wordings: list[Wording], rename: Callable[[list[str]], dict[str, str]] | None, with_file: bool) -> DataFrame:
    """Cells under their names: a column holds, row by row, the cell that the row's header calls so; null where it has none."""
    places: dict[str, dict[int, list[int]]] = {}
    for w in wordings:
        names = rename(w.columns) if rename else {}
        for k, c in enumerate(w.columns):
            places.setdefault(names.get(c, c), {}).setdefault(k, []).append(w.number)
    cols = []
    for name, at in places.items():
        cell = F.coalesce(*[F.when(F.col("_wording").isin(numbers), F.col(f"c{k}")) if len(numbers) < len(wordings) else F.col(f"c{k}") for k, numbers in at.items()])
        cols.append(cell.alias(name))
    return rows.select(*cols, *(["_file"] if with_file else []))


def trip_csv_scan(spark: SparkSession, path: str, limit: int | None = None, skip_bad_lines: bool = False, encoding: str = "auto") -> DataFrame:
    """All-text CSV with a header.

    Short rows are padded with nulls; of over-long rows the cells beyond the
    header are not given out, or `skip_bad_lines` drops the rows; which rows
    come out does not depend on the columns that are read. 'auto' reads each
    file as UTF-8, or as Latin-1 if its bytes are no UTF-8. Files with other
    headers are aligned by name; a folder without files gives no rows.
    """
    out = aligned(*exported_rows(spark, path, False, encoding, skip_bad_lines), None, False)
    return out if limit is None else out.limit(limit)


def multi_file_scan(spark: SparkSession, path: str, rename: Callable[[list[str]], dict[str, str]] | None = None, with_file: bool = False) -> DataFrame:
    """All CSV files below a folder in one scan, columns aligned by name, each file in its own charset.

    rename maps the columns of one header to new names, for exports whose
    headers differ in wording. The number of files does not matter to the
    plan or the driver; the number of distinct headers does.
    """
    return aligned(*exported_rows(spark, path, True), rename, with_file)


# Header synonyms of the waypoint export.
WAYPOINT_HEADERS = {
    "distance": "distance", "dist": "distance",
    "status": "status",
    "latitude": "latitude", "lat": "latitude",
    "longitude": "longitude", "lon": "longitude", "lng": "longitude",
    "location": "location",
}


def waypoint_names(columns: list[str]) -> dict[str, str]:
    out = {}
    for c in columns:
        low = c.strip().lower()
        if "date" in low and "time" in low:
            out[c] = "datetime"
        elif low in WAYPOINT_HEADERS:
            out[c] = WAYPOINT_HEADERS[low]
    return out


def waypoint_scan(spark: SparkSession, path: str) -> DataFrame:
    """Waypoint files; the asset id comes from the file or folder name."""
    rows = multi_file_scan(spark, path, rename=waypoint_names, with_file=True)
    for missing in ("datetime", "distance", "status", "latitude", "longitude", "location"):
        if missing not in rows.columns:
            rows = rows.withColumn(missing, F.lit(None).cast("string"))
    status = clean_str(F.col("status"))
    return rows.select(
        F.regexp_extract("_file", r"Waypoint[_=]([^/.]+)", 1).alias("asset_id"),
        parse_datetime(F.col("datetime")).alias("recorded_at"),
        status.alias("status"),
        status_speed(status).alias("speed_kmph"),
        safe_float(F.col("distance")).alias("distance_from_prev"),
        safe_float(F.col("latitude")).alias("latitude"),
        safe_float(F.col("longitude")).alias("longitude"),
        clean_str(F.col("location")).alias("location_text"),
    ).filter(F.col("recorded_at").isNotNull())


def new_vehicles(waypoints: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Asset ids seen in waypoint files only."""
    return waypoints.select("asset_id").distinct().join(vehicles.select("asset_id"), "asset_id", "left_anti")


def pruned_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


# Target name -> export columns, preferred one first.
COLUMN_VARIANTS = {
    "driver_name": ["s_driver_name"],
    "driver_mobile": ["s_driver_mob1", "s_driver_mobile_no"],
    "driver_mobile2": ["s_driver_mob2"],
    "asset_id": ["s_asset_id"],
    "asset_type": ["s_asset_type"],
    "trailer_type": ["s_trailer_type"],
    "origin": ["s_origin", "s_org_node_name"],
    "destination": ["s_destination", "s_dest_node_name"],
    "final_destination": ["s_final_dest"],
    "cust_login_id": ["s_cnr_name", "s_cust_login_id"],
    "cne_name": ["s_cne_name"],
    "cne_id": ["i_cne_id"],
    "trip_start": ["dt_trip_start"],
    "trip_end_raw": ["dt_trip_end"],
    "trip_eta": ["dt_trip_eta"],
    "ata_in": ["dt_ata_in", "dt_trip_ata"],
    "ata_out": ["dt_ata_out"],
    "dt_created": ["dt_created"],
    "dt_updated": ["dt_updated", "dt_modified"],
    "trip_km": ["i_trip_km"],
    "total_dist": ["i_total_dist"],
    "cover_dist": ["i_cover_dist"],
    "trip_status": ["c_trip_status"],
    "is_active": ["c_is_active"],
    "trip_close_remark": ["s_close_reason", "s_trip_close_remark"],
    "material_desc": ["s_material_desc"],
    "invoice_no": ["s_invoice", "s_invoice_no"],
    "invoice_date": ["s_invoice_date"],
    "ref_no": ["s_ref_no"],
    "ref_date": ["s_ref_date"],
    "entry_type": ["s_entry_type", "s_event_code"],
    "own_market_type": ["s_own_market_type", "s_service_provider"],
    "running_sts": ["s_running_sts"],
    "trip_seq": ["i_trip_seq"],
    "delay_by": ["i_delay_by"],
    "device_id": ["s_device_id"],
    "device_type": ["s_device_type"],
    "entity_id": ["i_entity_id"],
    "cnr_id": ["i_cnr_id"],
    "created_by": ["s_created_by"],
    "updated_by": ["s_modified_by", "s_updated_by"],
    "track_link": ["s_track_link"],
    "data_string": ["s_data_string", "s_card_id"],
}


def column_variant_resolve(df: DataFrame) -> DataFrame:
    """Export column names to target names.

    The second name is taken when the first column is absent or its text is
    ''; a missing value in a present first column stays missing. Only the
    dispatch number falls back row by row.
    """
    have = set(df.columns)
    numbers = [clean_str(F.col(c)) for c in ("s_dispatch_entry_no", "i_trip_no") if c in have]
    cols = [F.coalesce(*numbers).alias("dispatch_entry_no")] if numbers else []
    for target, names in COLUMN_VARIANTS.items():
        present = [n for n in names if n in have]
        if not present:
            continue
        c = F.col(present[0])
        if len(present) > 1:
            c = F.when(c == "", F.col(present[1])).otherwise(c)
        cols.append(c.alias(target))
    return df.select(*cols)


# How each target column is typed.
TIME_COLUMNS = ["trip_start", "trip_end_raw", "trip_eta", "ata_in", "ata_out", "dt_created", "dt_updated"]
NUMBER_COLUMNS = ["trip_km", "total_dist", "cover_dist", "delay_by"]
INTEGER_COLUMNS = ["trip_seq", "entity_id", "cnr_id", "cne_id"]
MOBILE_COLUMNS = ["driver_mobile", "driver_mobile2"]


def typed_trips(df: DataFrame) -> DataFrame:
    """Resolved text columns to typed raw trip rows."""
    from ..functions.cleaning import clean_mobile, safe_int

    def typed(c):
        if c in TIME_COLUMNS:
            return parse_datetime(F.col(c))
        if c in NUMBER_COLUMNS:
            return safe_float(F.col(c))
        if c in INTEGER_COLUMNS:
            return safe_int(F.col(c))
        if c in MOBILE_COLUMNS:
            return clean_mobile(F.col(c))
        return clean_str(F.col(c))

    return df.select(*[typed(c).alias(c) for c in df.columns])


def dead_columns(df: DataFrame) -> DataFrame:
    """One row per column that is all NULL or holds one value.

    'One distinct value' is tested as min = max, so one pass without any
    distinct count decides all columns.
    """
    aggs = []
    for c in df.columns:
        q = F.col(f"`{c}`")
        aggs.append((F.count(q) == 0) | (F.min(q) == F.max(q)))
    flags = df.agg(*[a.alias(f"f{n}") for n, a in enumerate(aggs)])
    pairs = ", ".join(f"'{c}', f{n}" for n, c in enumerate(df.columns))
    return flags.selectExpr(f"stack({len(df.columns)}, {pairs}) as (column_name, dead)").filter("dead").select("column_name")


def drop_dead_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[r[0] for r in dead_columns(df).collect()])  # one short name per column


def column_profile(df: DataFrame) -> DataFrame:
    """Rows, type, NULLs, mean, deviation, extremes per column, in one pass."""
    aggs, parts = [], []
    for n, f in enumerate(df.schema.fields):
        q = F.col(f"`{f.name}`")
        numeric = f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")
        x = q.cast("double")
        nothing = F.lit(None).cast("double")
        aggs += [
            F.count(F.lit(1)).alias(f"r{n}"), F.sum(F.when(q.isNull(), 1).otherwise(0)).alias(f"u{n}"),
            (F.avg(x) if numeric else F.max(nothing)).alias(f"a{n}"),
            (F.stddev_samp(x) if numeric else F.max(nothing)).alias(f"s{n}"),
            (F.min(x) if numeric else F.max(nothing)).alias(f"l{n}"),
            (F.max(x) if numeric else F.max(nothing)).alias(f"h{n}"),
        ]
        parts.append(f"'{f.name}', '{f.dataType.simpleString()}', r{n}, u{n}, a{n}, s{n}, l{n}, h{n}")
    flat = df.agg(*aggs)
    return flat.selectExpr(
        f"stack({len(parts)}, {', '.join(parts)}) as (column_name, data_type, row_count, null_count, mean, std, min, max)"
    )


def table_counts(spark: SparkSession, tables: dict) -> DataFrame:
    """Rows per table; -1 where a table or path is missing. Any other error is raised. Values are DataFrames or callables giving one."""
    out = None
    for name, table in tables.items():
        try:
            n = (table() if callable(table) else table).agg(F.count(F.lit(1)).alias("row_count"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise
            n = spark.range(1).select(F.lit(-1).cast("bigint").alias("row_count"))
        row = n.select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def readiness_check(spark: SparkSession, trips: DataFrame, driver_summary: DataFrame, route_summary: DataFrame) -> DataFrame:
    """Counts and the flag that says whether training may start."""
    n = trips.agg(
        F.count(F.lit(1)).alias("trips"),
        F.sum(F.when(F.col("trip_duration_minutes") > 0, 1).otherwise(0)).alias("trips_with_duration"),
    )
    d = driver_summary.agg(F.count(F.lit(1)).alias("n"))
    r = route_summary.agg(F.count(F.lit(1)).alias("n"))
    out = n.withColumns({"driver_summary": d.scalar(), "route_summary": r.scalar()})
    ready = (F.col("trips_with_duration") >= 100) & (F.col("driver_summary") >= 10) & (F.col("route_summary") >= 10)
    return out.withColumn("ready", F.when(ready, 1).otherwise(0))
