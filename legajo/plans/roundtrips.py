"""Queries through files, tables and streams: what is written to the shared folder and read again equals the driver's tables.

Each has DuckDB SQL over the tables themselves.  They register with the catalog.
"""

from __future__ import annotations

import io
import sqlite3
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.functions import keys
from legajo.operators import relational as rel
from legajo.operators import reports, sections
from legajo.plans.catalog import _SQL_LINES, _lines, _table, query
from legajo.session import fresh_folder
from legajo.sinks import files as out
from legajo.sinks import warehouse
from legajo.sources import archives, files, pdf
from legajo.streaming import ingest

_YEARS = range(1994, 2002)  # the tables have none of 1994


def _store(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, written by the driver."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    stream.write(bytearray(content))
    stream.close()


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").withColumn("y", F.date_format("o_orderdate", "yyyy"))


# --- CSV ---------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'a \"b\", ' || c_name || chr(10) || 'c' END AS note, c_acctbal FROM customer")
def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values quoted, with quotes, commas and line ends inside; an empty one is null again."""
    note = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('a "b", '), "c_name", F.lit("\nc")))
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", note.alias("note"), "c_acctbal")
    path = fresh_folder(spark, "csv")
    out.write_csv(rows, path, quote_all=True)
    back = files.read_csv(spark, path)
    return back.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    out.write_csv(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return files.read_csv_inferred(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y') AS y FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 2001")
def csv_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a year with declared types; the missing year is skipped."""
    path, orders = fresh_folder(spark, "csv"), _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "y")
    for y in _YEARS[1:]:
        out.write_csv(orders.where(F.col("y") == str(y)), f"{path}/o_{y}.csv")
    return files.read_csv_years(spark, f"{path}/o_{{year}}.csv", _YEARS, orders.schema)


@query("SELECT o_orderpriority AS titulo, strftime(o_orderdate, '%Y') || '.csv' AS nombre_archivo, count(*) AS n FROM orders GROUP BY ALL")
def csv_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each output name; one column of all files with the file's name."""
    path = fresh_folder(spark, "csv")
    out.write_csv_per_document(_orders(spark, sf_dir).select(F.col("y").alias("output_name"), F.col("o_orderpriority").alias("titulo"), "o_orderkey"), path)
    out.name_csv_files(spark, path)
    return files.read_column_with_file(spark, f"{path}/*.csv").groupBy("titulo", "nombre_archivo").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y') || '.csv' AS name, strftime(o_orderdate, '%Y') AS stem FROM orders")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    out.write_csv_per_document(_orders(spark, sf_dir).select(F.col("y").alias("output_name"), "o_orderkey"), path)
    out.name_csv_files(spark, path)
    return files.list_files(spark, path, ".csv").select("name", keys.file_stem("path").alias("stem"))


@query("SELECT DISTINCT o_orderpriority, strftime(o_orderdate, '%Y') AS y FROM orders WHERE o_orderstatus IN ('F', 'O')")
def csv_category_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end with a category's name, united without repeated rows; a category without files is skipped."""
    path, orders = fresh_folder(spark, "csv"), _orders(spark, sf_dir)
    for status in ("F", "O", "P"):
        for half, some in (("a", F.col("y") < "1998"), ("b", F.col("y") >= "1998")):
            out.write_csv(orders.where((F.col("o_orderstatus") == status) & some).select("o_orderpriority", "y"), f"{path}/{half}_{status}.csv")
    return rel.union_distinct([files.read_csv_suffix(spark, path, f"_{status}.csv") for status in ("F", "O", "none")])


# --- Parquet, JSON, text -----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem")
def parquet_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with small row groups, read as a list of paths, compacted, and checked for their columns."""
    path = fresh_folder(spark, "parquet")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    flags = [items.where(F.col("l_returnflag") == "R"), items.where(F.col("l_returnflag") != "R")]
    for i, part in enumerate(flags):
        out.write_parquet(part, f"{path}/{i}", block_rows=1000)
    whole = files.read_parquet(spark, [f"{path}/0", f"{path}/1"])
    out.write_parquet(whole, f"{path}/all", partition=["l_returnflag"])
    out.compact(spark, f"{path}/all", f"{path}/one", 1, remove=True)
    return files.read_parquet_checked(spark, f"{path}/one", items.columns)


@query("SELECT n_nationkey % 7 <> 0 AS is_valid, CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS name FROM nation")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON files; broken ones are marked."""
    path = fresh_folder(spark, "json")
    body = F.when(F.col("n_nationkey") % 7 != 0, F.to_json(F.struct(F.struct("n_name").alias("a")))).otherwise("{broken")
    _table(spark, sf_dir, "nation").select("n_nationkey", body.alias("value")).write.partitionBy("n_nationkey").text(path)
    return files.read_json_documents(spark, f"{path}/*/*.txt").select("is_valid", F.when(F.col("is_valid"), keys.json_field("json", "a.n_name")).alias("name"))


@query(f"WITH {_SQL_LINES} SELECT 'Página ' || page_number || ': ' || line_text AS value, count(*) AS n FROM lines GROUP BY ALL")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "text")
    out.write_lines(_lines(spark, sf_dir), path)
    return spark.read.text(path, lineSep="\n").groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS title, CAST(NULL AS VARCHAR) AS id, event_id % 10 <> 0 AS known FROM events")
def api_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an API's answers; broken answers give nulls."""
    events = _table(spark, sf_dir, "events")
    answer = F.concat(F.lit('{"tender":{"title":"'), keys.json_field("props", "k"), F.lit('","statusDetails":"x"}}'))
    broken = F.col("event_id") % 10 == 0
    made = events.select("event_id", keys.api_tender(F.when(broken, "{").otherwise(answer)).alias("t"))
    return made.select("event_id", "t.title", "t.id", F.coalesce(F.col("t.statusDetails") == "x", F.lit(False)).alias("known"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '.rar' WHEN 3 THEN '.zip' ELSE '.doc' END AS extension,
      CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE CAST(o_custkey + 1 AS INTEGER) END AS page FROM orders"""
)
def header_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File extensions from answer headers, and page numbers of outline entries."""
    kind = F.element_at(F.array(*map(F.lit, ("application/pdf", "text/json; x", "application/x-rar", "text/html", "application/pdf"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    name = F.when(F.col("o_orderkey") % 5 == 4, F.lit('attachment; filename="a.b.DOC"'))
    page = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", keys.extension(name, kind).alias("extension"), keys.page_number(page).alias("page"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(epoch(o_orderdate) AS BIGINT) + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 * 3600 + 61 ELSE -5400 END END AS seconds FROM orders"""
)
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text with several offsets; one that can't be read is null."""
    kind, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(kind == 0, F.concat(day, F.lit("T00:00:00Z"))).when(kind == 1, F.concat(day, F.lit("T00:01:01-04:00"))).when(kind == 2, F.concat(day, F.lit(" 00:00:00+01:30"))).otherwise("n/a")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(keys.timestamp(text)).alias("seconds"))


# --- PDF backends and archives -----------------------------------------------


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    """A small text for each nation, in place of a PDF: two pages, outline entries of two depths."""
    path = fresh_folder(spark, "scan")
    for r in _table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        text = f"# {r.n_name}\n## Key  {r.n_nationkey}\nbody\nKey {r.n_nationkey}\f## Region {r.n_regionkey}\n\nlast"
        _store(spark, f"{path}/2024_{r.n_regionkey}_{r.n_nationkey}.txt", text.encode())
    return path


@query(
    """WITH o AS (SELECT '2024_' || n_regionkey || '_' || n_nationkey AS document_id, CAST(n_nationkey AS VARCHAR) AS nro_licitacion, CAST(n_regionkey AS VARCHAR) AS category_id, * FROM nation)
    SELECT document_id, '2024' AS "year", category_id, nro_licitacion, 'Key ' || n_nationkey AS title, CAST(1 AS INTEGER) AS page, CAST(2 AS INTEGER) AS depth FROM o
    UNION ALL SELECT document_id, '2024', category_id, nro_licitacion, 'Region ' || n_regionkey, 2, 2 FROM o"""
)
def outline_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.scan_outline(spark, _nation_files(spark, sf_dir), "text", pattern="*.txt").drop("position")


@query(
    """WITH o AS (SELECT '2024_' || n_regionkey || '_' || n_nationkey || '.txt' AS archivo, * FROM nation)
    SELECT n_name AS titulo, CAST(1 AS INTEGER) AS pagina, CAST(1 AS INTEGER) AS linea, '1-1' AS pagina_linea, archivo FROM o
    UNION ALL SELECT 'Key ' || n_nationkey, 1, 2, '1-2', archivo FROM o UNION ALL SELECT 'Region ' || n_regionkey, 2, 1, '2-1', archivo FROM o"""
)
def outline_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.outline_positions(spark, _nation_files(spark, sf_dir), "text", pattern="*.txt")


@query(
    """WITH o AS (SELECT '2024_' || n_regionkey || '_' || n_nationkey AS document_id, * FROM nation)
    SELECT document_id, page_number, line_number, replace(replace(line_text, '$n', n_name), '$k', CAST(n_nationkey AS VARCHAR)) AS line_text, position FROM o, (VALUES (1, 1, '# $n', 1), (1, 2, '## Key  $k', 2), (1, 3, 'body', 3),
      (1, 4, 'Key $k', 4), (2, 3, 'last', 7)) v(page_number, line_number, line_text, position)
    UNION ALL SELECT document_id, 2, 1, '## Region ' || n_regionkey, 5 FROM o UNION ALL SELECT document_id, 2, 2, '', 6 FROM o"""
)
def scan_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines with their number on the page and through the document, blank ones counted."""
    raw = pdf.scan_raw_lines(spark, _nation_files(spark, sf_dir), "text", "*.txt").drop("error")
    return sections.with_position(raw).select("document_id", "page_number", (F.col("idx") + 1).alias("line_number"), "line_text", "position")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS body, n_nationkey % 5 = 0 AS failed FROM nation")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first member of each archive whose name ends as it should; an archive without one gives an error."""
    path = fresh_folder(spark, "zip")
    for r in _table(spark, sf_dir, "nation").collect():  # 25 rows at every scale
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            z.writestr("other.pdf", "no")
            if r.n_nationkey % 5:
                z.writestr(f"x/{archives.TERMS_SUFFIX}", r.n_name)
        _store(spark, f"{path}/{r.n_nationkey}.zip", made.getvalue())
    found = archives.extract_members(archives.read_archives(spark, path))
    return found.select(keys.file_stem("path").cast("int").alias("n_nationkey"), F.col("content").cast("string").alias("body"), F.col("error").isNotNull().alias("failed"))


# --- reports and pages -------------------------------------------------------


@query(f"WITH {_SQL_LINES} SELECT document_id, page_number, CAST(count(*) AS INTEGER) AS n, string_agg(line_text, chr(10) ORDER BY line_number) AS body FROM lines GROUP BY ALL")
def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reports.nested_lines(_lines(spark, sf_dir))
    return made.select("document_id", "page_number", F.size("lines").alias("n"), F.array_join("lines.line_text", "\n").alias("body"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while the rows are written."""
    df, seen = reports.counted(_table(spark, sf_dir, "orders"), "orders", filled=F.col("o_orderstatus") == "F")
    df.write.parquet(fresh_folder(spark, "parquet"))
    return spark.createDataFrame([(seen.get["total"], seen.get["filled"])], "total long, filled long")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 20 AND c_custkey < 70")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows is the feature: it has bounds."""
    return rel.page_of_rows(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 20, 70)


# --- warehouse ---------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS category_id, n_name AS descripcion FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def jdbc_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice to a database table that the first append makes; the database is one inside the driver."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = warehouse.categories_table(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("categoria_id"), F.col("n_name").alias("categoria")))
    for _ in range(2):
        warehouse.append_embedded(rows, url, "categorias", text_type="VARCHAR(1000)")
    return warehouse.read_embedded(spark, url, "categorias")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, CASE WHEN year(o_orderdate) BETWEEN 1996 AND 1999 THEN 'kept' ELSE 'left' END AS place FROM orders")
def appended_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One append for each year; the rows of other years come back."""
    path, rows = fresh_folder(spark, "parquet"), _orders(spark, sf_dir).select("o_orderkey", F.col("y").alias("year"))
    rest = warehouse.append_by_year(rows, lambda part, y: part.write.mode("append").parquet(path), [str(y) for y in range(1996, 2000)])
    kept = spark.read.schema(rows.schema).parquet(path).withColumn("place", F.lit("kept"))
    return kept.union(rest.withColumn("place", F.lit("left"))).withColumnRenamed("year", "y")


@query("SELECT o_orderkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS \"year\" FROM orders WHERE year(o_orderdate) = 1997")
def year_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by year; a reader of one year reads its folder alone."""
    path = fresh_folder(spark, "parquet")
    warehouse.write_years(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.col("y").alias("year")), path)
    return spark.read.parquet(path).where("year = 1997")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(s_acctbal < 0 AS BOOLEAN) AS poor, s_suppkey % 9 = 0 AS nameless FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 9 = 0")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a database rejects, found by appending: batches that fail are appended row by row."""
    path = fresh_folder(spark, "db")
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_name")).alias("s_name"), "s_acctbal")
    rows.sparkSession.createDataFrame([(1,)], "x int").write.parquet(path)  # makes the folder
    where = f"{_local(path)}/w.db"
    with sqlite3.connect(where) as db:
        db.execute("CREATE TABLE t (s_suppkey TEXT PRIMARY KEY, s_name TEXT NOT NULL, s_acctbal TEXT CHECK (CAST(s_acctbal AS REAL) >= 0))")
    bad = warehouse.append_isolated(rows.coalesce(1), lambda: sqlite3.connect(where), "t", f"{path}/letters", batch=50)
    return bad.select("s_suppkey", (F.col("s_acctbal").cast("double") < 0).alias("poor"), F.col("s_name").isNull().alias("nameless"))


# --- streams -----------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events")
def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two goes; a stream that is run after each appends what is new, and nothing when run again."""
    path, events = fresh_folder(spark, "stream"), _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in (events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0"), None):
        if part is not None:
            part.write.mode("append").parquet(f"{path}/in")
        ingest.run_to_parquet(ingest.file_stream(spark, f"{path}/in", events.schema, files_per_trigger=2), f"{path}/out", f"{path}/mark").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{path}/out")


@query("SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, CAST(max(epoch_us(ts)) AS BIGINT) AS last, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and day, from a stream that lets days go that have passed."""
    path = fresh_folder(spark, "stream")
    events = _table(spark, sf_dir, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"), "event_id")
    events.coalesce(1).write.parquet(f"{path}/in")
    stream = ingest.file_stream(spark, f"{path}/in", T.StructType(events.schema.fields)).withColumn("ts", F.timestamp_micros("us"))
    latest = ingest.latest_per_key_stream(stream, "user_id", "ts")

    def keep(part: DataFrame, n: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/out")

    latest.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/mark").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.select("user_id", F.unix_seconds("window_start").alias("day"), F.col("us").alias("last"), "event_id")
