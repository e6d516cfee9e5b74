"""Relational operators, sections against a plain model, sources, sinks and streams."""

import http.server
import io
import json
import random
import threading
import zipfile

import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from legajo import schemas
from legajo.operators import relational as rel
from legajo.operators import reports, sections
from legajo.plans import pipelines
from legajo.sinks import files as out
from legajo.sinks import warehouse
from legajo.sources import archives, files, http as web, pdf
from legajo.streaming import ingest


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- relational --------------------------------------------------------------


def test_column_rule():
    assert rel.column_rule("compiledRelease/tender/documents/0/documentTypeDetails") == "tender_documents_document_type_details"
    assert rel.column_rule("Open Contracting ID") == "open_contracting_id"
    assert rel.column_rule("compiledRelease/awards/0/suppliers/0/id") == "awards_suppliers_id"
    assert rel.column_rule("tender/value - amountGs_") == "tender_value_amount_gs" and rel.column_rule("x/0") == "x_0"


def test_nullsafe_join_fans_out(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 7), (None, 8), (None, 9), ("a", 5)], "k string, v int")
    got = rel.left_join_nullsafe(left, right, "k")
    assert got.columns == ["k", "v_x", "v_y"]
    assert rows(got) == [("a", 2, 5), ("b", 3, None), (None, 1, 7), (None, 1, 8), (None, 1, 9)]
    assert "SortMergeJoin" in got._jdf.queryExecution().toString() or "HashJoin" in got._jdf.queryExecution().toString()


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "2020", 2), ("a", "2020", 3), (None, "1", 4), (None, "2", 5)], "k string, d string, i int")
    assert rows(rel.latest_per_key(df, ["k"], "d", ["i"])) == [("a", "2020", 2), (None, "2", 5)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x"), (0, "y"), (None, None), (1, "z")], "a int, b string")
    assert df.count() == 4 and rel.where_method(df, "a", "positive").count() == 2 and rel.where_method(df, "b", "non_null").count() == 3
    assert rows(rel.where_method(df, "a", "unique", ["b"])) == [(0, "y"), (1, "x"), (None, None)]
    with pytest.raises(ValueError):
        rel.where_method(df, "a", "unique")
    assert rel.where_literal(df, "a", "1").count() == 2
    assert rows(rel.where_given(df, limit=1, order=["b"], a=1, b=None)) == [(1, "x")]
    with pytest.raises(ValueError):
        rel.where_method(df, "a", "nonsense")
    with pytest.raises(ValueError):
        rel.where_given(df, must=True, a=9)
    with pytest.raises(ValueError):
        rel.required(df, ["a", "c"])
    yes, no = rel.split_by(df, F.col("a") > 0)
    assert (yes.count(), no.count()) == (2, 2)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert rows(rel.first_of_each_name(df)) == [(1, 2)]
    assert rel.with_missing(rel.first_of_each_name(df), ["b", "z"]).columns == ["a", "b", "z"]
    assert rows(rel.replace_content(spark.createDataFrame([("o", "n")], "content string, cleaned_content string"))) == [("n",)]


def test_unions_and_keys(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([(1,), (2,)], "i int")
    assert rows(rel.union_all([a, None, b])) == [(1, "x"), (1, None), (2, None)]
    assert rel.union_distinct([a, a]).count() == 1
    assert rows(rel.missing_keys(b.union(spark.createDataFrame([(None,)], "i int")), a, "i")) == [(2,)]
    assert rows(rel.present_keys(b, a, "i")) == [(1,)]
    assert rows(rel.page_of_rows(b, "i", 0, 2)) == [(1,)]


# --- sections ----------------------------------------------------------------


def model(outlines, lines):
    """(ord -> texts) by walking a document's titles in order."""
    result = {}
    for doc in {o[1] for o in outlines if o[1] is not None}:
        own = sorted((o for o in outlines if o[1] == doc), key=lambda o: (o[2], o[3] is None, o[3] or 0, o[0]))
        for k, (ord_, _, page, line) in enumerate(own):
            end, stop = (own[k + 1][2], own[k + 1][3]) if k + 1 < len(own) else (page + 1, None)
            text = []
            for d, p, n, t in sorted(lines):
                if d == doc and page <= p <= end:
                    early = p == page and line is not None and n < line
                    late = p == end and stop is not None and n >= stop
                    if not early and not late:
                        text.append(t)
            result[ord_] = (text, stop)
    return result


@pytest.mark.parametrize("by_page", [False, True])
def test_sections_equal_model(spark, by_page):
    rng = random.Random(5)
    outlines, lines = [], []
    for d in range(12):
        doc = None if d == 11 else f"d{d}"
        for _ in range(rng.randint(1, 8)):
            outlines.append((len(outlines), doc, rng.randint(1, 4), rng.choice([None, 1, 2, 3, 4])))
        if d % 5:
            lines += [(f"d{d}", p, n, f"{d}.{p}.{n}") for p in range(1, 6) for n in range(1, 6) if rng.random() < 0.8 and p != 3]
    o = spark.createDataFrame(outlines, "ord int, document_id string, page int, line_number int")
    ls = spark.createDataFrame(lines, "document_id string, page_number int, line_number int, line_text string")
    got = {r.ord: (r.content, r.content_length, r.line_end) for r in sections.assemble_sections(o, ls, by_page).collect()}
    assert got == {k: ("\n".join(t), len(t), stop) for k, (t, stop) in model(outlines, lines).items()}


def test_line_pairs(spark):
    a, b = "REQUISITOS DE PARTICIPACIÓN Y CRITERIOS DE", "EVALUACIÓN"
    pages = {1: ["x", a, b, "", "y"], 2: [a, a, b, "z"], 3: [a], 4: [b, a, " ", b]}
    raw = spark.createDataFrame([("d", p, i, t) for p, ls in pages.items() for i, t in enumerate(ls)], "document_id string, page_number int, idx int, line_text string")
    assert rows(sections.number_lines(raw)) == sorted(
        [("d", 1, 1, "x"), ("d", 1, 2, f"{a} {b}"), ("d", 1, 4, "y"), ("d", 2, 1, a), ("d", 2, 2, f"{a} {b}"), ("d", 2, 3, "z"), ("d", 3, 1, a), ("d", 4, 1, b), ("d", 4, 2, a), ("d", 4, 4, b)], key=repr
    )


def test_title_match(spark):
    outlines = spark.createDataFrame([("d", 1, "T  x"), ("d", 2, "T x"), ("d", 1, None), ("d", 1, "a....")], "document_id string, page int, title string")
    lines = spark.createDataFrame([("d", 1, 1, "T x"), ("d", 1, 4, "T x"), ("d", 1, 5, "a..")], "document_id string, page_number int, line_number int, line_text string")
    got = sections.match_titles(outlines, lines)
    assert rows(got.select("page", "title", "line_number")) == [(1, "T  x", 1), (1, "T  x", 4), (1, "a....", None), (1, None, None), (2, "T x", None)]
    assert reports.match_rate(got).first().match_rate == 40.0


def test_positions(spark):
    raw = spark.createDataFrame([("d", 2, 0, "c"), ("d", 1, 1, ""), ("d", 1, 0, "a"), ("d", 2, 1, "c"), ("e", 5, 3, "z"), (None, 1, 0, "n")], "document_id string, page_number int, idx int, line_text string")
    got = sections.with_position(raw)
    assert rows(got.select("document_id", "line_text", "position")) == rows(spark.createDataFrame([("d", "a", 1), ("d", "", 2), ("d", "c", 3), ("d", "c", 4), ("e", "z", 1), (None, "n", 1)], "d string, t string, p int"))
    titles = spark.createDataFrame([(1, "d", "c"), (2, "d", "none")], "k int, document_id string, title string")
    found = sections.first_equal_line(titles, got.withColumn("line_number", F.col("idx") + 1), ["k"])
    assert rows(found.select("k", "matched_page", "matched_line")) == [(1, 2, 3), (2, None, None)]


def test_tenders_take_the_latest_moment(spark):
    """Text order would take the wrong rows: offsets differ, one date has no time, one is no date."""
    made = [("a", "2024-03-01T23:00:00-04:00", "u1"), ("a", "2024-03-02T01:00:00+00:00", "u2"), ("b", "2024-03-01", "u3"), ("b", "2024-03-01T00:00:00+05:00", "u4"), ("b", "x", "u5"), ("c", None, "u6")]
    docs = spark.createDataFrame([(*r, "k", "2024-01-01") for r in made], "tender_id string, tender_documents_date_published string, tender_documents_url string, kind string, date string")
    records = spark.createDataFrame([("a", "ocds-x-77-1", "1 - obras")], "tender_id string, open_contracting_id string, tender_main_procurement_category_details string")
    categories = spark.createDataFrame([("obras", 5)], "categoria string, categoria_id int")
    got = pipelines.tender_metadata(docs, records, categories, {"kind": "k"})
    assert rows(got.select("tender_id", "version_pliego", "nro_licitacion", "categoria_id")) == [("a", "u1", "77", 5), ("b", "u3", None, None), ("c", "u6", None, None)]


def test_counted(spark, tmp_path):
    df, seen = reports.counted(spark.range(10), "batch", even=F.col("id") % 2 == 0)
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"total": 10, "even": 5}


def test_clean_sections(spark):
    df = spark.createDataFrame([("d", "a\na,,\na,", 3), ("e", "", 0), (None, "x", 1), ("f", None, 0)], "document_id string, content string, content_length int")
    assert rows(sections.clean_sections(df.where("document_id = 'f'").withColumn("content_length", F.lit(1)))[0].select("has_duplicates")) == [(False,)]
    cleaned, report = sections.clean_sections(df)
    assert rows(cleaned.select("document_id", "has_duplicates", "cleaned_content")) == [("d", True, "a\na,")]
    assert report.count() == 1 and "cleaned_content" not in report.columns
    assert rows(reports.nested_lines(spark.createDataFrame([("d", 1, 2, "b"), ("d", 1, 1, "a")], "document_id string, page_number int, line_number int, line_text string")).select(F.size("lines"))) == [(2,)]


# --- sources and sinks -------------------------------------------------------


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q', "l\nm"), ("", "NA", None)], "x string, y string, z string")
    for quote_all in (False, True):
        path = str(tmp_path / f"csv{quote_all}")
        out.write_csv(df, path, quote_all)
        assert rows(files.read_csv(spark, path)) == sorted([("a,b", 'q"q', "l\nm"), (None, None, None)], key=repr)
    got = files.read_column_with_file(spark, str(tmp_path / "csvTrue"), "x", "f")
    assert got.columns == ["x", "f"] and got.count() == 2


def test_typed_and_yearly_csv(spark, tmp_path):
    (tmp_path / "o_2021.csv").write_text("document_id,year,category_id,nro_licitacion,title,page,depth\n2021_1_2,2021,1,2,T,3,2\n")
    got = files.read_csv_years(spark, str(tmp_path / "o_{year}.csv"), [2021, 2022], schemas.OUTLINES)
    assert rows(got) == [("2021_1_2", "2021", "1", "2", "T", 3, 2)]
    assert files.read_csv_years(spark, str(tmp_path / "x_{year}.csv"), [2021], schemas.OUTLINES).count() == 0
    (tmp_path / "o_2022.csv").write_text("")
    assert files.read_csv_years(spark, str(tmp_path / "o_{year}.csv"), [2021, 2022], schemas.OUTLINES).count() == 1
    good, bad = files.readable(spark, [str(tmp_path / f"o_{y}.csv") for y in (2021, 2022, 2023)])
    assert len(good) == 1 and len(bad) == 2
    (tmp_path / "a_obras.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b_obras.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b_bienes.csv").write_text("x,y\n5,6\n")
    assert rows(rel.union_distinct([files.read_csv_suffix(spark, str(tmp_path), f"_{c}.csv") for c in ("obras", "none", "bienes")])) == [("1", "2"), ("3", "4"), ("5", "6")]
    assert dict(files.read_csv_inferred(spark, str(tmp_path / "o_2021.csv")).dtypes)["page"] == "int"


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([("a", "2021"), ("b", "2022")], "t string, year string")
    out.write_parquet(df, str(tmp_path / "p"), ["year"], 1 << 20)
    assert rows(spark.read.parquet(str(tmp_path / "p")).where("year = 2021").select("t")) == [("a",)]
    assert files.read_parquet_checked(spark, str(tmp_path / "p"), ["year", "t"]).count() == 2
    with pytest.raises(ValueError):
        files.read_parquet_checked(spark, str(tmp_path / "p"), ["t"])
    assert out.compact(spark, str(tmp_path / "p"), str(tmp_path / "q"), 1).count() == 2 and (tmp_path / "p").exists()
    assert out.compact(spark, str(tmp_path / "q"), str(tmp_path / "none"), 1).count() == 2 and not (tmp_path / "none").exists()
    assert out.compact(spark, str(tmp_path / "p"), str(tmp_path / "r"), 1, remove=True).count() == 2 and not (tmp_path / "p").exists()
    out.write_parquet(spark.range(2500).coalesce(1), str(tmp_path / "g"), block_rows=1000)
    meta = pq.ParquetFile(next((tmp_path / "g").glob("*.parquet"))).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]
    out.write_csv_per_document(spark.createDataFrame([("s 1_2", "a"), ("s 1_2", "b"), ("t_1", "c")], "output_name string, titulo string"), str(tmp_path / "docs"))
    assert out.name_csv_files(spark, str(tmp_path / "docs")) == ["s 1_2.csv", "t_1.csv"]
    assert sorted((tmp_path / "docs" / "s 1_2.csv").read_text().split("\n")) == ["", '"a"', '"b"', '"titulo"']
    out.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        out.compact(spark, str(tmp_path / "p"), str(tmp_path / "p"), 1)


def test_json_and_html(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    clause = {"convocatoria_slug": "s", "pliego_version": 1, "plantilla": {"a": {"clausulas": {"c": {"titulo": "T"}}}}}
    (folder / "a.json").write_text(json.dumps(clause))
    (folder / "b.json").write_text("{broken")
    docs = files.read_json_documents(spark, str(folder))
    assert rows(docs.select("is_valid")) == [(False,), (True,)]
    table = pipelines.clause_table(docs.drop("is_valid"))
    assert rows(table.select("output_name", "titulo", "editable")) == [("s_1", "T", "false")]
    out.write_csv_per_document(table.drop("path"), str(tmp_path / "clauses"))
    assert (tmp_path / "clauses" / "output_name=s_1").is_dir()
    (tmp_path / "h.html").write_text("<h3> Uno </h3><h3>Dos</h3>")
    assert [r.text for r in files.read_html(spark, str(tmp_path / "h.html")).collect()] == ["Uno", "Dos"]


def test_pdf_scan(spark, tmp_path):
    (tmp_path / "2024_1_77.pdf").write_text("# Top\n## Sub  title\nSub  title\nbody\f## Next\nNext\nmore")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe")
    raw = pdf.scan_raw_lines(spark, str(tmp_path), "text")
    assert rows(raw.where("error is not null").select("document_id")) == [("bad",)]
    lines = pdf.scan_lines(spark, str(tmp_path), "text")
    assert lines.columns == schemas.PDF_LINES.names and lines.where("page_number = 2").count() == 3
    outline = pdf.scan_outline(spark, str(tmp_path), "text")
    assert rows(outline.select("document_id", "year", "nro_licitacion", "title", "page")) == [("2024_1_77", "2024", "77", "Next", 2), ("2024_1_77", "2024", "77", "Sub title", 1)]
    made = pipelines.sections(outline.drop("position").withColumn("ord", F.struct("document_id", "page", "title")), lines)[0]
    assert {r.title: r.content for r in made.collect()}["Next"] == "Next\nmore"
    at = pdf.outline_positions(spark, str(tmp_path), "text")
    assert at.columns == schemas.OUTLINE_POSITIONS.names
    assert rows(at) == [("Next", 2, 1, "2-1", "2024_1_77.pdf"), ("Sub title", 1, 2, "1-2", "2024_1_77.pdf"), ("Top", 1, 1, "1-1", "2024_1_77.pdf")]
    found = files.list_files(spark, str(tmp_path), ".pdf")
    assert rows(found.select("name")) == [("2024_1_77.pdf",), ("bad.pdf",)]
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0
    out.write_lines(lines.where("page_number = 2"), str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["Página 2: # Next".replace("# ", "## "), "Página 2: Next", "Página 2: more"]


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/readme.txt", "r")
        z.writestr("x/77-01-pliego-de-bases-y-condiciones-pbc.pdf", "PDF")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no zip")
    (tmp_path / "c.rar").write_bytes(b"Rar!x")
    got = {r.path.rsplit("/", 1)[1]: r for r in archives.extract_members(archives.read_archives(spark, str(tmp_path))).collect()}
    assert bytes(got["a.zip"].content) == b"PDF" and "BadZipFile" in got["b.zip"].error and got["c.rar"].error == "unsupported: rar"
    exact = archives.extract_members(archives.read_archives(spark, str(tmp_path)).where("path like '%a.zip'"), "x/readme.txt", exact=True)
    named = archives.named(exact, F.lit("2024-01-01"), F.lit(-1), F.lit("77"))
    assert named.first().file_name == "2024_-1_77.pdf"


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if "/csv/7" in self.path:
                body, kind = b'a;b\n"1";"x;y"\n', "text/csv"
            elif "/api/7" in self.path:
                body, kind = b'{"tender": {"id": "7", "title": "T"}}', "application/json"
            elif self.path == "/f":
                body, kind = b"data", "application/pdf"
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server, tmp_path):
    urls = spark.createDataFrame([(f"{server}/f",), (f"{server}/gone",), (None,)], "url string")
    got = {r.url.rsplit("/", 1)[1]: r for r in web.with_extension(web.fetch(urls, tries=2, wait=0.01)).collect()}
    assert len(got) == 2 and bytes(got["f"].content) == b"data" and got["f"].extension == ".pdf" and "404" in got["gone"].error
    ids = spark.createDataFrame([("7", 1), ("8", 2), (None, 3)], "id string, v int")
    looked = web.lookup_csv(ids, "id", server + "/csv/{key}", ["a", "b"], sep=";", tries=1)
    assert rows(looked.select("v", "a", "b")) == [(1, "1", "x;y"), (2, None, None), (3, None, None)]
    api = web.lookup_api(ids, "id", server + "/api/{key}", token="t", tries=1)
    assert rows(api.select("v", "tender.title")) == [(1, "T"), (2, None), (3, None)]
    web.download(f"{server}/f", str(tmp_path / "f"))
    assert (tmp_path / "f").read_bytes() == b"data"
    assert rows(web.read_url_csv(spark, f"{server}/csv/7", ";")) == [("1", "x;y")]


def test_warehouse(spark, tmp_path):
    df = spark.createDataFrame([("d\x00", "1", "new", "old", "2021"), ("e", "2", None, "o", "2030"), ("f", "3", "n", "o", None)], "document_id string, nro_licitacion string, cleaned_content string, content string, year string")
    table = warehouse.sections_table(df)
    assert rows(table.select("document_id", "content")) == [("d", "new"), ("e", ""), ("f", "n")]
    written = {}
    rest = warehouse.append_by_year(table, lambda part, y: written.__setitem__(y, part.count()))
    assert written == {"2021": 1, "2022": 0, "2023": 0, "2024": 0} and rest.count() == 2
    warehouse.write_years(table, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).where("year = 2021").count() == 1
    ddl = warehouse.warehouse_ddl("s")
    assert ddl[0] == 'CREATE SCHEMA IF NOT EXISTS "s"' and len(ddl) == 8 and "PARTITION BY LIST" in ddl[3]
    assert 'REFERENCES "s"."categorias" ("category_id")' in ddl[2] and 'REFERENCES "s"."licitaciones" ("nro_licitacion")' in ddl[3]
    good, bad = warehouse.split_bad(table, {"year": F.col("year").rlike("^20")})
    assert (good.count(), bad.first().failed_checks) == (2, "year")
    tenders = warehouse.tenders_table(df.withColumn("i", F.lit(1)), ["i"])
    assert tenders.columns == ["nro_licitacion", "category_id", "year"] and tenders.first().category_id is None


def test_jdbc(spark):
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = "jdbc:derby:memory:legajo;create=true"
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "category_id string, descripcion string")
    for _ in range(2):
        warehouse.append_jdbc(df, url, "categorias", text_type="VARCHAR(1000)", **driver)
    assert spark.read.format("jdbc").options(url=url, dbtable="categorias", **driver).load().count() == 4


def test_embedded_database(spark):
    url = "jdbc:derby:memory:embedded;create=true"
    df = spark.range(25).selectExpr("cast(id as string) category_id", "case when id <> 7 then 'a \"' || id || '\n' end `year`")
    for _ in range(2):
        warehouse.append_embedded(df, url, "t", batch=10, text_type="VARCHAR(1000)")
    got = warehouse.read_embedded(spark, url, "t", batch=8)
    assert got.columns == df.columns and rows(got) == rows(df.union(df))
    with pytest.raises(Py4JJavaError):  # the third row is too long: none stays
        warehouse.append_embedded(df.selectExpr("category_id", "repeat('x', case when category_id = '2' then 2000 else 1 end) year"), url, "t", batch=1)
    assert warehouse.read_embedded(spark, url, "t").count() == 50
    warehouse.append_embedded(df.limit(0), url, "empty", text_type="VARCHAR(1000)")
    assert warehouse.read_embedded(spark, url, "empty").collect() == []


def test_rejected_rows_are_isolated(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "w.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (k TEXT PRIMARY KEY, v TEXT NOT NULL CHECK (length(v) < 4))")
    df = spark.createDataFrame([(str(i), None if i == 5 else "long" if i == 17 else "ok") for i in range(30)] + [("3", "ok")], "k string, v string").coalesce(1)
    bad = warehouse.append_isolated(df, lambda: sqlite3.connect(path), "t", str(tmp_path / "letters"), batch=10)
    assert bad.columns == ["k", "v", "error"] and rows(bad.select("k", "v")) == [("17", "long"), ("3", "ok"), ("5", None)]
    assert "NOT NULL" in bad.where("k = 5").first().error
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*) FROM t").fetchone() == (28,)


# --- streams -----------------------------------------------------------------


def test_stream_restarts(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    first.coalesce(1).write.parquet(source)

    def run():
        stream = ingest.file_stream(spark, source, first.schema)
        ingest.run_to_parquet(stream, target, mark).awaitTermination()
        return spark.read.parquet(target).count()

    assert run() == 2
    first.coalesce(1).write.mode("append").parquet(source)
    assert run() == 4
    assert run() == 4


def test_stream_batches_and_latest(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:05:00", 2)], "k string, t string, v int").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(source)
    seen = []
    ingest.run_batches(ingest.file_stream(spark, source, df.schema), lambda part, n: seen.append(part.count()), str(tmp_path / "m1")).awaitTermination()
    assert seen == [2]
    latest = ingest.latest_per_key_stream(ingest.file_stream(spark, source, df.schema), "k", "t")
    q = latest.writeStream.outputMode("complete").format("memory").queryName("latest_rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "m2")).start()
    q.awaitTermination()
    assert [(str(r.window_start), r.k, r.v) for r in spark.sql("select * from latest_rows").collect()] == [("2024-01-01 00:00:00", "a", 2)]
