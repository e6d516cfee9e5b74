"""Normalizers and keys on the awkward rows that decide whether titles match lines."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from legajo.functions import keys, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f("c")).first()[0]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.clean_canonical, "a  ----b,,,, c....d::::e   aaBBcc²² ___ Llamado Nº 2021-1100", "a --b, c..d::e aBc² _ Llamado Nº 2021-10"),
        (text.clean_canonical, None, None),
        (text.clean_canonical, "", ""),
        (text.clean_canonical, "a \x1c b", "a b"),
        (text.clean_canonical, "a....", "a.."),
        (text.clean_bulk, "aa  --", "a --"),
        (text.clean_outline, None, ""),
        (text.clean_outline, " x\n y ", "x y"),
        (text.clean_blanking, "a,b--c  d..e", "a b c d e"),
        (text.halve_marks, "a,,b//c°°;;", "a,b/c°;"),
        (text.drop_consecutive_duplicates, "\na\na\nb\n\n", "\na\nb\n"),
        (text.drop_consecutive_duplicates, "a\nb\na", "a\nb\na"),
        (text.drop_consecutive_duplicates, "", ""),
        (text.drop_consecutive_duplicates, None, None),
        (text.has_consecutive_duplicates, "a\na", True),
        (text.has_consecutive_duplicates, "a\nb\na", False),
        (text.strip_controls, "a\x00b\x0bc\r\nd\re\x7f\tf", "abc\nd\ne\tf"),
        (text.strip_controls, None, ""),
        (text.strip_all_controls, "a\x00b\n\t\x7f", "ab"),
        (text.deep_clean, "Dirección\x85 x\n y", "Direccio n x y"),
        (text.deep_clean, None, None),
    ],
)
def test_normalizers(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("value,want", list(zip(["ABC", "Abc", "Nº 1", "ÁÉ 12", "123", "", "ß", "ǅ", "日本", "A日", None], "TFFTFFFFFTF", strict=True)))
def test_is_uppercase(spark, value, want):
    assert one(spark, value, text.is_uppercase) == (want == "T")


def test_canonical_equals_python(spark):
    rng = random.Random(3)
    alphabet = "aab  ..,,::--__é²²\n\t ÑÑ11\x1f"
    values = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(200)]

    def python(x):
        x = re.sub(r"(\w)\1+", r"\1", x)
        for a, b in (("--", "-"), ("::", ":"), ("..", ".")):
            x = x.replace(a, b)
        return re.sub(r"\s+", " ", re.sub(",+", ",", x)).strip()

    rows = spark.createDataFrame([(v,) for v in values], "c string").select("c", text.clean_canonical("c").alias("k")).collect()
    assert [r.k for r in rows] == [python(r.c) for r in rows]


def test_deep_clean_equals_python(spark):
    def python(x):
        x = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", x)
        return re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7f]", " ", unicodedata.normalize("NFKD", x))).strip()

    values = ["Ñandú  ½ ﬁn", "日本", "a\u0085b", ""]
    rows = spark.createDataFrame([(v,) for v in values], "c string").select("c", text.deep_clean("c").alias("k")).collect()
    assert [r.k for r in rows] == [python(r.c) for r in rows]


def test_elements(spark):
    html = "<h3> A &amp; <b>b </b> c</h3><p>x</p><H3>Ñ</H3><h3></h3>"
    assert one(spark, html, text.element_texts) == ["A &bc", "Ñ", ""]
    assert one(spark, None, text.element_texts) is None


def test_elements_with_closed_references(spark):
    html = "<h3 title='a&b'>a&&amp</h3><h3>&amp;amp; &copy; &copy &ampx; &nope; &#65; &#x42; &#67 &; &amp;lt;</h3><h3>&amp;&am</h3>"
    assert one(spark, html, lambda c: text.element_texts(c, closed=True)) == ["a&&amp", "&amp; © &copy &ampx; &nope; A B &#67 &; &lt;", "&&am"]
    assert one(spark, html, text.element_texts) == ["a&&", "&amp; © © &x; &nope; A B C &; &lt;", "&&am"]
    assert one(spark, None, lambda c: text.element_texts(c, closed=True)) is None


@pytest.mark.parametrize("value,want", [("Datos", True), ("Ámbito - (x)", True), ("año", False), ("Año", False), ("Plan 1", False), ("A_b", False), ("About", False)])
def test_subtitle(spark, value, want):
    assert one(spark, value, lambda c: text.is_subtitle(c, ("About",))) == want


@pytest.mark.parametrize(
    "f,value,want",
    [
        (keys.nro_licitacion, "a-b-c-d", "c"),
        (keys.nro_licitacion, "a-b", None),
        (keys.nro_licitacion, None, None),
        (keys.version_pliego, "https://x/y/z", "z"),
        (keys.version_pliego, "https://x/", ""),
        (keys.categoria, "12 - a - b", "a - b"),
        (keys.categoria, "plain", "plain"),
        (keys.year, "2021-05-01", "2021"),
        (keys.file_key_number, "2024_-1_403005.pdf", "403005"),
        (keys.file_key_number, "x.pdf", None),
        (keys.file_stem, "file:/a/b/2024_1_2.pdf", "2024_1_2"),
        (keys.typed_category, "41.0", 41),
        (keys.typed_category, "x", -1),
        (keys.typed_category, None, -1),
        (keys.nulled, "NA", None),
        (keys.nulled, "NAB", "NAB"),
    ],
)
def test_keys(spark, f, value, want):
    assert one(spark, value, f) == want


def test_document_id(spark):
    got = [tuple(one(spark, v, keys.document_id_parts)) for v in ("2024_-1_403005", "2024_5_7_x", "x2024_1_2")]
    assert got == [("2024", "-1", "403005"), ("2024", "5", "7"), ("", "", "")]


def test_extension(spark):
    df = spark.createDataFrame([('attachment; filename="a.PDF"', None), (None, "application/pdf"), (None, None), (None, "application/x-rar")], "d string, t string")
    assert [r[0] for r in df.select(keys.extension("d", "t")).collect()] == [".pdf", ".pdf", ".zip", ".rar"]


def test_clauses(spark):
    good = '{"convocatoria_slug":"s","pliego_version":2,"plantilla":{"a":{"clausulas":{"x":{"titulo":"T","editable":null,"cuerpo":"old","cuerpo":"new"},"y":{"titulo":"U","opcional":true}}},"b":{},"a2":{"clausulas":{}}}}'
    rows = one(spark, good, keys.clauses)
    assert [(r.titulo, r.cuerpo, r.editable, r.no_aplica, r.opcional) for r in rows] == [("T", "new", None, "false", "false"), ("U", None, "false", "false", "true")]
    assert not one(spark, "{broken", keys.clauses)
    assert one(spark, '{"plantilla":{}}', keys.clauses) == []
    assert one(spark, good, keys.output_name) == "s_2"


def test_api_tender(spark):
    assert one(spark, '{"tender":{"id":"7","title":"t"}}', keys.api_tender).title == "t"
    broken = spark.createDataFrame([("{",)], "c string").select(keys.api_tender("c")["id"]).first()[0]
    assert broken is None


def test_page_line(spark):
    df = spark.createDataFrame([(3, 4), (3, None)], "p int, l int").select(keys.page_line("p", "l").alias("x"), keys.page_number(F.lit(None)).alias("n"))
    assert [tuple(r) for r in df.collect()] == [("3-4", 1), (None, 1)]
