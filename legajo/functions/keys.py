"""Keys, ids and JSON fields as Column functions.  Out of range yields null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_ID = r"^(\d{4})_(-?\d+)_(\d+)"
CLAUSE_TEXTS = ("titulo", "pre_informacion", "cuerpo", "post_informacion", "ayuda")
CLAUSE_FLAGS = ("editable", "no_aplica", "opcional")
#: Tokens that CSV readers of the data-frame kind take for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nro_licitacion(ocid: Column | str) -> Column:
    """Third field of an open-contracting id."""
    return F.get(F.split(_col(ocid), "-", -1), 2)


def version_pliego(url: Column | str) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(_col(url), "/", -1), -1)


def timestamp(c: Column | str) -> Column:
    """A date or time as text, with or without an offset, as the moment it names; null where it names none."""
    return _col(c).try_cast("timestamp")


def categoria(details: Column | str) -> Column:
    """What follows the first ` - `, or all."""
    c = _col(details)
    return F.when(F.instr(c, " - ") > 0, F.get(F.split(c, " - ", 2), 1)).otherwise(c)


def year(date: Column | str) -> Column:
    """First four characters of a date string."""
    return F.substring(_col(date), 1, 4)


def document_id_parts(c: Column | str) -> Column:
    """struct<year, category_id, nro_licitacion> of a file stem; empty strings where it has another form."""
    names = ("year", "category_id", "nro_licitacion")
    return F.struct(*[F.regexp_extract(_col(c), DOCUMENT_ID, i + 1).alias(n) for i, n in enumerate(names)])


def typed_category(c: Column | str) -> Column:
    """Category id as int, -1 where unknown."""
    return F.coalesce(_col(c).try_cast("double").try_cast("int"), F.lit(-1))


def file_key(date: Column | str, category: Column | str, nro: Column | str) -> Column:
    """year_category_number; null if a part is null."""
    return F.concat(year(date), F.lit("_"), _col(category).cast("string"), F.lit("_"), _col(nro).cast("string"))


def file_key_number(name: Column | str, suffix: str = ".pdf") -> Column:
    """Third `_` field of a file name, without the suffix."""
    return F.replace(F.get(F.split(_col(name), "_", -1), 2), F.lit(suffix), F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/", -1), -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def page_line(page: Column | str, line: Column | str) -> Column:
    return F.when(_col(line).isNotNull(), F.concat(_col(page).cast("string"), F.lit("-"), _col(line).cast("string")))


def page_number(raw: Column | str, offset: int = 1) -> Column:
    """Zero-based page of an outline entry as a page number; 1 where unknown."""
    return F.coalesce(_col(raw).cast("int") + offset, F.lit(1))


def extension(disposition: Column | str, content_type: Column | str) -> Column:
    """File extension from response headers: that of the attachment's name, else by type, else .zip."""
    name = F.regexp_extract(F.coalesce(_col(disposition), F.lit("")), r'filename="?([^";]+)"?', 1)
    own = F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)
    kind = F.lower(F.coalesce(_col(content_type), F.lit("")))
    by_type = F.when(kind.contains("pdf"), ".pdf").when(kind.contains("json"), ".json").when(kind.contains("rar"), ".rar").otherwise(".zip")
    return F.when(own != "", F.lower(own)).otherwise(by_type)


def nulled(c: Column | str, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Null tokens of CSV files become null."""
    return F.when(~_col(c).isin(*tokens), _col(c))


def clauses(json: Column | str) -> Column:
    """array<struct<...>> of the clauses of a document; null if the text is no JSON.

    A flag that is missing is 'false', an explicit null stays null; of a
    repeated key the first place and the last value count.
    """
    kind = "struct<plantilla:map<string,struct<clausulas:map<string,map<string,string>>>>>"
    sections = F.from_json(_col(json), kind)["plantilla"]

    def unique(m: Column) -> Column:
        entries = F.map_entries(m)
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])

    inner = F.filter(unique(sections), lambda s: s["clausulas"].isNotNull())
    flat = F.flatten(F.transform(inner, lambda s: unique(s["clausulas"])))

    def last(m: Column, key: str) -> Column:
        return F.element_at(F.filter(F.map_entries(m), lambda e: e["key"] == key), -1)["value"]

    def clause(m: Column) -> Column:
        texts = [F.when(F.map_contains_key(m, k), last(m, k)).alias(k) for k in CLAUSE_TEXTS]
        flags = [F.when(F.map_contains_key(m, k), last(m, k)).otherwise("false").alias(k) for k in CLAUSE_FLAGS]
        return F.struct(*texts, *flags)

    return F.transform(flat, clause)


def json_field(json: Column | str, path: str) -> Column:
    return F.get_json_object(_col(json), f"$.{path}")


def output_name(json: Column | str) -> Column:
    """Name of a document's own output: slug_version."""
    return F.concat(json_field(json, "convocatoria_slug"), F.lit("_"), json_field(json, "pliego_version"))


def api_tender(json: Column | str) -> Column:
    """struct of the eight tender fields of an API answer; null fields where the answer is broken."""
    from legajo.schemas import API_TENDER

    return F.from_json(_col(json), f"struct<tender:{API_TENDER.simpleString()}>")["tender"]
