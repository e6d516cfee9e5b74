"""Declared schemas of the tables that the pipelines read and write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType()}


def _struct(text: str) -> T.StructType:
    fields = [f.split() for f in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


PDF_LINES = _struct("document_id string, page_number int, line_number int, line_text string, processed_date string")
OUTLINES = _struct("document_id string, year string, category_id string, nro_licitacion string, title string, page int, depth int")
OUTLINES_WITH_LINES = _struct("document_id string, year string, category_id string, nro_licitacion string, title string, page int, depth int, line_number int")
SECTIONS = _struct(
    "document_id string, nro_licitacion string, category_id string, year string, title string, content string, page int, line_start int, line_end int, depth int, content_length int"
)
OUTLINE_POSITIONS = _struct("titulo string, pagina int, linea int, pagina_linea string, archivo string")
CLAUSES = _struct("titulo string, pre_informacion string, cuerpo string, post_informacion string, ayuda string, editable string, no_aplica string, opcional string")
CATEGORIES = _struct("categoria_id int, categoria string")
TENDER_LOOKUP = _struct(
    "planificacion_slug string, convocatoria_slug string, adjudicacion_slug string, precalificacion_slug string, convenio_slug string, nro_licitacion string, "
    "nombre_licitacion string, tipo_procedimiento string, categoria string, convocante string, _etapa_licitacion string, etapa_licitacion string, "
    "fecha_entrega_oferta string, tipo_licitacion string, fecha_estimada string, fecha_publicacion_convocatoria string, geo string"
)
API_TENDER = _struct(
    "mainProcurementCategoryDetails string, mainProcurementCategory string, title string, procurementMethodDetails string, "
    "procurementMethod string, id string, statusDetails string, awardCriteriaDetails string"
)
#: Tables of the warehouse: every column is text.
WAREHOUSE = {
    "categorias": ("category_id", "descripcion"),
    "licitaciones": ("nro_licitacion", "category_id", "year"),
    "pliegos": ("document_id", "nro_licitacion", "title", "content", "page", "line_start", "line_end", "depth", "content_length", "year"),
}
WAREHOUSE_YEARS = ("2021", "2022", "2023", "2024")
