"""Queries on references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.spec import Grouping, Listing, Tables

YEAR = "coalesce(substring(date, 1, 4), year)"
LANGUAGE = "hyphenation IS NOT NULL OR language IS NOT NULL"
#: The leading number of a year, 0 without one.
NUMBER = f"CAST(coalesce(nullif(regexp_extract(CAST({YEAR} AS STRING), '^ *([0-9]+)', 1), ''), '0') AS BIGINT)"


def _references(t: Tables) -> DataFrame:
    """Articles with the number of their references, which are counted before the join."""
    return t("articulos").join(t("bibtex").groupBy("id_articulo").agg(F.count(F.lit(1)).alias("citadas")), "id_articulo", "left")


def _dated(t: Tables) -> DataFrame:
    """Articles of a year with what their dated references come to, which is made before the join."""
    own = t("bibtex").filter(F.col("year").cast("string").rlike("^[0-9]{4}$") | F.col("date").cast("string").rlike("^[0-9]{4}"))
    own = own.select("id_articulo", F.expr(YEAR).alias("anio"), F.expr(NUMBER).alias("numero"))
    own = own.groupBy("id_articulo").agg(F.count(F.lit(1)).alias("citadas"), F.sum("numero").alias("suma"), F.min("anio").alias("primera"), F.max("anio").alias("ultima"))
    return t("articulos").filter("ano_publicacion IS NOT NULL").join(own, "id_articulo")


AGE = "CAST(ano_publicacion * citadas - suma AS DOUBLE) / citadas"

QUERIES = (
    Grouping("BIB-001", "References by entry type", "bibtex", {"tipo": "tipo_de_entrada"}, {"referencias": "count(*)"}, order="referencias DESC; tipo", share="porcentaje"),
    Grouping("BIB-002", "References by year and type", "bibtex", {"ano": YEAR, "tipo": "tipo_de_entrada"}, {"referencias": "count(*)"}, order="referencias DESC; ano; tipo"),
    Grouping("BIB-003", "References by language", "bibtex", {"idioma": "coalesce(hyphenation, language)"}, {"referencias": "count(*)"}, where=f"({LANGUAGE})", order="referencias DESC; idioma", share="porcentaje", share_of=f"({LANGUAGE})"),
    Grouping("BIB-004", "Top 10 cited journals", "bibtex", {"revista": "journal_title"}, {"citas": "count(*)", "articulos": "count(DISTINCT id_articulo)"}, where="journal_title IS NOT NULL", order="citas DESC; revista", limit=10),
    Grouping("BIB-005", "Top 10 cited publishers", "bibtex", {"editorial": "publisher"}, {"citas": "count(*)", "ubicaciones": "joined(location, '; ')"}, where="publisher IS NOT NULL", order="citas DESC; editorial", limit=10, late=("ubicaciones",)),
    Grouping("BIB-006", "Top 20 cited authors", "bibtex", {"autor": "author"}, {"citas": "count(*)", "articulos": "count(DISTINCT id_articulo)", "anos": f"joined_down({YEAR}, ', ')"}, where="author IS NOT NULL", order="citas DESC; autor", limit=20, late=("articulos", "anos")),
    Listing("BIB-CAL-001", "References without DOI since 2010", "bibtex", {"id_articulo": "id_articulo", "tipo": "tipo_de_entrada", "autor": "author", "titulo": "title", "ano": YEAR, "publicado_en": "coalesce(journal_title, book_title, event_title)"}, where=f"blank(doi) AND tipo_de_entrada IN ('article', 'inproceedings', 'incollection', 'inbook') AND {YEAR} >= '2010'", order=f"{NUMBER} DESC; id"),
    Listing("BIB-CAL-002", "References without year", "bibtex", {"id": "id", "id_articulo": "id_articulo", "tipo": "tipo_de_entrada", "autor": "author", "titulo": "title", "editorial": "publisher"}, where="coalesce(substring(date, 1, 4), year, '') = ''", order="id_articulo; id"),
    Listing("BIB-CAL-003", "References without author and editor", "bibtex", {"id": "id", "id_articulo": "id_articulo", "tipo": "tipo_de_entrada", "titulo": "title", "ano": YEAR}, where="blank(author) AND blank(editor)", order="id_articulo; id"),
    Listing("BIB-ART-001", "References by article", "", {"id_articulo": "id_articulo", "titulo": "titulo_articulo", "referencias": "coalesce(citadas, 0)", "tipo": "tipo_articulo", "estado": "estado_articulo"}, order="coalesce(citadas, 0) DESC; id_articulo", views=("articulos", "bibtex"), plan=_references),
    Listing("BIB-ART-002", "Age of references by article", "", {"id_articulo": "id_articulo", "titulo": "titulo_articulo", "referencias": "citadas", "antiguedad": f"round({AGE}, 1)", "mas_antigua": "primera", "mas_reciente": "ultima"}, order=f"{AGE} DESC; id_articulo", views=("articulos", "bibtex"), plan=_dated),
    Grouping("BIB-GEO-001", "Top 20 places of publication", "bibtex", {"ubicacion": "location"}, {"referencias": "count(*)", "editoriales": "joined(publisher, '; ')"}, where="location IS NOT NULL", order="referencias DESC; ubicacion", limit=20, late=("editoriales",)),
)
