"""Lookups around documents: profiles, help texts, vocabularies, name indexes, reference order, metadata of a PDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.docs.marks import tex_escape

def profile_listing(profiles: DataFrame, links: DataFrame, shortcodes: DataFrame) -> DataFrame:
    """Active shortcodes of active profiles: profile, place, shortcode. ``links``: id_perfil, id_shortcode, orden_en_perfil."""
    own = profiles.filter("activo = 1").select("id_perfil", F.col("nombre").alias("profile"))
    codes = shortcodes.filter("activo = 1").select("id_shortcode", F.col("nombre").alias("shortcode"))
    return links.join(own, "id_perfil").join(codes, "id_shortcode").select("profile", F.col("orden_en_perfil").alias("place"), "shortcode").orderBy("profile", "place", "shortcode")


def localized(texts: DataFrame, language: str, default: str = "es") -> DataFrame:
    """For each component its text in ``language``, else in the default language, else none: componente, idioma, ayuda."""
    wanted = texts.filter(F.col("idioma").isin(language, default))
    best = F.min_by(F.struct("idioma", "ayuda"), F.when(F.col("idioma") == language, 0).otherwise(1))
    return wanted.groupBy("componente").agg(best.alias("b")).select("componente", "b.idioma", "b.ayuda")


def vocabulary(entries: DataFrame, kind: str) -> DataFrame:
    return entries.filter((F.col("tipo") == kind) & (F.col("activo") == 1)).select("codigo", "nombre")


def name_index(references: DataFrame, columns: list[str], place: str) -> DataFrame:
    """Each non-blank name in any of the columns, with its number of mentions and of different places. One pass over the table."""
    every = references.select(F.explode(F.array(*columns)).alias("name"), F.col(place).alias("place")).filter("name IS NOT NULL AND name <> ''")
    return every.groupBy("name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("place").alias("places"))


def numbered_references(references: DataFrame, document: str, keys: list[str], numbers: tuple[str, ...] = ("volume",)) -> DataFrame:
    """``references`` with ``number``, the place in its document's list ordered by ``keys`` (nulls first). Keys in ``numbers`` go by the number at
    their beginning, padded, so 9 comes before 10, and by the text where that is equal; texts without one come first.
    """
    leading = {k: F.regexp_extract(k, r"^\s*0*(\d+)", 1) for k in numbers}
    by = [c for k in keys for c in ((F.length(leading[k]).asc_nulls_first(), leading[k].asc_nulls_first(), F.col(k).asc_nulls_first()) if k in leading else (F.col(k).asc_nulls_first(),))]
    order = Window.partitionBy(document).orderBy(*by)
    return references.withColumn("number", F.row_number().over(order).cast("long"))


#: Keys of the document information, and those that are there only with a value.
INFORMATION = (("title", "pdftitle"), ("authors", "pdfauthor"), ("subject", "pdfsubject"), ("keywords", "pdfkeywords"))
IDENTIFIERS = (("doi", "DOI"), ("isbn", "ISBN"), ("isbn13", "ISBN13"))


def pdf_metadata(rows: DataFrame, key: str, language: str = "es") -> DataFrame:
    """``key`` and ``setup``, the lines that set a PDF's information, from title, authors, subject, keywords, language, doi, isbn and isbn13.

    Null texts are empty and a null language is ``language``; an empty one stays empty. A null identifier has no line, an empty one has
    one. All but the language are escaped for TeX.
    """
    lines = [F.lit("\\hypersetup{")]
    lines += [F.concat(F.lit(f"  {name}={{"), tex_escape(F.col(c)), F.lit("},")) for c, name in INFORMATION]
    lines += [F.concat(F.lit("  pdflang={"), F.coalesce(F.col("language"), F.lit(language)), F.lit("},")), F.lit("  pdfinfo={")]
    lines += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"    {name}={{"), tex_escape(F.col(c)), F.lit("},"))) for c, name in IDENTIFIERS]
    return rows.select(key, F.array_join(F.filter(F.array(*lines, F.lit("  },"), F.lit("}")), lambda x: x.isNotNull()), "\n").alias("setup"))
