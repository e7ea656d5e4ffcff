"""Queries across authors, articles and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.spec import Built, Grouping, Listing, Tables, for_spark, unpivoted

PUBLISHED = "estado_articulo = 'publicado'"


def _published(t: Tables, *columns: str) -> DataFrame:
    return t("articulos").filter(PUBLISHED).select("id_articulo", *columns)


def _coauthors(t: Tables, as_of: str, collation: str | None = None, least: int = 3) -> DataFrame:
    """Authors with fewer than ``least`` published articles are in no pair that stays, so they go first. Pairs of the others are counted
    without their articles; these, titles and names are joined to the pairs that stay. An article of k such authors gives
    k * (k - 1) / 2 pairs.
    """
    links = t("articulo_autor").join(_published(t), "id_articulo", "left_semi").select("id_articulo", "id_autor")
    often = links.groupBy("id_autor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("id_autor")
    signed = links.join(often, "id_autor", "left_semi").repartition("id_articulo").distinct()  # dealt out once for both steps
    one, two = (signed.withColumnRenamed("id_autor", f"autor_{i}") for i in (1, 2))
    pairs = one.join(two, "id_articulo").filter("autor_1 < autor_2").groupBy("autor_1", "autor_2").agg(F.count(F.lit(1)).alias("articulos")).filter(F.col("articulos") >= least)
    kept = pairs.join(one, "autor_1").join(two, ["autor_2", "id_articulo"])
    titled = kept.join(t("articulos").select("id_articulo", "titulo_articulo"), "id_articulo").groupBy("autor_1", "autor_2", "articulos")
    out = titled.agg(F.expr(for_spark("joined(titulo_articulo, '; ')", as_of, collation)).alias("titulos"))
    names = t("autores").select("id_autor", "apellidos_nombre")
    for i in (1, 2):
        out = out.join(names.select(F.col("id_autor").alias(f"autor_{i}"), F.col("apellidos_nombre").alias(f"nombre_{i}")), f"autor_{i}")
    return out.select("autor_1", "autor_2", "nombre_1", "nombre_2", "articulos", "titulos").orderBy(F.desc("articulos"), "autor_1", "autor_2")


def _by_journal(t: Tables) -> DataFrame:
    rows = t("articulo_autor").join(_published(t, "id_revista", "fecha_publicacion_online"), "id_articulo")
    return rows.join(t("autores").select("id_autor", "apellidos_nombre", "afiliacion_actual"), "id_autor").join(t("revistas_md").select("id_revista", "titulo_revista"), "id_revista")


def _countries(t: Tables) -> DataFrame:
    located = t("autores").filter("pais_afiliacion IS NOT NULL").select("id_autor", "pais_afiliacion")
    return _published(t, "titulo_articulo", "fecha_publicacion_online").join(t("articulo_autor"), "id_articulo").join(located, "id_autor")


def _dashboard(t: Tables, as_of: str, collation: str | None = None) -> DataFrame:
    """One pass over each table, their counts side by side, then one row for each."""
    n = lambda name, condition: F.count(F.when(condition, 1)).alias(name)
    active, state, blank = F.col("estado_autor") == "activo", F.col("estado_articulo"), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    authors = t("autores").agg(n("activos", active), n("disponibles", active & (F.col("disponible_revision") == 1)))
    this_year = F.year("fecha_publicacion_online") == F.year(F.lit(as_of).cast("date"))
    articles = t("articulos").agg(n("en_revision", state == "en_revision"), n("publicados", (state == "publicado") & this_year), n("sin_doi", state.isin("aceptado", "publicado") & blank("doi")))
    journals = t("revistas_md").agg(n("revistas", F.col("estado_publicacion") == "activa"))
    unknown = t("articulo_autor").join(t("autores").filter(blank("orcid")).select("id_autor"), "id_autor", "left_semi").select("id_articulo")
    done = t("articulos").filter(state.isin("aceptado", "publicado")).select("id_articulo")
    without = done.join(unknown, "id_articulo", "left_semi").agg(F.count(F.lit(1)).alias("sin_orcid"))
    one = authors.crossJoin(articles).crossJoin(journals).crossJoin(without)  # one row each
    rows = [("'Autores Activos'", "activos"), ("'Revisores Disponibles'", "disponibles"), ("'Artículos en Revisión'", "en_revision"), ("'Artículos Publicados (Año Actual)'", "publicados"), ("'Revistas Activas'", "revistas"), ("'Artículos sin ORCID (CRÍTICO)'", "sin_orcid"), ("'Artículos sin DOI (CRÍTICO)'", "sin_doi")]
    return unpivoted(one, ["metrica", "valor"], rows)


def _unpublished(t: Tables) -> DataFrame:
    """A row for each link of an author to an article that is not published, and one for each author without links."""
    links = t("articulo_autor").join(_published(t).withColumn("publicado", F.lit(1)), "id_articulo", "left").select("id_autor", "publicado")
    return t("autores").join(links, "id_autor", "left").filter("publicado IS NULL")


def _never_published(t: Tables) -> DataFrame:
    return t("autores").join(t("articulo_autor").join(_published(t), "id_articulo", "left_semi"), "id_autor", "left_anti")


PERSON = {"autor": "apellidos_nombre", "email": "email_principal", "institucion": "afiliacion_actual", "estado": "estado_autor", "creado": "fecha_creacion_registro", "dias": "days(AS_OF, fecha_creacion_registro)"}

QUERIES = (
    Built("CROSS-001", "Co-authors of three articles or more", ("articulo_autor", "articulos", "autores"), _coauthors),
    Grouping("CROSS-002", "Authors with two articles or more in a journal", "articulo_autor JOIN autores USING (id_autor) JOIN articulos USING (id_articulo) JOIN revistas_md USING (id_revista)", {"id_revista": "id_revista", "id_autor": "id_autor"}, {"revista": "any_value(titulo_revista)", "autor": "any_value(apellidos_nombre)", "institucion": "any_value(afiliacion_actual)", "publicaciones": "count(DISTINCT id_articulo)", "primera": "min(fecha_publicacion_online)", "ultima": "max(fecha_publicacion_online)"}, where=PUBLISHED, having="publicaciones >= 2", order="revista; publicaciones DESC; id_autor", views=("articulo_autor", "autores", "articulos", "revistas_md"), plan=lambda t: _by_journal(t).withColumn("estado_articulo", F.lit("publicado"))),
    Grouping("CROSS-003", "Articles with authors from three countries or more", "articulos JOIN articulo_autor USING (id_articulo) JOIN autores USING (id_autor)", {"id": "id_articulo"}, {"titulo": "any_value(titulo_articulo)", "paises": "count(DISTINCT pais_afiliacion)", "lista": "joined(pais_afiliacion, ', ')", "publicacion": "any_value(fecha_publicacion_online)"}, where=f"{PUBLISHED} AND pais_afiliacion IS NOT NULL", having="paises >= 3", order="paises DESC; id", views=("articulos", "articulo_autor", "autores"), plan=lambda t: _countries(t).withColumn("estado_articulo", F.lit("publicado"))),
    Built("CROSS-004", "Dashboard", ("autores", "articulos", "articulo_autor", "revistas_md"), _dashboard),
    Grouping("CROSS-005", "Process time by type of article", "articulos", {"tipo": "tipo_articulo"}, {"articulos": "count(*)", "dias_decision": "round(avg(days(fecha_aceptacion, fecha_recepcion)), 0)", "dias_publicacion": "round(avg(days(fecha_publicacion_online, fecha_aceptacion)), 0)", "dias_totales": "round(avg(days(fecha_publicacion_online, fecha_recepcion)), 0)"}, where=f"{PUBLISHED} AND fecha_recepcion IS NOT NULL AND fecha_aceptacion IS NOT NULL AND fecha_publicacion_online IS NOT NULL AND tipo_articulo IS NOT NULL", order="articulos DESC; tipo"),
    Listing("CROSS-006", "Active authors and their unpublished articles", "autores LEFT JOIN (SELECT id_autor, p.id_articulo AS publicado, 1 AS enlace FROM articulo_autor LEFT JOIN (SELECT id_articulo FROM articulos WHERE estado_articulo = 'publicado') p USING (id_articulo)) USING (id_autor)", PERSON, where="publicado IS NULL AND estado_autor = 'activo'", order="fecha_creacion_registro DESC; id_autor", views=("autores", "articulo_autor", "articulos"), plan=_unpublished),
    Listing("CROSS-006-STRICT", "Active authors without any published article", "(SELECT * FROM autores WHERE id_autor NOT IN (SELECT id_autor FROM articulo_autor JOIN articulos USING (id_articulo) WHERE estado_articulo = 'publicado'))", PERSON, where="estado_autor = 'activo'", order="fecha_creacion_registro DESC; id_autor", views=("autores", "articulo_autor", "articulos"), plan=_never_published),
)
