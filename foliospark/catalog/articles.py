"""Queries on articles and their reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.spec import Built, Grouping, Listing, Tables, unpivoted

PUBLISHED = "estado_articulo = 'publicado'"
DONE = "estado_articulo IN ('aceptado', 'publicado')"
UNDER_WAY = "estado_articulo IN ('en_revision', 'aceptado', 'publicado')"
#: States in the order of the workflow, fixed values; others come last.
STATES = ("borrador", "en_revision", "aceptado", "publicado", "rechazado", "retractado")
RANK = f"coalesce(nullif(array_position(array({', '.join(map(repr, STATES))}), estado), 0), 99)"
ID = {"id": "id_articulo", "titulo": "titulo_articulo"}


def _left(other: str, *columns: str):
    """Articles with what another table has for them."""
    return lambda t: t("articulos").join(t(other).select("id_articulo", *columns), "id_articulo", "left")


def _reviews(t: Tables) -> DataFrame:
    authors = t("autores").select("id_autor", "apellidos_nombre", "email_principal")
    return t("articulo_revisor").join(authors, "id_autor")


def _pending(t: Tables) -> DataFrame:
    return _reviews(t).join(t("articulos").select("id_articulo", "titulo_articulo", "estado_articulo"), "id_articulo")


def _reviewed(t: Tables) -> DataFrame:
    return t("articulos").join(t("articulo_revisor").select("id_articulo", "ronda_revision"), "id_articulo")


def _with_references(t: Tables) -> DataFrame:
    per_article = t("bibtex").groupBy("id_articulo").count().withColumnRenamed("count", "numero_referencias")
    return t("articulos").join(per_article, "id_articulo", "left")


HUMANS, ANIMALS, BOTH = "humanos", "animales", "humanos_y_animales"
#: Reporting guides, their flags, and the kind of work each applies to, fixed values.
GUIDES = (
    ("ARRIVE (Animales)", "cumple_arrive", lambda: F.col("tipo_sujetos_investigacion").isin(ANIMALS, BOTH)),
    ("CONSORT (Ensayos Clínicos)", "cumple_consort", lambda: F.col("tipo_sujetos_investigacion").isin(HUMANS, BOTH)),
    ("STROBE (Observacionales)", "cumple_strobe", lambda: F.col("tipo_sujetos_investigacion") == HUMANS),
    ("PRISMA (Revisiones)", "cumple_prisma", lambda: F.col("tipo_articulo").contains("revision")),
)
DATABASES = (("Scopus", "citas_scopus"), ("Web of Science", "citas_wos"), ("Google Scholar", "citas_google_scholar"))


def _guides(t: Tables, as_of: str, collation: str | None = None) -> DataFrame:
    """All guides in one pass."""
    parts = [m for _, flag, fits in GUIDES for m in (F.sum(F.when(fits(), F.col(flag))).alias(flag), F.count(F.when(fits(), 1)).alias(f"n_{flag}"))]
    rows = [(f"'{name}'", f"CAST({flag} AS BIGINT)", f"n_{flag}", f"round(CAST({flag} AS DOUBLE) * 100.0 / nullif(n_{flag}, 0), 2)") for name, flag, _ in GUIDES]
    return unpivoted(t("articulos").filter(PUBLISHED).agg(*parts), ["guia", "cumplen", "aplicable", "porcentaje"], rows)


def _citations(t: Tables, as_of: str, collation: str | None = None) -> DataFrame:
    """All databases in one pass."""
    parts = [m for _, c in DATABASES for m in (F.count(F.when(F.col(c) > 0, 1)).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.avg(c).alias(f"m_{c}"))]
    rows = [(f"'{name}'", f"n_{c}", f"CAST(s_{c} AS BIGINT)", f"round(m_{c}, 2)") for name, c in DATABASES]
    return unpivoted(t("articulos").filter(PUBLISHED).agg(*parts), ["base_de_datos", "articulos_citados", "total_citas", "promedio"], rows)


def _review_counts(t: Tables) -> DataFrame:
    counts = t("articulo_revisor").groupBy("id_articulo").agg(F.count(F.lit(1)).alias("revisores"), F.count("decision").alias("completadas"))
    return t("articulos").join(counts, "id_articulo", "left")


QUERIES = (
    Grouping("ART-WF-001", "Articles by state", "articulos", {"estado": "estado_articulo"}, {"articulos": "count(*)", "dias_promedio": "round(avg(days(AS_OF, fecha_creacion_registro)), 0)"}, order=RANK, share="porcentaje"),
    Listing("ART-WF-002", "In review for more than 60 days", "", {"id": "id_articulo", "titulo": "titulo_articulo", "recepcion": "fecha_recepcion", "dias": "days(AS_OF, fecha_recepcion)", "editor": "responsable_edicion", "revisores": "coalesce(revisores, 0)", "completadas": "coalesce(completadas, 0)"}, where="estado_articulo = 'en_revision' AND fecha_recepcion < AS_OF - INTERVAL 60 DAY", order="days(AS_OF, fecha_recepcion) DESC; id_articulo", views=("articulos", "articulo_revisor"), plan=_review_counts),
    Listing("ART-WF-003", "Drafts idle for 30 days", "articulos", {**ID, "responsable": "responsable_edicion", "creado": "fecha_creacion_registro", "ultima": "fecha_actualizacion_registro", "dias": "days(AS_OF, fecha_actualizacion_registro)"}, where="estado_articulo = 'borrador' AND fecha_actualizacion_registro < AS_OF - INTERVAL 30 DAY", order="fecha_actualizacion_registro; id_articulo"),
    Listing("ART-WF-004", "Accepted, not yet published", "articulos", {**ID, "aceptacion": "fecha_aceptacion", "dias": "days(AS_OF, fecha_aceptacion)", "tipo": "tipo_articulo", "editor": "responsable_edicion", "notas": "notas_internas"}, where="estado_articulo = 'aceptado' AND fecha_publicacion_online IS NULL", order="fecha_aceptacion; id_articulo"),
    Listing("ART-WF-005", "Changed in the last month", "articulos", {**ID, "estado": "estado_articulo", "cambio": "fecha_actualizacion_registro", "responsable": "responsable_edicion", "usuario": "usuario_creacion"}, where="fecha_actualizacion_registro >= AS_OF - INTERVAL 1 MONTH", order="fecha_actualizacion_registro DESC; id_articulo"),
    Listing("ART-CAL-001", "Without DOI", "articulos", {**ID, "estado": "estado_articulo", "publicacion": "fecha_publicacion_online", "editor": "responsable_edicion"}, where=f"{DONE} AND blank(doi)", order="fecha_publicacion_online DESC; id_articulo"),
    Listing("ART-CAL-002", "JATS validation pending", "articulos", {**ID, "estado": "estado_articulo", "validado": "validado_jats", "errores": "errores_validacion", "responsable": "responsable_edicion"}, where=f"{DONE} AND coalesce(validado_jats, 0) = 0", order="fecha_aceptacion DESC; id_articulo"),
    Listing("ART-CAL-003", "Metadata less than 80 % complete", "articulos", {**ID, "estado": "estado_articulo", "completitud": "completitud_metadatos", "calidad": "calidad_metadatos", "responsable": "responsable_edicion"}, where="completitud_metadatos < 80 AND estado_articulo <> 'rechazado'", order="completitud_metadatos; id_articulo"),
    Grouping("ART-CAL-004", "Without corresponding author", "articulos LEFT JOIN articulo_autor USING (id_articulo)", {"id": "id_articulo"}, {"titulo": "any_value(titulo_articulo)", "estado": "any_value(estado_articulo)", "editor": "any_value(responsable_edicion)", "autores": "count(id_autor)", "aceptacion": "max(fecha_aceptacion)"}, where=f"autor_correspondencia IS NULL AND {UNDER_WAY}", order="aceptacion DESC; id", hidden=("aceptacion",), views=("articulos", "articulo_autor"), plan=_left("articulo_autor", "id_autor")),
    Listing("ART-CAL-005", "XML validation errors", "articulos", {**ID, "errores": "errores_validacion", "validado": "validado_jats", "responsable": "responsable_edicion"}, where="NOT blank(errores_validacion) AND estado_articulo <> 'rechazado'", order="fecha_actualizacion_registro DESC; id_articulo"),
    Built("ART-STD-001", "Compliance with reporting guides", ("articulos",), _guides),
    Listing("ART-STD-002", "Human subjects without ethics approval", "articulos", {**ID, "sujetos": "tipo_sujetos_investigacion", "aprobacion": "aprobacion_comite_etica", "numero": "numero_aprobacion_etica", "consentimiento": "consentimiento_informado", "editor": "responsable_edicion"}, where=f"tipo_sujetos_investigacion IN ('humanos', 'humanos_y_animales') AND coalesce(aprobacion_comite_etica, 0) = 0 AND {UNDER_WAY}", order="fecha_recepcion DESC; id_articulo"),
    Listing("ART-STD-003", "Animals without committee approval", "articulos", {**ID, "especies": "estudios_animales_especies", "n_animales": "numero_animales", "aprobacion": "aprobacion_comite_animal", "numero": "numero_aprobacion_animal", "protocolo": "protocolo_bienestar_animal", "editor": "responsable_edicion"}, where=f"tipo_sujetos_investigacion IN ('animales', 'humanos_y_animales') AND coalesce(aprobacion_comite_animal, 0) = 0 AND {UNDER_WAY}", order="fecha_recepcion DESC; id_articulo"),
    Listing("ART-STD-004", "Clinical trials without registration", "articulos", {**ID, "tipo_estudio": "estudios_humanos_tipo", "registro": "registro_ensayo_clinico", "aprobacion": "aprobacion_comite_etica", "editor": "responsable_edicion"}, where=f"contains(estudios_humanos_tipo, 'ensayo') AND blank(registro_ensayo_clinico) AND {UNDER_WAY}", order="fecha_recepcion DESC; id_articulo"),
    Grouping("ART-PROD-001", "Published articles by type", "articulos", {"tipo": "tipo_articulo"}, {"articulos": "count(*)"}, where=f"{PUBLISHED} AND tipo_articulo IS NOT NULL", order="articulos DESC; tipo", share="porcentaje", share_of=PUBLISHED),
    Grouping("ART-PROD-002", "Work of each editor", "articulos", {"editor": "responsable_edicion"}, {"articulos": "count(*)", "publicados": "n_if(estado_articulo = 'publicado')", "en_revision": "n_if(estado_articulo = 'en_revision')", "aceptados": "n_if(estado_articulo = 'aceptado')", "rechazados": "n_if(estado_articulo = 'rechazado')", "dias_decision": "round(avg(days(fecha_aceptacion, fecha_recepcion)), 0)"}, where="responsable_edicion IS NOT NULL", order="articulos DESC; editor"),
    Grouping("ART-PROD-003", "Published articles by year", "articulos LEFT JOIN (SELECT id_articulo, count(*) AS numero_referencias FROM bibtex GROUP BY id_articulo) USING (id_articulo)", {"ano": "ano_publicacion"}, {"articulos": "count(*)", "paginas_promedio": "avg(numero_paginas)", "referencias": "total(numero_referencias)"}, where=f"{PUBLISHED} AND ano_publicacion IS NOT NULL", order="ano DESC", views=("articulos", "bibtex"), plan=_with_references),
    Grouping("ART-PROD-004", "Acceptance rate by year", "articulos", {"ano": "CAST(year(fecha_recepcion) AS BIGINT)"}, {"manuscritos": "count(*)", "publicados": "n_if(estado_articulo = 'publicado')", "rechazados": "n_if(estado_articulo = 'rechazado')", "tasa": "round(CAST(n_if(estado_articulo = 'publicado') AS DOUBLE) * 100.0 / count(*), 2)"}, where="estado_articulo IN ('publicado', 'rechazado') AND fecha_recepcion IS NOT NULL", order="ano DESC"),
    Listing("ART-MET-001", "Top 20 by views and downloads", "articulos", {**ID, "vistas": "visualizaciones", "descargas": "descargas", "interacciones": "visualizaciones + descargas", "publicacion": "fecha_publicacion_online"}, where=f"{PUBLISHED} AND (visualizaciones > 0 OR descargas > 0)", order="visualizaciones + descargas DESC; id_articulo", limit=20),
    Listing("ART-MET-002", "Top 20 by Altmetric score", "articulos", {**ID, "altmetric": "altmetric_score", "menciones": "menciones_redes", "publicacion": "fecha_publicacion_online", "doi": "doi"}, where=f"{PUBLISHED} AND altmetric_score IS NOT NULL", order="altmetric_score DESC; id_articulo", limit=20),
    Built("ART-MET-003", "Citations by database", ("articulos",), _citations),
    Listing("ART-REV-001", "Pending reviews", "articulo_revisor JOIN autores USING (id_autor) JOIN articulos USING (id_articulo)", {"revisor": "apellidos_nombre", "email": "email_principal", "id": "id_articulo", "titulo": "titulo_articulo", "asignacion": "fecha_asignacion", "dias": "days(AS_OF, fecha_asignacion)", "tipo": "tipo_revision", "ronda": "ronda_revision"}, where="decision IS NULL AND estado_articulo = 'en_revision'", order="days(AS_OF, fecha_asignacion) DESC; id_revision", views=("articulo_revisor", "autores", "articulos"), plan=_pending),
    Grouping("ART-REV-002", "Review time by reviewer", "articulo_revisor JOIN autores USING (id_autor)", {"id_autor": "id_autor"}, {"revisor": "any_value(apellidos_nombre)", "revisiones": "count(id_revision)", "dias_promedio": "round(avg(days(fecha_revision, fecha_asignacion)), 0)", "mas_rapida": "min(days(fecha_revision, fecha_asignacion))", "mas_lenta": "max(days(fecha_revision, fecha_asignacion))", "media": "avg(days(fecha_revision, fecha_asignacion))"}, where="decision IS NOT NULL AND fecha_revision IS NOT NULL", having="revisiones >= 3", order="media; id_autor", hidden=("media",), views=("articulo_revisor", "autores"), plan=_reviews),
    Grouping("ART-REV-003", "Decisions by reviewer", "articulo_revisor JOIN autores USING (id_autor)", {"id_autor": "id_autor"}, {"revisor": "any_value(apellidos_nombre)", "revisiones": "count(*)", "aceptar": "n_if(decision = 'aceptar')", "rechazar": "n_if(decision = 'rechazar')", "cambios_mayores": "n_if(decision = 'cambios_mayores')", "cambios_menores": "n_if(decision = 'cambios_menores')", "aceptacion": "round(CAST(n_if(decision = 'aceptar') AS DOUBLE) * 100.0 / count(*), 2)"}, where="decision IS NOT NULL", having="revisiones >= 5", order="revisiones DESC; id_autor", views=("articulo_revisor", "autores"), plan=_reviews),
    Grouping("ART-REV-004", "More than two rounds of review", "articulos JOIN articulo_revisor USING (id_articulo)", {"id": "id_articulo"}, {"titulo": "any_value(titulo_articulo)", "rondas": "max(ronda_revision)", "recepcion": "any_value(fecha_recepcion)", "dias": "any_value(days(AS_OF, fecha_recepcion))", "editor": "any_value(responsable_edicion)"}, where="estado_articulo = 'en_revision'", having="rondas > 2", order="rondas DESC; id", views=("articulos", "articulo_revisor"), plan=_reviewed),
    Grouping("ART-TIME-001", "Decision time by outcome", "articulos", {"decision": "estado_articulo"}, {"articulos": "count(*)", "dias_promedio": "round(avg(days(fecha_aceptacion, fecha_recepcion)), 0)", "minimo": "min(days(fecha_aceptacion, fecha_recepcion))", "maximo": "max(days(fecha_aceptacion, fecha_recepcion))"}, where=f"fecha_recepcion IS NOT NULL AND fecha_aceptacion IS NOT NULL AND {DONE}"),
    Listing("ART-TIME-002", "From acceptance to publication", "articulos", {**ID, "aceptacion": "fecha_aceptacion", "publicacion": "fecha_publicacion_online", "dias": "days(fecha_publicacion_online, fecha_aceptacion)", "editor": "responsable_edicion"}, where=f"{PUBLISHED} AND fecha_aceptacion IS NOT NULL AND fecha_publicacion_online IS NOT NULL", order="days(fecha_publicacion_online, fecha_aceptacion) DESC; id_articulo"),
    Listing("ART-TIME-003", "Published more than 90 days after acceptance", "articulos", {**ID, "aceptacion": "fecha_aceptacion", "publicacion": "fecha_publicacion_online", "dias": "days(fecha_publicacion_online, fecha_aceptacion)", "editor": "responsable_edicion", "notas": "notas_internas"}, where=f"{PUBLISHED} AND days(fecha_publicacion_online, fecha_aceptacion) > 90", order="days(fecha_publicacion_online, fecha_aceptacion) DESC; id_articulo"),
)
