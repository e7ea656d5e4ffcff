"""Queries on authors and reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.spec import Built, Grouping, Listing, Tables, unpivoted

ACTIVE = "estado_autor = 'activo'"
#: Labels of h-index ranges by their lower bounds, fixed values.
RANGES = ((21, "21+ (Líderes)"), (11, "11-20 (Consolidados)"), (6, "6-10 (Intermedios)"), (0, "0-5 (Emergentes)"))
RANGE = f"CASE {' '.join(f"WHEN h_index >= {low} THEN '{label}'" for low, label in RANGES)} ELSE 'Sin datos' END"


def _reviewers(t: Tables) -> DataFrame:
    """Reviewers with the counts of their reviews, which are made before the join."""
    counts = t("articulo_revisor").groupBy("id_autor").agg(F.count(F.lit(1)).alias("hechas"), F.count("decision").alias("decididas"))
    return t("autores").join(counts, "id_autor", "left")


def _flag(column: str, text: str) -> str:
    return f"CASE WHEN blank({column}) THEN '{text}' ELSE '' END"


#: Identifiers and their columns, fixed values.
IDENTIFIERS = (("ORCID", "orcid"), ("Scopus ID", "scopus_id"), ("Researcher ID", "researcher_id"), ("Google Scholar", "google_scholar_id"))


def _coverage(t: Tables, as_of: str, collation: str | None = None) -> DataFrame:
    """All identifiers in one pass."""
    has = [F.count(F.when(F.col(c) != "", 1)).alias(c) for _, c in IDENTIFIERS]
    one = t("autores").filter(ACTIVE).agg(F.count(F.lit(1)).alias("total"), *has)
    rows = [(f"'{name}'", c, "total", f"round(CAST({c} AS DOUBLE) * 100.0 / nullif(total, 0), 2)") for name, c in IDENTIFIERS]
    return unpivoted(one, ["tipo_identificador", "con_id", "total_autores", "porcentaje"], rows)


CRITICAL = ("email_principal", "afiliacion_actual", "pais_afiliacion", "area_investigacion", "orcid")

QUERIES = (
    Grouping("AUT-REV-001", "Reviewers by research area", "autores", {"area": "area_investigacion"}, {"total_revisores": "count(*)", "disponibles": "n_if(disponible_revision = 1)", "no_disponibles": "n_if(disponible_revision = 0)", "calificacion_promedio": "round(avg(calificacion_colaboracion), 2)"}, where=f"{ACTIVE} AND area_investigacion IS NOT NULL", order="disponibles DESC; area"),
    Listing("AUT-REV-002", "Available reviewers and their expertise", "autores", {"nombre": "apellidos_nombre", "email": "email_principal", "institucion": "afiliacion_actual", "areas": "areas_revision", "expertise": "expertise_revision", "calificacion": "calificacion_colaboracion"}, where=f"disponible_revision = 1 AND {ACTIVE} AND areas_revision IS NOT NULL", order="calificacion_colaboracion DESC; apellidos"),
    Grouping("AUT-REV-003", "Areas with fewer than three available reviewers", "autores", {"area": "area_investigacion"}, {"revisores": "count(*)", "nombres": "listed(apellidos_nombre, '; ')"}, where=f"disponible_revision = 1 AND {ACTIVE} AND area_investigacion IS NOT NULL", having="revisores < 3", order="revisores; area", late=("nombres",)),
    Listing("AUT-REV-004", "Review workload", "", {"id_autor": "id_autor", "revisor": "apellidos_nombre", "email": "email_principal", "revisiones": "coalesce(hechas, 0)", "pendientes": "CASE WHEN hechas IS NULL THEN 1 ELSE hechas - decididas END", "completadas": "coalesce(decididas, 0)", "calificacion": "calificacion_colaboracion"}, where=f"disponible_revision = 1 AND {ACTIVE}", order="coalesce(hechas, 0) DESC; id_autor", views=("autores", "articulo_revisor"), plan=_reviewers),
    Listing("AUT-REV-005", "Reviewers with permanent conflicts", "autores", {"revisor": "apellidos_nombre", "email": "email_principal", "conflictos": "conflictos_permanentes", "areas": "areas_revision"}, where=f"NOT blank(conflictos_permanentes) AND {ACTIVE}", order="apellidos"),
    Listing("AUT-BIB-001", "Top 20 authors by h-index", "autores", {"autor": "apellidos_nombre", "h_index": "h_index", "i10_index": "i10_index", "publicaciones": "numero_publicaciones", "citas": "numero_citas", "institucion": "afiliacion_actual", "pais": "pais_afiliacion"}, where=f"h_index IS NOT NULL AND {ACTIVE}", order="h_index DESC; numero_citas DESC; id_autor", limit=20),
    Grouping("AUT-BIB-002", "Authors by range of h-index", "autores", {"rango": RANGE}, {"autores": "count(*)", "orden": "min(coalesce(h_index, 999))"}, where=ACTIVE, order="orden", share="porcentaje", share_of=ACTIVE, hidden=("orden",)),
    Listing("AUT-BIB-003", "Metrics older than six months", "autores", {"autor": "apellidos_nombre", "h_index": "h_index", "ultima": "fecha_actualizacion_metricas", "dias": "days(AS_OF, fecha_actualizacion_metricas)", "email": "email_principal", "estado": "estado_autor"}, where=f"fecha_actualizacion_metricas < AS_OF - INTERVAL 6 MONTH AND {ACTIVE} AND h_index IS NOT NULL", order="fecha_actualizacion_metricas; id_autor"),
    Grouping("AUT-INST-001", "Top 20 institutions", "autores", {"institucion": "afiliacion_actual", "pais": "pais_afiliacion"}, {"autores": "count(*)", "con_ror": "n_if(NOT blank(ror_afiliacion_actual))"}, where=f"{ACTIVE} AND afiliacion_actual IS NOT NULL", order="autores DESC; institucion; pais", limit=20, share="porcentaje", share_of=ACTIVE),
    Grouping("AUT-INST-002", "Authors by country", "autores", {"pais": "pais_afiliacion"}, {"autores": "count(*)"}, where=f"{ACTIVE} AND pais_afiliacion IS NOT NULL", order="autores DESC; pais", share="porcentaje", share_of=ACTIVE),
    Grouping("AUT-INST-003", "Institutions without a ROR id", "autores", {"institucion": "afiliacion_actual", "pais": "pais_afiliacion"}, {"autores_afectados": "count(*)"}, where=f"{ACTIVE} AND afiliacion_actual IS NOT NULL AND blank(ror_afiliacion_actual)", order="autores_afectados DESC; institucion; pais"),
    Grouping("AUT-DISC-001", "Authors by two-digit UNESCO code", "autores", {"codigo_unesco": "substring(clasificacion_unesco, 1, 2)"}, {"autores": "count(*)", "areas": "joined(area_investigacion, '; ')"}, where=f"clasificacion_unesco IS NOT NULL AND {ACTIVE}", order="autores DESC; codigo_unesco", share="porcentaje", share_of=f"clasificacion_unesco IS NOT NULL AND {ACTIVE}"),
    Grouping("AUT-DISC-002", "Top 15 research areas", "autores", {"area": "area_investigacion"}, {"autores": "count(*)"}, where=f"{ACTIVE} AND area_investigacion IS NOT NULL", order="autores DESC; area", limit=15, share="porcentaje", share_of=f"{ACTIVE} AND area_investigacion IS NOT NULL"),
    Grouping("AUT-DISC-003", "Authors by OECD field", "autores", {"campo_oecd": "clasificacion_oecd"}, {"autores": "count(*)", "paises": "joined(pais_afiliacion, ', ')"}, where=f"clasificacion_oecd IS NOT NULL AND {ACTIVE}", order="autores DESC; campo_oecd"),
    Listing("AUT-ID-001", "Active authors without ORCID", "autores", {"autor": "apellidos_nombre", "email": "email_principal", "institucion": "afiliacion_actual", "pais": "pais_afiliacion", "estado": "estado_autor"}, where=f"blank(orcid) AND {ACTIVE}", order="apellidos"),
    Built("AUT-ID-002", "Coverage of persistent identifiers", ("autores",), _coverage),
    Listing("AUT-CAL-001", "Unverified authors", "autores", {"autor": "apellidos_nombre", "creado": "fecha_creacion_registro", "dias": "days(AS_OF, fecha_creacion_registro)", "fuente": "fuente_registro", "creado_por": "usuario_creacion", "email": "email_principal"}, where=f"coalesce(verificado, 0) = 0 AND {ACTIVE}", order="fecha_creacion_registro DESC; id_autor"),
    Listing("AUT-CAL-002", "Author records older than a year", "autores", {"autor": "apellidos_nombre", "email": "email_principal", "institucion": "afiliacion_actual", "ultima": "fecha_actualizacion_registro", "dias": "days(AS_OF, fecha_actualizacion_registro)", "estado": "estado_autor"}, where=f"fecha_actualizacion_registro < AS_OF - INTERVAL 1 YEAR AND {ACTIVE}", order="fecha_actualizacion_registro; id_autor"),
    Listing("AUT-CAL-003", "Authors with critical fields missing", "autores", {"autor": "apellidos_nombre", "email": _flag("email_principal", "SIN EMAIL"), "afiliacion": _flag("afiliacion_actual", "SIN AFILIACIÓN"), "pais": _flag("pais_afiliacion", "SIN PAÍS"), "area": _flag("area_investigacion", "SIN ÁREA"), "orcid": _flag("orcid", "SIN ORCID"), "estado": "estado_autor"}, where=f"{ACTIVE} AND ({' OR '.join(f'blank({c})' for c in CRITICAL)})", order="apellidos"),
    Grouping("AUT-EST-001", "Authors by state", "autores", {"estado": "estado_autor"}, {"autores": "count(*)"}, order="autores DESC; estado", share="porcentaje"),
    Listing("AUT-EST-002", "Authors inactive for six months at most", "autores", {"autor": "apellidos_nombre", "inactivo_desde": "fecha_inactividad", "dias": "days(AS_OF, fecha_inactividad)", "institucion": "afiliacion_actual", "email": "email_principal"}, where="estado_autor = 'inactivo' AND fecha_inactividad >= AS_OF - INTERVAL 6 MONTH", order="fecha_inactividad DESC; id_autor"),
    Listing("AUT-ROL-001", "Authors who are editors as well", "autores", {"nombre": "apellidos_nombre", "tipo": "tipo_autor", "editor_en": "editor_revista", "comites": "comite_editorial", "institucion": "afiliacion_actual"}, where=f"{ACTIVE} AND (NOT blank(editor_revista) OR NOT blank(comite_editorial))", order="apellidos"),
    Grouping("AUT-ROL-002", "Authors by type", "autores", {"tipo": "tipo_autor"}, {"autores": "count(*)"}, where=f"{ACTIVE} AND tipo_autor IS NOT NULL", order="autores DESC; tipo", share="porcentaje", share_of=ACTIVE),
    Grouping("AUT-FORM-001", "Authors by degree", "autores", {"grado": "grado_maximo"}, {"autores": "count(*)"}, where=f"{ACTIVE} AND grado_maximo IS NOT NULL", order="autores DESC; grado", share="porcentaje", share_of=ACTIVE),
    Grouping("AUT-FORM-002", "Top 15 doctoral universities", "autores", {"universidad": "universidad_doctorado"}, {"doctores": "count(*)", "primer_ano": "min(ano_doctorado)", "ultimo_ano": "max(ano_doctorado)"}, where=f"universidad_doctorado IS NOT NULL AND {ACTIVE}", order="doctores DESC; universidad", limit=15),
)
