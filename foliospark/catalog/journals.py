"""Queries on journals."""

from __future__ import annotations

from foliospark.catalog.authors import _flag
from foliospark.catalog.spec import Grouping, Listing

ACTIVE = "estado_publicacion = 'activa'"
ID = {"id": "id_revista", "titulo": "titulo_revista"}
REQUIRED = ("issn_impreso", "e_issn", "doi_prefix", "url_revista", "licencia_defecto")
COHERENCE = "CASE WHEN tipo_acceso = 'abierto' AND blank(licencia_defecto) THEN 'INCONSISTENTE: Acceso abierto sin licencia' WHEN tipo_acceso = 'suscripcion' AND contains(lower(licencia_defecto), 'cc') THEN 'INCONSISTENTE: Suscripción con licencia CC' WHEN tipo_acceso = 'embargado' AND coalesce(periodo_embargo, 0) = 0 THEN 'INCONSISTENTE: Embargo sin período' ELSE 'OK' END"


def _valid(column: str) -> str:
    """An ISSN is wrong only if it is there."""
    return f"CASE WHEN NOT like_issn({column}) THEN 'FORMATO INVÁLIDO' ELSE 'OK' END"


QUERIES = (
    Listing("REV-META-001", "Journals with required fields missing", "revistas_md", {**ID, "issn_impreso": _flag("issn_impreso", "FALTA ISSN IMPRESO"), "issn_electronico": _flag("e_issn", "FALTA ISSN ELECTRÓNICO"), "doi_prefix": _flag("doi_prefix", "FALTA DOI PREFIX"), "url": _flag("url_revista", "FALTA URL"), "licencia": _flag("licencia_defecto", "FALTA LICENCIA"), "estado": "estado_publicacion"}, where=f"{ACTIVE} AND ({' OR '.join(f'blank({c})' for c in REQUIRED)})"),
    Listing("REV-META-002", "ISSN formats", "revistas_md", {**ID, "issn_impreso": "issn_impreso", "issn_electronico": "e_issn", "validez_impreso": _valid("issn_impreso"), "validez_electronico": _valid("e_issn")}, where=f"{ACTIVE} AND (NOT blank(issn_impreso) OR NOT blank(e_issn))"),
    Listing("REV-META-003", "Journals without preservation", "revistas_md", {**ID, "produccion": "repositorio_produccion_plataforma", "preservacion": "repositorio_preservacion_plataforma", "cms": "sistema_gestion_contenidos", "estado": "estado_publicacion"}, where=f"{ACTIVE} AND blank(repositorio_preservacion_url)"),
    Listing("REV-STD-001", "Open access without a CC license", "revistas_md", {**ID, "acceso": "tipo_acceso", "licencia": "licencia_defecto", "url_licencia": "url_licencia", "politica": "politica_acceso_abierto"}, where=f"tipo_acceso IN ('abierto', 'mixto') AND (blank(licencia_defecto) OR NOT contains(lower(licencia_defecto), 'cc')) AND {ACTIVE}"),
    Listing("REV-STD-002", "Indexing of journals", "revistas_md", {"titulo": "titulo_revista", "indexada_en": "indexada_en", "scielo": "categoria_scielo", "latindex": "categoria_latindex", "cuartil": "cuartil_scimago", "factor_impacto": "factor_impacto", "estado": "estado_publicacion"}, where=ACTIVE, order="titulo_revista"),
    Listing("REV-STD-003", "Journals without OAI-PMH", "revistas_md", {**ID, "url": "url_revista", "oai_pmh": "url_oai_pmh", "cms": "sistema_gestion_contenidos", "indexada_en": "indexada_en"}, where=f"{ACTIVE} AND blank(url_oai_pmh)"),
    Grouping("REV-EST-001", "Journals by state", "revistas_md", {"estado": "estado_publicacion"}, {"revistas": "count(*)", "titulos": "listed(titulo_revista, '; ')"}),
    Listing("REV-EST-002", "Suspended and finished journals", "revistas_md", {"titulo": "titulo_revista", "estado": "estado_publicacion", "ano_inicio": "ano_inicio", "ano_fin": "ano_fin", "ultima": "fecha_actualizacion", "notas": "notas_internas"}, where="estado_publicacion IN ('suspendida', 'finalizada')", order="fecha_actualizacion DESC; id_revista"),
    Listing("REV-AUD-001", "Journals unchanged for six months", "revistas_md", {**ID, "ultima": "fecha_actualizacion", "dias": "days(AS_OF, fecha_actualizacion)", "usuario": "usuario_creacion", "estado": "estado_publicacion"}, where=f"{ACTIVE} AND fecha_actualizacion < AS_OF - INTERVAL 6 MONTH", order="fecha_actualizacion; id_revista"),
    Listing("REV-AUD-002", "Journals changed in the last month", "revistas_md", {"titulo": "titulo_revista", "cambio": "fecha_actualizacion", "usuario": "usuario_creacion", "estado": "estado_publicacion", "notas": "notas_internas"}, where="fecha_actualizacion >= AS_OF - INTERVAL 1 MONTH", order="fecha_actualizacion DESC; id_revista"),
    Listing("REV-AUD-003", "Access type and license that do not agree", "revistas_md", {"titulo": "titulo_revista", "acceso": "tipo_acceso", "licencia": "licencia_defecto", "embargo": "periodo_embargo", "validacion": COHERENCE}, where=f"{ACTIVE} AND {COHERENCE} <> 'OK'"),
)
