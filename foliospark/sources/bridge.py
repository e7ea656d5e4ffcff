"""The editorial tables, derived from a star schema of customers, orders, lines, parts and suppliers.

Each view is one SELECT that Spark and other SQL engines read alike; ``{customer}``
and the like stand for the source tables. Modulo rules put in the nulls and
blanks that the editorial queries look for.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-12-31"

VIEWS = {
    "autores": """
SELECT c_custkey AS id_autor, c_name AS apellidos, c_name AS apellidos_nombre,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 1 THEN '' ELSE 'a' || CAST(c_custkey AS STRING) || '@example.org' END AS email_principal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'Institute ' || CAST(c_custkey % 40 AS STRING) END AS afiliacion_actual,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE n_name END AS pais_afiliacion,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_mktsegment || '-' || CAST(c_custkey % 100 AS STRING) END AS area_investigacion,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE '0000-' || CAST(c_custkey AS STRING) END AS orcid,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'S' || CAST(c_custkey AS STRING) END AS scopus_id,
  CASE WHEN c_custkey % 8 < 3 THEN NULL ELSE 'R' || CAST(c_custkey AS STRING) END AS researcher_id,
  CASE WHEN c_custkey % 9 < 5 THEN NULL ELSE 'G' || CAST(c_custkey AS STRING) END AS google_scholar_id,
  CASE WHEN c_custkey % 40 < 25 THEN 'ror' || CAST(c_custkey % 40 AS STRING) WHEN c_custkey % 40 < 30 THEN '' END AS ror_afiliacion_actual,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(10 + c_custkey % 23 AS STRING) || '01' END AS clasificacion_unesco,
  CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE 'OECD ' || CAST(c_custkey % 6 AS STRING) END AS clasificacion_oecd,
  CASE c_custkey % 5 WHEN 0 THEN 'Doctorado' WHEN 1 THEN 'Maestría' WHEN 2 THEN 'Licenciatura' WHEN 3 THEN 'Especialización' END AS grado_maximo,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'University ' || CAST(c_custkey % 31 AS STRING) END AS universidad_doctorado,
  CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE 1960 + c_custkey % 41 END AS ano_doctorado,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'expertise ' || c_mktsegment END AS expertise_revision,
  CASE WHEN c_custkey % 23 = 0 THEN 'Journal ' || CAST(c_custkey % 9 AS STRING) WHEN c_custkey % 23 = 1 THEN '' END AS editor_revista,
  CASE WHEN c_custkey % 29 = 0 THEN 'Board ' || CAST(c_custkey % 9 AS STRING) WHEN c_custkey % 29 = 1 THEN '' END AS comite_editorial,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(floor((c_acctbal + 1000) / 400) AS BIGINT) END AS h_index,
  CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) AS i10_index, c_custkey % 120 AS numero_publicaciones, c_custkey % 900 AS numero_citas,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE DATE '2001-12-31' - CAST(c_custkey % 500 AS INT) END AS fecha_actualizacion_metricas,
  CASE c_custkey % 3 WHEN 0 THEN 'externo' WHEN 1 THEN 'interno' END AS tipo_autor,
  CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS disponible_revision,
  CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE 'review ' || c_mktsegment END AS areas_revision,
  CASE WHEN c_custkey % 14 = 0 THEN 'conflict ' || CAST(c_custkey AS STRING) WHEN c_custkey % 14 = 1 THEN '' END AS conflictos_permanentes,
  CASE c_custkey % 10 WHEN 7 THEN 'inactivo' WHEN 8 THEN 'jubilado' WHEN 9 THEN 'emerito' ELSE 'activo' END AS estado_autor,
  CASE WHEN c_custkey % 10 = 7 THEN DATE '2001-12-31' - CAST(c_custkey % 400 AS INT) END AS fecha_inactividad,
  c_custkey % 5 + 1 AS calificacion_colaboracion,
  DATE '2001-12-31' - CAST(c_custkey % 2000 AS INT) AS fecha_creacion_registro,
  DATE '2001-12-31' - CAST(c_custkey % 800 AS INT) AS fecha_actualizacion_registro,
  'user' || CAST(c_custkey % 6 AS STRING) AS usuario_creacion, 'source' || CAST(c_custkey % 4 AS STRING) AS fuente_registro,
  CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS verificado
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""",
    "articulos": """
SELECT id_articulo, id_revista, tipo_articulo, tipo_sujetos_investigacion, estudios_humanos_tipo, estudios_animales_especies, numero_animales,
  protocolo_bienestar_animal, aprobacion_comite_animal, numero_aprobacion_animal, cumple_arrive, cumple_consort, cumple_strobe, cumple_prisma,
  titulo_articulo, numero_paginas, fecha_recepcion, fecha_aceptacion, fecha_publicacion_online,
  CAST(year(fecha_publicacion_online) AS BIGINT) AS ano_publicacion, doi, autor_correspondencia, consentimiento_informado, aprobacion_comite_etica,
  numero_aprobacion_etica, registro_ensayo_clinico, visualizaciones, descargas, citas_scopus, citas_wos, citas_google_scholar, altmetric_score,
  menciones_redes, validado_jats, errores_validacion, calidad_metadatos, completitud_metadatos, estado_articulo, fecha_creacion_registro,
  fecha_actualizacion_registro, usuario_creacion, responsable_edicion, notas_internas
FROM (SELECT o_orderkey AS id_articulo, o_custkey AS id_revista,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'revision narrativa' ELSE o_orderpriority END AS tipo_articulo,
  CASE o_orderkey % 7 WHEN 0 THEN 'humanos' WHEN 1 THEN 'animales' WHEN 2 THEN 'humanos_y_animales' WHEN 3 THEN 'in_vitro' WHEN 4 THEN 'in_silico' ELSE 'no_aplica' END AS tipo_sujetos_investigacion,
  CASE o_orderkey % 8 WHEN 0 THEN 'ensayo clínico' WHEN 1 THEN 'observacional' END AS estudios_humanos_tipo,
  CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'species ' || CAST(o_orderkey % 5 AS STRING) END AS estudios_animales_especies,
  CASE WHEN o_orderkey % 7 IN (1, 2) THEN o_orderkey % 60 END AS numero_animales,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'protocol ' || CAST(o_orderkey % 12 AS STRING) END AS protocolo_bienestar_animal,
  CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS aprobacion_comite_animal,
  CASE WHEN o_orderkey % 3 = 1 THEN 'CA' || CAST(o_orderkey AS STRING) END AS numero_aprobacion_animal,
  CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS cumple_arrive, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS cumple_consort,
  CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS cumple_strobe, CASE o_orderkey % 8 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS cumple_prisma,
  'Title ' || CAST(o_orderkey AS STRING) AS titulo_articulo, o_orderkey % 30 + 1 AS numero_paginas,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha_recepcion,
  CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) END AS fecha_aceptacion,
  CASE WHEN o_orderkey % 12 < 4 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 + o_orderkey % 150 AS INT) END AS fecha_publicacion_online,
  CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '10.5555/' || CAST(o_orderkey AS STRING) END AS doi,
  CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_custkey END AS autor_correspondencia,
  CASE o_orderkey % 3 WHEN 0 THEN 0 ELSE 1 END AS consentimiento_informado,
  CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS aprobacion_comite_etica,
  CASE WHEN o_orderkey % 4 > 1 THEN 'CE' || CAST(o_orderkey AS STRING) END AS numero_aprobacion_etica,
  CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 8 THEN '' ELSE 'NCT' || CAST(o_orderkey AS STRING) END AS registro_ensayo_clinico,
  o_orderkey % 1000 AS visualizaciones, o_orderkey % 300 AS descargas,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 50 END AS citas_scopus, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 40 END AS citas_wos,
  o_orderkey % 70 AS citas_google_scholar, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 977 AS DOUBLE) / 4 END AS altmetric_score,
  CASE WHEN o_orderkey % 8 = 1 THEN 'mentions ' || CAST(o_orderkey % 11 AS STRING) END AS menciones_redes,
  CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS validado_jats,
  CASE o_orderkey % 11 WHEN 0 THEN 'error ' || CAST(o_orderkey % 13 AS STRING) WHEN 1 THEN '' END AS errores_validacion,
  o_orderkey % 10 AS calidad_metadatos, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) END AS completitud_metadatos,
  CASE o_orderkey % 6 WHEN 0 THEN 'borrador' WHEN 1 THEN 'en_revision' WHEN 2 THEN 'aceptado' WHEN 3 THEN 'publicado' WHEN 4 THEN 'rechazado' ELSE 'retractado' END AS estado_articulo,
  CAST(o_orderdate AS DATE) - 5 AS fecha_creacion_registro, DATE '2001-12-31' - CAST(o_orderkey % 90 AS INT) AS fecha_actualizacion_registro,
  'user' || CAST(o_orderkey % 6 AS STRING) AS usuario_creacion, CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'ED_' || CAST(o_custkey % 20 AS STRING) END AS responsable_edicion,
  CASE WHEN o_orderkey % 10 = 0 THEN 'note ' || CAST(o_orderkey % 17 AS STRING) END AS notas_internas
FROM {orders}) AS base
""",
    "articulo_autor": "SELECT DISTINCT l_orderkey AS id_articulo, l_suppkey AS id_autor FROM {lineitem}",
    "articulo_revisor": """
SELECT l_orderkey * 10 + l_linenumber AS id_revision, l_orderkey AS id_articulo, l_suppkey AS id_autor,
  CASE l_linenumber % 3 WHEN 0 THEN 'peer_review' WHEN 1 THEN 'editorial' ELSE 'tecnica' END AS tipo_revision, CAST(l_linenumber AS BIGINT) AS ronda_revision,
  CAST(l_shipdate AS DATE) AS fecha_asignacion, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS fecha_revision,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'A' THEN 'aceptar' WHEN l_returnflag = 'R' THEN 'rechazar'
    WHEN l_partkey % 2 = 0 THEN 'cambios_mayores' ELSE 'cambios_menores' END AS decision
FROM {lineitem}
""",
    "revistas_md": """
SELECT p_partkey AS id_revista, p_name || ' ' || CAST(p_partkey AS STRING) AS titulo_revista,
  CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1234-567x' WHEN 3 THEN '12345678' ELSE '1234-' || CAST(100 + p_partkey % 900 AS STRING) || 'X' END AS issn_impreso,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abcd-1234' ELSE '4321-' || CAST(1000 + p_partkey % 9000 AS STRING) END AS e_issn,
  1950 + p_partkey % 50 AS ano_inicio, CASE WHEN p_size % 10 > 7 THEN 2000 + p_partkey % 2 END AS ano_fin,
  CASE WHEN p_size % 10 = 8 THEN 'suspendida' WHEN p_size % 10 = 9 THEN 'finalizada' ELSE 'activa' END AS estado_publicacion,
  CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://j' || CAST(p_partkey AS STRING) || '.example.org' END AS url_revista,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://oai.example.org/' || CAST(p_partkey AS STRING) END AS url_oai_pmh,
  CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '10.' || CAST(1000 + p_partkey AS STRING) END AS doi_prefix,
  'platform ' || CAST(p_partkey % 3 AS STRING) AS repositorio_produccion_plataforma, 'cms ' || CAST(p_partkey % 4 AS STRING) AS sistema_gestion_contenidos,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://keep.example.org' END AS repositorio_preservacion_url,
  CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE 'LOCKSS' END AS repositorio_preservacion_plataforma,
  CASE p_partkey % 4 WHEN 0 THEN 'abierto' WHEN 1 THEN 'suscripcion' WHEN 2 THEN 'mixto' ELSE 'embargado' END AS tipo_acceso,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'propia' WHEN 3 THEN 'cc by' ELSE 'CC BY 4.0' END AS licencia_defecto,
  'https://license.example.org/' || CAST(p_partkey % 3 AS STRING) AS url_licencia, 'policy ' || CAST(p_partkey % 6 AS STRING) AS politica_acceso_abierto,
  CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 12 END AS periodo_embargo, 'index ' || CAST(p_partkey % 8 AS STRING) AS indexada_en,
  'A' || CAST(p_partkey % 2 AS STRING) AS categoria_scielo, 'B' || CAST(p_partkey % 3 AS STRING) AS categoria_latindex, 'Q' || CAST(1 + p_partkey % 4 AS STRING) AS cuartil_scimago,
  CAST(p_partkey % 80 AS DOUBLE) / 8 AS factor_impacto, DATE '2001-12-31' - CAST(p_partkey % 400 AS INT) AS fecha_actualizacion,
  'user' || CAST(p_partkey % 6 AS STRING) AS usuario_creacion, CASE WHEN p_partkey % 6 = 0 THEN 'note ' || CAST(p_partkey % 7 AS STRING) END AS notas_internas
FROM {part}
""",
    "bibtex": """
SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 53 = 0 THEN 0 ELSE l_orderkey END AS id_articulo,
  CASE l_linenumber WHEN 1 THEN 'article' WHEN 2 THEN 'book' WHEN 3 THEN 'inproceedings' WHEN 4 THEN 'incollection' WHEN 5 THEN 'inbook' ELSE 'misc' END AS tipo_de_entrada,
  CASE l_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS author, CASE l_partkey % 20 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Editor ' || CAST(l_suppkey % 9 AS STRING) END AS editor,
  'Work ' || CAST(l_partkey AS STRING) AS title, CASE WHEN l_linenumber = 5 THEN 'Book ' || CAST(l_partkey % 50 AS STRING) END AS book_title,
  CASE WHEN l_linenumber = 1 THEN p_brand END AS journal_title, CASE WHEN l_linenumber = 3 THEN 'Meeting ' || CAST(l_partkey % 30 AS STRING) END AS event_title,
  CASE l_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '20ab' ELSE CAST(year(l_shipdate) + 7 AS STRING) END AS year,
  CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'n.d.' WHEN 2 THEN CAST(year(l_shipdate) + 10 AS STRING) || '-03' WHEN 3 THEN CAST(year(l_shipdate) AS STRING) END AS date,
  CASE l_partkey % 6 WHEN 0 THEN 'english' WHEN 1 THEN 'spanish' END AS hyphenation, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'french' ELSE 'german' END AS language,
  CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE n_name END AS location, CASE WHEN l_partkey % 16 = 0 THEN NULL ELSE p_type END AS publisher,
  CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '10.1/' || CAST(l_partkey AS STRING) END AS doi,
  CASE l_partkey % 18 WHEN 0 THEN '' WHEN 1 THEN s_name WHEN 2 THEN 'Translator ' || CAST(l_suppkey % 7 AS STRING) END AS translator,
  CASE WHEN l_partkey % 25 = 1 THEN 'Commentator ' || CAST(l_suppkey % 3 AS STRING) END AS commentator, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 30 AS STRING) END AS volume
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
""",
}
SOURCES = ("customer", "nation", "orders", "lineitem", "part", "supplier")


def sql_views(needed: list[str]) -> str:
    """The needed views as the beginning of a SQL statement."""
    plain = {s: s for s in SOURCES}
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**plain).strip()})" for v in needed)


def editorial_tables(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """Lazy DataFrames by name; only what a query uses is read."""

    def table(name: str) -> DataFrame:
        used = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if "{" + s + "}" in VIEWS[name]}
        return spark.sql(VIEWS[name], **used)

    return SimpleNamespace(table=table)
