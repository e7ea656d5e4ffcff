"""Document transforms, lookups and constraint checks on tables derived from the star schema, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.docs import blocks, fences, lookups, marks, names, tree
from foliospark.quality import books, catalogue, constraints, evolution
from foliospark.sources import dump, jats, jsonside, lenient, sidefiles
from foliospark.sources.bridge import VIEWS as EDITORIAL
from foliospark.sources.bridge import editorial_tables, sql_views
from foliospark.sources.workspace import new_path

#: Derived tables, in SQL that both sides read.
VIEWS = {
    "blocks": """SELECT l_orderkey AS document, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos, CAST(1 + l_partkey % 3 AS INT) AS level,
  CASE WHEN l_linenumber % 3 = 1 OR l_partkey % 4 = 0 THEN 'Header' WHEN l_partkey % 7 = 0 THEN 'RawBlock' WHEN l_partkey % 9 = 0 THEN 'CodeBlock' ELSE 'Para' END AS kind,
  CASE l_suppkey % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'unnumbered' WHEN 2 THEN 'bibliography' ELSE 'plain' END AS class,
  'see @k' || CAST(l_partkey AS STRING) || ' & <b> @k' || CAST(l_suppkey AS STRING) || '.' AS text FROM {lineitem}""",
    "cited": "SELECT 'k' || CAST(p_partkey AS STRING) AS key, p_name AS entry FROM {part}",
    "marked": """SELECT p_partkey, '@rdm{{' || p_name || '} and @q{{a @q{{' || p_brand || '} b} at 5 % of a_b' AS text,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Figura ' || CAST(p_size AS STRING) || ':  ' || p_name END AS caption,
  CASE p_partkey % 4 WHEN 0 THEN 'fm-' WHEN 1 THEN 'a-' WHEN 2 THEN 'bm-' ELSE 'x' END || CAST(p_size AS STRING) || '-part.md' AS file_name FROM {part}""".replace("{{", "{ob}"),
    "fenced": """SELECT p_partkey AS document, CASE WHEN p_partkey % 2 = 0 THEN 'body' ELSE 'back' END AS place, replace(CASE p_partkey % 9 WHEN 0 THEN p_name
  WHEN 1 THEN '::: box id="i' || CAST(p_partkey AS STRING) || '"~' || p_name || '~:::'
  WHEN 2 THEN '::: {ob}.fig #f' || CAST(p_partkey AS STRING) || ' caption="' || p_brand || '"}~::: box~' || p_name || '~:::~after~:::'
  WHEN 3 THEN 'a~::: box id=x~' || p_name || '~:::~b~:::: {ob}.box #q}~' || p_brand || '~::::~c'
  WHEN 4 THEN '::: figure~' || p_name || '~:::' WHEN 5 THEN '::: figure caption="c" id="d"~::: box~' || p_name || '~:::'
  WHEN 6 THEN '::: other~' || p_name || '~:::~tail' WHEN 7 THEN p_name || '~:::' ELSE '::: back~' || p_name || '~:::' END, '~', chr(10)) AS text FROM {part}""",
    "named": """SELECT p_partkey AS id, p_size AS place, CASE p_partkey % 6 WHEN 0 THEN 'Ana Maria Perez' || CAST(p_partkey % 10 AS STRING) || ' and {ob}Grupo and Co} AND Ana Maria Perez1' WHEN 1 THEN 'van der Berg' || CAST(p_partkey % 7 AS STRING) || ', Jan'
  WHEN 2 THEN 'Jean de la Fontaine and others' WHEN 3 THEN 'King, Jr, Martin' WHEN 4 THEN '' END AS author,
  CASE WHEN p_partkey % 5 = 0 THEN 'berg, Jan' WHEN p_partkey % 5 = 1 THEN 'Jan  van der Berg' || CAST(p_partkey % 7 AS STRING) END AS editor FROM {part}""",
    "loose": """SELECT p_partkey AS id, replace(CASE p_partkey % 6 WHEN 0 THEN '{ob}"a": .5 /* half */ "b": [1 2, "x"], // end~}' WHEN 1 THEN '{ob}"a": "' || p_brand || '", "b": {ob}"c": null,},} tail'
  WHEN 2 THEN '{ob}"a" 1}' WHEN 3 THEN '[1, {ob}"a": 2}]' WHEN 4 THEN '' ELSE '{ob}"a": ' || CAST(p_partkey AS STRING) || '}' END, '~', chr(10)) AS text,
  p_name || CASE p_partkey % 3 WHEN 0 THEN chr(127) || '\u2028' WHEN 1 THEN '"' ELSE '' END AS plain, p_partkey % 30 AS hole FROM {part}""",
    "headed": """SELECT l_orderkey AS document, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos, CAST(1 + l_partkey % 3 AS INT) AS level,
  CASE WHEN l_partkey % 5 < 3 THEN 'Header' WHEN l_partkey % 10 = 3 THEN 'Div' ELSE 'Para' END AS kind, CASE WHEN l_partkey % 10 = 3 THEN 'refs' WHEN l_partkey % 15 = 2 THEN 'bibliography' END AS id,
  CASE WHEN l_suppkey % 4 = 1 THEN 'unnumbered' ELSE 'plain' END AS class, 'see @k' || CAST(l_partkey % 50 AS STRING) || ' and @k' || CAST(l_suppkey AS STRING) AS text FROM {lineitem}""",
    "figured": """SELECT document, pos, CAST(CASE pos WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 1 ELSE 0 END AS INT) AS depth,
  CASE pos WHEN 1 THEN 'Div' WHEN 2 THEN 'Figure' WHEN 3 THEN 'Caption' WHEN 4 THEN 'Plain' WHEN 5 THEN 'Figure' WHEN 6 THEN 'Figure' ELSE 'Para' END AS kind,
  CASE WHEN pos < 4 THEN '' WHEN part % 4 = 0 THEN 'Drawing ' || CAST(part AS STRING) ELSE 'Figura ' || CAST(part AS STRING) || ':  drawing' END AS text
FROM (SELECT l_orderkey AS document, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos FROM {lineitem}) x""",
    "statements": """SELECT p_partkey, 'INSERT INTO `roles` VALUES (' || CAST(p_partkey AS STRING) || ', ' || chr(39) || 'it' || chr(39) || chr(39) || 's ' || p_name || chr(39) || ', NULL), (-1.5, ' || chr(39) || 'a;b(c)' || chr(39) || ', ' || chr(39) || chr(39) || ');' AS statement FROM {part}""",
    "configured": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{ob}"metadata":{ob}"title":"' || p_name || '","license":{ob}"name":"CC"}}}' WHEN 1 THEN '{ob}"title":"' || p_name || '","license":"BY"}'
  WHEN 2 THEN '{ob}"metadata":{ob}"title":""}}' ELSE 'no json' END AS json FROM {part}""",
    "profiles": "SELECT n_nationkey AS id_perfil, n_name AS nombre, CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 1 END AS activo FROM {nation}",
    "codes": "SELECT s_suppkey AS id_shortcode, s_name AS nombre, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS activo FROM {supplier}",
    "links": "SELECT s_nationkey AS id_perfil, s_suppkey AS id_shortcode, s_suppkey % 9 AS orden_en_perfil FROM {supplier}",
    "help": """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS componente, p_name AS ayuda,
  CASE p_partkey % 6 WHEN 0 THEN 'es' WHEN 1 THEN 'pt' WHEN 2 THEN 'en' WHEN 3 THEN 'it' WHEN 4 THEN 'fr' ELSE 'de' END AS idioma FROM {part} WHERE p_partkey % 11 > 2""",
    "entries": "SELECT p_type AS tipo, p_partkey AS codigo, p_name AS nombre, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE 1 END AS activo FROM {part}",
    "roles": "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'autor' WHEN 1 THEN 'traductor' WHEN 2 THEN 'compilador' END AS rol, CAST(c_custkey % 50 AS STRING) AS edad, c_name AS nota FROM {customer}",
    "metadata": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || ' & 5 %' END AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS authors, CASE WHEN c_custkey % 5 = 0 THEN 'a_b' END AS subject,
  CAST(NULL AS STRING) AS keywords, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'pt' END AS language, CASE c_custkey % 4 WHEN 0 THEN '10.1/a_' || CAST(c_custkey AS STRING) WHEN 1 THEN '' END AS doi,
  CASE WHEN c_custkey % 6 = 0 THEN '978' END AS isbn, CASE WHEN c_custkey % 7 = 0 THEN '979' END AS isbn13 FROM {customer}""",
    "colecciones": "SELECT CAST(r_regionkey AS BIGINT) AS id_coleccion, CASE WHEN r_regionkey % 2 = 0 THEN '1234-5678' END AS issn FROM {region}",
    "series": "SELECT CAST(n_nationkey AS BIGINT) AS id_serie, CAST(n_regionkey + CASE WHEN n_nationkey % 6 = 0 THEN 100 ELSE 0 END AS BIGINT) AS id_coleccion, n_name AS issn FROM {nation}",
    "libros_md": """SELECT CAST(p_partkey AS BIGINT) AS id_libro, CAST(p_partkey % 150 AS BIGINT) AS id_proyecto, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 6 AS BIGINT) END AS id_coleccion,
  CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 30 AS BIGINT) END AS id_serie, CASE p_partkey % 3 WHEN 0 THEN 'monografia' WHEN 1 THEN 'manual' ELSE 'novela' END AS tipo_libro FROM {part}""",
    "libro_autor": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id_relacion, CAST(CASE WHEN l_partkey % 40 = 0 THEN -1 ELSE l_partkey END AS BIGINT) AS id_libro,
  CASE l_linenumber WHEN 1 THEN 'editor' WHEN 2 THEN 'otro' ELSE 'autor' END AS rol_libro FROM {lineitem}""",
    "partes_libro": "SELECT CAST(s_suppkey AS BIGINT) AS id_parte, CAST(CASE WHEN s_suppkey % 9 = 0 THEN -2 ELSE s_suppkey END AS BIGINT) AS id_libro, s_name AS titulo_parte FROM {supplier}",
    "capitulos": """SELECT CAST(o_orderkey AS BIGINT) AS id_capitulo, CAST(CASE WHEN o_orderkey % 50 = 0 THEN -3 ELSE 1 + o_custkey % 100 END AS BIGINT) AS id_libro,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(1 + o_orderkey % 12 AS BIGINT) END AS id_parte FROM {orders}""",
    "capitulo_autor": "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id_relacion, CAST(CASE WHEN l_suppkey % 8 = 0 THEN -4 ELSE l_orderkey END AS BIGINT) AS id_capitulo FROM {lineitem}",
    "noted": """SELECT CAST(o_orderkey AS STRING) AS document, o_orderkey AS number, replace(CASE o_orderkey % 4 WHEN 0 THEN '# Note ' || CAST(o_orderkey AS STRING) || ' {ob}.own #n -}~~at ' || o_orderstatus || '~  more~# no heading~~```sql~select 1~~# nor here~```~## End ##~last'
  WHEN 1 THEN '' WHEN 2 THEN CAST(NULL AS STRING) ELSE '## A~### B~text~```~open ' || CAST(o_orderkey AS STRING) END, '~', chr(10)) AS text FROM {orders}""",
}
TEMPLATES = (
    ("box", '<boxed-text id="{{id}}">{{contenido}}{{more}}</boxed-text>', "::: box", None, "any"), ("figure", '<fig id="{{id}}"><caption>{{caption}}</caption>{{contenido}}</fig>', "::: {.fig #fig-id}", "id,caption", "any"),
    ("other", None, None, None, "any"), ("back", "<ack>{{contenido}}</ack>", None, "", "back"),
)
SOURCES = ("customer", "nation", "lineitem", "orders", "part", "region", "supplier")


def _sql(view: str, names: dict[str, str]) -> str:
    text = VIEWS[view]
    for source, name in names.items():
        text = text.replace("{" + source + "}", name)
    return text.replace("{ob}", "{")


#: Views whose documents are put in order by windows or by what is made of them: the source and its column that tells documents apart.
DEALT = {"blocks": ("lineitem", "l_orderkey"), "headed": ("lineitem", "l_orderkey"), "figured": ("lineitem", "l_orderkey")}
#: Source rows that a task gets of these, so that its memory does not grow with the input.
ROWS_A_TASK = 100_000


def dealt(rows: DataFrame, column: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` dealt out by ``column`` to as many tasks as ``rows_a_task`` asks for. What orders or counts within ``column`` needs no other exchange."""
    return rows.repartition(max(1, -(-rows.count() // rows_a_task)), column)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {s: f"parquet.`{sf_dir}/{s}.parquet`" for s in SOURCES}
    if name not in DEALT:
        return spark.sql(_sql(name, used))
    source, column = DEALT[name]
    rows = dealt(spark.read.parquet(f"{sf_dir}/{source}.parquet"), column)
    return spark.sql(_sql(name, used | {source: "{" + source + "}"}).replace("{", "{{").replace("}", "}}").replace("{{" + source + "}}", "{" + source + "}"), **{source: rows})


def _with(*views: str) -> str:
    return "WITH " + ",\n".join(f"{v} AS ({_sql(v, {s: s for s in SOURCES})})" for v in views)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "blocks").withColumn("classes", F.array("class")).drop("class")


#: Where each value may stand in the metadata, the first that is there counts.
PATHS = {"title": ("$.metadata.title", "$.title"), "license": ("$.metadata.license.name", "$.license")}


def _colophon(spark: SparkSession, sf_dir: str, page_break: bool = False) -> DataFrame:
    own = spark.createDataFrame([(0, "Para", 0, ["plain"], "printed"), (1, "Para", 0, ["plain"], "bound")], "pos int, kind string, level int, classes array<string>, text string")
    return blocks.with_colophon(_blocks(spark, sf_dir), own, page_break=page_break).select("document", "pos", "kind", "text")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _view(spark, sf_dir, "marked").select("p_partkey", marks.em_dashes(t).alias("dashes"), marks.quotes(t).alias("quotes"), marks.tex_escape(F.col("file_name")).alias("tex"), marks.tex_escape(F.concat(F.lit("a_b & 5 % \\ "), "caption")).alias("tex_caption"), marks.xml_escape(F.concat(F.lit("<a & b> "), "caption")).alias("xml"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "marked").select("p_partkey", marks.caption(F.col("caption")).alias("c")).select("p_partkey", "c.label", "c.rest")


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank, number = marks.chapter_order(F.col("file_name"))
    return _view(spark, sf_dir, "marked").select("p_partkey", rank.alias("part_rank"), number.alias("number"))


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = evolution.Target({"id": "bigint", "rol": "string", "edad": "int", "pais": "string"}, dropped=("nota",), domains={"rol": (("autor", "traductor"), "autor")})
    return evolution.applied(_view(spark, sf_dir, "roles"), target).select("id", "rol", "edad", "pais")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = editorial_tables(spark, sf_dir).table("articulo_autor")
    return links.withColumn("es_correspondencia", F.when(F.col("id_autor") % 3 == 0, 1).when(F.col("id_autor") % 3 == 1, 0))


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _flagged(spark, sf_dir)
    return constraints.refused_correspondents(links, links.filter("id_autor % 2 = 0").withColumn("es_correspondencia", F.lit(1))).select("id_articulo", "id_autor")


def _shortcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(TEMPLATES, "name string, template string, opening string, required string, context string")
    found = fences.expanded(_view(spark, sf_dir, "fenced"), templates, context="place")
    return found.select("document", "text", F.array_join(F.transform("problems", lambda p: F.concat_ws(":", p["line"], p["name"], p["what"])), ",").alias("problems"))


def _lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, holes = lenient.variant(F.col("text")), F.create_map(F.lit(1).cast("long"), F.lit("1"), F.col("hole") + 2, F.lit('"x"'))
    rows = _view(spark, sf_dir, "loose").withColumn("v", value)
    return rows.select("id", F.try_variant_get("v", "$.a", "string").alias("a"), F.to_json(F.try_variant_get("v", "$.b", "variant")).alias("b"), lenient.escaped(F.col("plain")).alias("escaped"), lenient.array_or_object(holes).alias("holes"))


BOOKS = ("colecciones", "series", "libros_md", "libro_autor")


def _books(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: _view(spark, sf_dir, name) for name in BOOKS}


ALL_BOOKS = ("colecciones", "series", "libros_md", "partes_libro", "capitulos", "libro_autor", "capitulo_autor")


def _all_books(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: _view(spark, sf_dir, name) for name in ALL_BOOKS}


def _deleted_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _all_books(spark, sf_dir)
    left = catalogue.after_deletion(tables, books.rules(spark), "libros_md", tables["libros_md"].filter("id_libro % 10 = 3"))
    part = lambda name, parent: left[name].select(F.lit(name).alias("tabla"), F.col(books.PRIMARY[name]).alias("id"), F.col(parent).alias("padre"))
    return part("libros_md", "id_serie").unionAll(part("partes_libro", "id_libro")).unionAll(part("capitulos", "id_parte")).unionAll(part("libro_autor", "id_libro")).unionAll(part("capitulo_autor", "id_capitulo"))


def _jats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles, with signs in their titles that XML escapes or cannot hold, written as JATS and read again."""
    own = {n: _editorial(n)(spark, sf_dir) for n in ("articulos", "revistas_md", "autores", "articulo_autor", "bibtex")}
    titled = own["articulos"].withColumn("titulo_articulo", F.concat(F.col("titulo_articulo"), F.lit(' <i> & "\n\x01 ')))
    path = new_path(spark, "jats")
    jats.write(jats.articles(titled, own["revistas_md"], own["autores"], own["articulo_autor"], own["bibtex"]), path)
    return jats.read(spark, path)


def _file_colophon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colophon that is a Markdown file, made of the regions' names, behind every document."""
    path = new_path(spark, "colophon")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "\n\n").alias("names"))
    regions.select(F.concat(F.lit("# Imprint {-}\n\n"), "names").alias("value")).write.text(path)
    own = sidefiles.markdown_blocks(sidefiles.texts(spark, path)).select("pos", "kind", "level", "classes", "text")
    return blocks.with_colophon(_blocks(spark, sf_dir), own).select("document", "pos", "kind", "text")


def _editorial(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: editorial_tables(spark, sf_dir).table(name)


_reviews, _references, _articles, _authors = (_editorial(n) for n in ("articulo_revisor", "bibtex", "articulos", "articulo_autor"))
#: Keys of the editorial tables as a dump writes them.
KEYS = {
    "autores": ("PRIMARY KEY (`id_autor`)", "UNIQUE KEY `orcid` (`orcid`)"),
    "articulos": ("PRIMARY KEY (`id_articulo`)", "KEY `idx_titulo` (`titulo_articulo`(20))", "CONSTRAINT `a_1` FOREIGN KEY (`id_revista`) REFERENCES `revistas_md` (`id_revista`) ON DELETE SET NULL"),
    "revistas_md": ("PRIMARY KEY (`id_revista`)", "UNIQUE KEY `issn` (`issn_impreso`)"),
    "articulo_autor": ("UNIQUE KEY `u_1` (`id_articulo`,`id_autor`)", "UNIQUE KEY `u_2` (`id_articulo`,`id_autor`)", "CONSTRAINT `aa_1` FOREIGN KEY (`id_articulo`) REFERENCES `articulos` (`id_articulo`) ON DELETE CASCADE", "CONSTRAINT `aa_2` FOREIGN KEY (`id_autor`) REFERENCES `autores` (`id_autor`)"),
    "articulo_revisor": ("PRIMARY KEY (`id_revision`)", "UNIQUE KEY `r` (`id_articulo`,`id_autor`,`ronda_revision`)", "CONSTRAINT `ar_1` FOREIGN KEY (`id_autor`) REFERENCES `autores` (`id_autor`)"),
    "bibtex": ("PRIMARY KEY (`id`)", "CONSTRAINT `b_1` FOREIGN KEY (`id_articulo`) REFERENCES `articulos` (`id_articulo`)"),
}


def _dumped(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The tables written to a dump, and its statements."""
    path = new_path(spark, "dump")
    dump.write({n: _editorial(n)(spark, sf_dir) for n in names}, path, KEYS, compression="gzip")
    return dump.statements(spark, path)


def _loaded(spark: SparkSession, sf_dir: str, *names: str) -> dump.Loaded:
    """The tables written to a dump and loaded from it."""
    return dump.load(_dumped(spark, sf_dir, *names))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump's rows are parsed once, and the columns that constraints name are kept as Parquet, as several constraints read them."""
    read = _dumped(spark, sf_dir, *EDITORIAL)
    rules = dump.constraints(read).collect()
    named: dict[str, set[str]] = {}
    for r in rules:
        for table, columns in ((r["table"], r["columns"]), (r["parent"], r["parent_columns"])):
            named.setdefault(table, set()).update(columns or ())
    tables = dump.kept(read, named, new_path(spark, "constrained"))
    return catalogue.broken(tables, catalogue.declared(spark, rules)).withColumnRenamed("table", "table_name")


DOMAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_nested_sections": lambda s, d: blocks.nested_sections(_blocks(s, d)),
    "doc_flat_sections": lambda s, d: blocks.flat_sections(_blocks(s, d)),
    "doc_reference_lists": lambda s, d: blocks.reference_lists(_blocks(s, d)),
    "doc_contents_classes": lambda s, d: blocks.contents_classes(_blocks(s, d)).select("document", "pos", F.array_join("classes", ",").alias("classes")),
    "doc_section_bibliographies": lambda s, d: blocks.section_bibliographies(_blocks(s, d), _view(s, d, "cited")),
    "doc_colophon": _colophon,
    "doc_epub_colophon": lambda s, d: _colophon(s, d, page_break=True),
    "doc_contents_blocks": lambda s, d: blocks.contents_blocks(_blocks(s, d).withColumn("kind", F.when(F.col("kind") == "CodeBlock", "Div").otherwise(F.col("kind"))), "plain").select("document", "pos", "kind", "text"),
    "table_columns": lambda s, d: catalogue.statistics({n: _editorial(n)(s, d) for n in EDITORIAL}).select(F.col("table").alias("table_name"), "place", F.col("column").alias("column_name"), "kind", "n_rows", "n_null"),
    **{f"dump_{name}": (lambda s, d, name=name: _loaded(s, d, name).tables[name]) for name in EDITORIAL},
    "check_constraints": _broken,
    "seed_rows": lambda s, d: dump.inserted(_view(s, d, "statements"), "statement").select(F.col("table").alias("table_name"), F.col("row").alias("place"), "fields"),
    "json_metadata": lambda s, d: jsonside.first_values(_view(s, d, "configured"), "json", PATHS).select("p_partkey", "title", "license", "quoted"),
    "doc_marks": _marks,
    "doc_captions": _captions,
    "doc_chapter_order": _chapters,
    "doc_shortcodes": _shortcodes,
    "doc_tree_bibliographies": lambda s, d: tree.with_bibliographies(_view(s, d, "headed").withColumn("classes", F.array("class")), _view(s, d, "cited"), 2, "Works").select("document", F.array_join("path", ".").alias("path"), "kind", "level", "id", "text"),
    "doc_tree_captions": lambda s, d: tree.bold_captions(tree.from_depths(_view(s, d, "figured"))).select("document", F.array_join("path", ".").alias("path"), "label", "rest"),
    "doc_profile_shortcodes": lambda s, d: lookups.profile_listing(_view(s, d, "profiles"), _view(s, d, "links"), _view(s, d, "codes")),
    "doc_localized_help": lambda s, d: lookups.localized(_view(s, d, "help"), "en"),
    "doc_vocabulary": lambda s, d: lookups.vocabulary(_view(s, d, "entries"), "ECONOMY"),
    "doc_pdf_metadata": lambda s, d: lookups.pdf_metadata(_view(s, d, "metadata"), "id"),
    "doc_name_index": lambda s, d: lookups.name_index(_references(s, d), ["author", "editor", "translator", "commentator"], "id_articulo"),
    "doc_person_index": lambda s, d: names.person_index(_view(s, d, "named"), ["author", "editor"], "place"),
    "json_lenient": _lenient,
    "doc_reference_order": lambda s, d: lookups.numbered_references(_references(s, d), "id_articulo", ["author", "year", "volume", "title", "id"]).select("id", "id_articulo", "number"),
    "check_repeated_keys": lambda s, d: constraints.repeated_keys(_reviews(s, d), "id_articulo", "id_autor"),
    "check_orphans": lambda s, d: constraints.orphans(_references(s, d), "id_articulo", _articles(s, d).filter("estado_articulo = 'publicado'"), "id_articulo").select("id"),
    "check_cascade": lambda s, d: constraints.cascaded(_authors(s, d), "id_articulo", _articles(s, d).filter("estado_articulo = 'retractado'"), "id_articulo"),
    "check_domain": lambda s, d: constraints.outside_domain(_articles(s, d), "tipo_articulo", DOMAIN).select("id_articulo", "tipo_articulo"),
    "check_correspondents": lambda s, d: constraints.several_correspondents(_flagged(s, d)),
    "check_correspondent_updates": _refused,
    "xml_articles": lambda s, d: jats.heads(_jats(s, d)),
    "xml_contributors": lambda s, d: jats.contributors(_jats(s, d)),
    "xml_references": lambda s, d: jats.references(_jats(s, d)),
    "doc_markdown_blocks": lambda s, d: sidefiles.markdown_blocks(_view(s, d, "noted")).withColumn("classes", F.array_join("classes", ",")),
    "doc_file_colophon": _file_colophon,
    "check_all_book_tables": lambda s, d: catalogue.broken(_all_books(s, d), books.rules(s)),
    "delete_books": _deleted_books,
    "check_book_model": lambda s, d: books.violations(_books(s, d)),
    "delete_book_collection": lambda s, d: books.after_deletion(_books(s, d), "colecciones", _view(s, d, "colecciones").filter("id_coleccion = 2"))["libros_md"].select("id_libro", "id_coleccion", "id_serie"),
    "evolve_schema": _evolved,
}



def _statistics_sql() -> str:
    """For each table its columns as the other engine describes them, with what an unpivoted count finds."""
    kinds = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END"
    part = """SELECT '{t}' AS table_name, place, column_name, kind, n_rows, n_rows - coalesce(n_set, 0) AS n_null
FROM (SELECT column_name, (row_number() OVER ())::INTEGER AS place, {kinds} AS kind FROM (DESCRIBE SELECT * FROM {t})) JOIN (SELECT count(*) AS n_rows FROM {t}) ON true
LEFT JOIN (SELECT column_name, count(*) AS n_set FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY 1) USING (column_name)"""
    return sql_views(list(EDITORIAL)) + " " + " UNION ALL ".join(part.format(t=t, kinds=kinds) for t in EDITORIAL)


_XML = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_TEX = r"replace(replace(regexp_replace(replace({}, '\', '\textbackslash '), '([#$%&_{{}}])', '\\\1', 'g'), '~', '\textasciitilde '), '^', '\textasciicircum ')"
ORACLE_SQL: dict[str, str] = {
    "doc_nested_sections": f"""{_with("blocks")}, heads AS (SELECT document, pos, level FROM blocks WHERE kind = 'Header'),
ends AS (SELECT a.document, a.pos, min(b.pos) AS closed FROM heads a LEFT JOIN heads b ON a.document = b.document AND b.pos > a.pos AND b.level <= a.level GROUP BY 1, 2),
n_ends AS (SELECT document, closed, count(*) AS n FROM ends GROUP BY 1, 2),
parts AS (SELECT b.document, b.pos, CASE WHEN kind = 'Header' THEN repeat('</sec>', coalesce(n, 0)) || '<sec sec-type="level' || level || '"><title>' || {_XML} || '</title>' ELSE '<p>' || {_XML} || '</p>' END AS part
  FROM blocks b LEFT JOIN n_ends e ON b.document = e.document AND b.pos = e.closed
  UNION ALL SELECT document, 1000000, repeat('</sec>', n) FROM n_ends WHERE closed IS NULL)
SELECT document, string_agg(part, '' ORDER BY pos) AS jats FROM parts GROUP BY document""",
    "doc_flat_sections": f"""{_with("blocks")}
SELECT document, '<?xml version="1.0" encoding="UTF-8"?><article xmlns="http://jats.nlm.nih.gov">' || string_agg(CASE WHEN kind = 'Header' THEN '<sec><title>' || {_XML} || '</title>' WHEN kind = 'Para' THEN '<p>' || {_XML} || '</p>'
  WHEN kind = 'RawBlock' THEN text ELSE '' END, '' ORDER BY pos) || '</article>' AS jats FROM blocks GROUP BY document""",
    "doc_reference_lists": f"""{_with("blocks")}, marked AS (SELECT *, class IN ('references', 'bibliography') AS own, pos - row_number() OVER (PARTITION BY document, class IN ('references', 'bibliography') ORDER BY pos) AS run FROM blocks),
lists AS (SELECT document, min(pos) AS first, string_agg(CASE WHEN kind = 'Para' THEN '<ref><p>' || {_XML} || '</p></ref>' ELSE '' END, '' ORDER BY pos) AS refs FROM marked WHERE own GROUP BY document, run)
SELECT document, row_number() OVER (PARTITION BY document ORDER BY first) AS list, '<ref-list><title>References</title>' || refs || '</ref-list>' AS ref_list FROM lists""",
    "doc_epub_colophon": f"""{_with("blocks")}, added(i, kind, text) AS (VALUES (1, 'Div', ''), (2, 'Header', 'Colofón'), (3, 'Para', 'printed'), (4, 'Para', 'bound'))
SELECT document, pos, kind, text FROM blocks
UNION ALL SELECT document, CAST(last + i AS INTEGER), kind, text FROM (SELECT document, max(pos) AS last FROM blocks GROUP BY document), added""",
    "doc_contents_blocks": rf"""{_with("blocks")}, made AS (SELECT document, pos, unnest(range(CASE WHEN kind = 'CodeBlock' AND class = 'plain' THEN 3 ELSE 1 END)) AS i, kind, class, text FROM blocks)
SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY pos, i) AS INTEGER) AS pos,
  CASE WHEN kind = 'CodeBlock' AND class = 'plain' THEN 'RawBlock' WHEN kind = 'CodeBlock' THEN 'Div' ELSE kind END AS kind,
  CASE WHEN kind = 'CodeBlock' AND class = 'plain' THEN ['\hypersetup{{linkcolor=black}}', '\setcounter{{tocdepth}}{{0}}', '\tableofcontents'][i + 1] ELSE text END AS text FROM made""",
    "table_columns": _statistics_sql(),
    **{f"dump_{name}": f"{sql_views([name])} SELECT * FROM {name}" for name in EDITORIAL},
    "check_constraints": f"""{sql_views(list(EDITORIAL))}
SELECT 'autores' AS table_name, 'primary' AS rule, 'id_autor' AS columns, count(*) AS n FROM (SELECT id_autor FROM autores GROUP BY 1 HAVING count(*) > 1 OR id_autor IS NULL)
UNION ALL SELECT 'autores', 'unique', 'orcid', count(*) FROM (SELECT orcid FROM autores WHERE orcid IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'articulos', 'primary', 'id_articulo', count(*) FROM (SELECT id_articulo FROM articulos GROUP BY 1 HAVING count(*) > 1 OR id_articulo IS NULL)
UNION ALL SELECT 'articulos', 'reference', 'id_revista', count(*) FROM articulos WHERE id_revista IS NOT NULL AND id_revista NOT IN (SELECT id_revista FROM revistas_md)
UNION ALL SELECT 'revistas_md', 'primary', 'id_revista', count(*) FROM (SELECT id_revista FROM revistas_md GROUP BY 1 HAVING count(*) > 1 OR id_revista IS NULL)
UNION ALL SELECT 'revistas_md', 'unique', 'issn_impreso', count(*) FROM (SELECT issn_impreso FROM revistas_md WHERE issn_impreso IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'articulo_autor', 'unique', 'id_articulo,id_autor', count(*) FROM (SELECT id_articulo, id_autor FROM articulo_autor WHERE id_articulo IS NOT NULL AND id_autor IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'articulo_autor', 'reference', 'id_articulo', count(*) FROM articulo_autor WHERE id_articulo NOT IN (SELECT id_articulo FROM articulos)
UNION ALL SELECT 'articulo_autor', 'reference', 'id_autor', count(*) FROM articulo_autor WHERE id_autor NOT IN (SELECT id_autor FROM autores)
UNION ALL SELECT 'articulo_revisor', 'primary', 'id_revision', count(*) FROM (SELECT id_revision FROM articulo_revisor GROUP BY 1 HAVING count(*) > 1 OR id_revision IS NULL)
UNION ALL SELECT 'articulo_revisor', 'unique', 'id_articulo,id_autor,ronda_revision', count(*) FROM (SELECT 1 FROM articulo_revisor WHERE id_articulo IS NOT NULL AND id_autor IS NOT NULL AND ronda_revision IS NOT NULL GROUP BY id_articulo, id_autor, ronda_revision HAVING count(*) > 1)
UNION ALL SELECT 'articulo_revisor', 'reference', 'id_autor', count(*) FROM articulo_revisor WHERE id_autor NOT IN (SELECT id_autor FROM autores)
UNION ALL SELECT 'bibtex', 'primary', 'id', count(*) FROM (SELECT id FROM bibtex GROUP BY 1 HAVING count(*) > 1 OR id IS NULL)
UNION ALL SELECT 'bibtex', 'reference', 'id_articulo', count(*) FROM bibtex WHERE id_articulo NOT IN (SELECT id_articulo FROM articulos)""",
    "seed_rows": """SELECT 'roles' AS table_name, 1::BIGINT AS place, p_partkey || '|it''s ' || p_name || '|NULL' AS fields FROM part UNION ALL SELECT 'roles', 2, '-1.5|a;b(c)|' FROM part""",
    "json_metadata": """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name WHEN p_partkey % 4 = 2 THEN '' END AS title, CASE p_partkey % 4 WHEN 0 THEN 'CC' WHEN 1 THEN 'BY' END AS license,
  CASE WHEN p_partkey % 4 < 2 THEN '"' || p_name || '"' WHEN p_partkey % 4 = 2 THEN '""' END AS quoted FROM part""",
    "doc_contents_classes": f"""{_with("blocks")}
SELECT document, pos, CASE WHEN kind = 'Header' AND level = 1 AND class = 'unnumbered' THEN 'unnumbered,unlisted' ELSE class END AS classes FROM blocks""",
    "doc_section_bibliographies": rf"""{_with("blocks", "cited")}, numbered AS (SELECT *, sum(CASE WHEN kind = 'Header' AND level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY pos) AS section FROM blocks),
keys AS (SELECT DISTINCT document, CAST(section AS BIGINT) AS section, unnest(regexp_extract_all(text, '@([A-Za-z][\w:-]*)', 1)) AS key FROM numbered)
SELECT document, section, key, entry FROM keys JOIN cited USING (key)""",
    "doc_colophon": f"""{_with("blocks")}, added(i, kind, text) AS (VALUES (1, 'Header', 'Colofón'), (2, 'Para', 'printed'), (3, 'Para', 'bound'))
SELECT document, pos, kind, text FROM blocks
UNION ALL SELECT document, CAST(last + i AS INTEGER), kind, text FROM (SELECT document, max(pos) AS last FROM blocks GROUP BY document), added""",
    "doc_marks": rf"""{_with("marked")}
SELECT p_partkey, regexp_replace(text, '@rdm\{{(.*?)\}}', '—\1—', 'gs') AS dashes,
  regexp_replace(text, '@q\{{a @q\{{(.*?)\}} b\}}', '«a “\1” b»', 'gs') AS quotes, {_TEX.format("file_name")} AS tex, {_TEX.format("'a_b & 5 % ' || chr(92) || ' ' || caption")} AS tex_caption,
  replace(replace(replace('<a & b> ' || caption, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM marked""",
    "doc_captions": rf"""{_with("marked")}
SELECT p_partkey, regexp_extract(caption, '^(Figura\s+\d+:)', 1) AS label, regexp_replace(caption, '^Figura\s+\d+:\s*', '') AS rest FROM marked""",
    "doc_chapter_order": rf"""{_with("marked")}
SELECT p_partkey, CASE WHEN file_name LIKE 'fm-%' THEN 1 WHEN file_name LIKE 'a-%' THEN 2 WHEN file_name LIKE 'bm-%' THEN 3 ELSE 9 END AS part_rank,
  CASE WHEN file_name LIKE 'x%' THEN NULL ELSE CAST(split_part(file_name, '-', 2) AS INTEGER) END AS number FROM marked""",
    "doc_shortcodes": """SELECT p_partkey AS document, replace(CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN '<boxed-text id="i' || p_partkey || '">' || p_name || '{{more}}</boxed-text>'
  WHEN 2 THEN '<fig id="f' || p_partkey || '"><caption>' || p_brand || '</caption><boxed-text id="{{id}}">' || p_name || '{{more}}</boxed-text>~after</fig>'
  WHEN 3 THEN 'a~<boxed-text id="x">' || p_name || '{{more}}</boxed-text>~b~<boxed-text id="q">' || p_brand || '{{more}}</boxed-text>~c'
  WHEN 4 THEN '::: figure~' || p_name || '~:::' WHEN 5 THEN '::: figure caption="c" id="d"~<boxed-text id="{{id}}">' || p_name || '{{more}}</boxed-text>'
  WHEN 6 THEN '::: other~' || p_name || '~:::~tail' WHEN 7 THEN p_name || '~:::'
  ELSE CASE WHEN p_partkey % 2 = 1 THEN '<ack>' || p_name || '</ack>' ELSE '::: back~' || p_name || '~:::' END END, '~', chr(10)) AS text,
  CASE p_partkey % 9 WHEN 4 THEN '0:figure:missing' WHEN 5 THEN '0:figure:unclosed' WHEN 6 THEN '0:other:unknown' WHEN 8 THEN CASE WHEN p_partkey % 2 = 1 THEN '' ELSE '0:back:context' END ELSE '' END AS problems FROM part""",
    "doc_tree_bibliographies": rf"""{_with("headed", "cited")}, kept AS (SELECT * FROM headed WHERE NOT (kind = 'Header' AND coalesce(id, '') = 'bibliography') AND NOT (kind = 'Div' AND coalesce(id, '') = 'refs')),
heads AS (SELECT document, pos, level, class <> 'unnumbered' AS numbered FROM kept WHERE kind = 'Header'),
counted AS (SELECT *, sum(CASE WHEN numbered AND level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY pos) AS c1 FROM heads),
tops AS (SELECT document, pos, level, CASE WHEN NOT numbered THEN 'x' || pos WHEN level = 1 THEN c1::VARCHAR ELSE c1 || '.' || c2 END AS name
  FROM (SELECT *, sum(CASE WHEN numbered AND level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document, c1 ORDER BY pos) AS c2 FROM counted) WHERE level <= 2),
ended AS (SELECT t.document, t.pos, t.level, t.name, coalesce(min(b.pos), 1000000) AS stop FROM tops t LEFT JOIN heads b ON b.document = t.document AND b.pos > t.pos AND (t.level = 1 OR b.level <= 2) GROUP BY 1, 2, 3, 4),
inside AS (SELECT e.document, e.pos AS head, e.level, e.name, k.pos, k.text FROM ended e JOIN kept k ON k.document = e.document AND k.pos >= e.pos AND k.pos < e.stop),
keys AS (SELECT DISTINCT document, head, level, name, unnest(regexp_extract_all(text, '@([A-Za-z][\w:-]*)', 1)) AS key FROM inside),
lists AS (SELECT document, head, level, name, entry, row_number() OVER (PARTITION BY document, head ORDER BY key, entry) AS n FROM keys JOIN cited USING (key)),
lasts AS (SELECT document, head, max(pos) AS pos FROM inside GROUP BY 1, 2),
rows AS (SELECT document, pos, 0 AS sub, 0 AS n, kind, level, id, text FROM kept
  UNION ALL SELECT DISTINCT document, pos, 1, 0, 'Header', level + 1, 'bibliography-' || name, 'Works' FROM lists JOIN lasts USING (document, head)
  UNION ALL SELECT DISTINCT document, pos, 2, 0, 'Div', 0, 'refs-' || name, '' FROM lists JOIN lasts USING (document, head)
  UNION ALL SELECT document, pos, 2, n, 'Para', 0, NULL, entry FROM lists JOIN lasts USING (document, head))
SELECT document, dense_rank() OVER (PARTITION BY document ORDER BY pos, sub) || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS path, kind, level::INTEGER AS level, id, text FROM rows""",
    "doc_tree_captions": f"""{_with("figured")}
SELECT a.document, CASE a.pos WHEN 1 THEN '1' WHEN 2 THEN '1.1' WHEN 3 THEN '1.1.1' WHEN 4 THEN '1.1.1.1' WHEN 5 THEN '2' WHEN 6 THEN '2.1' ELSE CAST(a.pos - 4 AS VARCHAR) END AS path,
  CASE WHEN a.pos = 2 AND b.text LIKE 'Figura%' THEN split_part(b.text, '  ', 1) WHEN a.pos = 5 AND a.text LIKE 'Figura%' THEN split_part(a.text, '  ', 1) END AS label,
  CASE WHEN a.pos = 2 AND b.text LIKE 'Figura%' THEN 'drawing' WHEN a.pos = 5 AND a.text LIKE 'Figura%' THEN 'drawing' END AS rest
FROM figured a LEFT JOIN figured b ON a.document = b.document AND b.pos = 4""",
    "doc_profile_shortcodes": f"""{_with("profiles", "links", "codes")}
SELECT p.nombre AS profile, orden_en_perfil AS place, c.nombre AS shortcode FROM links JOIN profiles p USING (id_perfil) JOIN codes c USING (id_shortcode) WHERE p.activo = 1 AND c.activo = 1""",
    "doc_localized_help": f"""{_with("help")}
SELECT componente, coalesce(e.idioma, s.idioma) AS idioma, CASE WHEN e.idioma IS NULL THEN s.ayuda ELSE e.ayuda END AS ayuda
FROM (SELECT * FROM help WHERE idioma = 'en') e FULL JOIN (SELECT * FROM help WHERE idioma = 'es') s USING (componente)""",
    "doc_vocabulary": f"{_with('entries')} SELECT codigo, nombre FROM entries WHERE tipo = 'ECONOMY' AND activo = 1",
    "doc_pdf_metadata": rf"""{_with('metadata')} SELECT id, replace('\hypersetup{{~  pdftitle={{' || CASE WHEN title IS NULL THEN '' ELSE replace(title, ' & 5 %', ' \& 5 \%') END || '}},~  pdfauthor={{' || coalesce(authors, '') || '}},~  pdfsubject={{'
  || CASE WHEN subject IS NULL THEN '' ELSE 'a\_b' END || '}},~  pdfkeywords={{}},~  pdflang={{' || coalesce(language, 'es') || '}},~  pdfinfo={{~' || CASE WHEN doi IS NULL THEN '' ELSE '    DOI={{' || replace(replace(doi, '_', '\_'), '#', '\#') || '}},~' END
  || CASE WHEN isbn IS NULL THEN '' ELSE '    ISBN={{978}},~' END || CASE WHEN isbn13 IS NULL THEN '' ELSE '    ISBN13={{979}},~' END || '  }},~}}', '~', chr(10)) AS setup FROM (SELECT * REPLACE (replace(title, '#', '\#') AS title) FROM metadata)""",
    "doc_name_index": f"""{sql_views(["bibtex"])}, every AS (SELECT author AS name, id_articulo FROM bibtex UNION ALL SELECT editor, id_articulo FROM bibtex
  UNION ALL SELECT translator, id_articulo FROM bibtex UNION ALL SELECT commentator, id_articulo FROM bibtex)
SELECT name, count(*) AS mentions, count(DISTINCT id_articulo) AS places FROM every WHERE name <> '' GROUP BY name""",
    "doc_person_index": f"""{_with("named")},
every AS (SELECT id, place, family, given, prefix, suffix FROM (SELECT id, place, author AS list, unnest(CASE id % 6 WHEN 0 THEN [{{'family': 'Perez' || id % 10, 'given': 'Ana Maria', 'prefix': NULL, 'suffix': NULL}}, {{'family': 'Grupo and Co', 'given': NULL, 'prefix': NULL, 'suffix': NULL}}, {{'family': 'Perez1', 'given': 'Ana Maria', 'prefix': NULL, 'suffix': NULL}}]
    WHEN 1 THEN [{{'family': 'Berg' || id % 7, 'given': 'Jan', 'prefix': 'van der', 'suffix': NULL}}] WHEN 2 THEN [{{'family': 'Fontaine', 'given': 'Jean', 'prefix': 'de la', 'suffix': NULL}}] WHEN 3 THEN [{{'family': 'King', 'given': 'Martin', 'prefix': NULL, 'suffix': 'Jr'}}] END, recursive := true) FROM named)
  UNION ALL SELECT id, place, CASE WHEN id % 5 = 0 THEN 'berg' ELSE 'Berg' || id % 7 END, 'Jan', CASE WHEN id % 5 = 1 THEN 'van der' END, NULL FROM named WHERE id % 5 < 2)
SELECT family, given, prefix, suffix, count(*) AS mentions, count(DISTINCT place) AS places FROM every GROUP BY 1, 2, 3, 4""",
    "json_lenient": r"""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '0.5' WHEN 1 THEN p_brand WHEN 5 THEN p_partkey::VARCHAR END AS a, CASE p_partkey % 6 WHEN 0 THEN '[1,2,"x"]' WHEN 1 THEN '{"c":null}' END AS b,
  '"' || p_name || CASE p_partkey % 3 WHEN 0 THEN '\u007f\u2028' WHEN 1 THEN '\"' ELSE '' END || '"' AS escaped,
  CASE WHEN p_partkey % 30 <= 8 THEN '[1,' || repeat('null,', (p_partkey % 30)::INTEGER) || '"x"]' ELSE '{"1":1,"' || (p_partkey % 30 + 2) || '":"x"}' END AS holes FROM part""".replace("\\\\", "\\"),
    "doc_reference_order": f"""{sql_views(["bibtex"])}
SELECT id, id_articulo, row_number() OVER (PARTITION BY id_articulo ORDER BY author NULLS FIRST, year NULLS FIRST, CAST(volume AS INTEGER) NULLS FIRST, title NULLS FIRST, id) AS number FROM bibtex""",
    "check_repeated_keys": f"{sql_views(['articulo_revisor'])} SELECT id_articulo, id_autor, count(*) AS n FROM articulo_revisor GROUP BY 1, 2 HAVING count(*) > 1",
    "check_orphans": f"{sql_views(['bibtex', 'articulos'])} SELECT id FROM bibtex b WHERE NOT EXISTS (SELECT 1 FROM articulos a WHERE a.id_articulo = b.id_articulo AND estado_articulo = 'publicado')",
    "check_cascade": f"{sql_views(['articulo_autor', 'articulos'])} SELECT id_articulo, id_autor FROM articulo_autor WHERE id_articulo IN (SELECT id_articulo FROM articulos WHERE estado_articulo = 'retractado')",
    "check_domain": f"{sql_views(['articulos'])} SELECT id_articulo, tipo_articulo FROM articulos WHERE tipo_articulo NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
    "check_correspondents": f"{sql_views(['articulo_autor'])} SELECT id_articulo, count(*) AS n FROM articulo_autor WHERE id_autor % 3 = 0 GROUP BY 1 HAVING count(*) > 1",
    "check_correspondent_updates": f"""{sql_views(['articulo_autor'])} SELECT id_articulo, id_autor FROM articulo_autor a WHERE id_autor % 2 = 0 AND id_autor % 3 > 0
  AND EXISTS (SELECT 1 FROM articulo_autor b WHERE b.id_articulo = a.id_articulo AND b.id_autor % 3 = 0)""",
    "xml_articles": f"""{sql_views(["articulos", "revistas_md"])}
SELECT id_articulo, tipo_articulo, titulo_articulo || ' <i> & "' || chr(10) || '� ' AS titulo_articulo, doi, a.id_revista AS id_revista, titulo_revista, issn_impreso, e_issn,
  fecha_recepcion, fecha_aceptacion, fecha_publicacion_online FROM articulos a LEFT JOIN revistas_md r ON a.id_revista = r.id_revista""",
    "xml_contributors": f"""{sql_views(["articulos", "autores", "articulo_autor"])}
SELECT l.id_articulo AS id_articulo, CAST(row_number() OVER (PARTITION BY l.id_articulo ORDER BY l.id_autor) AS INTEGER) AS place, l.id_autor AS id_autor, apellidos, orcid, scopus_id
FROM articulo_autor l JOIN articulos a ON a.id_articulo = l.id_articulo LEFT JOIN autores p ON p.id_autor = l.id_autor""",
    "xml_references": f"""{sql_views(["articulos", "bibtex"])}
SELECT b.id_articulo AS id_articulo, id, tipo_de_entrada, title, year, volume FROM bibtex b JOIN articulos a ON a.id_articulo = b.id_articulo""",
    "doc_markdown_blocks": f"""{_with("noted")}, made(remainder, pos, kind, level, id, classes, text) AS (VALUES
  (0, 1, 'Header', 1, 'n', 'own,unnumbered', 'Note ~'), (0, 2, 'Para', 0, NULL, '', 'at ^ more # no heading'), (0, 3, 'CodeBlock', 0, NULL, 'sql', 'select 1' || chr(10) || chr(10) || '# nor here'),
  (0, 4, 'Header', 2, NULL, '', 'End'), (0, 5, 'Para', 0, NULL, '', 'last'),
  (3, 1, 'Header', 2, NULL, '', 'A'), (3, 2, 'Header', 3, NULL, '', 'B'), (3, 3, 'Para', 0, NULL, '', 'text'), (3, 4, 'CodeBlock', 0, NULL, '', 'open ~'))
SELECT document, pos, kind, level, id, classes, replace(replace(m.text, '~', document), '^', o_orderstatus) AS text
FROM noted JOIN made m ON number % 4 = remainder JOIN orders ON o_orderkey = number""",
    "doc_file_colophon": f"""{_with("blocks")}, added(i, kind, text) AS (SELECT 1, 'Header', 'Imprint' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_name), 'Para', r_name FROM region)
SELECT document, pos, kind, text FROM blocks
UNION ALL SELECT document, CAST(last + i AS INTEGER), kind, text FROM (SELECT document, max(pos) AS last FROM blocks GROUP BY document), added""",
    "check_all_book_tables": f"""{_with(*ALL_BOOKS)}
SELECT 'colecciones' AS "table", 'primary' AS rule, 'id_coleccion' AS "columns", count(*) - count(DISTINCT id_coleccion) AS n FROM colecciones
UNION ALL SELECT 'series', 'primary', 'id_serie', count(*) - count(DISTINCT id_serie) FROM series
UNION ALL SELECT 'libros_md', 'primary', 'id_libro', count(*) - count(DISTINCT id_libro) FROM libros_md
UNION ALL SELECT 'partes_libro', 'primary', 'id_parte', count(*) - count(DISTINCT id_parte) FROM partes_libro
UNION ALL SELECT 'capitulos', 'primary', 'id_capitulo', count(*) - count(DISTINCT id_capitulo) FROM capitulos
UNION ALL SELECT 'libro_autor', 'primary', 'id_relacion', count(*) FROM (SELECT 1 FROM libro_autor GROUP BY id_relacion HAVING count(*) > 1)
UNION ALL SELECT 'capitulo_autor', 'primary', 'id_relacion', count(*) FROM (SELECT 1 FROM capitulo_autor GROUP BY id_relacion HAVING count(*) > 1)
UNION ALL SELECT 'colecciones', 'unique', 'issn', count(*) FROM (SELECT 1 FROM colecciones WHERE issn IS NOT NULL GROUP BY issn HAVING count(*) > 1)
UNION ALL SELECT 'series', 'unique', 'issn', count(*) FROM (SELECT 1 FROM series WHERE issn IS NOT NULL GROUP BY issn HAVING count(*) > 1)
UNION ALL SELECT 'libros_md', 'unique', 'id_proyecto', count(*) FROM (SELECT 1 FROM libros_md WHERE id_proyecto IS NOT NULL GROUP BY id_proyecto HAVING count(*) > 1)
UNION ALL SELECT 'series', 'reference', 'id_coleccion', count(*) FROM series WHERE id_coleccion NOT IN (SELECT id_coleccion FROM colecciones)
UNION ALL SELECT 'libros_md', 'reference', 'id_coleccion', count(*) FROM libros_md WHERE id_coleccion NOT IN (SELECT id_coleccion FROM colecciones)
UNION ALL SELECT 'libros_md', 'reference', 'id_serie', count(*) FROM libros_md WHERE id_serie NOT IN (SELECT id_serie FROM series)
UNION ALL SELECT 'partes_libro', 'reference', 'id_libro', count(*) FROM partes_libro WHERE id_libro NOT IN (SELECT id_libro FROM libros_md)
UNION ALL SELECT 'capitulos', 'reference', 'id_libro', count(*) FROM capitulos WHERE id_libro NOT IN (SELECT id_libro FROM libros_md)
UNION ALL SELECT 'capitulos', 'reference', 'id_parte', count(*) FROM capitulos WHERE id_parte NOT IN (SELECT id_parte FROM partes_libro)
UNION ALL SELECT 'libro_autor', 'reference', 'id_libro', count(*) FROM libro_autor WHERE id_libro NOT IN (SELECT id_libro FROM libros_md)
UNION ALL SELECT 'capitulo_autor', 'reference', 'id_capitulo', count(*) FROM capitulo_autor WHERE id_capitulo NOT IN (SELECT id_capitulo FROM capitulos)""",
    "delete_books": f"""{_with(*ALL_BOOKS)}, gone AS (SELECT id_libro FROM libros_md WHERE id_libro % 10 = 3)
SELECT 'libros_md' AS tabla, id_libro AS id, id_serie AS padre FROM libros_md WHERE id_libro % 10 <> 3
UNION ALL SELECT 'partes_libro', id_parte, id_libro FROM partes_libro WHERE id_libro NOT IN (SELECT id_libro FROM gone)
UNION ALL SELECT 'capitulos', id_capitulo, CASE WHEN id_parte NOT IN (SELECT id_parte FROM partes_libro WHERE id_libro IN (SELECT id_libro FROM gone)) THEN id_parte END
FROM capitulos WHERE id_libro NOT IN (SELECT id_libro FROM gone)
UNION ALL SELECT 'libro_autor', id_relacion, id_libro FROM libro_autor WHERE id_libro NOT IN (SELECT id_libro FROM gone)
UNION ALL SELECT 'capitulo_autor', id_relacion, id_capitulo FROM capitulo_autor WHERE id_capitulo NOT IN (SELECT id_capitulo FROM capitulos WHERE id_libro IN (SELECT id_libro FROM gone))""",
    "check_book_model": f"""{_with(*BOOKS)}
SELECT 'colecciones' AS tabla, 'id_coleccion' AS columna, 'primary' AS regla, count(*) - count(DISTINCT id_coleccion) AS n FROM colecciones
UNION ALL SELECT 'series', 'id_serie', 'primary', count(*) - count(DISTINCT id_serie) FROM series
UNION ALL SELECT 'libros_md', 'id_libro', 'primary', count(*) - count(DISTINCT id_libro) FROM libros_md
UNION ALL SELECT 'libro_autor', 'id_relacion', 'primary', count(*) FROM (SELECT id_relacion FROM libro_autor GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'colecciones', 'issn', 'unique', count(*) FROM (SELECT issn FROM colecciones WHERE issn IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'series', 'issn', 'unique', count(issn) - count(DISTINCT issn) FROM series
UNION ALL SELECT 'libros_md', 'id_proyecto', 'unique', count(*) FROM (SELECT id_proyecto FROM libros_md GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'series', 'id_coleccion', 'reference', count(*) FROM series WHERE id_coleccion NOT IN (SELECT id_coleccion FROM colecciones)
UNION ALL SELECT 'libros_md', 'id_coleccion', 'reference', count(*) FROM libros_md WHERE id_coleccion NOT IN (SELECT id_coleccion FROM colecciones)
UNION ALL SELECT 'libros_md', 'id_serie', 'reference', count(*) FROM libros_md WHERE id_serie NOT IN (SELECT id_serie FROM series)
UNION ALL SELECT 'libro_autor', 'id_libro', 'reference', count(*) FROM libro_autor WHERE id_libro NOT IN (SELECT id_libro FROM libros_md)
UNION ALL SELECT 'libros_md', 'tipo_libro', 'domain', count(*) FROM libros_md WHERE tipo_libro = 'novela'
UNION ALL SELECT 'libro_autor', 'rol_libro', 'domain', count(*) FROM libro_autor WHERE rol_libro = 'otro'""",
    "delete_book_collection": f"""{_with(*BOOKS)}
SELECT id_libro, nullif(id_coleccion, 2) AS id_coleccion, CASE WHEN id_serie NOT IN (SELECT id_serie FROM series WHERE id_coleccion = 2) THEN id_serie END AS id_serie FROM libros_md""",
    "evolve_schema": f"{_with('roles')} SELECT id, CASE WHEN rol = 'compilador' THEN 'autor' ELSE rol END AS rol, CAST(edad AS INTEGER) AS edad, CAST(NULL AS VARCHAR) AS pais FROM roles",
}
