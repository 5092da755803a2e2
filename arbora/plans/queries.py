"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import render, text
from arbora.operators import calls, graph, imports, names, structure
from arbora.operators.lineage import columnar
from arbora.operators.parse import parse_files, table
from arbora.plans import corpus
from arbora.sources import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with each row's place in it: ``file_no``, by path, and ``row_no``."""
    rows = _read(spark, sf_dir, name).withColumns({"row_no": F.col("_metadata.row_index"), "at": F.col("_metadata.file_path")})
    paths = sorted(r["at"] for r in rows.select("at").distinct().collect())
    files = spark.createDataFrame(list(enumerate(paths)), "file_no int, path string")
    return rows.join(F.broadcast(files), F.col("at") == F.col("path")).drop("at", "path")


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t == "int"})


# Source analytics over the generated project.


@query(corpus.SQL + "SELECT caller_id, callee_id, CAST(line AS BIGINT) AS line, label, CAST(confidence AS DOUBLE) AS confidence FROM e")
def call_edges(spark, sf_dir):
    return _long(calls.call_edges(corpus.parsed(spark, sf_dir)).select("caller_id", "callee_id", "line", "label", F.col("confidence").cast("double").alias("confidence")))


@query(corpus.SQL + "SELECT caller_id AS from_id, callee_id AS to_id, 'calls' AS type, label || ':' || line AS label FROM e")
def call_graph_edges(spark, sf_dir):
    parsed = corpus.parsed(spark, sf_dir)
    return calls.call_graph(parsed, calls.call_edges(parsed))[1].select("from_id", "to_id", "type", "label")


@query(corpus.SQL + """, p AS (SELECT path, n, 2 + c + 8 * k AS b FROM m)
SELECT id, type, name, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM (
SELECT id, 'function' AS type, 'f_' || s AS name, b + 1 AS line_start, b + 7 AS line_end FROM f
UNION ALL SELECT path || ':function:use_' || n, 'function', 'use_' || n, b + 7, b + 10 FROM p
UNION ALL SELECT path || ':class:C_' || n, 'class', 'C_' || n, b + 1, b + 5 FROM p
UNION ALL SELECT path || ':global:G_' || n, 'global', 'G_' || n, b + 6, b + 6 FROM p
UNION ALL SELECT path || ':module:n' || n || '.py', 'module', 'n' || n || '.py', 1, b + 10 FROM p
UNION ALL SELECT DISTINCT 'r' || r || '/__init__.py:module:__init__.py', 'module', '__init__.py', 1, 1 FROM m)""")
def symbols_nodes(spark, sf_dir):
    return _long(names.symbols(corpus.parsed(spark, sf_dir)).select("id", "type", "name", "line_start", "line_end"))


@query(corpus.SQL + """, s AS (SELECT 'function' AS type FROM f UNION ALL SELECT 'function' FROM m UNION ALL SELECT 'class' FROM m UNION ALL SELECT 'global' FROM m UNION ALL SELECT 'module' FROM m UNION ALL SELECT 'module' FROM (SELECT DISTINCT r FROM m))
SELECT coalesce(type, 'total') AS type, count(*) AS n FROM s GROUP BY ROLLUP (type)""")
def symbol_summary(spark, sf_dir):
    return structure.symbol_summary(names.symbols(corpus.parsed(spark, sf_dir)))


_IMPORTS = corpus.SQL + """, i AS (
  SELECT 'file:' || path AS from_id, 'file:' || tpath AS to_id, 'f_' || t AS label, 'project' AS kind, 2 + iline AS line, 'r' || tr || '.n' || tn AS name FROM f WHERE across
  UNION ALL SELECT 'file:' || path, '@os', '', 'stdlib', 1, 'os' FROM m UNION ALL SELECT 'file:' || path, '@json', '', 'stdlib', 2, 'json' FROM m)
"""


@query(_IMPORTS.replace("@", "module:") + "SELECT from_id, to_id, label, kind, CAST(line AS BIGINT) AS line FROM i")
def import_edges_brief(spark, sf_dir):
    return _long(imports.brief_graph(corpus.parsed(spark, sf_dir))[1].select("from_id", "to_id", "label", "kind", "line"))


@query(_IMPORTS.replace("@", "builtin:") + "SELECT from_id, to_id, label, kind, CAST(line AS BIGINT) AS line FROM i")
def import_edges_resolved(spark, sf_dir):
    return _long(imports.resolved_graph(corpus.parsed(spark, sf_dir)))


@query(_IMPORTS + """, b AS (SELECT CASE WHEN kind = 'stdlib' THEN 'system' ELSE kind END AS bucket, name FROM i)
SELECT a.bucket, count(b.bucket) AS n, count(DISTINCT b.name) AS n_names FROM (VALUES ('project'), ('system'), ('unresolved')) a(bucket) LEFT JOIN b ON a.bucket = b.bucket GROUP BY 1""")
def dependency_summary(spark, sf_dir):
    return imports.summary(imports.resolutions(corpus.parsed(spark, sf_dir)))


#: Pairs of customers' functions and their callers of any depth.
_PAIRS = corpus.SQL + """, reach AS (SELECT s AS seed, s AS node, false AS moved FROM f UNION SELECT reach.seed, f.s, true FROM reach JOIN f ON f.t = reach.node),
pairs AS (SELECT DISTINCT seed, node FROM reach WHERE moved)
"""
#: Pairs of all nodes of the call graph and their callers of any depth.
_CLOSURE = corpus.SQL + """, reach AS (SELECT callee_id AS seed, caller_id AS node FROM e UNION SELECT reach.seed, e.caller_id FROM reach JOIN e ON e.callee_id = reach.node)
"""


@query(_CLOSURE + "SELECT seed, node FROM reach")
def transitive_callers(spark, sf_dir):
    edges = graph.cut(calls.call_edges(corpus.parsed(spark, sf_dir)).select("caller_id", "callee_id").distinct())
    called = edges.select("callee_id").distinct()
    return graph.closure(edges, called.select(F.col("callee_id").alias("seed"), F.col("callee_id").alias("node")))


@query(_CLOSURE + "SELECT seed, count(*) AS impacted FROM reach GROUP BY 1")
def impact_counts(spark, sf_dir):
    return transitive_callers(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("impacted"))


@query(corpus.SQL + "SELECT caller_id, callee_id, CAST(line AS BIGINT) AS line FROM e WHERE contains(callee_id, ':function:f_1')")
def callers_of(spark, sf_dir):
    edges = calls.call_edges(corpus.parsed(spark, sf_dir))
    return _long(graph.neighbours(edges, "callee_id", ":function:f_1").select("caller_id", "callee_id", "line"))


@query(corpus.SQL + "SELECT caller_id, callee_id, CAST(line AS BIGINT) AS line FROM e WHERE contains(caller_id, ':function:f_2')")
def callees_of(spark, sf_dir):
    edges = calls.call_edges(corpus.parsed(spark, sf_dir))
    return _long(graph.neighbours(edges, "caller_id", ":function:f_2").select("caller_id", "callee_id", "line"))


def _impact(spark, sf_dir, target, resolved=None):
    parsed = corpus.parsed(spark, sf_dir)
    edges = graph.cut(calls.call_edges(parsed))
    functions = graph.cut(calls.functions(parsed))
    return graph.impact(edges, imports.brief_graph(parsed)[1], functions, target, resolved)[0]


@query(_PAIRS + """SELECT b.id FROM pairs p JOIN f b ON b.s = p.node WHERE p.seed = 1 UNION SELECT id FROM f WHERE s = 1""")
def impact_symbol(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    row = _read(spark, sf_dir, "customer").where("c_custkey = 1").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).first()
    target = f"r{row['n_regionkey']}/n{row['n_nationkey']}.py:function:f_1"
    return _impact(spark, sf_dir, target, target)


@query(_PAIRS + """, target AS (SELECT path FROM m WHERE n = 3),
own AS (SELECT path || ':function:use_' || n AS id FROM m WHERE n = 3 UNION SELECT path || ':function:C_' || n || '.run' FROM m WHERE n = 3)
SELECT id FROM own UNION SELECT b.id FROM pairs p JOIN f a ON a.s = p.seed JOIN f b ON b.s = p.node WHERE a.n = 3
UNION SELECT 'file:' || path FROM target UNION SELECT 'file:' || f.path FROM f WHERE across AND tn = 3""")
def impact_file(spark, sf_dir):
    return _impact(spark, sf_dir, "n3.py")


@query(corpus.SQL + """, k AS (SELECT path AS rel_path, 'f_' || s AS name, s % 6 + 1 AS complexity FROM f
UNION ALL SELECT path, 'C_' || n || '.run', 1 FROM m UNION ALL SELECT path, 'C_' || n || '.step', 1 FROM m UNION ALL SELECT path, 'use_' || n, 1 FROM m)
SELECT rel_path, name, CAST(complexity AS BIGINT) AS complexity, CASE WHEN complexity <= 5 THEN 'A' ELSE 'B' END AS rank FROM k""")
def complexity_rank(spark, sf_dir):
    return _long(structure.complexity(corpus.parsed(spark, sf_dir)).select("rel_path", "name", "complexity", "rank"))


@query(corpus.SQL + """SELECT path AS rel_path, CAST(2 AS BIGINT) AS line, '''json'' imported but unused' AS message FROM m WHERE n % 2 = 1
UNION ALL SELECT path, 1, '''os'' imported but unused' FROM m WHERE k = 0""")
def lint_findings(spark, sf_dir):
    return _long(structure.lint(corpus.parsed(spark, sf_dir)))


@query(corpus.SQL + """SELECT path AS rel_path, 'f_' || s AS qualname FROM f WHERE s NOT IN (SELECT t FROM f) UNION ALL SELECT path, 'use_' || n FROM m""")
def dead_code(spark, sf_dir):
    return structure.dead_code(corpus.parsed(spark, sf_dir)).select("rel_path", "qualname")


@query(corpus.SQL + """SELECT name, count(*) AS n FROM (SELECT 'f_' || t AS name FROM f UNION ALL SELECT 'C_' || n FROM m UNION ALL SELECT 'step' FROM m UNION ALL SELECT 'run' FROM m UNION ALL SELECT 'run' FROM f) GROUP BY 1""")
def usages(spark, sf_dir):
    return structure.usages(corpus.parsed(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


@query(corpus.SQL + """, g AS (SELECT id, unnest([0, 1, 2, 3, 4, 5]) AS i, b FROM f)
SELECT id || ':entry' AS from_id, id || ':cfg:' || CASE WHEN i < 5 THEN '_CodeBlock' ELSE '_ReturnFrag' END || ':' || i || ':' || (b + 2 + i) AS to_id FROM g
UNION ALL SELECT path || ':function:run:entry', path || ':function:run:cfg:_CodeBlock:0:' || (2 + c + 8 * k + 3) FROM m
UNION ALL SELECT path || ':function:step:entry', path || ':function:step:cfg:_ReturnFrag:0:' || (2 + c + 8 * k + 5) FROM m
UNION ALL SELECT path || ':function:use_' || n || ':entry', path || ':function:use_' || n || ':cfg:_CodeBlock:' || i || ':' || (2 + c + 8 * k + 8 + i) FROM m, (VALUES (0), (1), (2)) v(i)""")
def cfg_containment(spark, sf_dir):
    return structure.control_flow(corpus.parsed(spark, sf_dir))[1].select("from_id", "to_id")


#: Every symbol of the project, in ``k``.
_KNOWN = corpus.SQL + """, k AS (SELECT path || ':' || type || ':' || name AS id, regexp_replace(path, '.*/', '') || ':' || type || ':' || name AS legacy_id, type, name FROM (
SELECT path, 'function' AS type, 'f_' || s AS name FROM f UNION ALL SELECT path, 'function', 'use_' || n FROM m UNION ALL SELECT path, 'class', 'C_' || n FROM m
UNION ALL SELECT path, 'global', 'G_' || n FROM m UNION ALL SELECT path, 'module', 'n' || n || '.py' FROM m UNION ALL SELECT DISTINCT 'r' || r || '/__init__.py', 'module', '__init__.py' FROM m))
"""


@query(_KNOWN + """SELECT id AS reference, id, 'resolved' AS outcome FROM k
UNION SELECT name, CASE WHEN type = 'function' THEN id END, CASE WHEN type = 'function' THEN 'resolved' ELSE 'missing' END FROM k
UNION SELECT legacy_id, CASE WHEN count(*) = 1 THEN min(id) END, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'missing' END FROM k GROUP BY 1
UNION SELECT 'no_such', NULL, 'missing'""")
def resolve_reference(spark, sf_dir):
    """The id, bare name and legacy id of every symbol."""
    known = graph.cut(names.symbols(corpus.parsed(spark, sf_dir)))
    asked = known.select(F.col("id").alias("reference")).union(known.select("name")).union(known.select("legacy_id")).union(spark.createDataFrame([("no_such",)], "reference string"))
    return names.resolve_references(asked, known)


@query(_KNOWN + "SELECT legacy_id, min(id) AS id FROM k GROUP BY 1 HAVING count(*) = 1")
def legacy_alias_unique(spark, sf_dir):
    return names.unique_aliases(names.symbols(corpus.parsed(spark, sf_dir)))


@query(_KNOWN + "SELECT id, replace(regexp_replace(id, '[:][a-z]+[:].*$', ''), '/', '__path__') || '__' || type || '__' || name AS key, id AS back FROM k")
def symbol_key_codec(spark, sf_dir):
    ids = names.symbols(corpus.parsed(spark, sf_dir)).select("id")
    coded = ids.withColumn("key", names.encode_key(F.col("id")))
    return coded.withColumn("back", names.decode_key(F.col("key")))


@query(corpus.SQL + """SELECT path AS rel_path, n % 4 = 1 AS import_graph, n % 4 = 1 OR n % 4 = 0 AS call_index, n % 4 = 2 AS reverse_index, n % 4 < 3 AS content FROM m
UNION ALL SELECT DISTINCT 'r' || r || '/__init__.py', false, false, false, false FROM m""")
def facet_changes(spark, sf_dir):
    """A second version with another call (0), another import (1) or another name (2), by nation modulo 4.

    Both versions are written, and then parsed once each in one job, into the tables that signatures read.
    """
    kind = F.regexp_extract("rel_path", r"n(\d+)\.py$", 1)
    kind = F.when(kind != "", F.pmod(F.try_to_number(kind, F.lit("99999")).cast("int"), F.lit(4)))
    changed = F.when(kind == 0, F.replace("source", F.lit("        self.step()"), F.lit("        self.stop()"))).when(kind == 1, F.replace("source", F.lit("import json"), F.lit("import math"))).when(kind == 2, F.regexp_replace("source", r"(?m)^G_", "H_")).otherwise(F.col("source"))
    both = columnar(corpus.files(spark, sf_dir).withColumn("changed", changed))
    old, new = both.select("rel_path", "source"), both.select("rel_path", F.col("changed").alias("source"))
    rows = [parse_files(corpus.spread(v), tables=structure.SIGNED).withColumn("version", F.lit(k)) for k, v in enumerate((old, new))]
    parsed = columnar(rows[0].union(rows[1]), "version", "tab")
    return structure.changed_layers(*[structure.signatures(parsed.where(F.col("version") == k), v) for k, v in enumerate((old, new))])


@query(corpus.SQL + "SELECT DISTINCT split_part('os', '.', 1) AS package FROM m WHERE false")
def unresolved_packages(spark, sf_dir):
    return imports.unresolved_packages(imports.resolutions(corpus.parsed(spark, sf_dir)))


@query(corpus.SQL + """, nodes AS (SELECT 'file:' || path AS id FROM m UNION SELECT DISTINCT 'file:r' || r || '/__init__.py' FROM m),
z AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS k, count(*) OVER () AS n FROM nodes)
SELECT id, round(480 + (220 + least(n, 40) * 4.0) * cos(2 * pi() * k / n), 6) + 0.0 AS x, round(360 + (220 + least(n, 40) * 4.0) * sin(2 * pi() * k / n), 6) + 0.0 AS y FROM z""")
def layout_positions(spark, sf_dir):
    nodes = imports.brief_graph(corpus.parsed(spark, sf_dir))[0].where("type = 'file'")
    return render.circle(nodes).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(corpus.SQL + """, pairs AS (SELECT path AS source, tpath AS target, string_agg(DISTINCT 'f_' || t, ', ' ORDER BY 'f_' || t) AS labels FROM f WHERE across GROUP BY 1, 2)
SELECT source, target, '"' || source || '" -> "' || target || '" [label="' || labels || '"];' AS text FROM pairs""")
def dot_text(spark, sf_dir):
    edges = imports.brief_graph(corpus.parsed(spark, sf_dir))[1].where("kind = 'project'")
    return render.dot(edges.select(F.substring("from_id", 6, 1000).alias("source"), F.substring("to_id", 6, 1000).alias("target"), "label"))


@query(corpus.SQL + """, z AS (SELECT path || ':class:C_' || n AS id, 'C_' || n AS name FROM m), o AS (SELECT name, row_number() OVER (ORDER BY id) - 1 AS k FROM z)
SELECT CAST(1 AS BIGINT) AS line, 'flowchart LR' AS text UNION ALL SELECT k + 2, '  n' || k || '["' || name || '"]' FROM o""")
def mermaid_lines(spark, sf_dir):
    nodes = names.symbols(corpus.parsed(spark, sf_dir)).where("type = 'class'").select("id", "name")
    return render.mermaid(nodes, spark.createDataFrame([], "from_id string, to_id string, label string"))


@query(corpus.SQL + """, d AS (SELECT 'r' || r || '/__init__.py' AS path, 'r' || r || '(__init__)' AS title, 'project' AS kind, 0 AS classes, 0 AS funcs, 0 AS globs FROM m GROUP BY r
UNION ALL SELECT path, 'n' || n, 'project', 1, k + 1, 1 FROM m UNION ALL SELECT * FROM (VALUES ('os', 'os', 'system', 0, 0, 0), ('json', 'json', 'system', 0, 0, 0)))
SELECT path, title, kind, CAST(classes AS BIGINT) AS classes, CAST(funcs AS BIGINT) AS funcs, CAST(globs AS BIGINT) AS globs FROM d""")
def diagram_modules(spark, sf_dir):
    parsed = corpus.parsed(spark, sf_dir)
    return imports.diagram(parsed, imports.resolutions(parsed))[0].drop("docstring")


@query(corpus.SQL + """SELECT path AS source, tpath AS target, string_agg(DISTINCT 'f_' || t, ', ' ORDER BY 'f_' || t) AS label FROM f WHERE across GROUP BY 1, 2
UNION ALL SELECT path, 'os', '' FROM m UNION ALL SELECT path, 'json', '' FROM m""")
def diagram_connections(spark, sf_dir):
    parsed = corpus.parsed(spark, sf_dir)
    return imports.diagram(parsed, imports.resolutions(parsed))[1]


@query(corpus.SQL + """SELECT path AS rel_path, 'f_' || s AS qualname, 'def f_' || s || '(x)' AS shown FROM f UNION ALL SELECT path, 'use_' || n, 'def use_' || n || '()' FROM m
UNION ALL SELECT path, 'C_' || n, 'class C_' || n FROM m UNION ALL SELECT path, 'C_' || n || '.run', 'def run(self)' FROM m UNION ALL SELECT path, 'C_' || n || '.step', 'def step(self)' FROM m""")
def signatures_shown(spark, sf_dir):
    return structure.signatures_shown(corpus.parsed(spark, sf_dir))


@query(_KNOWN + """SELECT id, '{"id":"' || id || '","name":"' || name || '"}' AS json FROM k""")
def graph_json(spark, sf_dir):
    nodes = names.symbols(corpus.parsed(spark, sf_dir)).select("id", "name")
    return graph.node_json(nodes)


@query("""SELECT DISTINCT unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[1:k], '.'))) AS module FROM (SELECT ['lib', replace(lower(p_brand), '#', '_'), 'p' || p_size] AS p FROM part)""")
def dir_modules(spark, sf_dir):
    path = F.concat(F.lit("lib/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("/p"), F.col("p_size").cast("string"), F.lit(".py"))
    return imports.dir_modules(_read(spark, sf_dir, "part").select(path.alias("rel_path")))


@query()
def disassembly(spark, sf_dir):
    from arbora.functions.bytecode import disassemble

    return disassemble(corpus.files(spark, sf_dir))


# The kernel over the tables.


@query("""SELECT page_id, url FROM pages WHERE len(list_filter(string_split(url, '/'), lambda p: p <> '' AND p <> '.pylintrc' AND regexp_full_match(p, '^\\..*|.*\\.pyc|.*\\.pyo|.*\\.swp|.*~|__pycache__|node_modules'))) = 0""")
def scan_exclude_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").where(scan.kept_names(F.col("url"))).select("page_id", "url")


@query("""SELECT page_id FROM pages WHERE NOT (starts_with(regexp_replace(url, '^[a-z]+://', ''), 'spam-farm.example.org/') OR starts_with(regexp_replace(url, '^[a-z]+://', ''), 'www.cheap-pills.example.com/en/'))""")
def scan_exclude_prefix(spark, sf_dir):
    paths = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"))
    return scan.outside(paths, ["spam-farm.example.org", "www.cheap-pills.example.com/en"]).select("page_id")


@query("""SELECT p_partkey, 'lib/' || replace(lower(p_brand), '#', '_') || CASE WHEN p_partkey % 10 = 0 THEN '/__init__.py' ELSE '/p' || p_partkey || '.py' END AS rel_path,
'lib.' || replace(lower(p_brand), '#', '_') || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '.p' || p_partkey END AS module FROM part""")
def module_names(spark, sf_dir):
    path = F.concat(F.lit("lib/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.when(F.col("p_partkey") % 10 == 0, "/__init__.py").otherwise(F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".py"))))
    rows = _read(spark, sf_dir, "part").select("p_partkey", path.alias("rel_path"))
    return rows.withColumn("module", names.module_name(F.col("rel_path")))


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), q AS (SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) AS line FROM l)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(content) AS BIGINT) AS n FROM q""")
def doc_lines(spark, sf_dir):
    return text.lines(_read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line", "start", F.length("content").cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS x FROM documents)
SELECT doc_id, CASE WHEN contains(x, chr(13) || chr(10)) THEN 'crlf' WHEN contains(x, chr(13)) THEN 'cr' ELSE 'lf' END AS eol, sha256(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS converted FROM t""")
def eol_convert(spark, sf_dir):
    x = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", x.alias("x"))
    return rows.select("doc_id", text.eol(F.col("x")).alias("eol"), F.sha2(text.convert_eol(F.col("x")), 256).alias("converted"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# -*- coding: latin-' || (doc_id % 9) || ' -*-' || chr(10) WHEN 1 THEN chr(10) || '# vim: set fileencoding=cp125' || (doc_id % 9) || ' :' || chr(10)
WHEN 2 THEN '<?xml version="1.0" encoding="utf-16"?>' || chr(10) ELSE chr(10) || chr(10) || '# coding: ascii' || chr(10) END || text AS x FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'latin-' || (doc_id % 9) WHEN 1 THEN 'cp125' || (doc_id % 9) WHEN 2 THEN 'utf-16' END AS encoding FROM t""")
def encoding_cookie(spark, sf_dir):
    n = (F.col("doc_id") % 9).cast("string")
    head = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# -*- coding: latin-"), n, F.lit(" -*-\n"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\n# vim: set fileencoding=cp125"), n, F.lit(" :\n"))).when(F.col("doc_id") % 4 == 2, '<?xml version="1.0" encoding="utf-16"?>\n').otherwise("\n\n# coding: ascii\n")
    return _read(spark, sf_dir, "documents").select("doc_id", text.coding(F.concat(head, "text")).alias("encoding"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-32' END AS encoding FROM documents""")
def bom_detect(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 4 == 0, "EFBBBF").when(F.col("doc_id") % 4 == 1, "FFFE").when(F.col("doc_id") % 4 == 2, "0000FEFF").otherwise("")
    content = F.concat(F.unhex(mark), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return _read(spark, sf_dir, "documents").select("doc_id", text.bom(content).alias("encoding"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))


@query("""WITH h AS (SELECT 'd/' || doc_id AS path, substr(sha256(text), 1, 16) AS hash FROM documents),
g AS (SELECT substr(sha256(path), 1, 2) AS part, substr(sha256(string_agg(path || ':' || hash, chr(10) ORDER BY path)), 1, 16) AS d, count(*) AS n FROM h GROUP BY 1)
SELECT substr(sha256(string_agg(d, chr(10) ORDER BY part)), 1, 16) AS revision, CAST(sum(n) AS BIGINT) AS files FROM g""")
def project_revision(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("rel_path"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    return structure.revision(rows)


@query("SELECT event_id, 'w10_' || (event_id // 10) AS qualname FROM events")
def spans_range_join(spark, sf_dir):
    """Events in the innermost of nested intervals of a thousand, a hundred and ten ids."""
    events = _read(spark, sf_dir, "events").select("event_id", F.expr("event_id div 1000").alias("bucket"), F.col("event_id").alias("line"))
    width = lambda w, order: events.select("bucket", F.expr(f"event_id div {w}").alias("i")).distinct().select("bucket", (F.col("i") * w).alias("line_start"), (F.col("i") * w + w - 1).alias("line_end"), F.lit(order).alias("ord"), F.concat(F.lit(f"w{w}_"), F.col("i").cast("string")).alias("qualname"))
    return calls.innermost(events, width(1000, 2).union(width(100, 1)).union(width(10, 0)), "bucket", "line", ["event_id"])


@query("""SELECT l_partkey AS id, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1""")
def node_dedup_first_wins(spark, sf_dir):
    """Of lines that share their order's key and number, the first of the table wins, as the SQL's does in one thread."""
    rows = _in_order(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "file_no", "row_no")
    return graph.first_wins(rows, ties=("file_no", "row_no"), skip_null=True)


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS name FROM part) SELECT name, count(*) AS n, count(DISTINCT p_partkey) AS parts, min(p_partkey) AS first FROM w GROUP BY 1""")
def reverse_index_lookup(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"), F.min("p_partkey").alias("first"))


@query("""SELECT 's' || s_suppkey AS tail, 'n' || s_nationkey AS head, 'to ' || s_name AS label, CAST(2 AS BIGINT) AS points, CAST(s_suppkey AS DOUBLE) AS x0 FROM supplier""")
def plain_dot_parse(spark, sf_dir):
    line = F.concat(F.lit("edge s"), F.col("s_suppkey").cast("string"), F.lit(" n"), F.col("s_nationkey").cast("string"), F.lit(" 2 "), F.col("s_suppkey").cast("string"), F.lit(' 1.5 2.5 3.5 "to '), "s_name", F.lit('" 1 1 solid black'))
    edges = render.parse_plain(_read(spark, sf_dir, "supplier").select(line.alias("value")))[2]
    return edges.select("tail", "head", "label", F.size("points").cast("long").alias("points"), F.col("points")[0]["x"].alias("x0"))


@query("""SELECT 'm' || (p_partkey % 50) || '.part' || p_partkey || '.run' AS qualified, CASE WHEN p_partkey % 50 < 25 THEN 'm' || (p_partkey % 50) || '.py:function:part' || p_partkey || '.run' END AS target FROM part WHERE p_partkey % 50 < 25""")
def longest_prefix(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.expr("'m' || (p_partkey % 50) || '.part' || p_partkey || '.run'").alias("qualified"))
    mods = _read(spark, sf_dir, "part").where("p_partkey % 50 < 25").select(F.expr("'m' || (p_partkey % 50)").alias("module")).distinct().withColumn("target_path", F.concat("module", F.lit(".py")))
    return calls.longest_prefix(rows, mods)


@query("""SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS last FROM orders GROUP BY 1""")
def local_name_last_wins(spark, sf_dir):
    return _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_orderkey").alias("last"))
