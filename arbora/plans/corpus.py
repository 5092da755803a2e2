"""A project generated from table rows, with its relations known by arithmetic.

Every nation is a module ``r{region}/n{nation}.py`` and every customer a
function in its nation's module; ``f_s`` calls ``f_(s div 2)``, a standard
library function, an undefined name and a method of an unknown receiver.  Every
module has a class whose methods call each other and a function that calls one
through an alias.  The engine parses the text; SQL computes the same relations
from the rows without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.lineage import columnar
from arbora.operators.parse import parse_files
from arbora.operators.structure import ordered

_CASES = "repeat('(1 if x else 0) + ', {}) || '0'"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path, source of the generated project."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("n"))
    target = own.join(nation, "n").select(F.col("s").alias("t"), F.col("n").alias("tn"), F.col("r").alias("tr"))
    calls = own.withColumn("t", F.expr("s div 2")).join(target, "t")
    text = F.expr("'def f_' || s || '(x):\\n    f_' || t || '(x)\\n    os.path.join(x)\\n    unknown_' || (s % 3) || '(x)\\n    y.run(x)\\n    x = ' || " + _CASES.format("cast(s % 6 as int)") + " || '\\n    return x\\n\\n'")
    line = F.when(F.col("tn") != F.col("n"), F.expr("'from r' || tr || '.n' || tn || ' import f_' || t || '\\n'"))
    parts = calls.groupBy("n").agg(F.array_join(ordered(text, "s"), "").alias("functions"), F.array_join(F.array_compact(ordered(line, "s")), "").alias("imports"))
    tail = F.expr("'class C_' || n || ':\\n    def run(self):\\n        self.step()\\n    def step(self):\\n        return 0\\nG_' || n || ' = 1\\ndef use_' || n || '():\\n    w = C_' || n || '()\\n    v = w\\n    v.run()\\n'")
    head = F.concat(F.lit("import os\nimport json"), F.when(F.col("n") % 2 == 0, "  # analysis: ignore").otherwise(""), F.lit("\n"))
    modules = nation.join(parts, "n", "left").select(F.expr("'r' || r || '/n' || n || '.py'").alias("rel_path"), F.concat(head, F.coalesce("imports", F.lit("")), F.coalesce("functions", F.lit("")), tail).alias("source"))
    packages = nation.select("r").distinct().select(F.expr("'r' || r || '/__init__.py'").alias("rel_path"), F.lit("").alias("source"))
    return modules.union(packages)


def spread(files: DataFrame) -> DataFrame:
    """Files over all cores and more: few rows of much work, which adaptive execution would put together."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "rel_path")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its parsed rows, parsed once and written, as every relation of a query reads them."""
    return columnar(parse_files(spread(files(spark, sf_dir))), "tab")


#: The same project as relations: ``f`` functions with their first line - 1 in ``b``, ``m`` modules with ``c`` imports and ``k`` functions.
SQL = """
WITH RECURSIVE c AS (
  SELECT c_custkey AS s, c_nationkey AS n, n_regionkey AS r, c_custkey // 2 AS t FROM customer JOIN nation ON n_nationkey = c_nationkey
), x AS (
  SELECT c.*, d.n AS tn, d.r AS tr, c.n <> d.n AS across, row_number() OVER (PARTITION BY c.n ORDER BY c.s) AS pos,
    sum(CASE WHEN c.n <> d.n THEN 1 ELSE 0 END) OVER (PARTITION BY c.n ORDER BY c.s) AS iline FROM c JOIN c d ON d.s = c.t
), m AS (
  SELECT n_nationkey AS n, n_regionkey AS r, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, count(x.s) AS k,
    coalesce(sum(CASE WHEN x.across THEN 1 ELSE 0 END), 0) AS c FROM nation LEFT JOIN x ON x.n = n_nationkey GROUP BY 1, 2
), f AS (
  SELECT x.*, m.path, 'r' || x.tr || '/n' || x.tn || '.py' AS tpath, 2 + m.c + 8 * (x.pos - 1) AS b, m.path || ':function:f_' || x.s AS id,
    'r' || x.tr || '/n' || x.tn || '.py:function:f_' || x.t AS tid FROM x JOIN m ON m.n = x.n
), e AS (
  SELECT id AS caller_id, tid AS callee_id, b + 2 AS line, 'f_' || t AS label, CASE WHEN across THEN 0.8 ELSE 0.9 END AS confidence FROM f
  UNION ALL SELECT id, 'external:function:os.path.join', b + 3, 'os.path.join', 0.55 FROM f
  UNION ALL SELECT id, 'external:function:unknown_' || (s % 3), b + 4, 'unknown_' || (s % 3), 0.3 FROM f
  UNION ALL SELECT id, 'external:function:y.run', b + 5, 'y.run', 0.35 FROM f
  UNION ALL SELECT path || ':function:C_' || n || '.run', path || ':function:C_' || n || '.step', 2 + c + 8 * k + 3, 'self.step', 0.85 FROM m
  UNION ALL SELECT path || ':function:use_' || n, 'external:function:C_' || n, 2 + c + 8 * k + 8, 'C_' || n, 0.3 FROM m
  UNION ALL SELECT path || ':function:use_' || n, path || ':function:C_' || n || '.run', 2 + c + 8 * k + 10, 'v.run', 0.85 FROM m
)
"""
