"""Import graphs, static resolution and classification.

Nothing is imported and no interpreter state is read: a module is looked up in
the project's own files first, then in the standard library's names, then in a
catalog of installed packages that the caller may give.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators import names
from arbora.operators.calls import modules
from arbora.operators.parse import table

STDLIB = sorted({*sys.stdlib_module_names, *sys.builtin_module_names})


def is_stdlib(module: Column) -> Column:
    return F.substring_index(module, ".", 1).isin(*STDLIB)


def resolve_files(wanted: DataFrame, modules_: DataFrame) -> DataFrame:
    """module, target_path: the file of the longest known prefix of each distinct module name."""
    parts = F.split("module", r"\.")
    each = wanted.select("module").where("module <> ''").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts))))
    each = each.withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."))
    hits = each.join(modules_.select(F.col("module").alias("prefix"), "target_path"), "prefix")
    return hits.groupBy("module").agg(F.max_by("target_path", "k").alias("target_path"))


def brief_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of imports by project modules only; other modules become external nodes."""
    own = table(parsed, "import").withColumn("module", F.regexp_replace("name", r"^\.+", "")).where("module <> ''")
    found = own.join(resolve_files(own, modules(parsed)), "module", "left")
    target = F.coalesce(names.file_id(F.col("target_path")), F.concat(F.lit("module:"), F.col("module")))
    kind = F.when(F.col("target_path").isNotNull(), "project").when(is_stdlib(F.col("module")), "stdlib").otherwise("third_party")
    edges = found.select(names.file_id(F.col("rel_path")).alias("from_id"), target.alias("to_id"), F.lit("imports").alias("type"), "label", kind.alias("kind"), "line")
    files = table(parsed, "file").select(names.file_id(F.col("rel_path")).alias("id"), F.lit("file").alias("type"), F.col("rel_path").alias("name"))
    external = found.where("target_path is null").select(F.concat(F.lit("module:"), "module").alias("id"), F.lit("external_module").alias("type"), F.col("module").alias("name")).distinct()
    return files.unionByName(external), edges


def resolutions(parsed: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Every import with its absolute module, file, bucket (system, project, other, unresolved) and error.

    A relative import climbs a directory for each dot after the first.  ``catalog`` has the top-level names of
    installed packages in a column ``module``.
    """
    own = table(parsed, "import")
    package = F.slice(F.split("rel_path", "/"), F.lit(1), F.greatest(F.size(F.split("rel_path", "/")) - F.greatest("level", F.lit(1)), F.lit(0)))
    bare = F.regexp_replace("name", r"^\.+", "")
    relative = F.array_join(F.array_compact(F.concat(package, F.array(F.when(bare != "", F.replace(bare, F.lit("."), F.lit("/")))))), "/")
    own = own.withColumn("module", F.when(F.col("level") > 0, F.replace(relative, F.lit("/"), F.lit("."))).otherwise(bare))
    found = own.join(modules(parsed), "module", "left")
    installed = F.lit(False)
    if catalog is not None:
        found = found.join(catalog.select(F.col("module").alias("top"), F.lit(True).alias("installed")).distinct(), F.substring_index("module", ".", 1) == F.col("top"), "left").drop("top")
        installed = F.coalesce("installed", F.lit(False))
    bucket = F.when(F.col("target_path").isNotNull(), "project").when((F.col("level") == 0) & is_stdlib(F.col("module")), "system").when(installed, "other").otherwise("unresolved")
    error = F.when(bucket == "unresolved", F.concat(F.lit("Could not resolve 'import "), "name", F.lit("' at line "), F.col("line").cast("string")))
    return found.select("rel_path", "ord", "name", "label", "line", "level", "module", "target_path", bucket.alias("bucket"), error.alias("error"))


def resolved_graph(parsed: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One edge for each resolution: from_id, to_id, label, kind."""
    r = resolutions(parsed, catalog)
    target = F.when(F.col("bucket") == "project", names.file_id(F.col("target_path"))).when(F.col("bucket") == "system", F.concat(F.lit("builtin:"), "module")).when(F.col("bucket") == "other", F.concat(F.lit("module:"), "module")).otherwise(F.concat(F.lit("unresolved:"), "name", F.lit(":"), F.col("line").cast("string")))
    kind = F.when(F.col("bucket") == "system", "stdlib").when(F.col("bucket") == "other", "third_party").otherwise(F.col("bucket"))
    return r.select(names.file_id(F.col("rel_path")).alias("from_id"), target.alias("to_id"), "label", kind.alias("kind"), "line")


def summary(resolved: DataFrame) -> DataFrame:
    """bucket, n, n_names: totals for each bucket, zeros included; "other" counts as unresolved."""
    folded = resolved.withColumn("bucket", F.when(F.col("bucket") == "other", "unresolved").otherwise(F.col("bucket")))
    all_ = resolved.sparkSession.createDataFrame([("project",), ("system",), ("unresolved",)], "bucket string")
    counts = folded.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))
    return all_.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_names", F.lit(0)).alias("n_names"))


def unresolved_packages(resolved: DataFrame) -> DataFrame:
    """Top-level names of absolute imports that nothing resolves."""
    return resolved.where("bucket = 'unresolved' and level = 0").select(F.substring_index("module", ".", 1).alias("package")).distinct()


def dir_modules(paths: DataFrame, column: str = "rel_path") -> DataFrame:
    """All importable dotted names under a directory: modules, and packages by their prefixes."""
    name = names.module_name(F.col(column))
    parts = F.split(name, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return paths.where(name != "").select(F.explode(prefixes).alias("module")).distinct()


def on_line(parsed: DataFrame, line: int) -> DataFrame:
    """Imports that a line holds: rel_path, name, items."""
    return table(parsed, "import").where(F.col("line") == line).select("rel_path", "name", "label")


def install_hint(packages: DataFrame) -> str | None:
    """What to install for packages that nothing resolves; None if there are none."""
    missing = sorted(r["package"] for r in packages.collect())
    return "pip install " + " ".join(missing) if missing else None


def diagram(parsed: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (path, title, kind, classes, funcs, globs, docstring) and connections (source, target, label) of an import diagram.

    Connections between the same boxes are one, with their labels in order.
    """
    parts = names.basename(F.col("rel_path"))
    package = F.element_at(F.split("rel_path", "/"), -2)
    title = F.when((parts == "__init__.py") & F.contains("rel_path", F.lit("/")), F.concat(package, F.lit("(__init__)"))).otherwise(F.regexp_replace(parts, r"\.py$", ""))
    defs = table(parsed, "def").where("depth = 0").groupBy("rel_path").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "function").alias("funcs"))
    globs = table(parsed, "global").groupBy("rel_path").agg(F.count("*").alias("globs"))
    own = table(parsed, "file").join(defs, "rel_path", "left").join(globs, "rel_path", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    boxes = own.select(F.col("rel_path").alias("path"), title.alias("title"), F.lit("project").alias("kind"), count("classes"), count("funcs"), count("globs"), "docstring")
    kind = F.when(F.col("bucket") == "system", "system").when(F.col("bucket") == "other", "other").otherwise("unknown")
    zero = F.lit(0).cast("bigint")
    outside = resolved.where("target_path is null").select(F.col("name").alias("path"), F.col("name").alias("title"), kind.alias("kind"), zero.alias("classes"), zero.alias("funcs"), zero.alias("globs"), F.lit(None).cast("string").alias("docstring")).dropDuplicates(["path"])
    ends = resolved.select(F.col("rel_path").alias("source"), F.coalesce("target_path", "name").alias("target"), "label").where("source <> target")
    merged = ends.groupBy("source", "target").agg(F.array_join(F.array_sort(F.array_remove(F.collect_set("label"), "")), ", ").alias("label"))
    return boxes.unionByName(outside), merged
