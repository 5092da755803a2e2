"""Identifiers: symbol ids, module names, reference resolution and key codecs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of encoded keys.
PATH_MARK = "__path__"
KINDS = ("function", "class", "global", "module")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def symbol_id(path: Column, kind: Column | str, name: Column) -> Column:
    return F.concat_ws(":", path, F.lit(kind) if isinstance(kind, str) else kind, name)


def legacy_id(path: Column, kind: Column | str, name: Column) -> Column:
    return symbol_id(basename(path), kind, name)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def module_name(path: Column) -> Column:
    """a/b.py is a.b, a/__init__.py is a, __init__.py is empty."""
    return F.translate(F.regexp_replace(path, r"(^|/)__init__\.py$|\.py$", ""), "/", ".")


def encode_key(symbol: Column) -> Column:
    """A symbol id as one path segment."""
    out = F.replace(symbol, F.lit("/"), F.lit(PATH_MARK))
    for kind in reversed(KINDS):
        at = F.instr(symbol, f":{kind}:")
        n = len(kind) + 2
        split = F.concat(F.replace(F.substring(symbol, F.lit(1), at - 1), F.lit("/"), F.lit(PATH_MARK)), F.lit(f"__{kind}__"), F.substring(symbol, at + n, F.length(symbol)))
        out = F.when(at > 0, split).otherwise(out)
    return out


def decode_key(key: Column) -> Column:
    out = F.replace(key, F.lit(PATH_MARK), F.lit("/"))
    for kind in reversed(KINDS):
        mark = f"__{kind}__"
        at = F.instr(key, mark)
        split = F.concat(F.replace(F.substring(key, F.lit(1), at - 1), F.lit(PATH_MARK), F.lit("/")), F.lit(f":{kind}:"), F.substring(key, at + len(mark), F.length(key)))
        out = F.when(at > 0, split).otherwise(out)
    return out


def unique_aliases(symbols: DataFrame) -> DataFrame:
    """legacy_id, id: legacy ids that stand for one canonical id only."""
    return symbols.groupBy("legacy_id").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("legacy_id", "id")


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """reference, id, outcome (resolved, ambiguous, missing) by rule priority.

    ``symbols`` has id, legacy_id, type, name, rel_path.  Each rule is an equi-join, so references come in
    any number: a reference's own form says which keys it can have.
    """
    parts = F.split("reference", ":")
    refs = references.select("reference").distinct().withColumns({"file": F.when(F.size(parts) >= 3, F.element_at(parts, 1)), "short": F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, 1000), ":")).when(F.size(parts) == 1, F.col("reference"))})
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("rel_path", "/"))), lambda k: F.array_join(F.slice(F.split("rel_path", "/"), k, 1000), "/"))
    by_suffix = symbols.where("type <> 'module'").select("id", "name", F.explode(suffixes).alias("suffix"))
    rules = [
        refs.join(symbols.select("id").distinct(), F.col("reference") == F.col("id")).select("reference", "id", F.lit(1).alias("rule")),
        refs.join(unique_aliases(symbols), F.col("reference") == F.col("legacy_id")).select("reference", "id", F.lit(2).alias("rule")),
        refs.where(F.size(parts) == 1).join(symbols.where("type = 'function'").select("id", "name").distinct(), F.col("short") == F.col("name")).select("reference", "id", F.lit(3).alias("rule")),
        refs.where("file is not null").join(by_suffix, (F.col("file") == F.col("suffix")) & (F.col("short") == F.col("name"))).select("reference", "id", F.lit(4).alias("rule")).distinct(),
    ]
    found = rules[0]
    for more in rules[1:]:
        found = found.unionByName(more)
    best = found.groupBy("reference", "rule").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).groupBy("reference").agg(F.min_by(F.struct("n", "id"), "rule").alias("best"))
    return refs.select("reference").join(best, "reference", "left").select(
        "reference",
        F.when(F.col("best.n") == 1, F.col("best.id")).alias("id"),
        F.when(F.col("best").isNull(), "missing").when(F.col("best.n") > 1, "ambiguous").otherwise("resolved").alias("outcome"),
    )


def symbols(parsed: DataFrame) -> DataFrame:
    """id, legacy_id, type, name, rel_path, line_start, line_end: modules, top-level functions and classes, globals; the first of an id wins."""
    from arbora.operators.parse import table

    files, defs, names = table(parsed, "file"), table(parsed, "def").where("depth = 0"), table(parsed, "global")
    ends = defs.groupBy("rel_path").agg(F.max("end_line").alias("last")).join(names.groupBy("rel_path").agg(F.max("line").alias("last_global")), "rel_path", "full_outer")
    module = files.join(ends, "rel_path", "left").select("rel_path", F.lit(0).alias("rank"), F.lit(0).alias("ord"), F.lit("module").alias("type"), basename(F.col("rel_path")).alias("name"), F.lit(1).alias("line_start"), F.greatest(F.lit(1), "last", "last_global").alias("line_end"))
    kinds = defs.select("rel_path", F.when(F.col("kind") == "function", 1).otherwise(2).alias("rank"), "ord", F.col("kind").alias("type"), "name", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"))
    globals_ = names.select("rel_path", F.lit(3).alias("rank"), "ord", F.lit("global").alias("type"), "name", F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    rows = module.unionByName(kinds).unionByName(globals_)
    first = rows.groupBy("rel_path", "type", "name").agg(F.min(F.struct("rank", "ord", "line_start", "line_end")).alias("x"))
    path, kind, name = F.col("rel_path"), F.col("type"), F.col("name")
    return first.select(symbol_id(path, kind, name).alias("id"), legacy_id(path, kind, name).alias("legacy_id"), "type", "name", "rel_path", "x.line_start", "x.line_end")


def lookup(parsed: DataFrame) -> DataFrame:
    """name, id, type, rel_path, line: the inverted index from names, and from short names of dotted ones, to definitions."""
    from arbora.operators.parse import table

    known = symbols(parsed).select("name", "id", "type", "rel_path", F.col("line_start").alias("line"))
    methods = table(parsed, "def").where("depth = 1").select(F.col("qualname").alias("name"), symbol_id(F.col("rel_path"), "function", F.col("qualname")).alias("id"), F.lit("function").alias("type"), "rel_path", "line")
    every = known.unionByName(methods)
    return every.unionByName(methods.withColumn("name", F.element_at(F.split("name", r"\."), -1)))
