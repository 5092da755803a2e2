"""Control flow, diagnostics, dead code, usages, facet signatures and summaries of parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators import names
from arbora.operators.parse import table


def control_flow(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containment nodes and edges of every function, by its unqualified name; the first of a name in a file counts."""
    rows = table(parsed, "fragment")
    function = names.symbol_id(F.col("rel_path"), "function", F.col("function"))
    own = F.concat_ws(":", function, F.lit("cfg"), "type_name", F.col("idx").cast("string"), F.col("line_start").cast("string"))
    nodes = rows.select("rel_path", "ord", "parent_ord", own.alias("id"), function.alias("function_id"), F.concat(F.lit("cfg_"), F.lower("type_name")).alias("type"), F.col("type_name").alias("name"), "line_start", "line_end")
    parents = nodes.select("rel_path", F.col("ord").alias("parent_ord"), F.col("id").alias("parent_id"))
    edges = nodes.join(parents, ["rel_path", "parent_ord"], "left").select(F.coalesce("parent_id", F.concat("function_id", F.lit(":entry"))).alias("from_id"), F.col("id").alias("to_id"), F.lit("cfg_flow").alias("type"))
    return nodes.select("id", "function_id", "type", "name", "line_start", "line_end").distinct(), edges


def rank(complexity: Column) -> Column:
    """A to F by 5, 10, 20, 30 and 40."""
    return F.when(complexity <= 5, "A").when(complexity <= 10, "B").when(complexity <= 20, "C").when(complexity <= 30, "D").when(complexity <= 40, "E").otherwise("F")


def complexity(parsed: DataFrame) -> DataFrame:
    return table(parsed, "complexity").select("rel_path", "name", "line", "complexity", rank(F.col("complexity")).alias("rank"))


def lint(parsed: DataFrame) -> DataFrame:
    """Findings of lines without a suppressing comment."""
    return table(parsed, "lint").where("not suppressed").select("rel_path", "line", "message")


def dead_code(parsed: DataFrame) -> DataFrame:
    """Definitions whose name nothing in the project reads, calls or imports; dunder methods are always alive."""
    used = table(parsed, "ref").where("ctx in ('load', 'attribute', 'string')").select("name").union(table(parsed, "item").select("name")).distinct()
    defs = table(parsed, "def").where("not name like '\\\\_\\\\_%'").select("rel_path", "kind", "name", "qualname", "line")
    return defs.join(used, "name", "left_anti")


def usages(parsed: DataFrame) -> DataFrame:
    """name, rel_path, line, col of every reference to a known definition, once for each place."""
    known = table(parsed, "def").select("name").distinct()
    refs = table(parsed, "ref").where("ctx <> 'string'").select("name", "rel_path", "line", "col").distinct()
    return refs.join(known, "name", "left_semi")


def digest(parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of parts on lines of their own."""
    return F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, 16)


def ordered(value: Column, *by: Column | str) -> Column:
    """An aggregate: the values in order."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    return F.transform(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("v")))), lambda x: x["v"])


#: The tables that signatures read.
SIGNED = ("import", "item", "def", "global", "call")


def signatures(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """rel_path, content_hash and the digests of a file's imports, symbols and calls."""
    items = table(parsed, "item").groupBy("rel_path", "import_ord").agg(F.array_join(ordered(F.concat_ws(":", "name", F.coalesce("alias", F.lit(""))), "ord"), "|").alias("items"))
    own = table(parsed, "import").withColumnRenamed("ord", "import_ord").join(items, ["rel_path", "import_ord"], "left")
    line = F.when(F.col("items").isNotNull(), F.concat_ws(":", F.lit("from"), "name", "items", F.col("line").cast("string"))).otherwise(F.concat_ws(":", F.lit("import"), "name", F.coalesce("alias", F.lit("")), F.col("line").cast("string")))
    imports = own.groupBy("rel_path").agg(digest(ordered(line, "import_ord")).alias("imports"))
    defs = table(parsed, "def").select("rel_path", "ord", F.concat_ws(":", "kind", "qualname").alias("part")).union(table(parsed, "global").select("rel_path", F.col("ord") + 1_000_000, F.concat(F.lit("global:"), "name")))
    symbols = defs.groupBy("rel_path").agg(digest(ordered(F.col("part"), "ord")).alias("symbols"))
    calls = table(parsed, "call").select("rel_path", F.concat_ws(":", F.col("line").cast("string"), "callee_name").alias("part")).groupBy("rel_path").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    empty = digest(F.array().cast("array<string>"))
    out = files.select("rel_path", F.substring(F.sha2(F.coalesce("source", F.lit("")), 256), 1, 16).alias("content_hash"))
    out = out.join(imports, "rel_path", "left").join(symbols, "rel_path", "left").join(calls, "rel_path", "left")
    imports_part = F.coalesce("imports", empty)
    return out.select("rel_path", "content_hash", imports_part.alias("imports"), F.coalesce("symbols", empty).alias("symbols"), digest(F.concat(F.array(imports_part), F.coalesce("parts", F.array().cast("array<string>")))).alias("calls"))


def changed_layers(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path and which layers a change of it clears: import_graph, call_index, reverse_index; all if one side lacks the file."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.rel_path") == F.col("b.rel_path"), "full_outer")
    missing = F.col("a.rel_path").isNull() | F.col("b.rel_path").isNull()
    differs = lambda facet: (missing | ~F.col(f"a.{facet}").eqNullSafe(F.col(f"b.{facet}")))
    return both.select(F.coalesce("a.rel_path", "b.rel_path").alias("rel_path"), differs("imports").alias("import_graph"), differs("calls").alias("call_index"), differs("symbols").alias("reverse_index"), differs("content_hash").alias("content"))


def revision(files: DataFrame, path: str = "rel_path", content_hash: str = "content_hash") -> DataFrame:
    """One digest over all files' paths and hashes in path order, by way of one digest for each of 256 path groups.

    Groups keep the ordered list of any one task to a 256th of the project.
    """
    grouped = files.groupBy(F.substring(F.sha2(F.col(path), 256), 1, 2).alias("part")).agg(digest(ordered(F.concat_ws(":", path, content_hash), path)).alias("d"), F.count("*").alias("n"))
    return grouped.agg(digest(ordered(F.col("d"), "part")).alias("revision"), F.sum("n").alias("files"))


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """type, n: symbols of each type and, as "total", of all."""
    return symbols.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


def signatures_shown(parsed: DataFrame) -> DataFrame:
    """rel_path, qualname, shown: each definition as it would be written on one line."""
    defs = table(parsed, "def")
    call = F.concat(F.when(F.col("is_async"), "async def ").otherwise("def "), "name", F.lit("("), F.coalesce("args", F.lit("")), F.lit(")"))
    kind = F.concat(F.lit("class "), "name", F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise(""))
    return defs.select("rel_path", "qualname", F.when(F.col("kind") == "class", kind).otherwise(call).alias("shown"))


def names_of(parsed: DataFrame) -> DataFrame:
    """rel_path, qualname, private, protected, static of every definition."""
    defs = table(parsed, "def")
    dunder = F.startswith("name", F.lit("__"))
    return defs.select("rel_path", "qualname", dunder.alias("private"), (F.startswith("name", F.lit("_")) & ~dunder).alias("protected"), F.array_contains(F.split("decorators", ", "), "staticmethod").alias("static"))


def flow_text(parsed: DataFrame) -> DataFrame:
    """rel_path, function, shown: the statement kinds of a function's own level, in order."""
    rows = table(parsed, "fragment").where("parent_ord is null")
    return rows.groupBy("rel_path", "function").agg(F.array_join(ordered(F.concat_ws(":", "type_name", F.col("line_start").cast("string")), "ord"), " ").alias("shown"))
