"""Call resolution: the first rule that gives a callee, for every call inside a function.

What a file says of its own calls comes from the parser; here are the joins
over the whole project.  Every rule is a left join against a relation that has one row for each key, so
a call stays one row, and the rules' answers are taken in their order.  The
relations are small against the calls (functions, modules, distinct qualified
names), and joins go by file or by name, never by containment over all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import names
from arbora.operators.parse import table


def modules(parsed: DataFrame) -> DataFrame:
    """module, target_path: the first file by path wins."""
    files = table(parsed, "file").select("rel_path", names.module_name(F.col("rel_path")).alias("module"))
    return files.groupBy("module").agg(F.min("rel_path").alias("target_path"))


def longest_prefix(qualified: DataFrame, modules_: DataFrame) -> DataFrame:
    """qualified, target: the symbol that the longest module prefix of each distinct name leads to."""
    parts = F.split("qualified", r"\.")
    each = qualified.select("qualified").where("qualified is not null").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts))))
    each = each.withColumns({"prefix": F.array_join(F.slice(parts, F.lit(1), F.col("k")), "."), "rest": F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), ".")})
    hits = each.join(modules_, F.col("prefix") == F.col("module"))
    kind = F.when(F.col("rest") == "", names.symbol_id(F.col("target_path"), "module", F.element_at(F.split("prefix", r"\."), -1))).otherwise(names.symbol_id(F.col("target_path"), "function", F.col("rest")))
    return hits.select("qualified", "k", kind.alias("target")).groupBy("qualified").agg(F.max_by("target", "k").alias("target"))


def functions(parsed: DataFrame) -> DataFrame:
    """id, rel_path, qualname, line_start, line_end of all functions and methods; the last definition of an id gives the lines."""
    spans = table(parsed, "span").withColumn("id", names.symbol_id(F.col("rel_path"), "function", F.col("qualname")))
    return spans.groupBy("id", "rel_path", "qualname").agg(F.max_by(F.struct("line_start", "line_end"), "ord").alias("x"), F.min("ord").alias("ord")).select("id", "rel_path", "qualname", "x.line_start", "x.line_end", "ord")


def innermost(points: DataFrame, intervals: DataFrame, key: str, point: str, ids: list[str]) -> DataFrame:
    """Each point with the interval of the same key that contains it and starts last; points in none are dropped."""
    own = intervals.select(F.col(key).alias("__key"), "line_start", "line_end", F.col("ord").alias("__ord"), "qualname")
    inside = points.join(own, (F.col(key) == F.col("__key")) & F.col(point).between(F.col("line_start"), F.col("line_end")))
    return inside.groupBy(*ids).agg(F.max(F.struct("line_start", -F.col("__ord"), "qualname"))["qualname"].alias("qualname"))


def call_edges(parsed: DataFrame) -> DataFrame:
    """caller_id, callee_id, line, label, confidence, provenance, rule, ord of every call inside a function."""
    inside = table(parsed, "call").where("qualname is not null")
    known = functions(parsed)
    mods = modules(parsed)
    size = F.size("chain")

    # Types of receivers: of functions with one qualified name, the last file's count.
    types = table(parsed, "local_type")
    last_file = types.groupBy("qualname").agg(F.max("rel_path").alias("rel_path"))
    types = types.join(last_file, ["qualname", "rel_path"]).select("qualname", F.col("var").alias("receiver"), "type_qualified")
    at = inside.join(types, ["qualname", "receiver"], "left")

    # Methods, by qualified name anywhere and in a class's own module.
    owner = F.when(F.contains("qualname", F.lit(".")), F.regexp_replace("qualname", r"\.[^.]*$", ""))
    class_name, class_module = F.element_at(F.split("type_qualified", r"\."), -1), F.when(F.contains("type_qualified", F.lit(".")), F.regexp_replace("type_qualified", r"\.[^.]*$", "")).otherwise(F.lit(""))
    at = at.withColumns({"self_method": F.when((F.col("receiver") == "self") & owner.isNotNull(), F.concat_ws(".", owner, "callee_name")), "typed_method": F.when((size == 2) & F.col("type_qualified").isNotNull(), F.concat_ws(".", class_name, "callee_name")), "typed_module": class_module})
    anywhere = known.groupBy("qualname").agg(F.min_by("id", F.struct("rel_path", "ord")).alias("method_id"))
    at = at.join(anywhere.select(F.col("qualname").alias("self_method"), F.col("method_id").alias("self_id")), "self_method", "left")
    at = at.join(mods.select(F.col("module").alias("typed_module"), F.col("target_path").alias("typed_path")), "typed_module", "left")
    at = at.join(anywhere.select(F.col("qualname").alias("typed_method"), F.col("method_id").alias("typed_any")), "typed_method", "left")
    in_file = known.select(F.col("qualname").alias("typed_method"), F.col("rel_path").alias("typed_path"), F.col("id").alias("typed_here"))
    at = at.join(in_file, ["typed_method", "typed_path"], "left")
    typed_id = F.when(F.col("typed_path").isNull(), F.col("typed_any")).otherwise(F.col("typed_here"))

    # Qualified names, resolved once for each distinct one.
    tail = F.array_join(F.slice("chain", F.lit(2), size), ".")
    chain = F.array_join("chain", ".")
    applies = (size >= 2) & F.col("type_qualified").isNull() & ((size >= 3) | F.col("receiver_import").isNotNull())
    at = at.withColumns({
        "chain_name": F.when(applies, F.when(F.col("receiver_import").isNotNull(), F.concat_ws(".", "receiver_import", tail)).otherwise(chain)),
        "attr_name": F.when(F.col("receiver_import").isNotNull(), F.concat_ws(".", "receiver_import", "callee_name")),
        "applies": applies,
    })
    wanted = at.select(F.explode(F.array("chain_name", "attr_name", "name_import")).alias("qualified"))
    targets = longest_prefix(wanted, mods)
    for name in ("chain_name", "attr_name", "name_import"):
        at = at.join(targets.select(F.col("qualified").alias(name), F.col("target").alias(f"{name}_target")), name, "left")

    # Modules named like the call.
    paths = table(parsed, "file").select("rel_path", names.module_name(F.col("rel_path")).alias("module")).where("rel_path like '%/%'")
    like = paths.select("rel_path", F.element_at(F.split("module", r"\."), -1).alias("callee_name")).union(paths.where("module like '%.%'").select("rel_path", F.regexp_extract("rel_path", r"([^/]*)\.py$", 1))).groupBy("callee_name").agg(F.min("rel_path").alias("like_path"))
    at = at.join(like, "callee_name", "left")

    external = lambda x: F.concat(F.lit("external:function:"), x)
    answer = lambda rule, target, confidence: F.struct(target.alias("id"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    here = lambda name: names.symbol_id(F.col("rel_path"), "function", F.col(name))
    receiver = F.col("receiver").isNotNull()
    best = (
        F.when(F.col("self_id").isNotNull(), answer(1, F.col("self_id"), 0.85))
        .when(typed_id.isNotNull(), answer(2, typed_id, 0.85))
        .when(F.col("applies") & F.col("chain_name_target").isNotNull(), answer(3, F.col("chain_name_target"), 0.75))
        .when(F.col("applies"), answer(3, external(chain), 0.55))
        .when(receiver & F.col("attr_name_target").isNotNull(), answer(4, F.col("attr_name_target"), 0.75))
        .when(receiver, answer(5, external(F.col("label")), 0.35))
        .when(F.col("local_qualname").isNotNull(), answer(6, here("local_qualname"), 0.9))
        .when(F.col("name_import_target").isNotNull(), answer(7, F.col("name_import_target"), 0.8))
        .when(F.col("name_import").isNotNull(), answer(7, external(F.col("name_import")), 0.5))
        .when(F.col("like_path").isNotNull(), answer(8, names.symbol_id(F.col("like_path"), "module", F.col("callee_name")), 0.6))
        .otherwise(answer(9, external(F.col("callee_name")), 0.3))
    )
    return at.withColumn("best", best).select(here("qualname").alias("caller_id"), F.col("best.id").alias("callee_id"), "line", "label", "best.confidence", F.lit("ast").alias("provenance"), "best.rule", "rel_path", "ord")


def call_graph(parsed: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (known and external functions) and the edges between them."""
    known = functions(parsed).select("id", F.lit("function").alias("type"), F.col("qualname").alias("name"), F.col("rel_path").alias("file"), "line_start", "line_end")
    inside = edges.join(known.select(F.col("id").alias("callee_id"), F.lit(True).alias("known")), "callee_id", "left").where("known or callee_id like 'external:%'")
    outside = edges.where("callee_id like 'external:%'").select("callee_id").distinct()
    external = outside.select(F.col("callee_id").alias("id"), F.lit("external_function").alias("type"), F.regexp_replace("callee_id", "^external:function:", "").alias("name"), F.lit("").alias("file"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"))
    return known.unionByName(external), inside.select(F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"), F.lit("calls").alias("type"), F.concat_ws(":", "label", F.col("line").cast("string")).alias("label"), "confidence", "provenance")
