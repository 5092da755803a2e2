"""A source tree as a database: queries return DataFrames or graphs, and relations are SQL views.

The parsed rows are the one stored relation.  They are kept in the shared
folder by content hash, so a refresh parses only files whose text changed, and
derived layers are rebuilt only if the facet they depend on did.
"""

from __future__ import annotations

import json
import posixpath
import threading
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import errors
from arbora.functions import render
from arbora.operators import calls, graph, imports, names, structure
from arbora.operators.lineage import cut
from arbora.operators.parse import TABLES, parse_files, table
from arbora.sources import scan

#: Every query with what it takes.
CATALOG = {
    "tree": "", "symbols": "path?", "lookup": "name", "import_graph": "resolved?", "call_graph": "symbol?", "control_flow": "function_id", "callers": "symbol", "callees": "symbol",
    "impact": "target", "usages": "symbol", "diagnostics": "path", "dead_code": "path?", "explain": "symbol", "import_diagram": "", "dependency_summary": "path?", "symbol_summary": "path?",
    "render": "kind, target?", "stats": "", "status": "", "catalog": "", "invalidate": "files", "warm": "", "sql": "text",
}


class Workspace:
    """One open project."""

    def __init__(self, spark: SparkSession, files: DataFrame, root: str = "", catalog: DataFrame | None = None, include_async: bool = False) -> None:
        """``files`` has rel_path and source; ``catalog`` names installed packages in ``module``."""
        self.spark, self.root, self.installed, self.include_async = spark, root, catalog, include_async
        self.lock, self.counts, self.layers = threading.RLock(), Counter(), {}
        self.files = cut(files.select("rel_path", "source"))
        self.parsed = cut(parse_files(self.files, include_async))

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: str | None = None, **options) -> Workspace:
        """Scan a directory; ``config`` names a JSON file in it whose ``excludeFromAnalysis`` lists what to leave out."""
        exclude = []
        if config is not None:
            exclude = json.loads("\n".join(r[0] for r in spark.read.text(f"{root.rstrip('/')}/{config}").collect())).get("excludeFromAnalysis", [])
        return cls(spark, scan.read_tree(spark, root, exclude), root, **options)

    def _layer(self, name: str, build):
        with self.lock:
            self.counts[name] += 1
            if name not in self.layers:
                self.layers[name] = build()
            return self.layers[name]

    def _path(self, path: str) -> str:
        """A path inside the project, relative to its root."""
        inner = posixpath.normpath(path.removeprefix(self.root.rstrip("/") + "/") if self.root else path)
        if inner.startswith(("..", "/")):
            raise errors.OutsideProject(path)
        return inner

    # Relations.

    def relation(self, name: str) -> DataFrame:
        return table(self.parsed, name)

    def register(self, prefix: str = "") -> list[str]:
        """All relations as temporary views, for SQL."""
        for name in TABLES:
            self.relation(name).createOrReplaceTempView(f"{prefix}{name}s")
        self._edges().createOrReplaceTempView(f"{prefix}call_edges")
        self._symbols().createOrReplaceTempView(f"{prefix}symbols")
        return [f"{prefix}{name}s" for name in TABLES] + [f"{prefix}call_edges", f"{prefix}symbols"]

    def sql(self, text: str) -> DataFrame:
        self.register()
        return self.spark.sql(text)

    def _symbols(self) -> DataFrame:
        return self._layer("symbols", lambda: cut(names.symbols(self.parsed)))

    def _edges(self) -> DataFrame:
        return self._layer("call_index", lambda: cut(calls.call_edges(self.parsed)))

    def _functions(self) -> DataFrame:
        return self._layer("functions", lambda: cut(calls.functions(self.parsed)))

    def _resolutions(self) -> DataFrame:
        return self._layer("resolutions", lambda: cut(imports.resolutions(self.parsed, self.installed)))

    # Queries.

    def tree(self) -> DataFrame:
        return self.files.select("rel_path").orderBy("rel_path")

    def symbols(self, path: str | None = None) -> DataFrame:
        rows = self._symbols()
        return rows if path is None else rows.where(F.col("rel_path") == self._path(path))

    def lookup(self, name: str) -> DataFrame:
        return self._layer("reverse_index", lambda: cut(names.lookup(self.parsed))).where(F.col("name") == name).drop("name").distinct()

    def resolve(self, reference: str) -> str:
        """The id of a reference; methods are found by their function ids."""
        found = names.resolve_references(self.spark.createDataFrame([(reference,)], "reference string"), self._symbols()).first()
        if found["outcome"] == "ambiguous":
            raise errors.Ambiguous(reference)
        if found["outcome"] == "missing":
            if self._functions().where(F.col("id") == reference).isEmpty():
                raise errors.NotFound(reference)
            return reference
        return found["id"]

    def import_graph(self, resolved: bool = True) -> graph.Graph:
        nodes, edges = self._layer("import_graph", lambda: tuple(map(cut, imports.brief_graph(self.parsed))))
        if resolved:
            edges = self._layer("resolved_graph", lambda: cut(imports.resolved_graph(self.parsed, self.installed)))
            outside = edges.where("to_id not like 'file:%'").select(F.col("to_id").alias("id"), F.lit("module").alias("type"), F.regexp_replace("to_id", "^[a-z]+:", "").alias("name")).distinct()
            nodes = nodes.where("type = 'file'").unionByName(outside)
        return graph.Graph(nodes, edges, {"kind": "import_graph", "resolved": resolved})

    def call_graph(self, symbol: str | None = None) -> graph.Graph:
        nodes, edges = calls.call_graph(self.parsed, self._edges())
        if symbol is not None:
            nodes = nodes.where(F.contains("id", F.lit(symbol)) | (F.col("name") == symbol))
            end = f":function:{symbol}"
            edges = edges.where((F.col("from_id") == symbol) | (F.col("to_id") == symbol) | F.endswith("from_id", F.lit(end)) | F.endswith("to_id", F.lit(end)))
        return graph.Graph(nodes, edges, {"kind": "call_graph"})

    def control_flow(self, function_id: str) -> graph.Graph:
        path, _, name = function_id.partition(":function:")
        nodes, edges = structure.control_flow(self.parsed)
        own = nodes.where(F.endswith("function_id", F.lit(f"{path}:function:{name.rsplit('.', 1)[-1]}")))
        return graph.Graph(own, edges.join(own.select(F.col("id").alias("to_id")), "to_id", "left_semi"), {"kind": "control_flow", "function_id": function_id})

    def callers(self, symbol: str) -> DataFrame:
        return graph.neighbours(self._edges(), "callee_id", self.resolve(symbol))

    def callees(self, symbol: str) -> DataFrame:
        return graph.neighbours(self._edges(), "caller_id", self.resolve(symbol))

    def impact(self, target: str) -> graph.Graph:
        resolved = None
        if ":function:" in target or ":class:" in target:
            try:
                resolved = self.resolve(target)
            except errors.AnalysisError:
                resolved = target
        nodes, edges = graph.impact(self._edges(), self.import_graph(False).edges, self._functions(), target, resolved)
        nodes = cut(nodes)
        typed = nodes.join(self._functions().select("id", "qualname"), "id", "left").select("id", F.when(F.col("qualname").isNotNull(), "function").when(F.startswith("id", F.lit("file:")), "file").otherwise("impact").alias("type"), F.coalesce("qualname", F.regexp_replace("id", "^file:", "")).alias("name"))
        return graph.Graph(typed, edges, {"kind": "impact_analysis", "target": target, "impacted_count": nodes.count()})

    def usages(self, symbol: str) -> DataFrame:
        return structure.usages(self.parsed).where(F.col("name") == symbol.rsplit(":", 1)[-1].rsplit(".", 1)[-1])

    def diagnostics(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Lint findings and complexity of a file."""
        here = F.col("rel_path") == self._path(path)
        return structure.lint(self.parsed).where(here), structure.complexity(self.parsed).where(here)

    def dead_code(self, path: str | None = None) -> DataFrame:
        rows = structure.dead_code(self.parsed)
        return rows if path is None else rows.where(F.col("rel_path") == self._path(path))

    def explain(self, symbol: str) -> dict[str, DataFrame]:
        """All that is known about a symbol, by section."""
        own = self.resolve(symbol)
        path = own.split(":", 1)[0]
        lint, complexity = self.diagnostics(path)
        flow = self.control_flow(own)
        return {"symbols": self.symbols(path), "imports": self._resolutions().where(F.col("rel_path") == path), "lint": lint, "complexity": complexity, "control_flow": flow.nodes, "usages": self.usages(own), "callers": self.callers(own), "callees": self.callees(own)}

    def import_diagram(self) -> DataFrame:
        """DOT statements of the project's inner imports, labels merged."""
        edges = self.import_graph(False).edges.where("kind = 'project'")
        return render.dot(edges.select(F.substring("from_id", 6, 10_000).alias("source"), F.substring("to_id", 6, 10_000).alias("target"), "label"))

    def dependency_summary(self, path: str | None = None) -> DataFrame:
        rows = self._resolutions()
        return imports.summary(rows if path is None else rows.where(F.col("rel_path") == self._path(path)))

    def symbol_summary(self, path: str | None = None) -> DataFrame:
        return structure.symbol_summary(self.symbols(path))

    def render(self, kind: str, target: str | None = None) -> str:
        """An HTML page of an import, call, control_flow or impact graph."""
        make = {"import": lambda: self.import_graph(False), "call": lambda: self.call_graph(target), "control_flow": lambda: self.control_flow(target or ""), "impact": lambda: self.impact(target or "")}
        if kind not in make:
            raise errors.AnalysisError(f"no such diagram: {kind}")
        g = make[kind]()
        return render.page(g.nodes.select("id", "name"), g.edges.withColumn("label", F.lit("")) if "label" not in g.edges.columns else g.edges, f"{kind} {target or ''}".strip())

    # State.

    def warm(self) -> int:
        self._symbols(), self._edges(), self._functions()
        return self.files.count()

    def status(self) -> dict:
        """What a client asks first."""
        return {"root": self.root, "files": self.files.count(), "parsed": self.relation("file").where("is_ok").count(), "queries": dict(self.counts)}

    def stats(self) -> dict:
        return {"layers": sorted(self.layers), "queries": dict(self.counts)}

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame([(k, v) for k, v in CATALOG.items()], "name string, arguments string")

    def revision(self) -> DataFrame:
        return structure.revision(self.files.select("rel_path", F.substring(F.sha2(F.coalesce("source", F.lit("")), 256), 1, 16).alias("content_hash")))

    def invalidate(self, files: DataFrame) -> dict[str, bool]:
        """Take new texts of the project, parse the changed ones, and drop the layers whose facet changed; which ones they are."""
        new = cut(files.select("rel_path", "source"))
        content = lambda rows: rows.select("rel_path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("h"))
        changed = cut(content(new).join(content(self.files), ["rel_path", "h"], "left_anti").select("rel_path"))
        stale = changed.union(self.files.join(new, "rel_path", "left_anti").select("rel_path")).distinct()
        parsed = cut(self.parsed.join(stale, "rel_path", "left_anti").unionByName(parse_files(new.join(changed, "rel_path", "left_semi"), self.include_async)))
        layers = structure.changed_layers(structure.signatures(self.parsed, self.files), structure.signatures(parsed, new))
        row = layers.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("import_graph", "call_index", "reverse_index")]).first().asDict()
        depends = {"import_graph": ("import_graph", "resolved_graph", "resolutions"), "call_index": ("call_index", "functions"), "reverse_index": ("reverse_index", "symbols", "functions", "call_index")}
        with self.lock:
            self.files, self.parsed = new, parsed
            for facet, own in depends.items():
                if row[facet]:
                    for name in own:
                        self.layers.pop(name, None)
        return row
