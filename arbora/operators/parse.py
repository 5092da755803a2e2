"""The parser: one pass over source files, in parallel, into tagged rows.

``parse_files`` maps (rel_path, source) to rows of one wide schema; each table
of :data:`TABLES` is a filter and a projection of it, so every relation of the
engine comes from a single scan.  A file is parsed in one task and nothing is
collected.  A file that does not parse gives one ``file`` row with its error
and no others.
"""

from __future__ import annotations

import ast
import gc
import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "rel_path string, tab string, ord int, parent_ord int, depth int, kind string, name string, qualname string, line int, end_line int, col int, "
    "label string, receiver string, chain array<string>, text string, level int, flag boolean, first string, second string"
)
_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

#: Columns of each table, as SQL over the tagged rows.
TABLES = {
    "file": ["flag AS is_ok", "text AS error", "label AS docstring", "end_line AS n_lines"],
    "def": ["ord", "parent_ord", "depth", "kind", "name", "qualname", "line", "end_line", "flag AS is_async", "chain AS bases", "text AS decorators", "label AS args"],
    "global": ["ord", "name", "line"],
    "import": ["ord", "name", "label", "receiver AS alias", "line", "level"],
    "item": ["parent_ord AS import_ord", "ord", "name", "receiver AS alias"],
    "span": ["ord", "qualname", "name AS short", "line AS line_start", "end_line AS line_end"],
    "call": ["ord", "line", "col", "label", "name AS callee_name", "receiver", "chain", "qualname", "text AS local_qualname", "first AS receiver_import", "second AS name_import"],
    "import_map": ["ord", "name AS local", "qualname AS qualified"],
    "local_type": ["ord", "qualname", "name AS var", "text AS type_qualified"],
    "fragment": ["ord", "parent_ord", "level AS idx", "kind AS type_name", "qualname AS function", "line AS line_start", "end_line AS line_end"],
    "ref": ["ord", "name", "line", "col", "kind AS ctx"],
    "lint": ["ord", "line", "text AS message", "flag AS suppressed"],
    "complexity": ["ord", "name", "line", "level AS complexity"],
}

# Fixed value: the comment that switches a line's findings off.
SUPPRESS = re.compile(r"analysis:\s*(off|disable|ignore)", re.I)

_FRAGMENTS = {
    ast.For: "_ForFrag", ast.AsyncFor: "_ForFrag", ast.While: "_WhileFrag", ast.If: "_IfFrag", ast.With: "_WithFrag", ast.AsyncWith: "_WithFrag", ast.Try: "_TryFrag",
    ast.Return: "_ReturnFrag", ast.Raise: "_RaiseFrag", ast.Break: "_BreakFrag", ast.Continue: "_ContinueFrag", ast.Assert: "_AssertFrag",
    ast.Import: "_ImportFrag", ast.ImportFrom: "_ImportFrag", ast.FunctionDef: "_FunctionFrag", ast.AsyncFunctionDef: "_FunctionFrag", ast.ClassDef: "_ClassFrag",
}
_DESCENDS = (ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def dotted(node: ast.expr) -> list[str] | None:
    """The names of a.b.c, or None for any other expression."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [*names, node.id][::-1] if isinstance(node, ast.Name) else None


def module_name(rel_path: str) -> str:
    """a/b.py is a.b, a/__init__.py is a."""
    stem = rel_path.removesuffix(".py")
    return ("" if stem == "__init__" else stem.removesuffix("/__init__")).replace("/", ".")


def cyclomatic(node: ast.AST) -> int:
    """McCabe's number: one, and one more for each decision."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
    return n


class _File:
    """Rows of one file, of the named tables."""

    def __init__(self, rel_path: str, source: str, include_async: bool, tables: Collection[str]) -> None:
        self.rel_path, self.source, self.tables, self.rows = rel_path, source, frozenset(tables), []
        self.functions = (ast.FunctionDef, ast.AsyncFunctionDef) if include_async else (ast.FunctionDef,)
        self.count: dict[str, int] = {}

    def add(self, tab: str, **columns) -> int:
        number = self.count[tab] = self.count.get(tab, -1) + 1
        if tab in self.tables:
            self.rows.append({"rel_path": self.rel_path, "tab": tab, "ord": number} | columns)
        return number

    def parse(self) -> list[dict]:
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as error:
            self.add("file", flag=False, text=f"{type(error).__name__}: {getattr(error, 'msg', error)}", end_line=self.source.count("\n") + 1)
            return self.rows
        self.walked = list(ast.walk(tree))
        self.add("file", flag=True, label=ast.get_docstring(tree), end_line=self.source.count("\n") + 1)
        spans = self._brief(tree)
        imports = self._import_map()
        if "call" in self.tables:
            self._calls(spans, imports)
        if "local_type" in self.tables:
            self._local_types(spans, imports)
        if not self.tables.isdisjoint(("ref", "fragment")):
            self._names()
        if not self.tables.isdisjoint(("lint", "complexity")):
            self._findings(tree)
        return self.rows

    def _brief(self, tree: ast.Module) -> list[tuple[str, int, int]]:
        """Definitions, globals, imports and spans: what stands directly in the module, in classes and one level in functions."""
        spans: list[tuple[str, int, int]] = []

        def define(node, parent: int | None, depth: int, prefix: str) -> int:
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            args = [] if kind == "class" else [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
            return self.add("def", parent_ord=parent, depth=depth, kind=kind, name=node.name, qualname=prefix + node.name, line=node.lineno, end_line=node.end_lineno, flag=isinstance(node, ast.AsyncFunctionDef), chain=[ast.unparse(b) for b in node.bases] if kind == "class" else [], text=", ".join(ast.unparse(d) for d in node.decorator_list), label=", ".join(args))

        def span(node, qualname: str) -> None:
            spans.append((qualname, node.lineno, node.end_lineno))

        known = set()
        methods = []
        for node in tree.body:
            if isinstance(node, self.functions):
                own = define(node, None, 0, "")
                span(node, node.name)
                for inner in node.body:
                    if isinstance(inner, self.functions):
                        define(inner, own, 1, f"{node.name}.")
                        span(inner, f"{node.name}.{inner.name}")
            elif isinstance(node, ast.ClassDef):
                own = define(node, None, 0, "")
                for inner in node.body:
                    if isinstance(inner, self.functions):
                        define(inner, own, 1, f"{node.name}.")
                        methods.append((inner, f"{node.name}.{inner.name}"))
            elif isinstance(node, ast.Assign):
                name = next((t.id for t in node.targets if isinstance(t, ast.Name)), None)
                if name is not None and name not in known:
                    known.add(name)
                    self.add("global", name=name, line=node.lineno)
            elif isinstance(node, ast.Import):
                for alias in node.names:
                    self.add("import", name=alias.name, label="", receiver=alias.asname, line=node.lineno, level=0)
            elif isinstance(node, ast.ImportFrom):
                own = self.add("import", name="." * node.level + (node.module or ""), label=", ".join(a.name for a in node.names), line=node.lineno, level=node.level)
                for alias in node.names:
                    self.add("item", parent_ord=own, name=alias.name, receiver=alias.asname)
        for node, qualname in methods:
            span(node, qualname)
        for qualname, line, end_line in spans:
            self.add("span", qualname=qualname, name=qualname.rsplit(".", 1)[-1], line=line, end_line=end_line)
        return spans

    def _import_map(self) -> dict[str, str]:
        """Local name to qualified name for imports anywhere in the file; the last one walked wins."""
        package = [p for p in module_name(self.rel_path).split(".") if p]
        found: dict[str, str] = {}
        for node in self.walked:
            if isinstance(node, ast.Import):
                found |= {a.asname or a.name.partition(".")[0]: a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                base = package[: max(0, len(package) - node.level)] if node.level else []
                stem = base + (node.module.split(".") if node.module else [])
                found |= {a.asname or a.name: ".".join([*stem, a.name]) for a in node.names if a.name != "*"}
        for local, qualified in found.items():
            self.add("import_map", name=local, qualname=qualified)
        return found

    def _calls(self, spans: list[tuple[str, int, int]], imports: dict[str, str]) -> None:
        """Calls with what the file itself says of them: the innermost function, what the names were imported as, and a local function of the name."""
        inside: dict[int, str] = {}
        for qualname, first, last in sorted(reversed(spans), key=lambda s: s[1]):  # later starts go over earlier ones
            inside |= dict.fromkeys(range(first, last + 1), qualname)
        local = {qualname.rsplit(".", 1)[-1]: qualname for qualname, _, _ in spans}
        for node in self.walked:
            if not isinstance(node, ast.Call) or not isinstance(node.func, (ast.Name, ast.Attribute)):
                continue
            chain = dotted(node.func)
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr
            receiver = chain[0] if chain and len(chain) > 1 else None
            self.add("call", line=node.lineno, col=node.col_offset, label=".".join(chain) if chain else name, name=name, receiver=receiver, chain=chain or [], qualname=inside.get(node.lineno), text=local.get(name), first=imports.get(receiver), second=imports.get(name))

    def _local_types(self, spans: list[tuple[str, int, int]], imports: dict[str, str]) -> None:
        """Variables of a function with the class or name that they were assigned, through aliases."""
        assigned = sorted(((n.lineno, k, t.id, n.value) for k, n in enumerate(self.walked) if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)), key=lambda x: x[:2])
        lines = [x[0] for x in assigned]
        for qualname, first, last in spans:
            own = [(target, value) for _, _, target, value in assigned[bisect_left(lines, first) : bisect_right(lines, last)]]
            types: dict[str, str] = {}
            for _ in range(8):  # fixed value: passes over a function
                before = dict(types)
                for target, value in own:
                    if isinstance(value, ast.Name):
                        types[target] = types.get(value.id) or imports.get(value.id, value.id)
                    elif isinstance(value, ast.Call) and (chain := dotted(value.func)):
                        types[target] = ".".join([imports.get(chain[0], chain[0]), *chain[1:]])
                if types == before:
                    break
            for var, kind in types.items():
                self.add("local_type", qualname=qualname, name=var, text=kind)

    def _fragments(self, body: list[ast.stmt], function: str, parent: int | None) -> None:
        """Statements as a containment tree; branches of an if are not descended."""
        index = 0
        for node in body:
            kind = next((v for k, v in _FRAGMENTS.items() if type(node) is k), None)
            if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and dotted(node.value.func) == ["sys", "exit"]:
                kind = "_SysExitFrag"
            if kind is None:
                kind = "_CodeBlock"
            own = self.add("fragment", parent_ord=parent, level=index, kind=kind, qualname=function, line=node.lineno, end_line=node.end_lineno)
            index += 1
            if isinstance(node, _DESCENDS):
                self._fragments(node.body, function, own)

    def _names(self) -> None:
        for node in self.walked:
            if isinstance(node, ast.Name):
                self.add("ref", name=node.id, line=node.lineno, col=node.col_offset, kind=type(node.ctx).__name__.lower())
            elif isinstance(node, ast.Attribute):
                self.add("ref", name=node.attr, line=node.lineno, col=node.col_offset, kind="attribute")
            elif isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
                self.add("ref", name=node.value, line=node.lineno, col=node.col_offset, kind="string")
        for node in self.walked:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self._fragments(node.body, node.name, None)

    def _findings(self, tree: ast.Module) -> None:
        lines = self.source.splitlines()
        off = lambda line: bool(0 < line <= len(lines) and SUPPRESS.search(lines[line - 1]))
        used = {n.id for n in self.walked if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Load, ast.Del))}
        exported = {c.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) for c in ast.walk(n.value) if isinstance(c, ast.Constant)}
        needed = used | exported
        messages = []
        for node in self.walked:
            if isinstance(node, (ast.Import, ast.ImportFrom)) and getattr(node, "module", None) != "__future__":
                for a in node.names:
                    local = a.asname or a.name.partition(".")[0]
                    if a.name != "*" and local not in needed:
                        full = f"{node.module}.{a.name}" if isinstance(node, ast.ImportFrom) and node.module else a.name
                        messages.append((node.lineno, f"'{full}{f' as {a.asname}' if a.asname else ''}' imported but unused"))
        seen: dict[str, int] = {}
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if node.name in seen:
                    messages.append((node.lineno, f"redefinition of unused '{node.name}' from line {seen[node.name]}"))
                seen[node.name] = node.lineno
        for line, message in sorted(messages):
            self.add("lint", line=line, text=message, flag=off(line))
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.add("complexity", name=node.name, line=node.lineno, level=cyclomatic(node))
            elif isinstance(node, ast.ClassDef):
                for inner in node.body:
                    if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        self.add("complexity", name=f"{node.name}.{inner.name}", line=inner.lineno, level=cyclomatic(inner))


def parse_source(rel_path: str, source: str, include_async: bool = False, tables: Collection[str] = tuple(TABLES)) -> list[dict]:
    """All rows of one file, of the named tables."""
    collecting = gc.isenabled()
    gc.disable()  # a tree has no cycles, and every full collection walks all of it
    try:
        return _File(rel_path, source, include_async, tables).parse()
    finally:
        if collecting:
            gc.enable()


def parse_files(files: DataFrame, include_async: bool = False, tables: Collection[str] = tuple(TABLES)) -> DataFrame:
    """Tagged rows, of the named tables, of every file of (rel_path, source); a null source is an empty file."""

    schema = pa.schema([(n, _ARROW.get(t, pa.string())) for n, t in (c.split() for c in SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist(parse_source(path, source.as_py() or "", include_async, tables), schema)

    return files.select("rel_path", "source").mapInArrow(run, SCHEMA)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One relation of the tagged rows."""
    return parsed.where(F.col("tab") == name).selectExpr("rel_path", *TABLES[name])
