"""Fixture projects through the workspace."""

import inspect

import pytest

from arbora import errors
from arbora.functions import render, text
from arbora.operators import graph, names
from arbora.operators.parse import parse_source
from arbora.plans.workspace import Workspace
from arbora.sources import scan
from arbora.streaming import refresh
from pyspark.sql import functions as F

SOIL = """import math
import absent_lib

DEPTH = 4


def acidity(sample):
    return math.log(sample)


def moisture(sample):
    guess(sample)
    return acidity(sample)
"""
BEDS = """from garden.soil import moisture
from . import soil


class Bed:
    width = 2

    def water(self):
        return self.measure()

    def measure(self):
        return moisture(self.width)


def survey(bed):
    return soil.acidity(bed)
"""
SEASON = """from garden.beds import Bed
import garden.soil as ground


def spring():
    first = Bed()
    second = first
    second.water()
    ground.moisture(1)
    return summer()


def summer():
    return None


def survey():
    return summer()
"""
PROJECT = {"garden/__init__.py": "", "garden/soil.py": SOIL, "garden/beds.py": BEDS, "season.py": SEASON, "torn.py": "def half(:\n", "bare.py": ""}


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace(spark, scan.from_rows(spark, PROJECT))


def edges(ws):
    return {(r["caller_id"], r["callee_id"]): r["confidence"] for r in ws._edges().collect()}


def test_call_rules(workspace):
    found = edges(workspace)
    bed, soil, season = ("garden/beds.py:function:", "garden/soil.py:function:", "season.py:function:")
    assert found[bed + "Bed.measure", soil + "moisture"] == 0.8
    assert found[bed + "Bed.water", bed + "Bed.measure"] == 0.85
    assert found[season + "spring", bed + "Bed.water"] == 0.85
    assert found[season + "spring", season + "summer"] == 0.9
    assert found[soil + "moisture", soil + "acidity"] == 0.9
    assert found[soil + "acidity", "external:function:math.log"] == 0.55
    assert found[soil + "moisture", "external:function:guess"] == 0.3


def test_callers_and_callees(workspace):
    assert {r["caller_id"] for r in workspace.callers("season.py:function:summer").collect()} == {"season.py:function:spring", "season.py:function:survey"}
    assert workspace.callees("garden/soil.py:function:moisture").count() == 2


def test_impact(workspace):
    g = workspace.impact("garden/beds.py:function:Bed.measure")
    assert {"garden/beds.py:function:Bed.measure", "garden/beds.py:function:Bed.water", "season.py:function:spring"} <= {r["id"] for r in g.nodes.collect()}
    assert {r["id"] for r in workspace.impact("season.py").nodes.collect() if r["id"].startswith("file:")} == {"file:season.py"}
    assert workspace.impact("no_such_name").meta["impacted_count"] == 0


def test_references(workspace):
    assert workspace.resolve("garden/soil.py:global:DEPTH") == "garden/soil.py:global:DEPTH"
    assert workspace.resolve("spring") == "season.py:function:spring"
    with pytest.raises(errors.Ambiguous):
        workspace.resolve("survey")
    with pytest.raises(errors.NotFound):
        workspace.resolve("winter")
    with pytest.raises(errors.OutsideProject):
        workspace.symbols("../x.py")


def test_imports(workspace):
    kinds = {r["to_id"]: r["kind"] for r in workspace.import_graph(False).edges.collect()}
    assert kinds["module:math"] == "stdlib"
    assert kinds["file:garden/soil.py"] == "project"
    assert kinds["module:absent_lib"] == "third_party"
    totals = {r["bucket"]: r["n"] for r in workspace.dependency_summary().collect()}
    assert totals == {"project": 4, "system": 1, "unresolved": 1}


def test_summary_lookup_usages_and_dead_code(workspace):
    counts = {r["type"]: r["n"] for r in workspace.symbol_summary().collect()}
    assert counts["total"] == sum(v for k, v in counts.items() if k != "total")
    assert workspace.lookup("acidity").count() == 1
    assert workspace.usages("summer").count() == 2
    assert "spring" in {r["name"] for r in workspace.dead_code().collect()}


def test_diagnostics_explain_and_flow(workspace):
    lint, complexity = workspace.diagnostics("garden/soil.py")
    assert [r["message"] for r in lint.collect()] == ["'absent_lib' imported but unused"]
    assert complexity.first()["rank"] == "A"
    assert workspace.control_flow("season.py:function:spring").nodes.count() == 5
    assert {k: v.count() for k, v in workspace.explain("spring").items()}["callees"] == 4


def test_broken_and_empty_files(workspace):
    ok = {r["rel_path"]: r["is_ok"] for r in workspace.relation("file").collect()}
    assert ok["torn.py"] is False
    assert ok["bare.py"] is True
    assert workspace.symbols("torn.py").count() == 1


def test_render_and_sql(workspace):
    assert "<svg" in workspace.render("call")
    assert workspace.sql("select count(*) n from defs").first()["n"] > 5
    assert workspace.call_graph().to_dict()["edges"]


def test_invalidation(spark):
    ws = Workspace(spark, scan.from_rows(spark, PROJECT))
    ws.warm()
    same = PROJECT | {"season.py": SEASON + "\n# a comment\n"}
    assert not any(ws.invalidate(scan.from_rows(spark, same)).values())
    more = same | {"season.py": SEASON.replace("    ground.moisture(1)\n", "    ground.moisture(1)\n    ground.acidity(2)\n")}
    assert ws.invalidate(scan.from_rows(spark, more)) == {"import_graph": False, "call_index": True, "reverse_index": False}
    other = more | {"garden/beds.py": BEDS.replace("from garden.soil", "from garden.water")}
    dropped = ws.invalidate(scan.from_rows(spark, other))
    assert dropped["import_graph"] and dropped["call_index"] and not dropped["reverse_index"]
    batch = spark.createDataFrame([("season.py", 1, "x = 1\n"), ("season.py", 2, "y = 1\n")], "rel_path string, version int, source string")
    assert refresh.apply_batch(ws, batch)["reverse_index"]
    assert ws.symbols("season.py").where("type = 'global'").first()["name"] == "y"


def test_parser_details():
    rows = parse_source("a.py", "async def g():\n    pass\nclass A(B):\n    @d\n    def m(self, x=1):\n        pass\nx = y = 2\nz: int = 3\n")
    defs = [(r["kind"], r["qualname"]) for r in rows if r["tab"] == "def"]
    assert defs == [("class", "A"), ("function", "A.m")]
    assert [r["name"] for r in rows if r["tab"] == "global"] == ["x"]
    assert ("function", "g") in [(r["kind"], r["qualname"]) for r in parse_source("a.py", "async def g():\n    pass\n", True) if r["tab"] == "def"]


def test_closure_ends_with_the_frontier_or_says_that_it_did_not(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "callee_id int, caller_id int")
    seed = spark.createDataFrame([(0, 0)], "seed int, node int")
    assert inspect.signature(graph.closure).parameters["rounds"].default is None
    assert sorted(r["node"] for r in graph.closure(chain, seed).collect()) == [1, 2, 3, 4, 5]
    assert graph.closure(chain, seed, rounds=5).count() == 5
    with pytest.raises(RuntimeError):
        graph.closure(chain, seed, rounds=4)


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / ".venv").mkdir()
    (tmp_path / "pkg/a.py").write_bytes(b"# -*- coding: latin-1 -*-\nx = '\xe9'\n")
    (tmp_path / "pkg/b.py").write_bytes(b"\xef\xbb\xbfy = 1\n")
    (tmp_path / ".venv/c.py").write_text("z = 1\n")
    rows = {r["rel_path"]: r for r in scan.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"pkg/a.py", "pkg/b.py"}
    assert "é" in rows["pkg/a.py"]["source"]
    assert rows["pkg/b.py"]["source"] == "y = 1\n" and rows["pkg/b.py"]["encoding"] == "bom-utf-8"


def test_cookie_after_a_long_first_line(spark):
    long = b"# " + b"-" * 1000
    rows = [("n", long + b"\n# coding: latin-1\nx = '\xe9'\n"), ("rn", long + b"\r\n# coding: latin-1\r\nx = '\xe9'\r\n"), ("third", b"\n\n# coding: latin-1\nx = '\xe9'\n"), ("r", b"\r\r# coding: latin-1\rx = '\xe9'\r")]
    got = {r["k"]: r["encoding"] for r in text.decode(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert got == {"n": "latin-1", "rn": "latin-1", "third": "utf-8", "r": "utf-8"}


def test_text_functions(spark):
    row = spark.createDataFrame([("One.\n\n    Two.\n      Three.\n    ", "a\r\nb\rc\n")], "d string, t string").select(text.trim_docstring(F.col("d")).alias("d"), text.convert_eol(F.col("t")).alias("t"), names.decode_key(names.encode_key(F.lit("a/b.py:class:C"))).alias("k")).first()
    assert row["d"] == "One.\n\nTwo.\n  Three."
    assert row["t"] == "a\nb\nc\n"
    assert row["k"] == "a/b.py:class:C"


def test_plain_layout(spark):
    lines = spark.createDataFrame([("graph 1.0 2 3",), ('node "a b" 1 2 0.5 0.5 "A \\"x\\"" solid',), ("edge a b 2 0 0 1 1 solid black",)], "value string")
    g, nodes, found = render.parse_plain(lines)
    assert g.first()["scale"] == 1.0
    assert nodes.first()["id"] == "a b" and nodes.first()["label"] == 'A "x"'
    assert len(found.first()["points"]) == 2


def test_encodings_and_bytecode(spark):
    import marshal

    from arbora.functions import bytecode, encodings

    row = spark.createDataFrame([("UTF8", "# coding: latin-1\n", "iso-8859-1")], "n string, t string, u string").select(encodings.normal_name("n").alias("n"), encodings.agrees(F.col("t"), F.col("u")).alias("ok"), encodings.exists(F.lit("no-such")).alias("no")).first()
    assert (row["n"], row["ok"], row["no"]) == ("utf-8", True, False)
    rows = {r["rel_path"]: r["code"] for r in bytecode.compiled(scan.from_rows(spark, {"a.py": "x = 1\n", "b.py": "("})).collect()}
    assert marshal.loads(rows["a.py"]).co_names == ("x",)
    assert rows["b.py"] is None


def test_status_hints_and_json(workspace):
    from arbora.operators import imports, structure

    assert workspace.status()["files"] == len(PROJECT)
    assert imports.install_hint(imports.unresolved_packages(workspace._resolutions())) == "pip install absent_lib"
    assert imports.on_line(workspace.parsed, 1).where("rel_path = 'garden/beds.py'").first()["name"] == "garden.soil"
    assert '"kind": "import_graph"' in workspace.import_graph(False).to_json()
    assert structure.names_of(workspace.parsed).where("private").count() == 0
    assert structure.flow_text(workspace.parsed).where("function = 'spring'").first()["shown"].count("_ReturnFrag") == 1


def test_following_a_stream(spark, tmp_path):
    ws = Workspace(spark, scan.from_rows(spark, {"a.py": "x = 1\n"}))
    source = tmp_path / "in"
    spark.createDataFrame([("a.py", 1, "y = 1\n"), ("b.py", 1, "z = 1\n")], "rel_path string, version int, source string").write.parquet(str(source))
    heard = []
    stream = spark.readStream.schema("rel_path string, version int, source string").parquet(str(source))
    running = refresh.follow(ws, stream, str(tmp_path / "check"), lambda n, dropped: heard.append((n, dropped["reverse_index"])))
    running.processAllAvailable()
    running.stop()
    assert heard == [(0, True)]
    assert sorted(r["name"] for r in ws.relation("global").collect()) == ["y", "z"]


def test_open_a_directory(spark, tmp_path):
    for path, source in {"a.py": "import b\n", "b.py": "def f():\n    pass\n", "gen/c.py": "x = 1\n", "project.json": '{"excludeFromAnalysis": ["gen"]}'}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(source)
    ws = Workspace.open(spark, str(tmp_path), config="project.json")
    assert [r["rel_path"] for r in ws.tree().collect()] == ["a.py", "b.py"]
    assert ws.import_graph(False).edges.first()["to_id"] == "file:b.py"
    assert ws.symbols(str(tmp_path / "b.py")).count() == 2


def test_first_wins_by_place_and_without_nulls(spark):
    rows = spark.createDataFrame([(1, None, 5, 2), (1, "b", 5, 3), (1, "c", 5, 9), (2, "d", None, 1), (None, "e", 1, 1), (3, None, 4, 1)], "id int, name string, ord int, row_no int").orderBy(F.desc("row_no"))
    kept = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert kept(graph.first_wins(rows, ties=("row_no",))) == [(1, None, 5), (2, None, None), (3, None, 4), (None, "e", 1)]
    assert kept(graph.first_wins(rows, ties=("row_no",), skip_null=True)) == [(1, "b", 5), (2, None, None), (3, None, 4), (None, "e", 1)]


@pytest.mark.parametrize("tables", [("import", "item", "def", "global", "call"), ("ref",), ("fragment",), ("lint", "complexity"), ("local_type", "span"), ("file", "import_map")])
def test_named_tables_are_those_of_all(tables):
    for source in (SOIL, BEDS, SEASON, "def broken("):
        assert parse_source("garden/x.py", source, tables=tables) == [r for r in parse_source("garden/x.py", source) if r["tab"] in tables]
