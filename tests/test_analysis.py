"""Sources, parsing, resolution and the whole analysis, on small repositories with expectations worked out by hand."""

import io
import tarfile
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrymap.config import Config
from quarrymap.operators import modules
from quarrymap.operators.parsing import parse_source
from quarrymap.plans import demo
from quarrymap.plans.analysis import analyze
from quarrymap.schemas import IMPORT
from quarrymap.sources import repositories as repos
from quarrymap.streaming.arrivals import analyze_arrivals, read_arrivals


def test_parse_source():
    got = parse_source('"""Module."""\nimport os.path as p, sys\nfrom ..a import b as c\nx = 1\n\n@app.get("/x")\nasync def f():\n    if x and x or x:\n        return [y for y in x if y]\n\nclass C:\n    """Doc."""\n\nif __name__ == "__main__":\n    f()\n')
    assert got["docstring"] == "Module." and got["has_main_block"] and got["parse_status"] == "ok"
    assert [(i["module"], i["names"], i["level"], i["raw"]) for i in got["imports"]] == [("os.path", ["p"], 0, "import os.path"), ("sys", ["sys"], 0, "import sys"), ("a", ["c"], 2, "from ..a import b")]
    assert [(s["name"], s["kind"], s["line_start"], s["line_end"], s["decorators"], s["docstring"]) for s in got["symbols"]] == [("f", "async_function", 7, 9, ["app.get"], None), ("C", "class", 11, 12, [], "Doc.")]
    assert got["estimated_complexity"] == 1 + 1 + 1 + 2 + 1  # two ifs, an `or` of two, an `and` of two, a filtered comprehension
    assert (got["module_level_start"], got["module_level_end"]) == (1, 15)


@pytest.mark.parametrize(("source", "warning"), [("def oops(\n", "SyntaxError: "), ("\0", "")])
def test_parse_errors_are_per_file(source, warning):
    got = parse_source(source)
    assert got["parse_status"] == "error" and got["parse_warning"].startswith(warning) and got["imports"] == []


def test_match_and_ternary_complexity():
    assert parse_source("match x:\n    case 1: pass\n    case _: pass\ny = 1 if x else 2\n")["estimated_complexity"] == 3
    assert parse_source("try:\n    pass\nexcept E:\n    pass\nwhile x: pass\n")["estimated_complexity"] == 2
    assert parse_source("if '__main__' == __name__:\n    pass\n")["has_main_block"] is False


def statement(path, module, names, level=0, is_from=True, line=1):
    return path, [(module, names, level, line, is_from, "")]


def resolve(spark, tree, *statements):
    files = spark.createDataFrame([("r", p) for p in tree], "analysis_id string, path string")
    parsed = spark.createDataFrame([("r", p, i) for p, i in statements], f"analysis_id string, path string, imports array<{IMPORT}>")
    got = modules.resolve_imports(modules.import_rows(parsed), modules.module_map(files)).orderBy("source_path", "nth", "try").collect()
    return [(r.imported_module, r.imported_names, r.target_path, r.confidence, r.unresolved_reason) for r in got]


NO = ("low", "external_or_unresolved")


@pytest.mark.parametrize(
    ("statement_", "want"),
    [
        (statement("a/x.py", "a.b", ["b"], is_from=False), [("a.b", ["b"], "a/b.py", "high", None)]),
        (statement("a/x.py", "os", ["os"], is_from=False), [("os", ["os"], None, *NO)]),
        (statement("a/x.py", "a.b", ["t", "u"]), [("a.b", ["t", "u"], "a/b.py", "high", None)]),
        (statement("a/x.py", "pk", ["sub"]), [("pk", ["sub"], "pk/__init__.py", "high", None)]),
        (statement("a/x.py", "a", ["b", "zz", "x"]), [("a.b", ["b"], "a/b.py", "high", None), ("a.x", ["x"], "a/x.py", "high", None)]),
        (statement("a/x.py", "a", ["zz", "yy"]), [("a", ["zz", "yy"], None, *NO)]),
        (statement("a/x.py", None, ["b", "zz"], 1), [("a.b", ["b"], "a/b.py", "high", None), ("a.zz", ["zz"], None, *NO)]),
        (statement("a/x.py", "b", ["t"], 1), [("a.b", ["t"], "a/b.py", "high", None)]),
        (statement("pk/__init__.py", "sub", ["t"], 1), [("pk.sub", ["t"], "pk/sub.py", "high", None)]),
        (statement("a/x.py", "pk", ["t"], 2), [("pk", ["t"], "pk/__init__.py", "high", None)]),
        (statement("a/x.py", "pk", ["t"], 3), [("pk", ["t"], None, "low", "relative_level_too_high")]),
        (statement("src/__init__.py", "pk", ["t"], 1), [("pk", ["t"], None, "low", "relative_import_without_source_module")]),
        (statement("a/x.py", "dup", ["t"]), [("dup", ["t"], "dup/__init__.py", "high", None)]),
    ],
)
def test_import_branches(spark, statement_, want):
    tree = ["a/x.py", "a/b.py", "pk/__init__.py", "pk/sub.py", "src/__init__.py", "dup.py", "dup/__init__.py"]
    assert resolve(spark, tree, statement_) == want


@pytest.fixture(scope="module")
def bundle(spark):
    return analyze(demo.raw_files(spark))


def test_files_of_the_demonstration(bundle):
    got = {(r.analysis_id, r.path): r for r in bundle.files.collect()}
    S = "src/shop/"
    want = {  # incoming, outgoing, symbols, entry confidence, category, importance
        f"{S}main.py": (0, 1, "high", "Entry Point", 1 + 25 + 1.5 + 20), f"{S}api/routes.py": (1, 0, "high", "Entry Point", 4 + 25 + 1.5 + 20),
        f"{S}services/orders.py": (1, 2, None, "Services", 4 + 2 + 1.5 + 10), f"{S}models/order.py": (1, 0, None, "Models / Data", 4 + 1.5 + 8), f"{S}core/settings.py": (0, 0, None, "Core / Domain", 10.0),
        f"{S}utils/ids.py": (1, 0, None, "Utilities", 4 + 1.5 + 4), "tests/test_orders.py": (0, 1, None, "Tests", 1 + 1.5 + 2), f"{S}__init__.py": (0, 0, None, "Other", 0.0), f"{S}api/__init__.py": (0, 0, None, "API / Routes", 12.0),
    }
    for path, (i, o, confidence, category, score) in want.items():
        r = got["shop", path]
        assert (r.incoming_count, r.outgoing_count, r.entrypoint_confidence, r.category, r.importance_score) == (i, o, confidence, category, score), path
    assert got["shop", f"{S}main.py"].external_imports == ["shop.core"]  # `from .core import settings` never tries a submodule
    assert got["shop", f"{S}main.py"].entrypoint_reasons == [
        "Filename matches common entry-point pattern (main.py)", 'Contains if __name__ == "__main__" block', "Calls uvicorn.run", "Referenced by console script (shop.main:run)",
    ]
    assert got["shop", f"{S}api/routes.py"].external_imports == ["fastapi", "shop.models", "shop.services"][:1] + ["shop.models", "shop.services"]
    assert ("shop", ".venv/lib/x.py") not in got and got["broken", "tool.py"].parse_status == "error"


def test_summaries_of_the_demonstration(bundle):
    stats = {r.analysis_id: r for r in bundle.statistics.collect()}
    assert stats["shop"].python_file_count == 9 and stats["shop"].internal_dependency_edges == 4 and stats["shop"].entry_point_count == 2 and stats["broken"].parse_warning_count == 1
    first = [r.path for r in bundle.start_here().filter("analysis_id = 'shop'").orderBy("rank").collect()]
    assert first[:3] == ["src/shop/api/routes.py", "src/shop/main.py", "src/shop/services/orders.py"] and "tests/test_orders.py" not in first
    selected = bundle.files.filter("path = 'src/shop/utils/ids.py'")
    impact = bundle.impact(selected).first()
    assert impact.direct_dependents == ["src/shop/services/orders.py"] and impact.second_level_dependents == ["tests/test_orders.py"] and impact.related_tests == ["tests/test_orders.py"]
    assert impact.representative_paths == [["src/shop/utils/ids.py", "src/shop/services/orders.py"], ["src/shop/utils/ids.py", "src/shop/services/orders.py", "tests/test_orders.py"]]
    assert {r.warning for r in bundle.warnings.collect()} == {r.warning for r in bundle.warnings.collect() if r.warning.startswith("tool.py: SyntaxError")}
    assert bundle.readmes.first().readme_excerpt == "# shop\n"


def test_chunks_of_the_demonstration(spark, bundle):
    chunks = [(r.chunk_type, r.symbol_name, r.line_start, r.line_end) for r in bundle.chunks.filter("path = 'src/shop/main.py'").orderBy("nth").collect()]
    assert chunks == [("module_overview", None, 1, 13), ("module_level", None, 1, 13), ("function", "run", 6, 9)]
    overview = bundle.chunks.filter("path = 'src/shop/main.py' AND nth = 0").first()
    assert overview.content == "Start.\n\nImports:\nfrom shop.api.routes import build\nfrom .core import settings\n\nSymbols: function:run"
    assert overview.search_text == "src/shop/main.py\n" + overview.content
    assert bundle.chunks.filter("path = 'src/shop/__init__.py' OR analysis_id = 'broken' AND path = 'tool.py'").count() == 0
    for n, want in ((120, 1), (121, 2), (241, 3)):
        source = "def f():\n" + "    x = 1\n" * (n - 1)
        cut = analyze(repos.from_rows(spark, [("w", "a.py", source)])).chunks.filter("chunk_type = 'function'")
        assert cut.count() == want
    secret = analyze(repos.from_rows(spark, [("w", "a.py", "secret = 'abcdefghijklmnop'\n")]))
    assert secret.chunks.count() == 0 and secret.files.count() == 1


def test_scan_limits(spark):
    raw = repos.from_rows(spark, [("r", p, "x" * n) for p, n in (("b.py", 5), ("a/__init__.py", 1), ("a.py", 1), ("big.py", 50), ("other.txt", 1), ("venv/x.py", 1))])
    kept, warnings = repos.scan(raw, Config(max_file_bytes=10))
    assert [r.path for r in kept.orderBy("scan_order").collect()] == ["a/__init__.py", "a.py", "b.py"]
    assert [r.warning for r in warnings.collect()] == ["Skipped oversized file: big.py"]
    kept, warnings = repos.scan(raw, Config(max_extracted_files=2))
    assert kept.count() == 2 and [r.warning for r in warnings.collect()] == ["File count limit reached while scanning."]
    with pytest.raises(PySparkException, match="Too many Python files"):
        repos.scan(raw, Config(max_python_files=1))[0].collect()


def test_directory_and_archives_agree(spark, tmp_path):
    for path, content in demo.SHOP.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(content)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "shop.tar.gz").write_bytes(demo.tar_bytes(demo.SHOP))
    (tmp_path / "packed" / "shop.zip").write_bytes(demo.zip_bytes(demo.SHOP))
    rows = lambda df: sorted((r.path, r.size_bytes, r.kind, r.content) for r in df.collect())
    tree = rows(repos.read_directory(spark, str(tmp_path / "tree"), "shop"))
    packed = repos.read_archives(spark, str(tmp_path / "packed"))
    assert len(tree) == len(demo.SHOP)
    assert rows(packed.filter("analysis_id = 'shop.zip'")) == rows(packed.filter("analysis_id = 'shop.tar.gz'")) == tree


def bad_archives():
    link = io.BytesIO()
    with tarfile.open(fileobj=link, mode="w") as t:
        member = tarfile.TarInfo("top/l")
        member.type, member.linkname = tarfile.SYMTYPE, "x"
        t.addfile(member)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        info = zipfile.ZipInfo("top/l")
        info.external_attr = 0o120777 << 16
        z.writestr(info, "x")
    return [
        ("a.tar", link.getvalue(), "symlinks"), ("a.zip", zipped.getvalue(), "symlinks"), ("a.tar", demo.tar_bytes({"../../x.py": ""}), "Unsafe"), ("a.zip", b"junk", "corrupt"), ("a.tar.gz", b"junk", "corrupt"),
        ("a.tar", demo.tar_bytes({f"{k}.py": "" for k in range(5)}), "Too many files"), ("a.tar", demo.tar_bytes({"a.py": "x" * 200}), "Too many bytes"),
    ]


@pytest.mark.parametrize(("name", "data", "message"), bad_archives())
def test_bad_archives(spark, name, data, message):
    frame = spark.createDataFrame([("a", name, data)], "analysis_id string, file_name string, data binary")
    with pytest.raises(PySparkException, match=message):
        repos.checked_members(repos.archive_members(frame), Config(max_extracted_files=3, max_extracted_bytes=100)).collect()


def test_arrivals(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    demo.raw_files(spark).write.parquet(source)
    for _ in range(2):
        query = analyze_arrivals(read_arrivals(spark, source), target, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert spark.read.parquet(f"{target}/files").count() == 11
    repos.from_rows(spark, [("shop", "only.py", "x = 1\n")]).write.mode("append").parquet(source)
    analyze_arrivals(read_arrivals(spark, source), target, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(f"{target}/files").groupBy("analysis_id").count().filter(F.col("count") == 1).count() == 1
