"""Column expressions on literals."""

import pytest
from pyspark.sql import functions as F

from quarrymap.functions import paths, text, urls
from quarrymap.operators import classify


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "module", "test", "python"),
    [
        ("src/demo/api/routes.py", "demo.api.routes", False, True),
        ("app/services/users.py", "app.services.users", False, True),
        ("src/demo/__init__.py", "demo", False, True),
        ("src/__init__.py", None, False, True),
        ("__init__.py", None, False, True),
        ("src.py", "src", False, True),
        ("a/src/b.py", "a.src.b", False, True),
        ("notes.txt", None, False, False),
        (".py", None, False, False),
        ("tests/x.py", "tests.x", True, True),
        ("a/Test/x.py", "a.Test.x", True, True),
        ("a/test_x.py", "a.test_x", True, True),
        ("a/x_test.py", "a.x_test", True, True),
        ("a/contest.py", "a.contest", False, True),
    ],
)
def test_paths(spark, path, module, test, python):
    p = F.col("p")
    assert one(spark, paths.module_name(p), p=path) == module
    assert one(spark, paths.is_test_path(p), p=path) is test
    assert one(spark, paths.is_python(p), p=path) is python


@pytest.mark.parametrize(("path", "safe"), [("src/app.py", True), ("../etc/passwd", False), ("/etc/passwd", False), ("C:/Windows", False), ("", False), ("\\x", False), ("a/..", False), ("a\\..\\b", False), ("a..b/c", True)])
def test_safe_paths(spark, path, safe):
    assert one(spark, paths.is_safe_relative(F.col("p")), p=path) is safe


@pytest.mark.parametrize(("name", "rest"), [("top/a/b.py", "a/b.py"), ("top", ""), ("./top//a", "a"), ("top\\a\\b", "a/b"), ("", ""), ("/top/a", "a")])
def test_strip_first_component(spark, name, rest):
    assert one(spark, paths.strip_first_component(F.col("p")), p=name) == rest


@pytest.mark.parametrize(("path", "ignored"), [("a/.venv/x.py", True), ("build/x.py", True), ("a/build.py", False), ("build", False), ("x.py", False)])
def test_ignored_directories(spark, path, ignored):
    assert one(spark, paths.in_ignored_directory(F.col("p")), p=path) is ignored


@pytest.mark.parametrize(
    ("source", "secret"),
    [
        ("-----BEGIN RSA PRIVATE KEY-----", True),
        ('API_KEY = "' + "a" * 20 + '"', True),
        ('api_key = "' + "a" * 19 + '"', False),
        ("Secret='" + "x" * 12 + "'", True),
        ("secret='" + "x" * 11 + "'", False),
    ],
)
def test_secrets(spark, source, secret):
    assert one(spark, text.looks_like_secret(F.col("s")), s=source) is secret


@pytest.mark.parametrize(("source", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n\n", 2)])
def test_line_count(spark, source, lines):
    assert one(spark, text.line_count(F.col("s")), s=source) == lines


def test_query_terms(spark):
    terms = text.query_terms(F.col("q"))
    q = "Where is UserService authentication in app/security/tokens.py?"
    assert one(spark, terms["path_terms"], q=q) == ["app/security/tokens.py"]
    assert one(spark, terms["symbol_terms"], q=q) == ["Where", "UserService"]
    assert one(spark, terms["concept_terms"], q=q) == ["where", "userservice", "authentication", "app/security/tokens.py"]


@pytest.mark.parametrize(("json", "items"), [(None, []), ("null", []), ('" a "', ["a"]), ('""', []), ('["a", "", " b "]', ["a", "b"]), ("5", ["5"]), ("plain", ["plain"])])
def test_string_list(spark, json, items):
    assert one(spark, text.string_list(F.col("j")), j=json) == items


@pytest.mark.parametrize("url", ["https://github.com/own-er/re.po", " https://github.com/own-er/re.po/ ", "https://github.com/own-er/re.po.git"])
def test_valid_urls(spark, url):
    got = one(spark, urls.parse_repository_url(F.col("u")), u=url)
    assert (got.owner, got.name, got.error) == ("own-er", "re.po", None)


@pytest.mark.parametrize(
    ("url", "error"),
    [
        (None, "required"), ("  ", "required"), ("git@github.com:a/b.git", "SSH"), ("https://gitlab.com/a/b", "Only github.com"), ("https://github.com/a/b/issues", "root URL"), ("http://github.com/a/b", "Invalid GitHub URL"),
        ("https://github.com/a", "Invalid GitHub URL"), ("https://github.com/-a/b", "owner"), ("https://github.com/a--b/c", "owner"), ("https://github.com/a/..", "repository name"), ("https://github.com/" + "a" * 40 + "/b", "owner"),
    ],
)
def test_invalid_urls(spark, url, error):
    got = one(spark, urls.parse_repository_url(F.col("u")), u=url)
    assert error in got.error and got.owner is None


EMPTY = "array<struct<name:string,decorators:array<string>>>"


@pytest.mark.parametrize(
    ("path", "entry", "decorators", "names", "externals", "category"),
    [
        ("tests/api/x.py", True, [], [], [], "Tests"), ("api/x.py", True, [], [], [], "Entry Point"), ("api/migrations/x.py", False, [], [], [], "Migrations"), ("alembic/0001_x.py", False, [], [], [], "Migrations"),
        ("alembic/x.py", False, [], [], [], "Other"), ("services/api/x.py", False, [], [], [], "API / Routes"), ("service/models/x.py", False, [], [], [], "Services"), ("db/core/x.py", False, [], [], [], "Models / Data"),
        ("core/config.py", False, [], [], [], "Core / Domain"), ("x/settings.py", False, [], [], [], "Configuration"), ("x/commands.py", False, [], [], [], "CLI"), ("scripts/x.py", False, [], [], [], "Scripts"),
        ("Utils/x.py", False, [], [], [], "Utilities"), ("x.py", False, ["app.widget"], [], [], "API / Routes"), ("x.py", False, ["my.ROUTER.x"], [], [], "API / Routes"), ("x.py", False, [], ["RouteTable"], ["flask.views"], "API / Routes"),
        ("x.py", False, [], ["RouteTable"], [], "Other"), ("x.py", False, [], [], ["sqlalchemy.orm"], "Models / Data"), ("x.py", False, [], [], ["os"], "Other"),
    ],
)
def test_categories(spark, path, entry, decorators, names, externals, category):
    symbols = [(n, decorators) for n in (names or ["f"])]
    row = spark.createDataFrame([(path, entry, symbols, externals)], f"path string, entry boolean, symbols {EMPTY}, externals array<string>")
    assert row.select(classify.classify(*map(F.col, ("path", "entry", "symbols", "externals"))).category.alias("c")).first().c == category


def entry(spark, path, main=False, hints=(), symbols=(), scripts=()):
    row = spark.createDataFrame([(path, main, list(hints), list(symbols), list(scripts))], "path string, main boolean, hints array<string>, symbols array<string>, scripts array<string>")
    reasons = classify.entry_reasons(*map(F.col, ("path", "main", "hints", "symbols", "scripts")))
    got = row.select(reasons.alias("r"), classify.entry_confidence(F.col("path"), reasons).alias("c")).first()
    return got.r, got.c


def test_entry_points(spark):
    assert entry(spark, "a/x.py") == ([], None)
    assert entry(spark, "a/app.py") == (["Filename matches common entry-point pattern (app.py)"], "medium")
    assert entry(spark, "a/wsgi.py")[1] == "high"
    assert entry(spark, "a/x.py", main=True) == (['Contains if __name__ == "__main__" block'], "high")
    assert entry(spark, "a/x.py", hints=["flask_app"])[1] == "high" and entry(spark, "a/x.py", hints=["typer_app"])[1] == "low"
    assert entry(spark, "a/x.py", symbols=["main", "main"]) == (["Defines notable symbol `main`"], "low")
    assert entry(spark, "src/pkg/mod.py", scripts=["zzz:run", "pkg.mod:run"]) == (["Referenced by console script (pkg.mod:run)"], "medium")
    assert entry(spark, "pkg/mod/__init__.py", scripts=["pkg.mod:run"])[0] == ["Referenced by console script (pkg.mod:run)"]
    assert entry(spark, "run.py", scripts=["pkg.mod:run"])[0] == ["Referenced by console script target (pkg.mod:run)"]


def test_importance(spark):
    row = spark.createDataFrame([(11, 2, True, 5, "Entry Point"), (1, 1, False, 50, "Other"), (90, 0, False, 0, "Other")], "i long, o long, e boolean, s int, c string")
    i, o, e, s, c = map(F.col, "ioesc")
    got = row.select(classify.importance(i, o, e, s, c).alias("x"), classify.importance_sentence(i, o, e, c).alias("t")).collect()
    assert [r.x for r in got] == [98.5, 35.0, 100.0]
    assert got[0].t == "Imported by 11 internal modules with 2 outgoing dependency edges and detected as an application entry point (category: Entry Point)."
    assert got[1].t == "Imported by 1 internal module with 1 outgoing dependency edge (category: Other)."
