"""Column expressions over repository paths (POSIX, relative)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never scanned, and metadata file names that are kept.
IGNORED_DIRECTORIES = [".git", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", "vendor"]
METADATA_NAMES = ["README.md", "README.rst", "pyproject.toml", "setup.cfg", "requirements.txt", "pytest.ini", "tox.ini"]
README_UPPER = ["README.MD", "README.RST"]


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty for a root file."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ends_with(path: Column, suffix: Column) -> Column:
    return F.endswith(path, suffix)


def is_python(path: Column) -> Column:
    return path.rlike(r"[^/]\.py$")


def is_metadata(path: Column) -> Column:
    name = basename(path)
    return name.isin(METADATA_NAMES) | F.upper(name).isin(README_UPPER)


def in_ignored_directory(path: Column) -> Column:
    """Whether a directory on the way to the file is ignored (the file's own name doesn't count)."""
    folders = F.slice(parts(path), F.lit(1), F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def module_name(path: Column) -> Column:
    """Dotted module of a Python file; null where there is none (`src/__init__.py`, other suffixes)."""
    inner = F.regexp_replace(path, r"^src/", "")
    inner = F.regexp_replace(inner, r"(^|/)__init__\.py$", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\.py$", ""), "/", ".")
    return F.when(is_python(path) & (inner != ""), inner)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)tests?(/|$)") | low.rlike(r"(^|/)test_[^/]*$") | low.rlike(r"_test\.py$")


def is_safe_relative(path: Column) -> Column:
    """False for empty or rooted paths, drive letters and any `..` part."""
    unix = F.translate(path, "\\", "/")
    return F.coalesce((path != "") & ~path.rlike(r"^[/\\]") & ~path.rlike(r"^.:") & ~F.array_contains(parts(unix), ".."), F.lit(False))


def strip_first_component(name: Column) -> Column:
    """Path without its first part; empty for a single part. Backslashes count as slashes."""
    real = F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(real) > 1, F.array_join(F.slice(real, F.lit(2), F.greatest(F.size(real), F.lit(1))), "/")).otherwise("")


def source_link(repository_url: Column, commit: Column, path: Column) -> Column:
    return F.concat(repository_url, F.lit("/blob/"), commit, F.lit("/"), path)
