"""Validation of repository URLs as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sub-page markers, the patterns of a URL and of a repository's name, and the sentences of errors
# (in `parse_repository_url`). Owners follow the host's public rule: letters, digits and single hyphens between
# them, at most 39 characters.
SUB_PAGES = ["/issues", "/pull/", "/pulls", "/blob/", "/tree/", "/commit/", "/raw/"]
URL = r"^https://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$"
OWNER = r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"
NAME = r"^[A-Za-z0-9._-]{1,100}$"


def parse_repository_url(raw: Column) -> Column:
    """struct(owner, name, error): error says which check failed first, null if the URL is valid."""
    value = F.trim(raw, F.lit(" \t\n\r\f\x0b"))
    low = F.lower(value)
    owner = F.regexp_extract(value, URL, 1)
    name = F.regexp_replace(F.regexp_extract(value, URL, 2), r"\.git$", "")
    sub_page = F.lit(False)
    for marker in SUB_PAGES:
        sub_page = sub_page | low.contains(marker)
    error = (
        F.when(raw.isNull() | (value == ""), "Repository URL is required.")
        .when(low.startswith("git@"), "SSH URLs are not supported. Use https://github.com/owner/repo.")
        .when(~low.contains("github.com"), "Only github.com repository URLs are supported.")
        .when(sub_page, "Provide a repository root URL, not an issue, pull request, or file URL.")
        .when(~value.rlike(URL), "Invalid GitHub URL. Expected https://github.com/owner/repository.")
        .when(~owner.rlike(OWNER) | (F.length(owner) > 39), "Invalid GitHub owner name.")
        .when(~name.rlike(NAME) | name.isin(".", ".."), "Invalid GitHub repository name.")
    )
    return F.struct(F.when(error.isNull(), owner).alias("owner"), F.when(error.isNull(), name).alias("name"), error.alias("error"))


def full_name(owner: Column, name: Column) -> Column:
    return F.concat_ws("/", owner, name)


def web_parts(url: Column) -> dict[str, Column]:
    """Scheme, host and path of any web URL (empty where missing)."""
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)),
        "path": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1),
    }
