"""Routes and wire names that frameworks derive from paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_route(path: Column) -> Column:
    """Route of a page file: below ``pages/`` or ``app/``, without index and extension, ``[x]`` as ``:x``, ``[...x]`` as ``*x``."""
    inner = F.regexp_extract(path, r"(?:^|/)(?:src/)?(?:pages|app)/(.*)\.[^./]+$", 1)
    inner = F.regexp_replace(inner, r"(^|/)(?:index|page)$", "")
    inner = F.regexp_replace(inner, r"\([^)/]*\)/?", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\[\.\.\.(\w+)\]", "*$1"), r"\[(\w+)\]", ":$1")
    return F.when(path.rlike(r"(^|/)(src/)?(pages|app)/.*\.[^./]+$"), F.concat(F.lit("/"), F.regexp_replace(inner, "/+$", "")))


def wire_name(name: Column) -> Column:
    """Commands meet their callers by the name in lower case without separators."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
