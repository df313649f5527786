"""Response headers kept by a cache: NUL-separated text after a status line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import bare_mime
from .urls import lenient_decode


def header_lines(raw: Column) -> Column:
    return F.filter(F.split(raw, "\u0000"), lambda p: p != "")


def parse_raw_headers(raw: Column) -> Column:
    """Struct of ``status_line``, ``headers`` (map; names in lower case, the last of a name wins),
    ``content_type``, ``content_length`` (null if no number) and ``filename``."""
    lines = header_lines(raw)
    fields = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda p: F.instr(p, ":") > 0)
    pairs = F.transform(fields, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_extract(p, "(?s)^[^:]*:(.*)$", 1)).alias("v")))
    names = F.transform(pairs, lambda x: x["k"])
    last = F.filter(pairs, lambda x, i: F.array_position(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), x["k"]) == 0)
    headers = F.map_from_entries(last)
    get = lambda n: F.try_element_at(headers, F.lit(n))
    return F.struct(
        F.try_element_at(lines, F.lit(1)).alias("status_line"), headers.alias("headers"), get("content-type").alias("content_type"),
        get("content-length").try_cast("bigint").alias("content_length"), disposition_filename(get("content-disposition")).alias("filename"),
    )


def disposition_filename(value: Column) -> Column:
    """File name of a Content-Disposition: the encoded form, else the quoted, else the bare one."""
    found = lambda pattern: F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))
    return F.coalesce(lenient_decode(found(r"(?i)filename\*=UTF-8''([^;]*)")), found(r'(?i)filename="([^"]*)"'), found(r"(?i)filename=([^;\"]+)"))


def simple_content_type(raw: Column) -> Column:
    """The first content type among the lines, in lower case and without parameters."""
    hits = F.filter(F.split(raw, "\u0000"), lambda p: F.lower(p).startswith("content-type:"))
    return F.nullif(bare_mime(F.regexp_extract(F.try_element_at(hits, F.lit(1)), "(?s)^[^:]*:(.*)$", 1)), F.lit(""))


def content_range_total(value: Column) -> Column:
    """The total of a Content-Range, null unless it is a positive number at the end."""
    total = F.regexp_extract(value, r"/(\d+)$", 1).try_cast("bigint")
    return F.when(total > 0, total)
