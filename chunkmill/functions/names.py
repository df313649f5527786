"""Names and paths of cache files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of a path by the first rule that holds; a rule is a list of alternatives, each a list
#: of substrings that must all occur in the lower-case path. Fixed values.
CLIENT_RULES = [
    ("Discord Development", [["discorddevelopment"]]),
    ("Discord Canary", [["discordcanary"]]),
    ("Discord PTB", [["discordptb"]]),
    ("Discord", [["discord"]]),
    ("Brave", [["brave"]]),
    ("Chrome", [["google", "chrome"], ["google-chrome"]]),
    ("Edge", [["edge"], ["microsoft-edge"]]),
    ("Opera", [["opera"]]),
]


def is_cache_file(name: Column) -> Column:
    """Whether a file name is one of a cache: ``f_`` and six hex digits, or sixteen and a stream."""
    return name.rlike("^(f_[0-9a-fA-F]{6}|[0-9a-fA-F]{16}_[01s])$")


def parse_cache_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``layout`` (blockfile, simple or null), ``hex_value`` bigint, ``hash`` and ``stream``.
    The hash of the simple layout is lower-case hex only."""
    n = F.col(name)
    block, simple = n.rlike("^f_[0-9a-fA-F]{6}$"), n.rlike("^[0-9a-f]{16}_[01s]$")
    return df.withColumns(
        {
            "layout": F.when(block, "blockfile").when(simple, "simple"),
            "hex_value": F.when(block, F.conv(F.substring(n, 3, 6), 16, 10).cast("bigint")),
            "hash": F.when(simple, F.substring(n, 1, 16)),
            "stream": F.when(simple, F.substring(n, 18, 1)),
        }
    )


def file_basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def client_name(path: Column) -> Column:
    """Label of the program a cache path belongs to, with its profile segment in brackets."""
    lower = F.lower(path)
    label = None
    for name, alternatives in CLIENT_RULES:
        hit = F.lit(False)
        for parts in alternatives:
            every = F.lit(True)
            for p in parts:
                every = every & lower.contains(p)
            hit = hit | every
        label = F.when(hit, name) if label is None else label.when(hit, name)
    label = label.otherwise("Custom")
    profile = F.regexp_extract(path, r"(?:^|[/\\])(Profile [^/\\]*)", 1)
    return F.when(profile != "", F.concat(label, F.lit(" ("), profile, F.lit(")"))).otherwise(label)
