"""One spelling for keys that arrive in many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, no-break space and the byte order mark included.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same for RE2, as DuckDB has it.
SPACE_RE2 = r"[\s\x0B\x1C-\x1F\x{85}\x{FEFF}\p{Z}]+"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end; a trim by characters, no regular expression per row."""
    return F.btrim(c, F.lit(SPACE))


def ecosystem(c: Column) -> Column:
    """Lower case; the registry's name for cargo becomes ``cargo``."""
    low = F.lower(trimmed(c))
    return F.when(low == "crates.io", F.lit("cargo")).otherwise(low)


def package(eco: Column, name: Column) -> Column:
    """A package name in the spelling of its (already normalised) ecosystem."""
    bare = trimmed(name)
    low = F.lower(bare)
    return F.when(eco == "go", bare).when(eco.isin("pypi", "cargo"), F.regexp_replace(low, "[-_.]+", "-")).otherwise(low)


def advisory(c: Column) -> Column:
    return F.upper(trimmed(c))


def sql_trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_RE2}|{SPACE_RE2}$', '', 'g')"


def sql_ecosystem(c: str) -> str:
    low = f"lower({sql_trimmed(c)})"
    return f"CASE WHEN {low} = 'crates.io' THEN 'cargo' ELSE {low} END"


def sql_package(eco: str, name: str) -> str:
    """``eco`` must already be normalised SQL."""
    bare = sql_trimmed(name)
    return f"CASE WHEN ({eco}) = 'go' THEN {bare} WHEN ({eco}) IN ('pypi', 'cargo') THEN regexp_replace(lower({bare}), '[-_.]+', '-', 'g') ELSE lower({bare}) END"


def sql_advisory(c: str) -> str:
    return f"upper({sql_trimmed(c)})"
