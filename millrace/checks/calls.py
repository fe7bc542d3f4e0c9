"""Call sites with their arguments by balance of parentheses: what no regular expression can find."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calls that some check looks into (fixed values).
SITE = re.compile(
    r"(?<![\w.])(eval|exec)\s*\(|\b(yaml\.load|subprocess\.(?:run|call|check_output|check_call|Popen)|os\.system|os\.popen|child_process\.exec(?:Sync)?"
    r"|requests\.(?:get|post|put|patch|delete|head|request))\s*\(|(\.(?:execute|executemany|query|raw))\s*\("
)


def arguments(text: str, opened: int, limit: int = 400) -> str:
    """The text between the parenthesis at ``opened`` and its partner, ``limit`` characters at most."""
    depth, end = 0, min(len(text), opened + limit)
    for i in range(opened, end):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth == 0:
                return text[opened + 1 : i]
    return text[opened + 1 : end]


def _sites(text: str | None) -> list[dict]:
    if not text:
        return []
    return [{"callee": m[1] or m[2] or m[3], "args": arguments(text, m.end() - 1)} for m in SITE.finditer(text)]


def _all_sites(texts: pd.Series) -> pd.Series:
    return texts.map(_sites)


def call_sites(text: Column) -> Column:
    """``array<struct<callee, args>>`` of the calls that checks look into."""
    return F.pandas_udf(_all_sites, "array<struct<callee:string,args:string>>")(text)
