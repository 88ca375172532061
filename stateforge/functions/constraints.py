"""Instruction constraints: does a response keep what its metadata asks for?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stateforge.functions import text

SCHEMA = "exact_text string, case_sensitive boolean, required_substrings array<string>, forbidden_substrings array<string>, starts_with string, ends_with string, min_words int, max_words int"


def passes(response: Column, metadata: Column) -> Column:
    """`metadata`: JSON text, or a struct of SCHEMA; what is absent asks nothing.  Case counts only if case_sensitive."""
    m = F.from_json(metadata, SCHEMA)
    clean = text.strip(F.coalesce(response, F.lit("")))
    cased = F.coalesce(m["case_sensitive"], F.lit(False))
    seen = F.when(cased, clean).otherwise(F.lower(clean))
    same = lambda c: F.when(cased, c).otherwise(F.lower(c))
    none = F.array().cast("array<string>")
    words = text.token_count(clean)
    checks = [
        m["exact_text"].isNull() | (seen == same(m["exact_text"])),
        F.forall(F.coalesce(m["required_substrings"], none), lambda x: F.contains(seen, same(x))),
        ~F.exists(F.coalesce(m["forbidden_substrings"], none), lambda x: F.contains(seen, same(x))),
        m["starts_with"].isNull() | F.startswith(seen, same(m["starts_with"])),
        m["ends_with"].isNull() | F.endswith(seen, same(m["ends_with"])),
        m["min_words"].isNull() | (words >= m["min_words"]),
        m["max_words"].isNull() | (words <= m["max_words"]),
    ]
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out
