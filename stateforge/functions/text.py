"""Text functions as column expressions; Python's str semantics where they differ from Java's.

An Arrow UDF is used only for what the JVM can't express, and only rows that
need it carry text to Python (the others carry null).
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What Python's str.strip and \s take for white space, and LaTeX spacing commands.
SPACE = r"[\s\x1c-\x1f]"
LATEX_SPACING = r"\\(?:,|;|!|quad\b|qquad\b)"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def non_empty(*cs: Column) -> Column:
    """The first that is not null or blank, stripped; else null."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in cs))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Unicode normal form KC; ASCII never leaves the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def folded(c: Column) -> Column:
    """What normalize_text does after NFKC: lower case, strip, LaTeX spacing to blanks, white space to one blank."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), "(?U)" + LATEX_SPACING, " "), rf"(?U){SPACE}+", " ")


def normalize_text(c: Column) -> Column:
    """NFKC, then `folded`."""
    return folded(nfkc(c))


def tokens(c: Column) -> Column:
    """White-space separated words (Python's str.split())."""
    return F.array_remove(F.split(c, rf"(?U){SPACE}+"), "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def plain_token_count(c: Column) -> Column:
    r"""The words of a text, 0 of none, where only tab, line ends, form feed and blank part them (SQL's \s: no vertical tab, nothing beyond ASCII)."""
    return F.coalesce(F.size(F.array_remove(F.split(c, r"[\t\n\f\r ]+"), "")), F.lit(0))


def shingles(words: Column, size: int = 5) -> Column:
    """The distinct runs of `size` words, each joined by a blank; of fewer words, one run of all; of none, none."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    places = F.arrays_zip(*(F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(size)))  # side by side, so that `words` is made a few times and not once a run
    runs = F.transform(places, lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(size))))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """The distinct 64-bit hashes of what `shingles` gives, without joining words."""
    n = F.greatest(F.size(words) - (size - 1), F.lit(0))
    places = F.arrays_zip(*(F.slice(words, F.lit(k + 1), n).alias(f"w{k}") for k in range(size)))
    runs = F.transform(places, lambda x: F.xxhash64(*(x[f"w{k}"] for k in range(size))))
    return F.when(F.size(words) >= size, F.array_distinct(runs)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays: both empty 1, one empty 0."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


@F.pandas_udf(StringType())
def _json_string(s: pd.Series) -> pd.Series:
    return s.map(lambda x: json.dumps(x, ensure_ascii=False), na_action="ignore")


def json_string(c: Column) -> Column:
    """A string as Python's json writes it, non-ASCII kept (Java writes other escapes for control characters)."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(c.isNull(), "null").otherwise(F.coalesce(_json_string(F.when(c.rlike(r"[\x00-\x1f]"), c)), F.concat(F.lit('"'), plain, F.lit('"'))))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and no blanks; string columns are quoted, others (numbers, ready JSON) are taken as they print."""
    parts: list[Column] = [F.lit("{")]
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(f'{"," * bool(k)}"{name}":'), fields[name]]
    return F.concat(*parts, F.lit("}"))


def stable_hash(length: int | None = None, **fields: Column) -> Column:
    """sha256 of the canonical JSON, in hex, whole or its beginning."""
    digest = F.sha2(canonical_json(**fields), 256)
    return F.substring(digest, 1, length) if length else digest
