"""Secret scans: patterns plus dictionary-primed zstandard novelty.

Three fixed patterns give the base spans.  Beyond them, every string in a
sensitive context (a word such as "key" or "auth", or a string that is reported,
at most `REACH` or `NEXT` code points before it, on its line or the next ones) is
a candidate, unless it lies inside a base span.  Its novelty is the number of
bytes by which it lengthens the zstandard form of the code around it, with a
compressor primed by a dictionary trained on identifiers of Python's library and
on those that stand in most texts of the corpus at hand, all of which are counted: names
from there or from nearby are cheap, random strings are not.  A candidate whose novelty reaches `THRESHOLD` of
its length (`ONE_CASE` if it is of lower-case letters alone, of which a random one
is cheaper) is reported as a span of kind "novel".  Base spans are always reported; their novelty is given too.

Spans are in code points, end exclusive.  Defined results: null and empty texts
have no spans; repeated rows are each scanned; columns beside id and text are
ignored; texts are scanned whole, however long.
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import keyword
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from types import ModuleType

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateforge.llm import kit

# The kinds in their order, their patterns and least lengths (of group 2, or of the match).
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16, "novel": 16}
# A run of 16 or more is the same as a run whose length is checked afterwards, and needs no match object for each short run.
HEX_LONG = re.compile(r"[0-9a-f]{16,}")

#: What marks a context as sensitive, how far before a candidate it may stand, what candidates look like, and from which novelty a byte they are reported.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[\x20_-]?key|auth(?:orization)?[\"']?\x20*[:=]|bearer\x20", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
ONE_CASE_RUN = re.compile(r"[a-z]+")
REACH, NEXT, AROUND, THRESHOLD, ONE_CASE, PRIMER = 64, 2, 256, 0.8, 0.71, 120

#: An identifier, how many of a corpus the dictionary is trained on, how many a task holds before it passes their counts on, and the dictionary's bytes.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_./-]{3,63}", re.ASCII)
NAMES, HELD, DICTIONARY = 1 << 14, 1 << 16, 16_384
#: Modules whose names stand for code in general.
LIBRARY = "builtins os re json logging argparse socket ssl http.client urllib.parse email.message datetime collections threading subprocess asyncio typing unittest sqlite3 csv configparser pathlib shutil hashlib hmac inspect functools itertools concurrent.futures decimal statistics tarfile zipfile smtplib imaplib ftplib locale".split()


@functools.cache
def library_names() -> tuple[str, ...]:
    """The names that Python's own library defines, of modules and of their classes; submodules don't count, as they come with their import."""
    found = set(keyword.kwlist)
    for module in map(importlib.import_module, LIBRARY):
        known = {n: x for n, x in vars(module).items() if not isinstance(x, ModuleType)}
        found |= {module.__name__, *known}
        for x in known.values():
            found |= set(dir(x)) if isinstance(x, type) else set()
    return tuple(sorted(n for n in found if len(n) >= 4))


def primer_of(names: Sequence[str]) -> bytes:
    """What stands before every context, so that the shortest has literals enough for the dictionary's entropy tables."""
    return " ".join(names[i * 7919 % len(names)] for i in range(PRIMER // 4))[:PRIMER].encode() + b"\n"


def trained_dictionary(corpus: Sequence[str] = (), names: Sequence[str] | None = None, size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary (content and entropy tables) from names (the library's), as code combines them, and from a corpus's identifiers."""
    names = library_names() if names is None else names
    n, samples = len(names), []
    pick = lambda i: names[i * 7919 % n]
    for i in range(n):
        a, b, c = pick(i), pick(3 * i + 1), pick(5 * i + 2)
        samples += [f"{a}_{b}", f"{a}.{b}({c})", f"{a}-{b}/{c}", f"self.{a} = {b}.{c}", f"{a}{b.title()}"]
    own = [" ".join(corpus[k : k + 4]) for k in range(0, len(corpus), 4)]
    if own:  # first, and as much as the library has: the trainer goes through its input in that order
        samples = own * max(1, sum(map(len, samples)) // max(1, sum(map(len, own)))) + samples
    return zstandard.train_dictionary(size, [x.encode() for x in samples], k=64, d=6).as_bytes()


def identifiers(text: str) -> list[str]:
    """The distinct identifiers of a text that stand in no base span and follow no sensitive word closely, so that no secret primes the dictionary."""
    hidden = sorted([(a, b) for _, a, b in base_spans(text)] + [(m.start(), m.end() + REACH) for m in SENSITIVE.finditer(text)])
    found, at, end = dict[str, None](), 0, 0
    for m in IDENTIFIER.finditer(text):
        while at < len(hidden) and hidden[at][0] < m.end():
            end = max(end, hidden[at][1])
            at += 1
        if m.start() >= end:
            found[m[0]] = None
    return list(found)


def name_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(name, n): in how many texts each identifier stands, of all texts in full.  A task adds up its own texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter[str]()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["name", "n"])
        for batch in batches:
            for t in batch.column(0):
                found.update(identifiers(t.as_py()))
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        yield out()

    texts = docs.select(F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    return texts.mapInArrow(run, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))


def corpus_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The dictionary of a corpus: that of the library with the corpus's most frequent identifiers, counted in all texts.

    It only primes the compressor: every text is scanned in full.  The driver gets
    NAMES names at most (ties by a hash, then the name), many times what a dictionary holds.
    """
    first = name_counts(docs, text_col).orderBy(F.desc("n"), F.xxhash64("name"), "name").limit(NAMES)
    found = first.select("name").toArrow().column(0).to_pylist()
    made = trained_dictionary(found)
    del found
    kit.release()
    return made


class Novelty:
    """Marginal compressed bytes of a string after its context; dictionary and primer are those of the library unless they are given."""

    def __init__(self, dictionary: bytes | None = None, primer: bytes | None = None, level: int = 3):
        primed = zstandard.ZstdCompressionDict(trained_dictionary() if dictionary is None else dictionary)
        self.primer = primer_of(library_names()) if primer is None else primer
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=primed)

    def marginal(self, context: str, candidate: str) -> int:
        """How many bytes `candidate` adds to the primed compressed form of `context`."""
        around = self.primer + context.encode()
        return len(self.zstd.compress(around + candidate.encode())) - len(self.zstd.compress(around))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three patterns, by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(text: str | None, novelty: Novelty, threshold: float = THRESHOLD) -> list[tuple[str, int, int, int]]:
    """All spans (kind, start, end, marginal bytes) of a text, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    context = lambda a, b: text[max(0, a - AROUND) : a] + "\n" + text[b : b + AROUND]
    found = [(k, a, b, novelty.marginal(context(a, b), text[a:b])) for k, a, b in base]
    done = passed = furthest = 0  # base spans that start by the candidate, and where the longest of them ends
    for s in SENSITIVE.finditer(text):
        limit = s.end() + REACH
        done = max(done, s.end())
        while (c := CANDIDATE.search(text, done, limit + LEAST["novel"])) is not None and c.start() <= limit:
            c = CANDIDATE.match(text, c.start())
            done = c.end()
            while passed < len(base) and base[passed][1] <= c.start():
                furthest = max(furthest, base[passed][2])
                passed += 1
            if c.end() <= furthest:
                continue
            more = novelty.marginal(context(*c.span()), c[0])
            if more >= (min(threshold, ONE_CASE) if ONE_CASE_RUN.fullmatch(c[0]) else threshold) * len(c[0]):
                found.append(("novel", *c.span(), more))
                limit = max(limit, c.end() + NEXT)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def redacted(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlapping spans are one, named by the first."""
    out, at = [], 0
    for k, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{k} removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


SPANS = "array<struct<kind: string, start: int, end: int, novelty: int>>"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, found) of every row; `found` has the spans with their novelty."""
    kind, primed, primer = docs.schema[id_col].dataType.simpleString(), corpus_dictionary(docs, text_col), primer_of(library_names())
    counts = [f"n_{k}" for k in KINDS]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed, primer)
        for batch in batches:
            rows = [scan(x.as_py(), novelty, threshold) for x in batch.column(1)]
            base = [joined(s for s in r if s[0] != "novel") for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    pa.array([joined(r) for r in rows], pa.string()),
                    pa.array([[dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in r] for r in rows], struct),
                ],
                ["_id", *counts, "base_sha256", "spans", "found"],
            )

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, found {SPANS}")
    return out.withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with all spans of `text_col` replaced by their kind; `length_col` follows.  A null text stays null."""
    primed, primer = corpus_dictionary(docs, text_col), primer_of(library_names())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed, primer)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = pa.array([None if (t := x.as_py()) is None else redacted(t, scan(t, novelty, threshold)) for x in batch.column(k)], pa.string())
            yield batch.set_column(k, pa.field(text_col, pa.string()), texts)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
