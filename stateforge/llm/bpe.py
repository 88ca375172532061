"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string there is one token that a correct encoding of
that prefix can end with.  `PrefixTable` stores it: the last token t of a
prefix is the only vocabulary entry that ends there and that the merge rules
leave beside the last token of the prefix before it.  Appending bytes adds
entries and changes none, so appends are exact; after an edit only entries from
the edit on can change, and they are taken over again once as many of them as
the longest token's bytes agree.

Texts are split by the pattern first, and each match is encoded on its own.
`TextCodec` encodes the distinct matches of some texts together, in order of
their bytes: the next one keeps the table of the prefix that it shares with the
last.  It remembers the encodings of recent matches.

Defined results: null and empty texts have no ids and decode to no bytes; any
string is encoded, special-token strings as ordinary text; repeated rows are
each encoded; columns beside id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct matches and token pairs whose results a worker remembers; code points of texts whose matches are encoded together.
REMEMBERED, TOGETHER = 200_000, 1 << 20


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Merges:
    """A vocabulary of ranks with the question that the table asks: do two neighbouring tokens stay as they are?"""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in ranks.values()}
        self.longest = max(map(len, ranks))
        #: answers of `stay`, by left << 32 | right
        self.known: dict[int, bool] = {}
        #: by the last two bytes, the lengths of tokens that end so, longest first
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 1:
                ends.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        #: the token that is another and one byte more, by id << 8 | byte; and every token's length
        self.longer = {ranks[t[:-1]] << 8 | t[-1]: r for t, r in ranks.items() if t[:-1] in ranks}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.byte = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.byte:
            raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")

    def merge(self, piece: bytes) -> list[int]:
        """The merge rules applied as they are defined: the lowest rank first, leftmost first.  For short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay(self, left: int, right: int) -> bool:
        """Whether the merge rules turn the two tokens' bytes into just these two (left -1: the one token's into it)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pair = [left, right] if left >= 0 else [right]
        ok = self.known[left << 32 | right] = self.merge(b"".join(map(self.tokens.__getitem__, pair))) == pair
        return ok


class PrefixTable:
    """A byte string and, for each of its prefixes, the unique valid last token."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, bytearray(), []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes at the end; no stored entry changes."""
        at = len(self.data)
        self.data += data
        self._extend(at, len(self.data))

    def _extend(self, start: int, stop: int) -> None:
        """Entries for the prefixes of start+1 ... stop bytes, the shorter ones' being known.

        Only one token is valid, so the likeliest are tried first: the last
        entry's and one byte more, then the byte alone, then all that end here.
        """
        merges, last, data = self.merges, self.last, self.data
        longer, size, byte, known, stay = merges.longer.get, merges.size, merges.byte, merges.known.get, merges.stay
        token = last[start - 1] if start else -1
        for end in range(start, stop):
            before = token
            b = data[end]
            if before >= 0:
                token = longer(before << 8 | b)
                if token is not None:
                    at = end - size[token]
                    left = last[at] if at >= 0 else -1
                    ok = known(left << 32 | token)
                    if stay(left, token) if ok is None else ok:
                        last.append(token)
                        continue
            token = byte[b]
            ok = known(before << 32 | token)
            if not (stay(before, token) if ok is None else ok):
                token = self._search(end + 1)
            last.append(token)

    def _search(self, end: int) -> int:
        """The one token of two bytes or more that ends there and stays beside the last token before it."""
        merges, data = self.merges, bytes(self.data[max(0, end - self.merges.longest) : end])
        for size in merges.lengths.get(data[-2:], ()):
            if size <= end and (token := merges.ranks.get(data[-size:])) is not None and size <= len(data):
                left = self.last[end - size - 1] if size < end else -1
                ok = merges.known.get(left << 32 | token)
                if merges.stay(left, token) if ok is None else ok:
                    return token
        raise ValueError(f"no token of the vocabulary can end at byte {end}")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replaces bytes [start, stop); re-encodes from there until the entries agree again.  Returns how many entries were computed."""
        old, moved = self.last, len(data) - (stop - start)
        self.data[start:stop] = data
        self.last = old[:start]
        agree = done = 0
        for end in range(start + 1, len(self.data) + 1):
            self._extend(end - 1, end)
            done += 1
            was = end - 1 - moved
            agree = agree + 1 if end > start + len(data) and old[was] == self.last[-1] else 0
            if agree >= self.merges.longest:
                self.last += old[was + 1 :]
                break
        return done

    def become(self, data: bytes) -> None:
        """Makes it the table of other bytes; entries of the prefix that both share are kept."""
        kept = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            kept += 1
        self.data[kept:] = data[kept:]
        del self.last[kept:]
        self._extend(kept, len(data))

    def ids(self) -> list[int]:
        """The encoding of the whole string, read back from its end."""
        out, end, last, size = [], len(self.data), self.last, self.merges.size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out


class TextCodec:
    """Encodes and decodes texts: the pattern's matches one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.find = regex.compile(pattern).findall
        #: of recent matches the ids as text, and the bytes decoded from them; and of those before them
        self._ids: dict[str, str] = {}
        self._bytes: dict[str, bytes] = {}
        self._old: tuple[dict[str, str], dict[str, bytes]] = {}, {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match: its own token if it is one, else from the table."""
        whole = self.merges.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.merges, piece).ids()

    def encode(self, text: str | None) -> list[int]:
        return [i for x in self.find(text or "") for i in self.piece(x.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))

    def _meet(self, matches: set[str]) -> list[str]:
        """Sees that these matches are known; gives those too long to stay so."""
        if len(self._ids) >= REMEMBERED:
            self._old = self._ids, self._bytes
            self._ids, self._bytes = {}, {}
        ids, back, (old_ids, old_back) = self._ids, self._bytes, self._old
        new = []
        for x in matches - ids.keys():
            if (found := old_ids.get(x)) is not None:
                ids[x], back[x] = found, old_back[x]
            else:
                new.append(x.encode())
        new.sort()
        merges, table, long = self.merges, PrefixTable(self.merges), []
        names, whole = merges.names, merges.ranks.get
        for x in new:
            text, one = x.decode(), whole(x)
            if one is None:
                table.become(x)
                found = table.ids()
                ids[text], back[text] = " ".join([names[i] for i in found]), self.decode(found)
            else:
                ids[text], back[text] = names[one], merges.tokens[one]
            if len(x) > 64:
                long.append(text)
        return long

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Each text's (number of ids, sha256 of the decimal ids joined by a blank, sha256 of the bytes decoded from them)."""
        matches = [self.find(x or "") for x in texts]
        long = self._meet(set().union(*matches))
        ids_of, bytes_of, out = self._ids.__getitem__, self._bytes.__getitem__, []
        for found in matches:
            ids = " ".join(map(ids_of, found)).encode()
            out.append((ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(map(bytes_of, found))).hexdigest()))
        for x in long:
            del self._ids[x], self._bytes[x]
        return out

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """`digests` of one text."""
        return self.digests([text])[0]


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The content of a rank file: a local file of the driver, or any path that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


_codecs: dict[tuple[str, str], TextCodec] = {}


def encoded(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.  `path`: the vocabulary's rank file (a fixed size, broadcast)."""
    content = read_ranks(docs.sparkSession, path)
    sent, key = docs.sparkSession.sparkContext.broadcast(content), (hashlib.sha256(content).hexdigest(), pattern)
    names = ["_id", "_n", "_ids_sha", "_sha", *["_ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _codecs:
            _codecs.clear()
            _codecs[key] = TextCodec(parse_ranks(sent.value), pattern)
        codec = _codecs[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, some, size = [], [], 0
            for x in texts:
                some.append(x)
                size += len(x or "")
                if size >= TOGETHER:
                    rows += codec.digests(some)
                    some, size = [], 0
            rows += codec.digests(some)
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                out.append(pa.array([codec.encode(x) for x in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, _n long, _ids_sha string, _sha string" + ", _ids array<int>" * with_ids)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"), F.col("_ids_sha").alias("ids_sha256"), F.col("_sha").alias("decoded_sha256"), *[F.col("_ids").alias("ids")] * with_ids)
