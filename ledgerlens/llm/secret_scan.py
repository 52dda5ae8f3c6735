"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

A candidate is a run of key characters near a sensitive word, in a private key's PEM block or next to another one that is
reported.  Its novelty is the number of bytes that zstandard needs for it beyond what it needs for its surroundings, with the surrounding text and a list of common
identifiers as dictionary, per character.  Names and prose compress well; random keys do not.  Copies of the candidate
or of parts of it are blanked out of the surroundings first, so a key that stands twice is as novel as one that stands once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B

KINDS = ("assign", "access", "hex", "novel")

# The patterns of the contract; a match whose measured part is shorter is dropped after matching.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_BYTES = np.zeros(256, dtype=bool)
HEX_BYTES[48:58] = HEX_BYTES[97:103] = True
HEX_MIN = 16
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length less those under 16
ASSIGN_MIN, ACCESS_MIN = 12, 18

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")  # how an assignment may begin, lower case
SENSITIVE = ("password", "passwort", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "bearer", "authorization", "client_id", "signature", "begin rsa", "begin private")
CANDIDATE_MIN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
PEM_LAST = re.compile(r"(?:(?<=\\)n|[\s\"'])([A-Za-z0-9+/=]+)(?:\s|\\[rn]|[\"'+,])*\Z")  # before an END line; line breaks may be escaped
REACH = 64  # characters between a reported candidate and the next one that is in its context
AROUND = 512  # characters of text on each side of a sensitive word that are its context, and of a candidate that prime the compressor
COPY = 8  # characters in a row that count as a copy of a part of a candidate
NOVEL_MIN = 0.6  # marginal compressed bytes per character

# Identifiers common in code and configuration.
IDENTIFIERS = (
    "import export default function return const class public private static void string boolean integer number null true false "
    "username user_name account access_token refresh_token id_token token_type bearer authorization authentication credential "
    "client_id client_secret api_key apikey secret_key private_key public_key password passwd database connection host port "
    "localhost example config configuration environment settings service endpoint request response header content application json "
    "session cookie redirect callback http https www com org net index version description parameter argument property value key name"
).encode()


def _without_copies(around: str, candidate: str) -> str:
    """The surroundings with blanks for what they share with the candidate in runs of at least ``COPY`` characters."""
    places: dict[str, list[int]] = {}
    for i in range(len(around) - COPY + 1):
        places.setdefault(around[i : i + COPY], []).append(i)
    shared = {i for k in range(len(candidate) - COPY + 1) for i in places.pop(candidate[k : k + COPY], ())}
    if not shared:
        return around
    kept = list(around)
    for i in shared:
        kept[i : i + COPY] = " " * COPY
    return "".join(kept)


def novelty(text: str, start: int, end: int, dictionary: bytes = IDENTIFIERS) -> float:
    """Marginal compressed bytes per character of ``text[start:end]`` given its surroundings, less its copies, and the dictionary."""
    left, right = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    left, right = _without_copies(left, text[start:end]), _without_copies(right, text[start:end])
    primed = zstandard.ZstdCompressionDict(dictionary + b" " + (left + right).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)
    before = left[-32:].encode()
    return (len(pack.compress(before + text[start:end].encode())) - len(pack.compress(before))) / (end - start)


def lowered(text: str) -> str:
    """ASCII-safe lower case with one character for each of the text's."""
    return text.replace("\u0130", "\0").replace("\u212a", "\0").lower()


def _places(low: str, words: tuple[str, ...]) -> list[tuple[int, int]]:
    """All (start, end) of the words, in order; plain searches are many times faster than one pattern over every position."""
    found = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            found.append((at, at + len(w)))
            at = low.find(w, at + 1)
    return sorted(found)


def base_spans(text: str, low: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """Pattern matches as (start, kind, end): leftmost, non-overlapping within each kind, by start, then kind."""
    found, after = [], 0
    for at, _ in _places(low, ASSIGN_WORDS):
        if at >= after and (m := ASSIGN.match(text, at)):
            after = m.end()
            if m.end(2) - m.start(2) >= ASSIGN_MIN:
                found.append((at, 0, after))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Base:
    """Pattern matches, asked whether a range touches any of them."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in base]
        self.ends = list(accumulate((b for _, _, b in base), max))

    def touches(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a


def _key_blocks(text: str) -> list[tuple[int, int, int]]:
    """Private keys in PEM armour that have an END line: start of the block, start of its END line, start of its last run of key characters."""
    found, end = [], -1
    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        if end < m.end():
            end = text.find("-----END", m.end())
        if end < 0:
            break
        if text.find("-----BEGIN", m.end(), end) < 0:
            last = PEM_LAST.search(text, max(m.end(), end - AROUND), end)
            found.append((m.start(), end, last.start(1) if last else end))
    return found


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]], dictionary: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Incompressible candidates in a sensitive context that touch no pattern match.

    In context is what lies at most ``AROUND`` characters before or after a sensitive word, all of a private key's PEM block,
    and, in both directions, the next candidate at most ``REACH`` characters from one that is reported.  The last line of a PEM block counts
    however short it is.  A candidate that holds sensitive words itself is also judged without them.
    """
    words, blocks = _places(low, SENSITIVE), _key_blocks(text)
    if not words and not blocks:
        return []
    matched, found = _Base(base), []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [s for s, _ in words], sorted(e for _, e in words)

    def novel(a: int, b: int) -> bool:
        return not matched.touches(a, b) and novelty(text, a, b, dictionary) >= NOVEL_MIN

    def reported(i: int, chained: bool) -> bool:
        a, b = runs[i]
        near = bisect_right(starts, b + AROUND) - bisect_left(ends, a - AROUND)  # words that overlap the surroundings
        inner = words[bisect_left(starts, a) : bisect_left(starts, b)]
        block = bisect_right(blocks, (a, len(text), 0)) - 1
        outside = chained or near > len(inner) or block >= 0 and a < blocks[block][1]
        if outside and novel(a, b):
            found.append((a, 3, b))
            return True
        if not inner:
            return False
        # A run with sensitive words in it: what follows the first one, else the whole run, else what stands after each of them.
        rest = inner[0][1]
        if b - rest >= CANDIDATE_MIN and novel(rest, b):
            got = [(rest, b)]
        elif not outside and novel(a, b):
            got = [(a, b)]
        else:
            after = zip((e for _, e in inner), [*(s for s, _ in inner[1:]), b], strict=True)
            got = [(x, y) for x, y in after if y - x >= CANDIDATE_MIN and novel(x, y)]
        found.extend((x, 3, y) for x, y in got)
        return bool(got)

    said = [reported(i, False) for i in range(len(runs))]
    for order in (range(len(runs)), range(len(runs) - 1, -1, -1)):
        before = None
        for i in order:
            if not said[i] and before is not None and said[before]:
                (_, b), (a, _) = sorted((runs[before], runs[i]))
                said[i] = a - b <= REACH and reported(i, True)
            before = i
    for _, end, last in blocks:
        tail = PEM_LAST.match(text, last - 1, end) if last < end else None
        if tail and len(tail[1]) < CANDIDATE_MIN and novel(*tail.span(1)):
            found.append((tail.start(1), 3, tail.end(1)))
    return sorted(set(found))


def _hex_texts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts hold a run of at least ``HEX_MIN`` hex digits."""
    start, end, first = B.tokens(buf, off, HEX_BYTES)
    long = np.concatenate([[0], np.cumsum(end - start >= HEX_MIN)])
    return long[first[1:]] > long[first[:-1]]


def _run(dictionary: bytes):
    def run(batches):
        for batch in batches:
            for part in B.slices(batch, "text", 8 << 20):
                counts, base_texts, all_texts = [], [], []
                hexes = _hex_texts(*B.raw(part.column(1)))
                for text, has_hex in zip(part.column(1).to_pylist(), hexes.tolist(), strict=True):
                    text = text or ""
                    low = lowered(text)
                    base = base_spans(text, low, has_hex)
                    every = sorted(base + novel_spans(text, low, base, dictionary))
                    counts.append([sum(k == kind for _, k, _ in every) for kind in range(4)])
                    base_texts.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base))
                    all_texts.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in every))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base_texts, pa.string()), pa.array(all_texts, pa.string())],
                    names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"],
                )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes = IDENTIFIERS) -> DataFrame:
    """Secrets of every text: ``id_col, n_assign, n_access, n_hex, n_novel, base, spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind (assign, access, hex, novel),
    comma-joined; ``base`` holds the pattern matches alone.  The span of an assignment is the whole match.
    One row per input row, repeated rows included.  A null text is empty; an empty text has no spans and empty strings.
    Whole texts are scanned; other columns are not read.  The dictionary must stay under 64 KB.
    """
    if len(dictionary) > 64 << 10:
        raise ValueError("the identifier dictionary is broadcast with the code: 64 KB at most")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    out = T.StructType([T.StructField("id", src.schema["id"].dataType), *counts, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
    return src.mapInArrow(_run(dictionary), out).withColumnRenamed("id", id_col)
