"""Secret scans: an Aho-Corasick pass over keywords, anchored patterns at the hits only, checksums last.

Hexadecimal runs have no keyword; they are found as long runs of a byte class.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Keywords, patterns and least lengths of the base kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX_LEAST = 32
# Token kinds of the method, whose last six characters are a CRC-32 of the rest in base 62.
CHECKED_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm")

OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True


def base62(n: int, width: int = 6) -> str:
    out = ""
    while len(out) < width:
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def keyword_automaton() -> ahocorasick.Automaton:
    """Keywords in lower case; every kind is looked for in one pass, letter case is settled at the hit."""
    automaton = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        automaton.add_word(word, ("assign", len(word)))
    automaton.add_word("akia", ("access", 4))
    for kind, prefixes in CHECKED_PREFIXES.items():
        for word in prefixes:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Byte offsets of maximal runs of HEX_LEAST or more."""
    inside = _HEX[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return [(int(a), int(b)) for a, b in zip(starts[ends - starts >= HEX_LEAST], ends[ends - starts >= HEX_LEAST])]


def spans_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed. Leftmost and not overlapping per kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower().decode("utf-8", "surrogatepass")  # bytes.lower() changes A-Z only, so offsets stay
    found, past = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton.iter(low))
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(low, start)
            keep = match and match.end(1) - match.start(1) >= ASSIGN_LEAST
        elif kind == "access":
            match = ACCESS.match(text, start)
            keep = match and match.end() - start >= ACCESS_LEAST
        else:
            match = CHECKED.match(text, start)
            keep = match and checksum_holds(match[1], match[2])
        if match and (keep or kind in ("assign", "access")):
            past[kind] = match.end()
        if keep:
            found.append((start, match.end(), kind))
    runs = _hex_runs(raw)
    if runs:
        if len(raw) == len(text):
            found += [(a, b, "hex") for a, b in runs]
        else:
            lead = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            found += [(int(lead[a]) - 1, int(lead[a]) - 1 + b - a, "hex") for a, b in runs]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One line per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Whole texts; null counts as empty and gives no spans and the digest of nothing. spans is
    kind:start:end joined by commas, base kinds and checked tokens; offsets in code points, end exclusive.
    base_sha256 covers the base kinds alone. Rows may repeat or lack an id; each is scanned for itself.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                found = spans_of(value.as_py() or "", automaton)
                base = [s for s in found if s[2] in KINDS[:3]]
                for column, kind in zip(columns, KINDS[:3]):
                    column.append(sum(s[2] == kind for s in base))
                told = [",".join(f"{k}:{a}:{b}" for a, b, k in part) for part in (base, found)]
                columns[3].append(hashlib.sha256(told[0].encode()).hexdigest())
                columns[4].append(told[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, OUT)
