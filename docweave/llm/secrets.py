"""Secret scans: a keyword automaton finds the places, expressions are anchored there, checksums decide.

One pass of an Aho-Corasick automaton over the text (A-Z in lower case) gives the starts of all keywords. An expression
is tried at those starts only, in order, and never inside the match before it; as every match starts with a keyword,
this gives the leftmost non-overlapping matches of the whole text. Long hexadecimal runs have no keyword: every 16th
byte and four between are looked at, which no run of 32 can pass, and runs are measured around the hits. Tokens that
carry a checksum or a header of their own are reported only if that validates.

Result by case: null or empty text has no spans, and the digest of the empty string; offsets are code points, so a
very long text is scanned whole; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import flat_bytes, slices, table

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
HEX_RUN, VALUE_CHARS, ACCESS_CHARS = 32, 8, 16

#: Keywords and the public formats of tokens.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_BYTES = re.compile(rb"[0-9a-f]+")


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _json_part(part: str) -> dict | None:
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


VALID = {
    "assign": lambda m: len(m[2]) >= VALUE_CHARS,
    "access": lambda m: len(m[0]) >= ACCESS_CHARS,
    "github": lambda m: checksum62(m[1]) == m[2],
    "npm": lambda m: checksum62(m[1]) == m[2],
    "jwt": lambda m: "alg" in (_json_part(m[1]) or {}) and _json_part(m[2]) is not None,
}
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            made.add_word(word, (kind, len(word)))
        made.make_automaton()
        _automaton = made
    return _automaton


def keyword_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the matches that start with a keyword."""
    starts: dict[str, list[int]] = {}
    for last, (kind, size) in automaton().iter(low):
        starts.setdefault(kind, []).append(last + 1 - size)
    found = []
    for kind, places in starts.items():
        after = 0
        for start in sorted(places):
            match = PATTERNS[kind].match(text, start) if start >= after else None
            if match:
                after = match.end()
                if VALID[kind](match):
                    found.append((start, KINDS.index(kind), after))
    return found


def hex_runs(raw: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Row -> (first, last + 1) byte of its runs of at least HEX_RUN hexadecimal digits."""
    step = HEX_RUN // 2
    places = np.arange(0, len(raw) - step, step)
    for ahead in (0, 7, 12, 16, 3):
        places = places[_HEX[raw[places + ahead]]]
    rows = np.searchsorted(at, places, side="right") - 1
    found: dict[int, list[tuple[int, int]]] = {}
    for place, row in zip(places.tolist(), rows.tolist()):
        low, high = int(at[row]), int(at[row + 1])
        done = found.get(row)
        if done and place - low < done[-1][1]:
            continue
        first = place
        while first > low and _HEX[raw[first - 1]]:
            first -= 1
        last = first + len(_HEX_BYTES.match(raw[first:high])[0])
        if last - first >= HEX_RUN:
            found.setdefault(row, []).append((first - low, last - low))
    return found


def scan(values: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Spans of every text of a string array, sorted by start, then kind."""
    raw, at = flat_bytes(values)
    hexes = hex_runs(raw, at)
    out = []
    for row, text in enumerate(values.to_pylist()):
        if not text:
            out.append([])
            continue
        data = raw[at[row]: at[row + 1]].tobytes()
        spans = keyword_spans(text, data.lower().decode())
        for first, last in hexes.get(row, ()):
            start = len(data[:first].decode())
            spans.append((start, 2, start + last - first))
        out.append(sorted(spans))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, counts of the base kinds, digest of the base spans and all spans of every row."""
    id_kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = scan(batch.column("text"))
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in range(len(BASE))]
                digest = [hashlib.sha256(written([s for s in spans if s[1] < len(BASE)]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(digest, pa.string()), pa.array(map(written, found), pa.string())],
                                                 names=[id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(rows, f"`{id_col}` {id_kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op9_secrets": op9_secrets}
