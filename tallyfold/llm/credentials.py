"""Secret scan with multipart credential linking.

Strong findings (the base kinds ``assign``, ``access``, ``hex``) are always reported.  Weak parts —
user or key identifiers, opaque runs of 20 and more characters, values of any length after a secret's name,
endpoints — mean little alone.  They are joined by interval: within a scope (a run of lines without a blank
line) every part is widened by ``reach`` characters and meets the parts there; a weak part is reported only if
a complementary part is among them (identifier with secret, secret with identifier or endpoint, endpoint with
secret).  Nothing else decides: no opaque run is dropped for how its characters look, except rulers without
any letter or digit.  A part is no partner of itself: of parts that overlap only a named secret (a value after a
secret's name, the password of ``scheme://user:password@host``, a strong finding) and the endpoint around it count.

``redact`` masks strong findings, and of the linked parts those that are secret by themselves: values after a secret's
name of six characters or with a digit, opaque runs with a piece that mixes letters and digits or the cases.  Names,
addresses and long ordinary words stay.

Null text: no spans.  Positions are code points, end exclusive.  Ties (same start) are ordered by kind:
assign, access, hex, then ident, opaque, endpoint, keyed.  Every text is scanned whole; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.rows import column, map_rows

# The base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

IDENT = re.compile(
    r"(?:(?<!secret)(?<!secret[_-])access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@_.+-]{3,})",
    re.IGNORECASE | re.ASCII,
)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
TARGET = re.compile(r"[^\s\"'<>]+")
ADDRESS = re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b")
USERINFO = re.compile(r"[^\s/:@?#]*:([^\s/@?#]+)@")
KEYED = re.compile(
    r"(?:passw(?:or)?d|passphrase|pwd|secret|token|credentials?"
    r"|(?:api|secret|private|signing|encryption|auth|shared|master|account|storage)[_-]?(?:access[_-]?)?key)"
    r"[\"']?\x20*[:=]\x20*[\"']?[^\s\"'<>]+",
    re.IGNORECASE | re.ASCII,
)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint", "keyed")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "opaque": "secret", "endpoint": "place", "keyed": "secret"}
LEAST_OPAQUE = 20
NEEDS = {"id": ("secret",), "secret": ("id", "place"), "place": ("secret",)}
FIELDS = [
    ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string"),
    ("n_linked", "bigint"),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the strong findings."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _outside(start: int, end: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The pieces of a span outside others, given by their starts (ascending) and the largest ends so far."""
    out = []
    i = max(0, bisect.bisect_right(starts, start) - 1)
    while i < len(starts) and starts[i] < end:
        if starts[i] > start:
            out.append((start, starts[i]))
        start = max(start, ends[i])
        i += 1
    if start < end:
        out.append((start, end))
    return out


def _sorted_spans(parts: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    parts = sorted(parts)
    return [s for s, _, _ in parts], np.maximum.accumulate([e for _, _, e in parts]).tolist() if parts else []


def endpoints(text: str) -> list[tuple[int, int, int]]:
    """Addresses with a scheme (kind 5), the passwords in them (kind 6), and numeric addresses with a port (kind 5).

    Every scheme is read back from its ``://``, so no run of letters is read more than once.
    """
    out, last = [], 0
    at = text.find("://")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in SCHEME:
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        target = TARGET.match(text, at + 3) if start < at else None
        if target:
            last = target.end()
            out.append((start, 5, last))
            user = USERINFO.match(text, at + 3, last)
            if user:
                out.append((user.start(1), 6, user.end(1)))
        at = text.find("://", max(at + 3, last))
    urls = [(s, e) for s, k, e in out if k == 5]
    starts = [s for s, _ in urls]
    for m in ADDRESS.finditer(text):
        i = bisect.bisect_right(starts, m.start())
        if not (i and urls[i - 1][1] > m.start()):
            out.append((m.start(), 5, m.end()))
    return out


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts outside the strong findings; of an opaque run, the pieces outside them."""
    named = [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    named += [(m.start(), 6, m.end()) for m in KEYED.finditer(text)]
    places = endpoints(text) if ":" in text else []
    taken = {(s, e) for s, _, e in named}
    named += [(s, k, e) for s, k, e in places if k == 6 and (s, e) not in taken]
    found = named + [p for p in places if p[1] == 5]
    starts, ends = _sorted_spans(strong)
    free = []
    for s, k, e in found:
        i = bisect.bisect_left(starts, e)
        if not (i and ends[i - 1] > s):
            free.append((s, k, e))
    around = _sorted_spans(named)
    for m in OPAQUE.finditer(text):
        for s, e in _outside(m.start(), m.end(), starts, ends):
            # What follows a named value in the same run is a part of its own; else the run stays whole.
            own = [(a, b) for a, b in _outside(s, e, *around) if b - a >= LEAST_OPAQUE] or [(s, e)]
            free += [(a, 4, b) for a, b in own if b - a >= LEAST_OPAQUE and text[a:b].strip("+/_=-")]
    return sorted(free, key=lambda part: part[1])


def linked(text: str, strong: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Weak parts with a complementary part within reach in the same scope: an interval join by role."""
    if not weak or len(weak) + len(strong) < 2:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    by: dict[tuple[int, str], list[tuple[int, int]]] = {}
    named: dict[int, list[int]] = {}
    for s, k, e in (*strong, *weak):
        scope = bisect.bisect_right(cuts, s)
        by.setdefault((scope, ROLE[KINDS[k]]), []).append((s, e))
        if ROLE[KINDS[k]] == "secret" and k != 4:
            named.setdefault(scope, []).append(s)
    index = {}
    for key, spans in by.items():
        spans.sort()
        ends = [e for _, e in spans]
        index[key] = ([s for s, _ in spans], sorted(ends), np.maximum.accumulate(ends).tolist())
    for starts in named.values():
        starts.sort()
    out = []
    for s, k, e in weak:
        scope, own = bisect.bisect_right(cuts, s), ROLE[KINDS[k]]
        for role in NEEDS[own]:
            starts, ends, reached = index.get((scope, role), ((), (), ()))
            before, after = bisect.bisect_right(ends, s), bisect.bisect_left(starts, e)
            near = (before and ends[before - 1] >= s - reach) or (after < len(starts) and starts[after] <= e + reach)
            if not near and role == "place" and k != 4:
                i = bisect.bisect_right(starts, s)
                near = i and reached[i - 1] > s
            elif not near and own == "place":
                inside = named.get(scope, ())
                near = bisect.bisect_left(inside, s) < bisect.bisect_left(inside, e)
            if near:
                out.append((s, k, e))
                break
    return out


PIECE = re.compile(r"[A-Za-z0-9]+")
VALUE = re.compile(r"[^:=]*[:=]\x20*[\"']?(.*)", re.DOTALL)


def secret_by_itself(text: str, start: int, kind: int, end: int) -> bool:
    """Is a linked part more than a name, an address or a word?"""
    if kind == 6:
        value = VALUE.fullmatch(text, start, end)
        value = value.group(1) if value else text[start:end]
        return len(value) >= 6 or any(c.isdigit() for c in value)
    if kind != 4:
        return False
    for m in PIECE.finditer(text, start, end):
        p = m.group()
        digits = sum(c.isdigit() for c in p)
        if len(p) > 4 and 0 < digits < len(p):
            return True
        if len(p) >= 12 and not digits and p[1:] != p[1:].lower() and p != p.upper():
            return True
    return False


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(
    docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), prefix: str = "", reach: int = 200
) -> DataFrame:
    """``carry`` columns of every document with the counts, digest and spans of its findings."""

    def scan(texts):
        rows = []
        for t in texts.to_pylist():
            t = t or ""
            base = base_spans(t)
            more = linked(t, base, weak_parts(t, base), reach)
            n = [sum(k == j for _, k, _ in base) for j in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
        types = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
        return [pa.array(c, t) for c, t in zip(zip(*rows), types)]

    return map_rows(docs, [text_col], FIELDS, scan, carry, prefix)


def redact(
    docs: DataFrame, text_col: str = "text", size_col: str | None = None, mask: str = "[SECRET]", reach: int = 200
) -> DataFrame:
    """``docs`` with every secret of the text (see above) replaced by ``mask``; null stays null.

    Overlapping spans become one mask.  ``size_col``, if given, is set to the new length in code points in
    the rows whose text changed.
    """

    def clean(texts):
        out, changed = [], []
        for t in texts.to_pylist():
            parts, at = [], 0
            if t:
                base = base_spans(t)
                more = [p for p in linked(t, base, weak_parts(t, base), reach) if secret_by_itself(t, *p)]
                for s, _, e in sorted(base + more):
                    if e > at:
                        if s >= at:
                            parts += [t[at:s], mask]
                        at = e
            changed.append(bool(parts))
            out.append("".join([*parts, t[at:]]) if parts else t)
        return [pa.array(out, pa.string()), pa.array(changed, pa.bool_())]

    out = map_rows(docs, [text_col], [("text", "string"), ("changed", "boolean")], clean, docs.columns, "_clean_")
    keep = []
    for c in docs.columns:
        if c == text_col:
            keep.append(F.col("_clean_text").alias(c))
        elif c == size_col:
            new = F.length("_clean_text").cast(docs.schema[c].dataType)
            keep.append(F.when(F.col("_clean_changed"), new).otherwise(column(c)).alias(c))
        else:
            keep.append(column(c))
    return out.select(*keep)
