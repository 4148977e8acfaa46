"""Secret scan: strong patterns by themselves, weak parts only when complementary parts stand together.

A credential is often of several parts: who (an identifier), what (a secret) and
where (an endpoint). Each part alone is too weak to report. The parts of a text are
laid out as intervals within scopes (runs of lines without an empty line between
them), and an interval join puts each part to its scope. A scope's weak parts are reported if it
holds a secret and a part of another sort, however far apart; an identifier beside an endpoint is none.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_text

# The base patterns, and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("identifier", "secret", "endpoint")

# Parts are whole runs of their signs, however long; each pattern looks at a sign a bounded number of times.
_IDENTIFIER = re.compile(r"""\b(?:access_?key_?id|client_?id|account_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])(?:https?|ftps?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, leftmost and non-overlapping per kind, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def _random_like(s: str) -> bool:
    """Mixed letters and digits with an entropy of at least 3 bits a character."""
    if not (any(c.isdigit() for c in s) and sum(c.isalpha() for c in s) >= 4):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) >= 3.0


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts of ``text`` whose scope holds a secret and a part of another sort, as spans; none overlaps a base span."""
    weak: list[tuple[int, int, str]] = []
    # Every weak secret has a digit, every endpoint "://", every identifier "=" or ":": most texts end here.
    if "://" in text:
        weak += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if ":" in text or "=" in text:
        weak += [(*m.span(1), "identifier") for m in _IDENTIFIER.finditer(text)]
    if not weak and not base:
        return []  # weak secrets can't be complementary to each other
    weak += [(*m.span(), "secret") for m in _SECRET.finditer(text) if _random_like(m[0])]
    # What a base span covers is strong already and takes part as the sort it has.
    taken: list[tuple[int, int]] = []
    for b, e, _ in base:  # merged, in order of start
        if taken and b <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((b, e))
    begins = [b for b, _ in taken]
    rank = {"endpoint": 0, "identifier": 1, "secret": 2}
    free: list[tuple[int, int, str]] = []
    for b, e, k in sorted(weak, key=lambda s: (s[0], rank[s[2]])):
        i = bisect.bisect_left(begins, e) - 1
        if (i < 0 or taken[i][1] <= b) and (not free or free[-1][1] <= b):
            free.append((b, e, k))
    if not free:
        return []
    sort = {"assign": "secret", "hex": "secret", "access": "identifier"}
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    # A part's scope is numbered by the ends before it.
    sorts: dict[int, set[str]] = {}
    for b, _, k in [(b, e, sort[k]) for b, e, k in base] + free:
        sorts.setdefault(bisect.bisect_right(ends, b), set()).add(k)
    whole = {scope for scope, kinds in sorts.items() if "secret" in kinds and len(kinds) > 1}
    return [s for s in free if bisect.bisect_right(ends, s[0]) in whole]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, in order of start, then kind; null is the empty text."""
    text = text or ""
    base = base_spans(text)
    order = BASE_KINDS + ADDED_KINDS
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], order.index(s[2]), s[1]))


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, counts of base spans, their digest, and all spans.

    Null and empty texts have no spans; the key is passed on as it is, null included.
    Repeated rows give repeated results. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1).to_pylist():
            base, every = scan(t)
            n = Counter(k for _, _, k in base)
            rows.append((*(n[k] for k in BASE_KINDS), hashlib.sha256(_line(base).encode()).hexdigest(), _line(every)))
        cols = list(zip(*rows))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_text(df.select(col(key), col(text)), run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, marker: str = "[SECRET]") -> str | None:
    """``text`` with every found span (overlapping ones as one) replaced by ``marker``."""
    if not text:
        return text
    out, at = [], 0
    for b, e, _ in scan(text)[1]:
        if b >= at:
            out += [text[at:b], marker]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the spans in ``text`` masked; nulls stay null, other columns are kept as they are."""
    at = df.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array([mask(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return map_text(df, run, df.schema, at)
