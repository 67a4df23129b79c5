"""Secrets in documents, with multipart credentials linked by interval joins.

Base spans, each kind on its own, leftmost and non-overlapping: ``assign`` (a
password, secret, token or key given a value of 8 or more characters), ``access``
(AKIA and capitals or digits, 16 or more in all) and ``hex`` (32 or more lower-case
hexadecimal digits). They are reported wherever they are.

Weak candidates say nothing on their own:

* ``id``: a user, client or account name given a value, an e-mail address, the user
  of a URL;
* ``secret``: a run of 20 or more characters that mixes lower case, upper case and
  digits, a quoted one of 8 or more, 32 or more capital hexadecimal digits, the
  password of a URL, a value after ``pwd``, ``pass``, ``auth``, ``bearer`` or ``key``, and
  what ``assign`` finds too short;
* ``endpoint``: a URL, a data-source name, a host with a port or of three labels or
  more, an IP address, a host or bucket given a value.

Scopes are the texts between blank lines. In a scope, the intervals of candidates and
base spans, widened by ``REACH`` code points, are joined: two parts meet if at most
that many lie between them. A weak secret is reported if it meets an identifier
(``id`` or ``access``); an identifier if it meets a secret (``secret``, ``assign`` or
``hex``); an endpoint if it meets both an identifier and a secret. All others are held
back, and counted. The join is a search in the sorted starts and ends of a scope, so
its cost is near linear in the parts of a text, however long.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Each row is scanned on its own: rows that repeat, ties and null ids give a row each,
an empty table gives none, and further columns of the documents, whatever their
names, don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .pii import emails
from .text import slices

#: The patterns of base spans.
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so a shorter run can't hide a longer one

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
BASE = KINDS[:3]
#: Code points between two parts that meet, at most.
REACH = 1000

_ID = re.compile(r"""(?ai:\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id|uid))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_QUOTED = re.compile(r"""(?:"([^\s"']{8,64})"|'([^\s"']{8,64})')""")
_CAPITAL_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-F]{32,}(?![0-9A-Za-z])")
_GIVEN = re.compile(r"""(?ai:\b(?:pwd|pass|auth|bearer|key|private_?key|credential))["']?(?:\x20*[:=]\x20*|\x20)["']?(?=[A-Za-z0-9+/_.=-])""")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]++")
_USER = re.compile(r"://([^\s/?#@:\"'<>]+)(?::([^\s/?#@\"'<>]+))?@")
_URL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}:(?://|[a-z]+://)[^\s\"'<>]{3,}")
_HOST = re.compile(r"(?<![A-Za-z0-9.@-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?::[0-9]{2,5}(?![0-9]))?")
_PLACE = re.compile(r"""(?ai:\b(?:host(?:_?name)?|server|endpoint|bucket|database|dsn))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._:/-]{3,})""")
_BLANK = re.compile(r"\n[\x20\t]*\n")

#: What texts hold, in lower case, that patterns can match; looking for it is cheaper.
_TOLD = {
    ASSIGN: ("password", "passwd", "secret", "token", "api"),
    _ID: ("user", "login", "client", "account", "access", "uid"),
    _GIVEN: ("pwd", "pass", "auth", "bearer", "key", "credential"),
    _PLACE: ("host", "server", "endpoint", "bucket", "database", "dsn"),
}
_DOTTED = re.compile(r"[A-Za-z0-9-]\.[A-Za-z0-9-]")

Span = tuple[str, int, int]


def _matches(pattern: re.Pattern, text: str, lower: str) -> Iterator[re.Match]:
    return pattern.finditer(text) if any(x in lower for x in _TOLD[pattern]) else iter(())


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in _matches(ASSIGN, text, text.lower()) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _mixed(run: str) -> bool:
    return any(c.islower() for c in run) and any(c.isupper() for c in run) and any(c.isdigit() for c in run)


def _hosts(text: str) -> Iterator[Span]:
    """Hosts with a port, of four numbers, or of three labels or more that end in letters."""
    for m in _HOST.finditer(text):
        labels = m[0].partition(":")[0].split(".")
        numbers = [x for x in labels if x.isascii() and x.isdigit() and len(x) <= 3]
        if ":" in m[0] or len(labels) == len(numbers) == 4 or len(labels) >= 3 and not labels[-1].isdigit() and len(labels[-1]) >= 2:
            yield "endpoint", m.start(), m.end()


def _given(text: str, lower: str) -> Iterator[Span]:
    """What a keyword is given: a value of 6 characters or more with a digit, to the end of its run.

    Runs are cut once and their last digits looked up, so keywords within one long run don't each read it.
    """
    values, end = _VALUE.finditer(text), 0
    run = digit = -1  # end of the run at hand, and its last digit
    for m in _matches(_GIVEN, text, lower):
        if m.start() < end:
            continue
        while run <= m.end():
            value = next(values)
            run = value.end()
            digit = next((k for k in range(run - 1, value.start() - 1, -1) if "0" <= text[k] <= "9"), -1) if run > m.end() else -1
        if digit >= m.end():
            end = run
            if run - m.end() >= 6:
                yield "secret", m.start(), run


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers, secrets and endpoints that say nothing on their own; none overlaps a base span."""
    lower = text.lower()
    found: set[Span] = {("id", m.start(), m.end()) for m in _matches(_ID, text, lower)} | {("endpoint", m.start(), m.end()) for m in _matches(_PLACE, text, lower)}
    found |= {("secret", m.start(), m.end()) for m in _RUN.finditer(text) if _mixed(m[0])}
    found |= {("secret", m.start(), m.end()) for m in _CAPITAL_HEX.finditer(text)}
    if '"' in text or "'" in text:
        found |= {("secret", *m.span(m.lastindex)) for m in _QUOTED.finditer(text) if _mixed(m[m.lastindex])}
    found |= set(_given(text, lower))
    found |= {("secret", m.start(), m.end()) for m in _matches(ASSIGN, text, lower) if 4 <= len(m[2]) < 8}
    if "@" in text:
        found |= {("id", s, e) for _, s, e in emails(text)}
        for m in _USER.finditer(text):
            found |= {("id", *m.span(1))} | ({("secret", *m.span(2))} if m[2] else set())
    if ":" in text:
        found |= {("endpoint", m.start(), m.end()) for m in _URL.finditer(text)}
    if _DOTTED.search(text):
        found |= set(_hosts(text))
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or reach[k - 1] <= s

    return [x for x in found if free(*x[1:])]


def _meets(spans: list[Span], others: list[Span]) -> set[Span]:
    """Those of ``spans`` within ``REACH`` of one of ``others``."""
    starts, ends = sorted(s for _, s, _ in others), sorted(e for _, _, e in others)
    # One of others overlaps [s - REACH, e + REACH] unless each begins after it or ends before it.
    return {x for x in spans if bisect_right(starts, x[2] + REACH) - bisect_left(ends, x[1] - REACH) > 0}


def linked(text: str, base: list[Span], weak: list[Span] | None = None) -> list[Span]:
    """The weak candidates of a text that have complementary parts in their scope."""
    weak = weak_spans(text, base) if weak is None else weak
    if not weak:
        return []
    cuts = [m.end() for m in _BLANK.finditer(text)]
    scopes: dict[int, list[Span]] = {}
    for x in base + weak:
        scopes.setdefault(bisect_right(cuts, x[1]), []).append(x)
    out: set[Span] = set()
    for parts in scopes.values():
        by = {k: [x for x in parts if x[0] == k] for k in KINDS}
        identifiers, secrets = by["id"] + by["access"], by["secret"] + by["assign"] + by["hex"]
        out |= _meets(by["secret"], identifiers) | _meets(by["id"], secrets)
        out |= _meets(by["endpoint"], identifiers) & _meets(by["endpoint"], secrets)
    return list(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches, "text"):
        found, held = [], []
        for text in part.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            weak = weak_spans(text, base)
            added = linked(text, base, weak)
            found.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in in_order(base + added)])
            held.append(len(weak) - len(added))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind), pa.array(held, pa.int64())], ["doc_id", "found", "held_back"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, found (array of kind, start, end, in order) and held_back (weak candidates without complement) of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_scanned, f"doc_id {dict(docs.dtypes)['doc_id']}, found array<struct<kind:string,start:bigint,end:bigint>>, held_back long")
