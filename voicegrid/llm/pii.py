"""Personal data in documents: base patterns and a skip-chain conditional random field.

Base spans, each kind on its own, leftmost and non-overlapping: ``email``, ``ip``
(parts at most 255), ``card`` (16 to 19 digits that pass Luhn's test) and ``phone``
(``+``, 8 to 15 digits). They are reported wherever they are.

The field labels the nodes of a document: numbers with the marks between their
digits, addresses with ``[at]`` for ``@``, and all other words, cut at quotes, commas
and brackets, that hold a digit or ``@``. A node's own potentials come from its shape,
its neighbours and what tests its digits pass. Nodes side by side share transition
potentials. Nodes that are alike (equal but for marks and case, in their last seven
digits, in the four parts of an address, or in the local part) share skip potentials at
any distance in the document: each with the last one before it, and with an anchor,
the first one that a base span covers, or else the first one. Nodes that a base span
covers are observed. Loopy message passing carries evidence over all edges until
messages rest, so that every ``988-555-2485`` is a phone number in a document that
has ``+1 (988) 555-2485`` anywhere. Nodes whose label has a marginal of ``SURE`` or more
are added as spans where no base span is.

The potentials are trained by pseudo-likelihood on a bounded sample of the different
texts with such words, ``SAMPLE_BYTES`` about, chosen by hash (a text that is larger by
itself isn't learnt from, only labelled); labels are those of the base spans. Patterns alone never show one number in two forms, so spans are
hidden: each node that has a key gets two copies in another form at another place
of its document, one that shares a skip edge with it and has its label, and one
without an edge and without a label. The copies' own features are the same, so what
tells them apart is the skip potential. A node that no base span covers but that is
alike to one within a span has no known label and isn't learnt from.

Nodes are few against texts, edges are two a node and key at most, and message
passing runs over all documents of a slice at once, so cost is linear in the texts.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Rows that repeat and null ids give a row each, ties have no part in anything. Very
long texts are seen whole, as are very long words. ``masked`` puts the kind in the
place of each span and leaves other columns alone, whatever their names, and null
texts null; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, renamed
from .text import slices

KINDS = ("email", "ip", "card", "phone")
#: Bytes of the texts that the potentials are trained on, about.
SAMPLE_BYTES = 8 << 20
SURE = 0.95
#: Messages rest when none changes by more; rounds of messages at most.
REST, ROUNDS = 1e-3, 200
DIMENSIONS = 1 << 12
_LABELS = 1 + len(KINDS)  # 0: none
#: Kinds of edges: side by side, alike, and from a node to its hidden copy, which tells the copy only.
BESIDE, ALIKE, COPY = 0, 1, 2

#: The patterns of base spans. The look-behind saves starts within a run, which can't match where its start doesn't.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOLD = re.compile(r"[0-9@]")
#: An address with its marks spelt out; a number with what may stand between its digits; any other word.
_SPELT = re.compile(r"[\[(]\x20?(?:at|@)\x20?[\])]")
_MAIL = r"(?P<mail>[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+)"
_NUMBER = r"\+?\(?[0-9](?:(?:[\x20().-]{1,2}|\[\.\]|)[0-9])+(?![\w@])"  # ends at the last digit that no word goes on from
_PLAIN = r"[^\s\"'`,;<>\[\]{}|=\\/]+"
_NODES = re.compile(f"{_NUMBER}|{_PLAIN}")
_NODES_AND_MAIL = re.compile(f"{_MAIL}|{_NUMBER}|{_PLAIN}")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    """Whether a run of digits, of any length, is 255 at most."""
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    if not _TOLD.search(text):
        return []
    found = list(emails(text))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _shape(word: str) -> str:
    """Runs of digits by length, runs of letters as one, marks as they are."""
    return _RUN.sub(lambda m: f"d{min(len(m[0]), 20)}" if "0" <= m[0][0] <= "9" else "a", word)


def _keys(word: str) -> list[str]:
    """What alike words have in common."""
    bare = word.lower().strip(".,;:!?()[]<>\"'")
    if _SPELT.search(bare):
        bare = re.sub(r"\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?", ".", re.sub(r"\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?", "@", bare))
    keys = [bare] if len(bare) >= 6 else []
    local, at, _ = bare.partition("@")
    if at and len(local) >= 6:
        keys.append(local)
    parts = re.findall("[0-9]+", word)
    if len(parts) == 4 and all(map(_byte, parts)):
        keys.append(f"ip:{'.'.join(p.lstrip('0') or '0' for p in parts)}")
    for piece in {word, *word.split(" ")}:
        digits = _digits(piece)
        if len(digits) >= 7:
            keys.append(f"#{digits[-7:]}")
    return list(dict.fromkeys(keys))


def _restyled(word: str, style: int) -> str:
    """``word`` as someone else might have put it."""
    local, at, domain = word.partition("@")
    if at:
        return [f"{local} [at] {domain}", local, f"{local}(at){domain}"][style % 3]
    parts = re.findall("[0-9]+", word)
    if len(parts) == 4 and all(map(_byte, parts)):
        return ["-", "[.]", " "][style % 3].join(parts)
    digits = _digits(word)
    if len(digits) < 7:
        return word
    if word[0] == "+":
        digits = digits[-10:] if style % 2 else digits[-7:]
    groups = [digits[:-4][k : k + 3] for k in range(0, len(digits) - 4, 3)] + [digits[-4:]] if len(digits) < 16 else [digits[k : k + 4] for k in range(0, len(digits), 4)]
    return ["-", ".", "", " "][style // 2 % 4].join(groups)


class Graph:
    """Nodes of the documents of a slice, their features and edges."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.place: list[tuple[int, int]] = []
        self.label: list[int] = []
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []  # (earlier, later, kind)

    def add(self, doc: int, text: str, base: list[Span], hide: bool = False) -> None:
        """The nodes of a text; with ``hide``, copies in other forms too, for training."""
        words = [(m.start(), m.end(), m.lastgroup == "mail") for m in (_NODES_AND_MAIL if _SPELT.search(text) else _NODES).finditer(text)]
        shapes: dict[int, str] = {}

        def shape(j: int) -> str:
            if j not in shapes:
                shapes[j] = _shape(text[words[j][0] : words[j][1]]) if 0 <= j < len(words) else ""
            return shapes[j]

        spans = sorted((s, e, KINDS.index(kind) + 1) for kind, s, e in base)
        at, last, alike = 0, -2, {}
        for k, (s, e, mail) in enumerate(words):
            if not mail and not _TOLD.search(text, s, e):
                continue
            while at < len(spans) and spans[at][1] <= s:
                at += 1
            node = len(self.doc)
            self.doc.append(doc)
            self.place.append((s, e))
            self.label.append(spans[at][2] if at < len(spans) and spans[at][0] < e else 0)
            word = text[s:e]
            self.features.append(self._features(word, shape(k), shape(k - 1), shape(k + 1)))
            if k == last + 1:
                self.edges.append((node - 1, node, BESIDE))
            last = k
            for key in _keys(word):
                alike.setdefault(key, []).append(node)
        edges = set()
        for nodes in alike.values():
            anchor = next((x for x in nodes if self.label[x]), nodes[0])
            edges.update((min(anchor, x), max(anchor, x)) for x in nodes if x != anchor)
            edges.update(zip(nodes, nodes[1:]))
        self.edges += [(a, b, ALIKE) for a, b in sorted(edges)]
        if hide:
            keyed = sorted({x for nodes in alike.values() for x in nodes})
            for n, node in enumerate(keyed):
                s, e = self.place[node]
                other = crc32(f"{doc} {n} {text[s:e]}".encode("utf-8", "surrogatepass"))
                copy, j = _restyled(text[s:e], other >> 8), other % len(words)
                features = self._features(copy, _shape(copy), shape(j), shape(j + 1))
                for label, edge in ((self.label[node], True), (0, False)):
                    if edge:
                        self.edges.append((node, len(self.doc), COPY))
                    self.doc.append(doc)
                    self.place.append((s, e))
                    self.label.append(label)
                    self.features.append(features)

    @staticmethod
    def _features(word: str, shape: str, before: str, after: str) -> list[int]:
        digits = _digits(word)
        parts = word.strip(".,;:!?()").split(".")
        tests = [
            "card" if 16 <= len(digits) <= 19 and luhn(digits) else "no card",
            "ip" if len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts) else "no ip",
            "email" if any(True for _ in emails(word)) else "no email",
            f"plus {word[0] == '+'}",
        ]
        names = ["any", f"shape {shape}", f"digits {min(len(digits), 20)}", *tests, f"before {before}", f"after {after}", f"around {before} {shape} {after}"]
        return [crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in names]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.features, np.int64).reshape(len(self.doc), -1), np.array(self.edges, np.int64).reshape(-1, 3)


@dataclass(frozen=True)
class Potentials:
    own: np.ndarray  # (DIMENSIONS, labels)
    pair: np.ndarray  # (2, labels, labels): side by side, alike


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def marginals(graph: Graph, potentials: Potentials) -> np.ndarray:
    """(nodes, labels) after rounds of damped sum-product messages over all edges, until they rest."""
    features, edges = graph.arrays()
    own, label = potentials.own[features].sum(1), np.array(graph.label)
    seen = np.flatnonzero(label)  # a base span's label is evidence
    own[seen] = -60.0
    own[seen, label[seen]] = 0.0
    a, b = edges[:, 0], edges[:, 1]
    pair = potentials.pair[edges[:, 2]]
    to_b, to_a = np.zeros((2, len(edges), _LABELS))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
        from_a, from_b = belief[a] - to_a, belief[b] - to_b
        new_b = _normal(np.logaddexp.reduce(from_a[:, :, None] + pair, axis=1))
        new_a = _normal(np.logaddexp.reduce(from_b[:, None, :] + pair, axis=2))
        change = max((float(np.abs(x - y).max(initial=0.0)) for x, y in ((new_b, to_b), (new_a, to_a))), default=0.0)
        to_b, to_a = (to_b + new_b) / 2, (to_a + new_a) / 2
        if change < REST:
            break
    belief = own.copy()
    np.add.at(belief, b, to_b)
    np.add.at(belief, a, to_a)
    return np.exp(_normal(belief))


def fit_pseudo_likelihood(features: np.ndarray, labels: np.ndarray, edges: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-5) -> Potentials:
    """Potentials that make each node's label likely given its features and the labels of the nodes it shares edges with."""
    own, pair = np.zeros((DIMENSIONS, _LABELS)), np.zeros((2, _LABELS, _LABELS))
    if not len(labels):
        return Potentials(own, pair)
    known = np.ones(len(labels), bool)
    for x, y in ((0, 1), (1, 0)):
        told = edges[(edges[:, 2] == ALIKE) & (labels[edges[:, y]] > 0)]
        known[told[labels[told[:, x]] == 0, x]] = False
    known[edges[(edges[:, 2] == COPY) & ~known[edges[:, 0]], 1]] = False
    edges = edges[known[edges[:, :2]].all(1)]
    a, b, kind = edges.T
    back = kind != COPY
    kind = np.minimum(kind, ALIKE)
    flat = features.ravel()
    truth = np.eye(_LABELS)[labels]
    moments = [np.zeros_like(x) for x in (own, pair, own, pair)]
    for step in range(1, steps + 1):
        raw = own[features].sum(1)
        np.add.at(raw, b, pair[kind, labels[a]])
        np.add.at(raw, a[back], pair[kind[back], :, labels[b[back]]])
        off = (np.exp(_normal(raw)) - truth) * known[:, None] / len(labels)
        g_own = np.stack([np.bincount(flat, np.repeat(off[:, k], features.shape[1]), DIMENSIONS) for k in range(_LABELS)], 1) + ridge * own
        g_pair = ridge * pair
        np.add.at(g_pair, (kind, labels[a]), off[b])
        np.add.at(g_pair.transpose(0, 2, 1), (kind[back], labels[b[back]]), off[a[back]])
        g_pair[ALIKE] += g_pair[ALIKE].T  # which of two alike nodes comes first tells nothing
        for x, g, m, v in ((own, g_own, 0, 2), (pair, g_pair, 1, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * g
            moments[v] = 0.999 * moments[v] + 0.001 * g * g
            x -= rate * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.999**step)) + 1e-8)
    return Potentials(own, pair)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Potentials:
    """Fit on about ``sample_bytes`` of the texts of ``docs`` (text) that have a digit or ``@``."""
    size = F.octet_length("text")
    texts = docs.select("text", F.xxhash64("text", F.lit("pii")).alias("key")).where(F.col("text").rlike("[0-9@]") & (size <= sample_bytes))
    # Texts that repeat count once, so copies leave the share of the others as it is.
    different = texts.groupBy("key").agg(F.max(size).alias("bytes"))
    share = min(1.0, sample_bytes / max(1, different.agg(F.sum("bytes")).first()[0] or 0))
    chosen = texts.where(F.pmod("key", F.lit(1 << 31)) < int(share * (1 << 31))).dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                graph = Graph()
                graph.add(0, text.as_py(), base_spans(text.as_py()), hide=True)
                rows.append(([x for f in graph.features for x in f], graph.label, [x for e in graph.edges for x in e]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(3))], ["key", "features", "labels", "edges"])

    found = materialize(chosen.mapInArrow(run, "key long, features array<long>, labels array<long>, edges array<long>"), "pii-sample").orderBy("key").collect()
    first, edges = 0, []
    for r in found:
        edges.append(np.array(r["edges"], np.int64).reshape(-1, 3) + [first, first, 0])
        first += len(r["labels"])
    labels = np.array([x for r in found for x in r["labels"]], np.int64)
    features = np.array([x for r in found for x in r["features"]], np.int64).reshape(len(labels), -1 if len(labels) else 1)
    return fit_pseudo_likelihood(features, labels, np.concatenate(edges) if edges else np.zeros((0, 3), np.int64))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without stops and without brackets that have no partner, at either end."""
    open_ = text.count("(", start, end) - text.count(")", start, end)
    while start < end and (text[start] in ".:!?" or text[start] == "(" and open_ > 0):
        open_ -= text[start] == "("
        start += 1
    while end > start and (text[end - 1] in ".:!?" or text[end - 1] == ")" and open_ < 0):
        open_ += text[end - 1] == ")"
        end -= 1
    return start, end


def find_all(texts: list[str], potentials: Potentials) -> list[list[Span]]:
    """All spans of each text, by kind, then start."""
    graph, found = Graph(), []
    for doc, text in enumerate(texts):
        found.append(base_spans(text))
        if _TOLD.search(text):
            graph.add(doc, text, found[doc])
    if graph.doc:
        chance = marginals(graph, potentials)
        best = chance.argmax(1)
        for node in np.flatnonzero((best > 0) & (chance.max(1) >= SURE) & (np.array(graph.label) == 0)):
            start, end = _trimmed(texts[graph.doc[node]], *graph.place[node])
            if start < end:
                found[graph.doc[node]].append((KINDS[best[node] - 1], start, end))
    return [sorted(x, key=lambda s: (KINDS.index(s[0]), s[1])) for x in found]


def scan(docs: DataFrame, potentials: Potentials) -> DataFrame:
    """doc_id, found (array of kind, start, end, added) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(potentials)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = []
            for text, spans in zip(texts, find_all(texts, shared.value), strict=True):
                base = set(base_spans(text)) if spans else ()
                rows.append([{"kind": k, "start": s, "end": e, "added": (k, s, e) not in base} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, found array<struct<kind:string,start:bigint,end:bigint,added:boolean>>")


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with ``[KIND]`` in the place of each span; of spans that overlap the first stands for all."""
    out, end = [], 0
    for s, e, kind in sorted((s, e, kind) for kind, s, e in spans):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame, potentials: Potentials) -> DataFrame:
    """``docs`` with masked texts; n_chars, where there is one, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(potentials)
    rows = renamed(docs, "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at = part.schema.get_field_index("text")
            texts = part.column(at).to_pylist()
            found = find_all([t or "" for t in texts], shared.value)
            new = [mask(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            yield part.set_column(at, "text", pa.array(new, pa.string()))

    out = rows.mapInArrow(run, rows.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.toDF(*docs.columns)
