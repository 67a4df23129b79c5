"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts each text into chunks of about a
kilobyte, so copies of a passage are cut alike wherever they stand. What a chunk
encodes to is kept and reused for all documents that a worker sees. Joins of chunks
are then repaired by re-encoding until both sides agree exactly.

Any vocabulary of the library: a join is a window over the end of what is encoded
and the beginning of the next chunk. The window is encoded anew, and widened, until
on either side a pre-token with the same place and ids stands in both: pre-tokens are
found from left to right, so from there on both go on alike. A window's last pre-token
and what might begin a special token at its end are not trusted. Without such a pre-token
the window grows to the whole text, so the ids are those of encoding it whole.

Byte-level vocabularies with the usual pre-tokenizer, told by the file, have places
where agreement needs no search: single spaces between two characters that aren't white
space. No token reaches over one, and what stands before one never changes the
tokens behind it. A chunk's core, between its first and last safe place, is as it is;
the tail of one chunk and the head of the next are re-encoded. Chunks without a safe
place (scripts without spaces, base64) are joined by windows as above.

Cores and joins that are new are encoded as pieces between safe places, all new
pieces of a slice of texts in one call of the library, and pieces are kept too.
All stores hold a bounded number of characters, in two generations: what is used
moves to the younger one, and when that is full the older one is dropped. So a
worker's memory doesn't grow with the corpus. Nothing is shuffled; a lost executor
costs its running tasks.

Strings of special tokens within a text become those tokens, as in the library.
Null and empty texts have no ids and decode to the empty text; very long texts are
encoded whole. Rows that repeat, ties and null ids give a row each, an empty table
none; further columns of the documents, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import _power_tables, mix, slices, text_bytes

#: Bytes that the rolling hash sees, and the bits of it that are zero at a cut.
WINDOW, CUT_BITS = 48, 10
#: Characters that each generation of a worker's stores holds, about.
KEPT_CHUNKS, KEPT_PIECES = 4_000_000, 4_000_000
#: The same for chunks that are kept by pre-token, whose values are larger.
KEPT_SPLIT = 400_000
#: Characters of a new chunk that a window sees at first, and by how much more each time.
FIRST, WIDER = 64, 4

#: From one safe place to the next.
_PIECE = re.compile(r"(?s).[^ ]*(?:(?:(?<=\s) | (?!\S))[^ ]*)*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Store:
    """Values by text, in a younger and an older generation."""

    def __init__(self, limit: int):
        self.young, self.old, self.limit, self.held = {}, {}, limit, 0

    def turn(self) -> bool:
        """Drop the older generation if the younger one is full."""
        full = self.held > self.limit
        if full:
            self.old, self.young, self.held = self.young, {}, 0
        return full

    def put(self, texts: list[str], values: list) -> None:
        self.young.update(zip(texts, values, strict=True))
        self.held += sum(map(len, texts))

    def missing(self, texts: set[str]) -> set[str]:
        """Those of ``texts`` in neither generation; the others are in the younger one afterwards."""
        texts = texts - self.young.keys()
        used = list(texts & self.old.keys())
        self.put(used, [self.old[t] for t in used])
        return texts.difference(used)


#: Place, end and ids of a pre-token.
Split = tuple[int, int, tuple[int, ...]]


def _splits(encoding, base: int) -> list[Split]:
    """The pre-tokens of an encoding, ``base`` characters further on."""
    ids, words = encoding.ids, encoding.word_ids
    cuts = [k for k, word in enumerate(words) if not k or word is None or word != words[k - 1]]
    offsets = encoding.offsets
    return [(offsets[s][0] + base, offsets[e - 1][1] + base, tuple(ids[s:e])) for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]


def _has_safe_places(library) -> bool:
    """Whether single spaces between others are where tokens end, whatever stands around."""
    spec = json.loads(library.to_str())
    pre, model, decoder = (spec[k] or {} for k in ("pre_tokenizer", "model", "decoder"))
    plain = spec["normalizer"] is None and spec["post_processor"] is None and model.get("type") == "BPE" and not model.get("dropout")
    levels = pre.get("type") == decoder.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and levels and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


class Encoder:
    """Encodes and decodes texts with one vocabulary; lives as long as its worker."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.safe = _has_safe_places(self.library)
        self.margin = max([8, *(len(t.content) for t in self.library.get_added_tokens_decoder().values())])
        self.decimal = [str(k) for k in range(self.library.get_vocab_size())]
        self.chunks, self.pieces, self.split = _Store(KEPT_CHUNKS), _Store(KEPT_PIECES), _Store(KEPT_SPLIT)
        self.odd: dict[str, str] = {}  # kept pieces that decode to another text

    def _encoded(self, text: str, base: int = 0) -> list[Split]:
        return _splits(self.library.encode(text, add_special_tokens=False), base)

    def repaired(self, chunks: list[str]) -> list[int]:
        """Ids of the text that ``chunks`` make up."""
        self.split.turn()
        new = list(self.split.missing(set(chunks)))
        self.split.put(new, [_splits(e, 0) for e in self.library.encode_batch(new, add_special_tokens=False)])
        known, text = self.split.young, "".join(chunks)
        begins = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).tolist()
        done: list[Split] = []
        mine, at = known[chunks[0]] if chunks else [], 0
        while at < len(chunks) - 1:
            # What the chunk alone and the whole text have in common for sure.
            done += [x for x in mine[:-1] if x[1] <= begins[at + 1] - self.margin]
            mine, at = self._window(text, begins, chunks, known, done, at + 1)
        return [id_ for x in [*done, *mine] for id_ in x[2]]

    def _window(self, text: str, begins: list[int], chunks: list[str], known: dict, done: list[Split], at: int) -> tuple[list[Split], int]:
        """Puts in ``done`` what is up to an agreement in chunk ``at`` or one behind it; the pre-tokens of that chunk from there, and its number."""
        back, stop, theirs = min(len(done), 4), min(len(text), begins[at] + FIRST), None
        while True:
            first = done[-back][0] if back else 0
            seen = self._encoded(text[first:stop], first)
            if back:
                tail = {x: len(done) - back + k for k, x in enumerate(done[len(done) - back :])}
                agreed = next((k for k, x in enumerate(seen) if x in tail), None)
                if agreed is None:
                    back = min(len(done), back * WIDER) if back < len(done) else 0
                    continue
                kept, seen = tail[seen[agreed]] + 1, seen[agreed + 1 :]
            else:
                kept = 0
            if stop == len(text):
                done[kept:] = seen
                return [], len(chunks)
            sure = [x for x in seen[:-1] if x[1] <= stop - self.margin]
            if theirs is None:
                theirs = {(s + begins[at], e + begins[at], ids): k for k, (s, e, ids) in enumerate(known[chunks[at]])}
            agreed = next((k for k, x in enumerate(sure) if x in theirs), None)
            if agreed is not None:
                base = begins[at]
                done[kept:] = sure[: agreed + 1]
                return [(s + base, e + base, ids) for s, e, ids in known[chunks[at]][theirs[sure[agreed]] + 1 :]], at
            stop = min(len(text), first + WIDER * (stop - first))
            while at + 1 < len(chunks) and begins[at + 1] + FIRST <= stop:
                at, theirs = at + 1, None

    def _learn(self, pieces: set[str]) -> None:
        new = list(self.pieces.missing(pieces))
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            ids = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            back = self.library.decode_batch(ids, skip_special_tokens=False)
            number = self.decimal.__getitem__
            self.pieces.put(part, [",".join(map(number, mine)) for mine in ids])
            if back != part:
                self.odd.update((p, b) for p, b in zip(part, back, strict=True) if p != b)

    def _read(self, pieces: list[str]) -> tuple[str, str]:
        """(ids, decoded text) of learnt pieces that follow one another."""
        known = self.pieces.young
        if self.odd and not self.odd.keys().isdisjoint(pieces):
            text = "".join(self.odd.get(p, p) for p in pieces)
        else:
            text = "".join(pieces)
        return ",".join([known[p] for p in pieces]), text

    def _joined(self, chunks: list[str]) -> tuple[str, str]:
        ids = self.repaired(chunks)
        return ",".join([self.decimal[k] for k in ids]), self.library.decode(ids, skip_special_tokens=False)

    def documents(self, texts: list[list[str]]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text, given as its chunks."""
        if not self.safe:
            return [self._joined(chunks) for chunks in texts]
        self.chunks.turn()
        if self.pieces.turn():
            self.odd = {p: b for p, b in self.odd.items() if p in self.pieces.old}
        new = {c: _PIECE.findall(c) for c in self.chunks.missing({c for chunks in texts for c in chunks})}
        known = self.chunks.young
        # Each text as the joins to repair and, between them, the chunks whose cores are as they are.
        plans, joins = [], {}
        for chunks in texts:
            plan, open_ = [], []
            for chunk in chunks:
                pieces = new.get(chunk)
                head, tail = (pieces[0], pieces[-1] if len(pieces) > 1 else "") if pieces else known[chunk][:2]
                open_.append(head)
                if tail:  # the chunk has a safe place, where the join ends
                    plan += [(tuple(open_), None), (None, chunk)]
                    open_ = [tail]
            if open_:
                plan.append((tuple(open_), None))
            plans.append(plan)
            joins.update((parts, None) for parts, _ in plan if parts is not None)
        needed: set[str] = set()
        for parts in joins:
            if len(parts) > 2:  # there are whole chunks within
                joins[parts] = self._joined(list(parts))
            else:
                joins[parts] = _PIECE.findall("".join(parts))
                needed.update(joins[parts])
        for pieces in new.values():
            needed.update(pieces[1:-1])
        self._learn(needed)
        self.chunks.put(list(new), [(p[0], p[-1] if len(p) > 1 else "", *self._read(p[1:-1])) for p in new.values()])
        out = []
        for plan in plans:
            read = [known[chunk][2:] if chunk is not None else joins[parts] if len(parts) > 2 else self._read(joins[parts]) for parts, chunk in plan]
            out.append((",".join([ids for ids, _ in read if ids]), "".join([text for _, text in read])))
        return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte positions where chunks begin: all documents' starts and the places the rolling hash picks."""
    places = [np.unique(offsets[:-1])]
    segment = 1 << 20
    for origin in range(0, len(data), segment):
        low = max(0, origin - WINDOW)
        part = data[low : origin + segment]
        power, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        at = np.arange(max(origin, WINDOW), low + len(part))  # a chunk may begin here: the window is what lies before
        seen = mix((sums[at - low] - sums[at - low - WINDOW]) * inverse[at - low - WINDOW])
        at = at[(seen >> np.uint64(64 - CUT_BITS)) == 0]
        at = at[(data[at] & 0xC0) != 0x80]  # not within a character
        # A window that reaches into the document before doesn't count.
        begins = offsets[np.searchsorted(offsets, at, "right") - 1]
        places.append(at[at - begins >= WINDOW])
    return np.unique(np.concatenate(places))


_encoders: dict[str, Encoder] = {}

#: Columns that can be asked for, with their types.
OUTPUTS = {"n_tokens": "long", "ids": "string", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and ``outputs`` of every row of ``docs`` (doc_id, text).

    ids: decimal, joined by commas; decoded: the ids decoded; ..._sha256: lower-case
    hexadecimal digests of them in UTF-8.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary)
        if encoder is None:
            encoder = _encoders[vocabulary] = Encoder(vocabulary)
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            begins = cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
            raw = data.tobytes()
            bounds = np.searchsorted(begins, offsets)
            texts = []
            for k in range(part.num_rows):
                edges = [*begins[bounds[k] : bounds[k + 1]].tolist(), int(offsets[k + 1])] if offsets[k + 1] > offsets[k] else []
                texts.append([raw[s:e].decode() for s, e in zip(edges, edges[1:])])
            out: dict[str, list] = {name: [] for name in outputs}
            for ids, decoded in encoder.documents(texts):
                for name in outputs:
                    if name == "n_tokens":
                        out[name].append(ids.count(",") + 1 if ids else 0)
                    else:
                        value = ids if name.startswith("ids") else decoded
                        out[name].append(hashlib.sha256(value.encode()).hexdigest() if name.endswith("sha256") else value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[n], pa.int64() if n == "n_tokens" else pa.string()) for n in outputs)], ["doc_id", *outputs])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *(f"{n} {OUTPUTS[n]}" for n in outputs)]))
