"""Personal information inside free text, by a character-level bidirectional LSTM with CRF transitions.

The network reads a text in overlapping windows, a frame of five characters a step, and scores the labels of each
character; scores of overlapping windows are averaged, weighted towards their middles, and the best label path is
decoded over the whole text. Spans are then snapped to whole tokens by an exact check, which can only move or
drop what the network found.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import spread

KINDS = ("email", "phone", "id_number", "address", "person")
#: Label 0 is outside; kind i begins with 2 i + 1 and goes on with 2 i + 2.
LABELS = 2 * len(KINDS) + 1
MODEL_FILE = os.path.join(os.path.dirname(__file__), "pii_model.npz")

# Classes of characters beyond ASCII.
OTHER_BLANK, LOWER, UPPER, OTHER, SIZE = 97, 98, 99, 100, 101


def _char_class(c: str) -> int:
    if " " <= c <= "~":
        return ord(c) - 31
    if c in "\n\r":
        return 96
    if c.isspace():
        return OTHER_BLANK
    return (LOWER if c.islower() else UPPER) if c.isalpha() else OTHER


#: Classes of the code points up to U+FFFF; those beyond are worked out one by one.
CLASSES = np.array([OTHER if 0xD800 <= i < 0xE000 else _char_class(chr(i)) for i in range(1 << 16)], np.uint8)


def encode_chars(text: str) -> np.ndarray:
    """Character classes of a text: ASCII as it is, the rest by kind; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = CLASSES[np.minimum(code, 0xFFFF)]
    for at in np.flatnonzero(code > 0xFFFF):
        out[at] = _char_class(text[at])
    return out


#: Characters that the network reads in one step: it runs over frames and gives labels to each character of a frame.
FRAME = 5


@dataclass
class Tagger:
    """Weights: character embedding (SIZE, E); per direction input (2, FRAME E, 4 H), recurrence (2, H, 4 H) and gate
    biases (2, 4 H); output (2 H, FRAME LABELS) and its bias; CRF transitions and scores of the first label.
    """

    embed: np.ndarray
    into: np.ndarray
    recur: np.ndarray
    gate: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    @classmethod
    def load(cls, path: str | bytes = MODEL_FILE) -> Tagger:
        """From a file, or from the bytes of one."""
        with np.load(io.BytesIO(path) if isinstance(path, bytes) else path) as z:
            return cls(**{f.name: z[f.name].astype(np.float32) for f in dataclass_fields(cls)})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in vars(self).items()})

    def emissions(self, ids: np.ndarray, frames: np.ndarray) -> np.ndarray:
        """(B, T, LABELS) scores of windows of character classes (B, T), T a multiple of FRAME; rows come in ascending
        numbers of frames, so that the rows which are still inside their window are always the last ones."""
        b, t = ids.shape
        n, h = t // FRAME, self.recur.shape[1]
        x = self.embed.take(ids.reshape(b, n, FRAME).transpose(1, 0, 2), axis=0).reshape(n, b, -1)
        # sigmoid(x) = (1 + tanh(x / 2)) / 2: one tanh for all four gates; the state is kept doubled
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5
        live = np.searchsorted(frames, np.arange(n), "right")
        states = np.zeros((n, b, 2 * h), np.float32)
        for d in range(2):
            weights = np.concatenate([self.recur[d] / 2, self.into[d], self.gate[d][None]]) * half
            given = np.zeros((b, len(weights)), np.float32)
            given[:, -1] = 1
            cell, act = np.zeros((b, h), np.float32), np.empty((b, 4 * h), np.float32)
            for s in range(n) if d == 0 else range(n - 1, -1, -1):
                on = slice(int(live[s]), b)
                g, a, c = given[on], act[on], cell[on]
                g[:, h:-1] = x[s, on]
                np.matmul(g, weights, out=a)
                np.tanh(a, out=a)
                a[:, : 3 * h] += 1
                c *= a[:, h : 2 * h]
                c += a[:, :h] * a[:, 3 * h :]
                c *= 0.5
                np.multiply(np.tanh(c), a[:, 2 * h : 3 * h], out=g[:, :h])
                states[s, on, d * h : (d + 1) * h] = g[:, :h]
        scores = states.reshape(n * b, 2 * h) @ (self.out / 2) + self.bias
        return scores.reshape(n, b, FRAME, LABELS).transpose(1, 0, 2, 3).reshape(b, t, LABELS)

    def lawful(self) -> np.ndarray:
        """Transitions in which a label inside a span only follows one of its own kind."""
        t = self.trans.copy()
        for k in range(len(KINDS)):
            other = [p for p in range(LABELS) if (p - 1) // 2 != k or p == 0]
            t[other, 2 * k + 2] = -1e4
        return t

    def first_lawful(self) -> np.ndarray:
        f = self.first.copy()
        f[2::2] = -1e4
        return f

    def sure_outside(self, em: np.ndarray, run: int = 12) -> np.ndarray:
        """True where the best path of a text is known to be outside, whatever it does elsewhere; never within ``run`` of its ends.

        Let the lead at a character be how far outside is ahead of the best other label, less what staying in a span can
        gain over staying outside. If a path is in a span at a character, put outside in its place as far as the ``run``
        characters around it go: the whole span, or its part from the left end of the run, or to the right end,
        where the rest begins anew, or all of the run. The leads are won, and what the transitions (and the
        first label of a rest that begins anew) can lose is bounded; where more is won, the path was not the best.
        """
        n = len(em)
        out = np.zeros(n, bool)
        if n <= 2 * run:
            return out
        t = self.lawful()
        start = float((t[0, 1:] - t[0, 0]).max())
        enter = float((t[1:, 1:] - t[1:, :1]).max())
        inner = max(0.0, float(t[1:, 1:].max() - t[0, 0]))
        leave = float((t[1:, 0] - t[0, 0]).max())
        by = np.ascontiguousarray(em.T)
        ahead = [max(0.0, float((by[2 * k + 2] - by[2 * k + 1]).max())) for k in range(len(KINDS))]
        anew = max(
            float(t[[2 * k + 1, 2 * k + 2], 2 * k + 2].max() - t[0, 2 * k + 1] + np.maximum(0, (t[2 * k + 2] - t[2 * k + 1])[t[2 * k + 1] > -1e3]).max()) + ahead[k] for k in range(len(KINDS))
        )
        lead = by[0] - by[1:].max(0) - inner
        weak = np.concatenate([[0], np.cumsum(lead <= max(0.0, start + leave))])
        total = np.concatenate([[0.0], np.cumsum(lead, dtype=np.float64)])
        # at every place from run to n - run - 1: the sums over the run before it (itself included), after it, and in between
        left, right = total[run + 1 : n - run + 1] - total[: n - 2 * run], total[2 * run + 1 :] - total[run : n - run]
        out[run : n - run] = (
            (weak[2 * run + 1 :] == weak[: n - 2 * run]) & (left > enter + leave) & (right > start + anew) & (left + right - lead[run : n - run] > enter + anew)
        )
        return out

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best label path of each text's emissions (n, LABELS), by decoding the stretches between sure places."""
        size = np.array([len(x) for x in scores])
        ends = np.cumsum(size)
        em = np.concatenate(scores) if len(scores) else np.zeros((0, LABELS), np.float32)
        open_ = ~self.sure_outside(em)
        # no run of sure places goes over the border of two texts
        for at in ends[:-1]:
            open_[max(0, at - 12) : at + 12] = True
        first = np.zeros(len(em) + 1, bool)
        first[ends - size] = True
        before = np.concatenate([[False], open_[:-1]])
        starts = np.flatnonzero(open_ & (~before | first[:-1]))
        stops = np.flatnonzero(open_ & (~np.append(open_[1:], False) | first[1:] | (np.arange(1, len(em) + 1) == len(em)))) + 1
        out = np.zeros(len(em), np.int8)
        last = np.zeros(len(em) + 1, bool)
        last[ends] = True
        order = np.argsort(stops - starts, kind="stable")
        starts, stops = starts[order], stops[order]
        at = 0
        while at < len(starts):
            z = at + 1
            while z < len(starts) and z - at < 2048 and (z - at + 1) * (stops[z] - starts[z]) <= 100_000:
                z += 1
            a, e = starts[at:z], stops[at:z]
            for i, path in enumerate(self.viterbi([em[x:y] for x, y in zip(a, e)], first[a], last[e])):
                out[a[i] : e[i]] = path
            at = z
        return np.split(out, ends[:-1]) if len(scores) else []

    def viterbi(self, scores: list[np.ndarray], starts: np.ndarray | None = None, stops: np.ndarray | None = None) -> list[np.ndarray]:
        """Best label path of each stretch (n, LABELS), in ascending length; before and behind one that does not start or
        stop its text lies the outside label.

        Labels lie in front of stretches in memory. Only sums are kept on the way forth; which label came before is worked out on the way back, for one path a stretch.
        """
        length = np.array([len(x) for x in scores])
        t, b, k = int(length.max()), len(scores), LABELS
        lawful, first = self.lawful(), self.first_lawful()
        begin = np.ones(b, bool) if starts is None else starts
        end = np.ones(b, bool) if stops is None else stops
        sums = np.empty((t, k, b), np.float32)
        for i, x in enumerate(scores):
            sums[: len(x), :, i] = x
        sums[0] += np.where(begin, first[:, None], lawful[0][:, None])
        live = np.searchsorted(length, np.arange(t), "right")
        trans = lawful[:, :, None]
        for s in range(1, t):
            on = slice(int(live[s]), b)
            sums[s, :, on] += (sums[s - 1, :, None, on] + trans).max(0)
        path = np.zeros((t, b), np.int8)
        last = np.arange(b)
        at = (sums[length - 1, :, last] + np.where(end[:, None], 0, lawful[:, 0])).argmax(1)
        for s in range(t - 1, -1, -1):
            on = slice(int(live[s]), b)
            now = at[on]
            path[s, on] = now
            if s:
                at[on] = (sums[s - 1, :, on].T + lawful.T[now]).argmax(1)
        return [path[:n, i] for i, n in enumerate(length)]

    def text_scores(self, texts: list[str], window: int = 1000, stride: int = 940, batch: int = 256) -> list[np.ndarray]:
        """Emissions of whole texts from overlapping windows, averaged with weights that rise towards a window's middle."""
        codes = [encode_chars(t) for t in texts]
        out: list[np.ndarray] = [np.zeros((0, LABELS), np.float32) for _ in texts]
        weight: dict[int, np.ndarray] = {}
        spans = [(i, a, min(a + window, len(c))) for i, c in enumerate(codes) for a in range(0, max(1, len(c) - (window - stride)), stride) if len(c)]
        spans.sort(key=lambda s: s[2] - s[1])
        for at in range(0, len(spans), batch):
            part = spans[at : at + batch]
            frames = np.array([-(-(z - a) // FRAME) for _, a, z in part])
            ids = np.zeros((len(part), int(frames[-1]) * FRAME), np.uint8)
            for r, (i, a, z) in enumerate(part):
                ids[r, : z - a] = codes[i][a:z]
            em = self.emissions(ids, frames)
            for r, (i, a, z) in enumerate(part):
                n, whole = z - a, len(codes[i])
                if n == whole:
                    out[i] = em[r, :n]
                    continue
                if i not in weight:
                    out[i], weight[i] = np.zeros((whole, LABELS), np.float32), np.zeros((whole, 1), np.float32)
                # at the borders of the text a window sees all there is
                left = np.full(n, window) if a == 0 else np.arange(1, n + 1)
                right = np.full(n, window) if z == whole else np.arange(n, 0, -1)
                w = np.minimum(left, right).astype(np.float32)[:, None]
                out[i][a:z] += em[r, :n] * w
                weight[i][a:z] += w
        for i, w in weight.items():
            out[i] /= w
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the (start, end, kind) of the best path over the whole text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, path in enumerate(self.paths(self.text_scores(texts))):
            inside = np.flatnonzero(path)
            if not len(inside):
                continue
            begins = path[inside] % 2 == 1
            first = inside[begins]
            stop = np.append(np.flatnonzero(begins)[1:], len(inside)) - 1
            out[i] = [(a, z + 1, (k - 1) // 2) for a, z, k in zip(first.tolist(), inside[stop].tolist(), path[first].tolist())]
        return out


TITLE = re.compile(r"(?:(?:Dr|Drs|Dra|Prof|Mrs|Mr|Ms|Miss|Mme|Mlle|Herr|Frau|Sr|Sra|Srta|Don|Doña|Pt|Pat|Patient|Patientin|Patiente|Paciente|Tel|cc)\b\.?:?\s+)+", re.I)
BEHIND_TITLE = re.compile(TITLE.pattern + r"$", re.I)
EMAIL = re.compile(r"[A-Za-z0-9][\w.+-]*(?:\s?@\s?|\s?[\[(]at[\])]\s?| at (?=[\w-]+ dot ))[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?| dot )[\w-]+)+")
# Words before an address that do not belong to it.
PLACE_WORDS = re.compile(r"(?:(?:the )?address|adresse|anschrift|direcci[oó]n|domicil(?:e|io)|wohnhaft(?: in)?|wohnt|lives at|moved from|to)\b\s?:?\s+", re.I)
LEAD = " \t\r\n.,;:/#*()<>[]{}|\"“”„»«–—-﻿​"


def _words_back(text: str, at: int, words: int = 4) -> int:
    """Where the word at ``at`` and ``words`` more before it begin, of whatever length."""
    for _ in range(words + 1):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _words_on(text: str, at: int, words: int = 8) -> int:
    for _ in range(words + 1):
        while at < len(text) and text[at].isspace():
            at += 1
        while at < len(text) and not text[at].isspace():
            at += 1
    return at


def snap(text: str, a: int, z: int, kind: int) -> tuple[int, int] | None:
    """Exact check of a span: whole tokens, no titles or labels before it; None where its kind's form fails."""
    name = KINDS[kind]
    if name == "email":
        for m in EMAIL.finditer(text, _words_back(text, a), _words_on(text, z)):
            if m.start() < z and m.end() > a:
                return m.span()
        return None
    keep = "+(" if name == "phone" else ""
    word = lambda i: text[i].isalnum() or text[i] in "'’"
    while a < z and text[a] in LEAD and text[a] not in keep:
        a += 1
    while z > a and text[z - 1] in LEAD and not (name == "person" and text[z - 1] == "."):
        z -= 1
    if a >= z:
        return None
    while a > 0 and word(a) and word(a - 1):
        a -= 1
    while z < len(text) and word(z - 1) and word(z):
        z += 1
    digits = sum(c.isdigit() for c in text[a:z])
    if name == "phone":
        # a bracket belongs to the number if it is closed inside
        more = "+(" if ")" in text[a:z].split("(")[0] else "+"
        while a > 0 and (text[a - 1] in more or text[a - 1].isdigit()):
            a -= 1
        if text[a] == "(" and ")" not in text[a:z]:
            a += 1
        return (a, z) if digits >= 6 else None
    if name == "id_number":
        return (a, z) if digits >= 5 else None
    if name == "address":
        while m := PLACE_WORDS.match(text, a, z):
            a = m.end()
        return (a, z) if digits >= 1 and z - a >= 8 else None
    m = TITLE.match(text, a, z)
    if m:
        a = m.end()
    # a surname of two letters is one only behind a title
    titled = m or BEHIND_TITLE.search(text, max(0, a - 16), a)
    if digits or z - a < (2 if titled else 3) or not any(c.isalpha() for c in text[a:z]):
        return None
    return a, z


_TAGGERS: dict[str | bytes, Tagger] = {}


def _raw_spans(tagger: Tagger, texts: list[str], core: int = 100_000, margin: int = 1_000, load: int = 400_000) -> list[list[tuple[int, int, int]]]:
    """Spans of texts, a bounded number of characters at a time. A long text goes in pieces that see ``margin``
    characters beyond their core on either side; a span belongs to the piece in whose core it starts."""
    pieces = [(i, a, text[max(0, a - margin) : a + core + margin]) for i, text in enumerate(texts) for a in range(0, max(1, len(text)), core)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(pieces):
        z, size = at, 0
        while z < len(pieces) and (z == at or size + len(pieces[z][2]) <= load):
            size += len(pieces[z][2])
            z += 1
        part = pieces[at:z]
        for (i, a, piece), spans in zip(part, tagger.spans([p[2] for p in part])):
            shift = max(0, a - margin)
            out[i] += [(s + shift, e + shift, k) for s, e, k in spans if a <= s + shift < a + core]
        at = z
    return out


def find(texts: list[str], path: str | bytes = MODEL_FILE) -> list[list[tuple[int, int, int]]]:
    """Per text the checked, non-overlapping (start, end, kind), in order."""
    if path not in _TAGGERS:
        _TAGGERS[path] = Tagger.load(path)
    out = []
    for text, spans in zip(texts, _raw_spans(_TAGGERS[path], texts)):
        kept: list[tuple[int, int, int]] = []
        for a, z, kind in spans:
            got = snap(text, a, z, kind)
            if got is None:
                continue
            a, z = got
            if kept and a < kept[-1][1]:
                if kept[-1][2] == kind:
                    kept[-1] = (kept[-1][0], max(z, kept[-1][1]), kind)
                continue
            kept.append((a, z, kind))
        out.append(kept)
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, z, kind in spans:
        parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = z
    return "".join([*parts, text[at:]])


def _run(df: DataFrame, doc_id: str, text: str, schema: str, make, path: str) -> DataFrame:
    with open(path, "rb") as f:
        weights = f.read()  # some 100 kB, which go with the task: the executors need no file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                # repeated texts of a piece are read once
                once = list(dict.fromkeys(texts))
                seen = dict(zip(once, find(once, weights)))
                yield make(piece, texts, [seen[t] for t in texts])

    return spread(df.select(F.col(doc_id), F.col(text).cast("string").alias("text"))).mapInArrow(work, schema)


def find_personal(df: DataFrame, *, doc_id: str, text: str, path: str = MODEL_FILE) -> DataFrame:
    """Rows (<doc_id>, pii_type, start_pos, end_pos), one per place; positions in code points from 1, end included.

    Null, empty and blank texts give no row; texts of any length are read whole; repeated rows give repeated
    results; a null id stays null.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def make(piece: pa.RecordBatch, texts, found) -> pa.RecordBatch:
        rows = [(r, a + 1, z, KINDS[k]) for r, spans in enumerate(found) for a, z, k in spans]
        ids = piece.column(0).take(pa.array([r[0] for r in rows], pa.int32()))
        return pa.RecordBatch.from_arrays([ids, pa.array([r[3] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], [doc_id, "pii_type", "start_pos", "end_pos"])

    return _run(df, doc_id, text, f"`{doc_id}` {kind}, pii_type string, start_pos long, end_pos long", make, path)


def redact_personal(df: DataFrame, *, doc_id: str, text: str, path: str = MODEL_FILE) -> DataFrame:
    """Rows (<doc_id>, text, n_places): every text with typed placeholders like [EMAIL]; null texts stay null."""
    kind = df.schema[doc_id].dataType.simpleString()

    def make(piece: pa.RecordBatch, texts, found) -> pa.RecordBatch:
        new = [None if t is None else redact(t, s) for t, s in zip(piece.column(1).to_pylist(), found)]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(new, pa.string()), pa.array([len(s) for s in found], pa.int64())], [doc_id, "text", "n_places"])

    return _run(df, doc_id, text, f"`{doc_id}` {kind}, text string, n_places long", make, path)
