"""Corpus encoding by a public byte-level BPE vocabulary, exactly and in linear time.

A text is split by the vocabulary's public pattern. A piece that is a token itself is done; any other piece is
encoded left to right by the longest token at each place. A token may follow another only if byte pair
merging would leave the border between the two, which is decided once per token pair and kept. Where no
token fits, the last one is shortened to its longest prefix that is a token. Each (place, token) is tried
at most once, so the work is linear in the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import OrderedDict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import spread

#: Largest rank file, in bytes, that is sent to the workers.
MOST_BYTES = 64 << 20
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


class ByteBpe:
    """Encoder over merge ranks: a token's id is its rank, and lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int], *, memo: int = 1 << 20):
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.texts = {rank: token for token, rank in self.ids.items()}
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = memo
        self.known: OrderedDict[str, tuple[int, ...]] = OrderedDict()

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token in self.halves:
            return self.halves[token]
        text = self.texts[token]
        got = None
        if len(text) > 1:
            parts = self._merge(text, below=token)
            got = (parts[0], parts[1]) if len(parts) == 2 else None
        self.halves[token] = got
        return got

    def _merge(self, text: str, below: int) -> list[int]:
        """Plain merging with ranks under ``below``; only ever used on single tokens, to learn their halves."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def _stays_apart(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens leaves the border between them."""
        key = (left, right)
        if key in self.fits:
            return self.fits[key]
        ids, texts = self.ids, self.texts
        bound, a, b, apart = len(texts) + 1, left, right, True
        while True:
            joint = ids.get(texts[a] + texts[b])
            if joint is not None and joint < bound:
                # would be merged across the border before either side was complete
                apart = False
                break
            # undo the later of the two merges: what touches the border one step earlier
            if a > b:
                inner = self._halves(a)
                if inner is not None:
                    bound, a = a, inner[1]
                    continue
                inner = self._halves(b)
                if inner is None:
                    break
                bound, b = b + 1, inner[0]
            else:
                inner = self._halves(b)
                if inner is not None:
                    bound, b = b + 1, inner[0]
                    continue
                inner = self._halves(a)
                if inner is None:
                    break
                bound, a = a, inner[1]
        if len(self.fits) >= self.memo:
            self.fits.clear()
        self.fits[key] = apart
        return apart

    def _prefix(self, token: int) -> int:
        """The longest proper prefix that is a token; -1 for a single byte."""
        if token not in self.shorter:
            text = self.texts[token]
            self.shorter[token] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), -1)
        return self.shorter[token]

    def _longest(self, piece: str) -> list[int]:
        """For each place, the longest token that starts there."""
        best, size = [0] * len(piece), [0] * len(piece)
        for end, (token, n) in self.automaton.iter(piece):
            at = end - n + 1
            if n > size[at]:
                best[at], size[at] = token, n
        return best

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, given as bytes in Latin-1."""
        one = self.ids.get(piece)
        if one is not None:
            return (one,)
        longest, texts, n = self._longest(piece), self.texts, len(piece)
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while True:
                to = at + len(texts[token])
                if not dead[to] and (not out or self._stays_apart(out[-1], token)):
                    out.append(token)
                    at = to
                    token = longest[at] if at < n else -1
                    break
                token = self._prefix(token)
                if token < 0:
                    dead[at] = 1
                    token = out.pop()
                    at -= len(texts[token])
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts give none."""
        if not text:
            return []
        ids: list[int] = []
        known, add = self.known, ids.extend
        for word in self.split(text):
            got = known.get(word)
            if got is None:
                got = self.encode_piece(word.encode("utf-8", "replace").decode("latin-1"))
                if len(word) <= 64:
                    if len(known) >= self.memo:
                        known.popitem(last=False)
                    known[word] = got
            add(got)
        return ids


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a rank file, built once per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(load_ranks(path))
    return _ENCODERS[path]


def _encoder_of(key: str, data: bytes) -> ByteBpe:
    """The encoder of a rank file's content, built once per Python process."""
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(read_ranks(data))
    return _ENCODERS[key]


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


def encode_corpus(df: DataFrame, *, doc_id: str, text: str, path: str | None = None, count_only: bool = False) -> DataFrame:
    """Rows (<doc_id>, ids array<int>), or (<doc_id>, n_tokens long) with ``count_only``.

    One row per row of ``df``, repeated ones too; null ids stay null. Null and empty texts give an empty list.
    Texts of any length are encoded whole. There is no shuffle but where the input has fewer partitions than cores; batches are kept small for long texts.
    """
    with open(path or rank_file(), "rb") as f:
        data = f.read()
    if len(data) > MOST_BYTES:
        raise ValueError(f"a rank file of {len(data)} bytes is too large to be sent to the workers")
    # the ranks travel with the job: the executors need no file
    key, sent = hashlib.blake2b(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)
    kind = df.schema[doc_id].dataType.simpleString()
    out = f"`{doc_id}` {kind}, " + ("n_tokens long" if count_only else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder_of(key, sent.value)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for at in range(0, b.num_rows, 256):
                ids = [enc.encode(t) for t in texts.slice(at, 256).to_pylist()]
                value = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), value], [doc_id, "n_tokens" if count_only else "ids"])

    return spread(df.select(F.col(doc_id), F.col(text).cast("string"))).mapInArrow(run, out)
