"""Free-entered values mapped to the entries of a reference list.

One Aho-Corasick automaton over all canonical names and aliases finds whole-word mentions inside a value; the
longest, leftmost, non-overlapping one wins. What holds no mention goes to token-set similarity: the words of the
value (and joined neighbours) are looked up among the words of the names by inverted indexes that miss nothing within two
edits, and the name whose words are all there, close together and with the fewest edits for its length, is
taken. The rest is reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that never name an ingredient on their own.
SALTS = frozenset("sodium potassium calcium disodium hydrochloride hcl citrate phosphate succinate fumarate maleate mesylate besylate tartrate acetate nitrate bromide monohydrate dihydrate anhydrous free base".split())
FORMS = frozenset(
    "oral tablet tablets tab tabs capsule capsules cap caps inj injection injectable solution susp suspension amp ampoule amps vial patch cream topical ointment syrup spray drops eye ear "
    "gtt tropfen tabletten comprime comprimes gelule gelules comprimido comprimidos sublingual extended release xr er sr iv i v im sc po cp".split()
)
REMARKS = frozenset("as inn drug active contains generic rac r s brand pharma labs ag see note discontinued name the of and for with per day daily x mg mcg ug g kg ml l iu units".split())
NOISE = SALTS | FORMS | REMARKS
MAKER = re.compile(r"[(\[][^()\[\]]*\b(?:labs|pharma|ag|brand|inc|gmbh|ltd)\b[^()\[\]]*[)\]]")
DOSE = re.compile(r"^\d+[a-z]{0,3}$")
LOOKALIKE = str.maketrans("0158", "oisb")


def plain(text: str) -> str:
    """Lower case, no accents, trade marks or punctuation, single blanks."""
    text = unicodedata.normalize("NFKD", re.sub(r"[™®©℠]", " ", text).lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", text))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) from a to b; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b))
    far = most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            cb = b[j - 1]
            best = old[j - 1] if ca == cb else 1 + min(old[j - 1], old[j], new[j - 1])
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, older[j - 2] + 1)
            new[j] = best
        if min(new[low - 1 : high + 1]) > most:
            return far
        older, old = old, new
    return min(old[len(b)], far)


def _pairs(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _counted(text: str) -> list[str]:
    """Letter pairs, each with the number of its occurrence, so that repeated ones count."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        p = text[i : i + 2]
        seen[p] = seen.get(p, 0) + 1
        out.append(f"{p}{seen[p]}")
    return out


def edits_allowed(length: int) -> int:
    return min(2, length // 4)


class TokenIndex:
    """Words within the edits that their length allows (none below 4 letters, 1 below 8, else 2), without loss.

    Words of one edit are found by what is left of them after one deletion; words of two by the number of letter
    pairs that two edits must leave: each takes three at most, if neighbours are swapped.
    """

    def __init__(self, tokens: Iterable[str], memo: int = 200_000):
        self.tokens = sorted(set(tokens))
        self.exact = {t: i for i, t in enumerate(self.tokens)}
        self.size = np.array([len(t) for t in self.tokens], np.int32)
        self.longest = int(self.size.max(initial=0))
        self.shortened: dict[str, list[int]] = {}
        pairs: dict[str, list[int]] = {}
        for i, t in enumerate(self.tokens):
            if edits_allowed(len(t)) == 1:
                for d in self._deletions(t):
                    self.shortened.setdefault(d, []).append(i)
            elif edits_allowed(len(t)) == 2:
                for p in _counted(t):
                    pairs.setdefault(p, []).append(i)
        self.pairs = {p: np.array(x, np.int32) for p, x in pairs.items()}
        self.memo, self.known = memo, {}

    @staticmethod
    def _deletions(t: str) -> set[str]:
        return {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}

    def near(self, word: str) -> list[tuple[int, int]]:
        """(token, edits) of every token that the word may stand for."""
        got = self.known.get(word)
        if got is not None:
            return got
        out = {}
        if word in self.exact:
            out[self.exact[word]] = 0
        if 3 <= len(word) <= 8:
            for d in self._deletions(word):
                for i in self.shortened.get(d, ()):
                    if i not in out and edit_distance(word, self.tokens[i], 1) <= 1:
                        out[i] = 1
        if 6 <= len(word) <= self.longest + 2:
            hits = [self.pairs[p] for p in _counted(word) if p in self.pairs]
            if hits:
                at, n = np.unique(np.concatenate(hits), return_counts=True)
                size = self.size[at]
                for i in at[(np.abs(size - len(word)) <= 2) & (n >= np.maximum(size, len(word)) - 7)].tolist():
                    if i not in out and (far := edit_distance(word, self.tokens[i], 2)) <= 2:
                        out[i] = far
        got = sorted(out.items())
        if len(self.known) >= self.memo:
            self.known.clear()
        self.known[word] = got
        return got


class NameMatcher:
    """Matcher over (entry id, name) and (entry id, alias); of entries with equal names the smaller id stands for both."""

    def __init__(self, names: Iterable[tuple[int, str]], aliases: Iterable[tuple[int, str]] = (), *, memo: int = 200_000):
        self.ids: dict[str, int] = {}
        for i, name in names:
            key = plain(name)
            if key:
                self.ids[key] = min(i, self.ids.get(key, i))
        self.aliases: dict[str, int] = {}
        for i, name in aliases:
            key = plain(name)
            if key and key not in self.ids:
                self.aliases[key] = min(i, self.aliases.get(key, i))
        self.automaton = None
        if self.ids or self.aliases:
            self.automaton = ahocorasick.Automaton()
            for how, listed in (("alias", self.aliases), ("mention", self.ids)):
                for key, i in listed.items():
                    self.automaton.add_word(f" {key} ", (len(key), i, how))
            self.automaton.make_automaton()
        self.most_words = max((len(k.split()) for k in [*self.ids, *self.aliases]), default=1)
        # names are sets of words; one written without its blanks is a word too
        self.parts: list[tuple[tuple[int, ...], int, str]] = []
        keys = sorted(self.ids)
        self.index = TokenIndex([w for k in keys for w in (*k.split(), k.replace(" ", ""))])
        self.names_of: dict[int, list[int]] = {}
        for k in keys:
            joined = k.replace(" ", "")
            for words in {(joined,), tuple(k.split())}:
                tokens = tuple(self.index.exact[w] for w in words)
                for t in set(tokens):
                    self.names_of.setdefault(t, []).append(len(self.parts))
                self.parts.append((tokens, self.ids[k], joined))
        self.memo = memo
        self.known: dict[str, tuple[int, str, float]] = {}

    def _mention(self, words: list[str], around: bool) -> tuple[int, int, int, str] | None:
        """(minus length, place, entry, how) of the longest of the non-overlapping mentions, the leftmost if tied; ``around``:
        the parts of a name may stand at both ends of the words."""
        if self.automaton is None:
            return None
        n = len(words)
        text = f" {' '.join(words + words[: min(n, self.most_words) - 1] if around else words)} "
        best = None
        for end, (size, i, how) in self.automaton.iter(text):
            if best is None or (-size, end - size) < best[:2]:
                if around and text.count(" ", end - size, end) > n:
                    continue
                best = (-size, end - size, i, how)
        return best

    @staticmethod
    def _word_lists(raw: str) -> list[list[str]]:
        """Words that may belong to a name: all of them but makers, and those outside brackets."""
        text = MAKER.sub(" ", unicodedata.normalize("NFKC", re.sub(r"[™®©℠]", " ", raw)).lower())
        out = []
        for t in (text, re.sub(r"[(\[].*?[)\]]", " ", text)):
            words = [w for w in plain(t).split() if w not in NOISE and not DOSE.match(w)]
            if words and words not in out:
                out.append(words)
        return out

    def _found(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Per token the (place, edits) where a word, or joined neighbours in either order, may stand for it."""
        n, out = len(words), {}
        for i in range(n):
            tries, joined = [words[i]], words[i]
            for j in range(1, n):
                joined += words[(i + j) % n]
                if len(joined) > self.index.longest + 2:
                    break
                tries.append(joined)
            if n > 1:
                tries.append(words[(i + 1) % n] + words[i])
            for word in tries:
                for token, far in self.index.near(word):
                    out.setdefault(token, []).append((i, far))
        return out

    def _similar(self, lists: list[list[str]]) -> tuple[int, float] | None:
        best = None
        for words in lists:
            # digits that look like letters become them
            words = [w.translate(LOOKALIKE) for w in words]
            n, found = len(words), self._found(words)
            for part in {p for t in found for p in self.names_of.get(t, ())}:
                tokens, entry, joined = self.parts[part]
                if any(t not in found for t in tokens):
                    continue
                most = edits_allowed(len(joined))
                far = self._together([found[t] for t in tokens], n, most)
                if far <= most:
                    own, other = _pairs(joined), _pairs("".join(words))
                    rank = (far / len(joined), -2 * len(own & other) / max(1, len(own) + len(other)), entry)
                    if best is None or rank < best[0]:
                        best = (rank, 1 - far / len(joined))
        return best and (best[0][2], best[1])

    @staticmethod
    def _together(places: list[list[tuple[int, int]]], n: int, most: int) -> int:
        """Fewest edits with which all words of a name stand near each other: within one place more than they are; the ends of the value meet."""
        if len(places) == 1:
            return min(far for _, far in places[0])
        best = most + 1
        for first, far in places[0]:
            total, taken = far, {first}
            for spots in places[1:]:
                near = [(f, p) for p, f in spots if p not in taken and min((p - first) % n, (first - p) % n) <= len(places)]
                if not near:
                    total = most + 1
                    break
                f, p = min(near)
                total += f
                taken.add(p)
            best = min(best, total)
        return best

    def match(self, raw: str) -> tuple[int, str, float]:
        """(entry id, how, similarity): how is 'mention', 'alias', 'similar' or 'unmatched' (id 0)."""
        got = self.known.get(raw)
        if got is None:
            lists = self._word_lists(raw)
            hits = [self._mention(plain(raw).split(), False), *(self._mention(words, True) for words in lists)]
            # of mentions of one length, that in the value as it stands comes first
            hit = min(((h[0], k, h) for k, h in enumerate(hits) if h), default=None)
            if hit is not None:
                got = (hit[2][2], hit[2][3], 1.0)
            elif (near := self._similar(lists)) is not None:
                got = (near[0], "similar", near[1])
            else:
                got = (0, "unmatched", 0.0)
            if len(self.known) >= self.memo:
                self.known.clear()
            self.known[raw] = got
        return got


_MATCHERS: dict[str, NameMatcher] = {}


def map_names(df: DataFrame, reference: DataFrame, *, row_id: str, value: str, entry_id: str, name: str, aliases: DataFrame | None = None, most_names: int = 500_000, most_letters: int = 20_000_000) -> DataFrame:
    """Rows (<row_id>, <entry_id>, how, similarity) of every row whose value is neither null nor blank; 0 if unmatched.

    The reference list is sent to every worker; more than ``most_names`` names, or ``most_letters`` in them, raise an
    error. Null and blank names of the list are ignored. Repeated rows give repeated results; very long values are read whole; an
    empty list leaves all unmatched. There is no shuffle: hot values are looked up in a memo.
    """

    def listed(t: DataFrame | None) -> list[tuple[int, str]]:
        if t is None:
            return []
        rows = t.where(F.col(entry_id).isNotNull() & (F.trim(F.col(name)) != "")).select(entry_id, name).limit(most_names + 1).collect()
        if len(rows) > most_names:
            raise ValueError(f"more than {most_names} names in the reference list")
        return [(r[0], r[1]) for r in rows]

    lists = (listed(reference), listed(aliases))
    size = sum(len(n) for x in lists for _, n in x)
    if size > most_letters:
        raise ValueError(f"the names of the reference list hold {size} letters, more than {most_letters}")
    sent = df.sparkSession.sparkContext.broadcast(lists)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one matcher a process, which serves all its partitions
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = NameMatcher(*sent.value)
        matcher = _MATCHERS[key]
        for b in batches:
            got = [matcher.match(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64())],
                [row_id, entry_id, "how", "similarity"],
            )

    kind = df.schema[row_id].dataType.simpleString()
    seen = df.where(F.regexp_replace(F.col(value), r"(?U)\s+", "") != "").select(row_id, value)
    return seen.mapInArrow(run, f"`{row_id}` {kind}, `{entry_id}` long, how string, similarity double")
