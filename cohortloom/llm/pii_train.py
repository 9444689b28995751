"""Labelled spans and numpy training of the tagger for personal information.

``python -m cohortloom.llm.pii_train DOCUMENTS.parquet OUT.npz [SECONDS [START.npz]]``, the second time with a rate of 0.003

Nearly half of the training texts are made up (``pii_synth``), with spans known by construction. The others are documents with
distant labels: names are learned from the phrases that introduce persons and then marked wherever they
stand as a full name or after a title; numbers are marked by the words before them or by their national form,
addresses by the towns of introduced addresses. In each round most labelled spans of documents are replaced by made-up
ones of their kind, so that the network learns contexts and shapes rather than the documents' lists. The sample
is bounded (``MOST_DOCUMENTS``). Gradients of the parts of a batch are worked out by several processes.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter

import numpy as np

from cohortloom.llm.pii import EMAIL, FRAME, KINDS, LABELS, SIZE, Tagger, encode_chars
from cohortloom.llm.pii_synth import Maker

MOST_DOCUMENTS = 20_000

_W = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]*[A-Za-zÀ-ÖØ-öø-ÿ]"
_TOKEN = rf"(?:{_W}|[A-Za-zÀ-ÖØ-öø-ÿ]\.)"
_NAME = rf"(?P<n>{_TOKEN}(?:,?\s+{_TOKEN}){{0,4}})"
TITLES = r"(?:Dr|Prof|Mrs|Mr|Ms|Miss|Mme|Mlle|M|Herr|Frau|Sra|Sr|Srta)\b\.?"
# Phrases that introduce a person.
PHRASES = [
    rf"(?:Pt|Patient|Pat\.?|Paciente|Nom|Nombre)\s?:\s*{_NAME}\s*(?=\n|$|  |Contact|Kontakt)",
    rf"(?:[Pp]atient|Patientin|La paciente|Le patient|La patiente|El paciente)\s+{_NAME}\s+(?:was started|signale|toma|nimmt|prend|refiere)",
    rf"Reviewed by {TITLES}\s+{_NAME}; copy to", rf"\bcc {_NAME}\s*<", rf"Consent taken by {_NAME} on \d", rf"Discharge letter for {_NAME},",
    rf"Next of kin: {_NAME}, phone", rf"suivie? par le Dr\.?\s+{_NAME}, joignable",
]
ALONE = [rf"Seen today with {TITLES}\s+{_NAME},? who reports", rf"(?:Mme|Herr|Frau|Sra?\.)\s+{_NAME}\s+(?:prend|klagt|toma|refiere|signale|nimmt)"]
# Words before numbers of a person, and national forms of phone numbers.
ID_WORDS = (
    r"(?:social security|soc\. ?sec\. no\.|SSN|NIR|n° de sécurité sociale|sécu|DNI|documento de identidad|KVNR|Vers\.-Nr\.|Versichertennummer|MRN|NHS(?: no\.| number)?|"
    r"insurance member|subscriber|policy holder no\.|patient ID|chart number|medical record no\.|travel document|passport(?: no\.)?)"
)
ID_VALUE = r"(?:[A-Z]{2}-\d{4}-\d{5}|[A-Z]{1,2}\d{6,10}|\d[\d .\-]{4,}\d(?:-?[A-Z](?!\w))?)"
PHONES = (
    r"(?<![\w+])(?:\(?(?:\+|00)49\)?[ -]?30[ /-]?23125[ -]?\d{3}|030[ /-]23125[ -]?\d{3}|(?:\+33 ?(?:\(0\))?[ .]?1|01)(?:[ .]?\d\d){4}|(?:\+44[ ]?7700|\(?07700\)?)[ ]?900[ -]?\d{3}|"
    r"(?:\+?1[ .-])?\(?202\)?[ .-]?555[ .-]?01\d\d|555-01\d\d)(?!\d)(?: ?ext\.? ?\d+)?"
)
STREET = (
    r"(?:(?:(?:Flat|Unit|Apt) ?\d+[,/] ?)?\d+ ?[A-Da-d]?(?: bis| ter)?,? (?:[^\W\d][\w'’.\-]*,? ){1,6}?|(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino) ?(?:[^\W\d][\w'’.\-]*,? ){1,5}?(?:n\.º )?\d+,? (?:\d+\.º \w,? )?|"
    r"(?:(?:Am|An|Im|In|Zum|Zur|Auf|Unter|Alte[nr]?|Neue[nr]?|Große[nr]?|Kleine[nr]?|de[rmn]) ){0,3}(?!Wohnhaft)[^\W\d][\w'’\-]*(?:straße|str\.|weg|ring|kamp|gasse|platz|allee|ufer|steig|damm|hof) ?\d+ ?[a-d]?(?:,| in)? |"
    r"(?:(?:Am|An|Im|In|Zum|Zur|Auf|Unter|Alte[nr]?|Neue[nr]?|de[rmn]) ){0,3}(?!Wohnhaft)[^\W\d][\w'’\-]+ \d+ ?[a-d]? in (?=\d{5} ))(?:Apt \d+, )?(?:\d{5} )?"
)


def learn(texts: list[str], least: int = 4) -> tuple[set[str], set[str], set[str]]:
    """Given names, surnames and towns that the documents introduce at least ``least`` times."""
    seen, alone, towns = Counter(), Counter(), Counter()
    for t in texts:
        for p in PHRASES:
            for m in re.finditer(p, t):
                seen.update(w.lower() for w in re.split(r"[,\s]+", m["n"]) if len(w) > 2)
        for p in ALONE:
            for m in re.finditer(p, t):
                alone[m["n"].split()[-1].lower()] += 1
        for m in re.finditer(r"(?:Address|Adresse|Anschrift|Dirección|the address)\s?:?\s[^\n]{4,50}?(?:,| \d{5}) ([A-ZÀ-Ý][\w'\-]+)(?= \d{5}| ZZ\d|\n|\.|$)", t):
            towns[m[1]] += 1
    sur = {w for w, n in alone.items() if n >= 1 and len(w) > 3}
    given = {w for w, n in seen.items() if n >= least and w not in sur and w not in ("van", "der", "von")}
    return given, sur, {w for w, n in towns.items() if n >= least}


class Labeller:
    def __init__(self, texts: list[str]):
        given, sur, towns = learn(texts)
        alt = lambda ws: "|".join(sorted(map(re.escape, ws), key=len, reverse=True)) or r"(?!)"
        s, g = rf"(?:van der\s+|von\s+)?(?:{alt(sur)})", rf"(?:(?:{alt(given)})|[a-zà-ý]\.)"
        self.person = re.compile(rf"(?<![\w@.+-])(?:{s},\s?{g}(?:\s{g})?|{g}(?:\s{g})?\s{s}|{s}\s(?:{alt(given)})(?:\s[a-z]\.)?)(?![\w@+])", re.I)
        self.titled = re.compile(rf"(?<!\w){TITLES}\s+(?P<v>{s})(?![\w@+])", re.I)
        self.ident = re.compile(rf"(?<!\w){ID_WORDS}[\s:#]*(?P<v>{ID_VALUE})")
        self.phone = re.compile(PHONES)
        self.address = re.compile(rf"(?<!\w)(?P<v>{STREET}(?:{alt(towns)})(?: \d{{5}}(?!\d)| ZZ\d \d[A-Z]{{2}})?)(?!\w)", re.I)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        taken = np.zeros(len(text) + 1, bool)

        def add(kind: str, a: int, z: int) -> None:
            if not taken[a:z].any():
                taken[a:z] = True
                out.append((a, z, KINDS.index(kind)))

        for m in EMAIL.finditer(text):
            add("email", *m.span())
        for m in self.ident.finditer(text):
            add("id_number", *m.span("v"))
        for m in self.phone.finditer(text):
            add("phone", *m.span())
        for m in self.address.finditer(text):
            add("address", *m.span("v"))
        for m in self.person.finditer(text):
            add("person", *m.span())
        for m in self.titled.finditer(text):
            add("person", *m.span("v"))
        return sorted(out)


def renew(text: str, spans: list[tuple[int, int, int]], maker: Maker, share: float = 0.6) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a share of its spans replaced by made-up ones of their kind."""
    parts, out, at, size = [], [], 0, 0
    for a, z, k in spans:
        got = text[a:z]
        if maker.chance(share):
            name = KINDS[k]
            alone = name == "person" and " " not in got
            got = maker.titled() if alone else {"person": maker.person, "email": maker.email, "phone": maker.phone, "id_number": maker.ident, "address": maker.address}[name]()
        parts += [text[at:a], got]
        size += a - at
        out.append((size, size + len(got), k))
        size += len(got)
        at = z
    return "".join([*parts, text[at:]]), out


def windows(texts: list[str], spans: list[list[tuple[int, int, int]]], size: int, rng: np.random.Generator) -> list[tuple[str, np.ndarray]]:
    """Training windows: all that hold a label, and as many without."""
    good, bad = [], []
    for t, sp in zip(texts, spans):
        lab = np.zeros(len(t), np.int8)
        for a, z, k in sp:
            lab[a], lab[a + 1 : z] = 2 * k + 1, 2 * k + 2
        off = int(rng.integers(0, size))
        for a in range(-off, len(t), size):
            z = a + size
            a = max(a, 0)
            w = lab[a:z]
            if len(w) < 8 or (w[0] and w[0] % 2 == 0):
                continue
            (good if w.any() else bad).append((t[a:z], w))
    keep = rng.permutation(len(bad))[: len(good)]
    return good + [bad[i] for i in keep]


def round_of(texts: list[str], spans: list[list[tuple[int, int, int]]], size: int, rng: np.random.Generator) -> list[tuple[str, np.ndarray]]:
    """One round's windows: documents with renewed spans, and made-up passages of about the same number of windows."""
    maker = Maker(rng)
    fresh = [renew(t, sp, maker) if maker.chance(0.75) else (t, sp) for t, sp in zip(texts, spans)]
    out = windows([f[0] for f in fresh], [f[1] for f in fresh], size, rng)
    made, goal = [], max(64, int(0.8 * len(out)))
    while len(made) < goal:
        t, sp = maker.passage()
        made += windows([t], [[(a, z, KINDS.index(k)) for a, z, k in sp]], size, rng)
    out += made
    shuffled = []
    for t, lab in out:
        r = rng.random()
        if r < 0.03 and len(t.upper()) == len(t):
            t = t.upper()
        elif r < 0.06 and len(t.lower()) == len(t):
            t = t.lower()
        shuffled.append((t, lab))
    return [shuffled[i] for i in rng.permutation(len(shuffled))]


def init(hidden: int, width: int, rng: np.random.Generator) -> Tagger:
    f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    gate = np.zeros((2, 4 * hidden), np.float32)
    gate[:, hidden : 2 * hidden] = 1.0  # forget gates start open
    m = Tagger(
        f(SIZE, width, scale=0.5), f(2, FRAME * width, 4 * hidden, scale=0.8 / np.sqrt(FRAME * width)), f(2, hidden, 4 * hidden, scale=0.6 / np.sqrt(hidden)), gate,
        f(2 * hidden, FRAME * LABELS, scale=1 / np.sqrt(2 * hidden)), np.zeros(FRAME * LABELS, np.float32), np.zeros((LABELS, LABELS), np.float32), np.zeros(LABELS, np.float32),
    )
    m.embed[0] = 0
    return m


def crf_gradient(em: np.ndarray, gold: np.ndarray, length: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the gold paths, and its gradients by emissions, transitions and first scores."""
    b, t, k = em.shape
    rows = np.arange(b)
    alpha = np.empty((t, b, k), np.float32)
    shift = np.zeros((t, b, 1), np.float32)
    live = np.arange(t)[:, None] < length[None, :]
    e_trans = np.exp(trans)
    # forward and backward sums, scaled per step
    top = em.max(2, keepdims=True)
    e_em = np.exp(em - top)
    a = e_em[:, 0] * np.exp(first)
    for s in range(t):
        if s:
            nxt = (a @ e_trans) * e_em[:, s]
            a = np.where(live[s][:, None], nxt, a)
        z = a.sum(1, keepdims=True)
        shift[s] = np.where(live[s][:, None], np.log(z), 0)
        a = np.where(live[s][:, None], a / z, a)
        alpha[s] = a
    log_z = (shift[:, :, 0] + np.where(live, top[:, :, 0].T, 0)).sum(0)
    beta = np.ones((b, k), np.float32)
    d_em = np.zeros_like(em)
    d_trans = np.zeros_like(trans)
    for s in range(t - 1, -1, -1):
        p = alpha[s] * beta
        p /= p.sum(1, keepdims=True)
        d_em[:, s] = np.where(live[s][:, None], p, 0)
        if s:
            on = live[s][:, None]
            right = np.where(on, e_em[:, s] * beta, 0)
            joint = (alpha[s - 1][:, :, None] * right[:, None, :]) * e_trans
            tot = joint.sum((1, 2), keepdims=True)
            d_trans += (joint / np.maximum(tot, 1e-30)).sum(0)
            back = right @ e_trans.T
            back /= np.maximum(back.sum(1, keepdims=True), 1e-30)
            beta = np.where(on, back, beta)
    d_first = d_em[:, 0].sum(0)
    score = first[gold[:, 0]] + em[rows, 0, gold[:, 0]]
    for s in range(t):
        on = live[s]
        d_em[rows[on], s, gold[on, s]] -= 1
        if s:
            score = score + np.where(on, trans[gold[:, s - 1], gold[:, s]] + em[rows, s, gold[:, s]], 0)
            np.subtract.at(d_trans, (gold[on, s - 1], gold[on, s]), 1)
    np.subtract.at(d_first, gold[:, 0], 1)
    return float((log_z - score).mean()), d_em / b, d_trans / b, d_first / b


def own_gradient(em: np.ndarray, gold: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Gradient of the cross entropy of each character on its own; it keeps labels apart where no lawful path leads to them."""
    p = np.exp(em - em.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    np.put_along_axis(p, gold[:, :, None], np.take_along_axis(p, gold[:, :, None], 2) - 1, 2)
    return p * (np.arange(em.shape[1])[None, :, None] < length[:, None, None]) / len(em)


def step(m: Tagger, ids: np.ndarray, gold: np.ndarray, length: np.ndarray, alone: float = 0.25) -> tuple[float, dict[str, np.ndarray]]:
    """Loss of the CRF and gradients of one batch, by backpropagation through time; ``alone`` weighs what each character adds on its own."""
    b, t = ids.shape
    n, h, width = t // FRAME, m.recur.shape[1], m.embed.shape[1]
    codes = ids.reshape(b, n, FRAME).transpose(1, 0, 2)
    x = m.embed[codes].reshape(n, b, FRAME * width)
    frames = -(-length // FRAME)
    live = (np.arange(n)[:, None] < frames[None, :]).astype(np.float32)
    both, live = np.stack([x, x[::-1]], 1), np.stack([live, live[::-1]], 1)
    gates = np.matmul(both, m.into[None]) + m.gate[None, :, None]
    acts, cells, hids = np.empty((n, 2, b, 4 * h), np.float32), np.zeros((n + 1, 2, b, h), np.float32), np.zeros((n + 1, 2, b, h), np.float32)
    for s in range(n):
        a = np.matmul(hids[s], m.recur) + gates[s]
        a[..., : 3 * h] = 0.5 * np.tanh(0.5 * a[..., : 3 * h]) + 0.5
        a[..., 3 * h :] = np.tanh(a[..., 3 * h :])
        acts[s] = a
        on = live[s][..., None]
        cells[s + 1] = (a[..., h : 2 * h] * cells[s] + a[..., :h] * a[..., 3 * h :]) * on
        hids[s + 1] = a[..., 2 * h : 3 * h] * np.tanh(cells[s + 1]) * on
    y = np.concatenate([hids[1:, 0], hids[1:, 1][::-1]], -1).reshape(n * b, 2 * h)
    em = (y @ m.out + m.bias).reshape(n, b, FRAME, LABELS).transpose(1, 0, 2, 3).reshape(b, t, LABELS)
    loss, d_em, d_trans, d_first = crf_gradient(em, gold, length, m.trans, m.first)
    d_em += alone * own_gradient(em, gold, length)
    flat = np.ascontiguousarray(d_em.reshape(b, n, FRAME * LABELS).transpose(1, 0, 2)).reshape(n * b, FRAME * LABELS)
    d_y = (flat @ m.out.T).reshape(n, b, 2 * h)
    d_h = np.stack([d_y[..., :h], d_y[::-1, :, h:]], 1)
    dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    d_a = np.empty((n, 2, b, 4 * h), np.float32)
    for s in range(n - 1, -1, -1):
        a, on = acts[s], live[s][..., None]
        i, f, o, g = (a[..., k * h : (k + 1) * h] for k in range(4))
        tc = np.tanh(cells[s + 1])
        dh = (dh + d_h[s]) * on
        dc = (dc + dh * o * (1 - tc * tc)) * on
        da = d_a[s]
        da[..., :h] = dc * g * i * (1 - i)
        da[..., h : 2 * h] = dc * cells[s] * f * (1 - f)
        da[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        da[..., 3 * h :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = np.matmul(da, m.recur.transpose(0, 2, 1))
    g_into, g_recur, d_x = np.empty_like(m.into), np.empty_like(m.recur), np.zeros((n * b, FRAME * width), np.float32)
    for d in range(2):
        da = d_a[:, d].reshape(-1, 4 * h)
        g_recur[d] = hids[:-1, d].reshape(-1, h).T @ da
        g_into[d] = both[:, d].reshape(-1, FRAME * width).T @ da
        back = (da @ m.into[d].T).reshape(n, b, -1)
        d_x += (back if d == 0 else back[::-1]).reshape(n * b, -1)
    hot = np.zeros((n * b * FRAME, SIZE), np.float32)
    hot[np.arange(len(hot)), codes.ravel()] = 1
    g_embed = hot.T @ d_x.reshape(-1, width)
    g_embed[0] = 0
    grads = {"embed": g_embed, "into": g_into, "recur": g_recur, "gate": d_a.sum((0, 2)), "out": y.T @ flat, "bias": flat.sum(0), "trans": d_trans, "first": d_first}
    return loss, grads


class Team:
    """Processes that work out gradients side by side; weights and gradients lie in shared memory."""

    def __init__(self, m: Tagger, workers: int, texts, spans, size: int, batch: int, seed: int):
        import multiprocessing as mp

        ctx = mp.get_context("fork")
        self.shapes = {k: v.shape for k, v in vars(m).items()}
        total = sum(int(np.prod(s)) for s in self.shapes.values())
        self.weights = np.frombuffer(ctx.RawArray("f", total), np.float32)
        self.grads = np.frombuffer(ctx.RawArray("f", total * workers), np.float32).reshape(workers, total)
        self.losses = np.frombuffer(ctx.RawArray("f", workers), np.float32)
        # a process that fails must not leave the others waiting
        self.ready, self.done = ctx.Barrier(workers + 1, timeout=120), ctx.Barrier(workers + 1, timeout=120)
        self.jobs = [ctx.Process(target=self.work, args=(w, texts[w::workers], spans[w::workers], size, batch, seed), daemon=True) for w in range(workers)]
        for j in self.jobs:
            j.start()

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def work(self, w: int, texts, spans, size: int, batch: int, seed: int) -> None:
        rng = np.random.default_rng([seed, w])
        m, grads = Tagger(**self.split(self.weights)), self.split(self.grads[w])
        queue: list[tuple[str, np.ndarray]] = []
        while True:
            while len(queue) < batch:
                queue += round_of(texts, spans, size, rng)
            pick, queue = queue[:batch], queue[batch:]
            ids, gold = np.zeros((batch, size), np.uint8), np.zeros((batch, size), np.int64)
            length = np.array([len(lab) for _, lab in pick])
            for r, (t, lab) in enumerate(pick):
                ids[r, : length[r]] = encode_chars(t)
                gold[r, : length[r]] = lab
            self.ready.wait()
            self.losses[w], got = step(m, ids, gold, length)
            for k, g in got.items():
                grads[k][...] = g
            self.done.wait()

    def close(self) -> None:
        for j in self.jobs:
            j.kill()


def train(texts: list[str], *, hidden: int = 48, width: int = 12, size: int = 190, batch: int = 32, workers: int = 8, seconds: float = 600, rate: float = 5e-3, seed: int = 3, start: Tagger | None = None, say=print) -> Tagger:
    """Tagger trained on at most MOST_DOCUMENTS distinct texts for about ``seconds``, anew or on from ``start``; Adam with a falling rate."""
    rng = np.random.default_rng(seed)
    texts = list(dict.fromkeys(texts))[:MOST_DOCUMENTS]
    labeller = Labeller(texts)
    spans = [labeller.spans(t) for t in texts]
    start = start or init(hidden, width, rng)
    team = Team(start, workers, texts, spans, size, batch, seed)
    flat = team.weights
    flat[:] = np.concatenate([v.ravel() for v in vars(start).values()])
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    began, n, shown, done = time.time(), 0, 0.0, 0.0
    while done < 1.0:
        team.ready.wait()
        team.done.wait()
        n += 1
        g = team.grads.mean(0)
        done = min(1.0, (time.time() - began) / seconds)
        g *= min(1.0, 5.0 / max(float(np.linalg.norm(g)), 1e-9))
        m1 += 0.1 * (g - m1)
        m2 += 0.005 * (g * g - m2)
        lr = rate * min(1.0, n / 200) * (0.01 + 0.99 * (1 - done) ** 1.2)
        flat -= lr * (m1 / (1 - 0.9**n)) / (np.sqrt(m2 / (1 - 0.995**n)) + 1e-7)
        shown += float(team.losses.mean())
        if n % 200 == 0:
            say(f"{time.time() - began:.0f} s, step {n}, loss {shown / 200:.3f}", flush=True)
            shown = 0.0
    team.close()
    return Tagger(**{k: v.copy() for k, v in team.split(flat).items()})


def score(found: list[list[tuple[int, int, int]]], truth: list[list[tuple[int, int, int]]]) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, cases) per kind, by kind and start."""
    out = {}
    for k, name in enumerate(KINDS):
        a = {(i, s) for i, sp in enumerate(found) for s, _, kk in sp if kk == k}
        b = {(i, s) for i, sp in enumerate(truth) for s, _, kk in sp if kk == k}
        out[name] = (len(a & b) / max(1, len(a)), len(a & b) / max(1, len(b)), len(b))
    return out


if __name__ == "__main__":
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(sys.argv[1], columns=["text"])["text"].to_pylist() if t]
    more = {"start": Tagger.load(sys.argv[4]), "rate": 3e-3, "seed": 5} if len(sys.argv) > 4 else {}
    train(texts, seconds=float(sys.argv[3]) if len(sys.argv) > 3 else 600, **more).save(sys.argv[2])
