"""Name mapping, encoding, mixing and personal information: exact or held-out checks and defined edge cases."""

import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import mixing, pii, pii_train
from cohortloom.llm.alias_map import NameMatcher, edit_distance, map_names, plain
from cohortloom.llm.byte_bpe import TOKENIZER_DIR, encode_corpus, encoder, rank_file

DATA = "/root/testdata"
FOREIGN_RECALL = 0.7


def texts(sf):
    return [t for t in pq.read_table(f"{DATA}/{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t]


# ------------------------------------------------------------------ names


def test_edit_distance():
    def slow(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in (1, 3):
            assert edit_distance(a, b, most) == min(slow(a, b), most + 1), (a, b, most)


NAMES = [(1, "Relaequimirtan"), (2, "sodium chloride"), (3, "insulin bratiferon"), (4, "bratiferon"), (5, "Zelbraimglusat"), (6, "zinc sulfate"), (7, "lyovaquicellopram beta"), (8, None), (9, " "), (11, "relaequimirtan")]


@pytest.mark.parametrize(
    "value, want",
    [
        ("Relaequimirtan sodium 20 mg tab", 1), ("RELAEQUIMIRTAN™ (Luha Labs)", 1), ("sodium chloride 0.9%", 2), ("zelbraimglusat sodium", 5), ("bratiferon", 4), ("Insulin  Bratiferon, citrate", 3), ("bratiferon (insulin)", 3),
        ("relaeqimirtan", 1), ("rélaequimirtan XR", 1), ("zelbrai mglusat", 5), ("beta (lyovaquicellopram)", 7), ("zelbraimgl", 0), ("compound 12", 0), ("sodium", 0), ("n/a", 0), ("12345", 0), ("?", 0), ("gusilamtacept", 0), ("relaequimirtan / zinc sulfate", 1),
    ],
)
def test_names(value, want):
    m = NameMatcher([n for n in NAMES if n[1]], [(5, "Tophepi")])
    assert m.match(value)[0] == want


def test_names_alias_and_empty_list():
    m = NameMatcher([(5, "Zelbraimglusat")], [(5, "Tophepi"), (6, "zelbraimglusat")])
    assert m.match("tophepi 20 mg") == (5, "alias", 1.0)
    assert NameMatcher([]).match("x") == (0, "unmatched", 0.0)
    assert plain("  ÀB-c™ ") == "ab c"


def test_map_names_edges(spark):
    df = spark.createDataFrame([(1, "Relaequimirtan", "a"), (1, "Relaequimirtan", "a"), (2, None, None), (3, "  ", None), (4, "relaequimirtan " + "tablet " * 30_000, None), (None, "zinc-sulfate", None)], "mech_id long, drug_name string, concept_name string")
    ref = spark.createDataFrame(NAMES, "concept_id long, concept_name string")
    args = dict(row_id="mech_id", value="drug_name", entry_id="concept_id", name="concept_name")
    got = map_names(df, ref, **args).collect()
    assert sorted((str(r["mech_id"]), r["concept_id"]) for r in got) == [("1", 1), ("1", 1), ("4", 1), ("None", 6)]
    assert map_names(df.limit(0), ref, **args).count() == 0
    assert {r["concept_id"] for r in map_names(df, ref.limit(0), **args).collect()} == {0}
    with pytest.raises(ValueError):
        map_names(df, ref, most_names=3, **args)


def test_names_with_known_damage():
    """Damaged names come back to their entry, names of no entry do not."""
    rng = random.Random(4)
    rows = pq.read_table(f"{DATA}/sf0.01/concept.parquet").to_pylist()
    names = [(r["concept_id"], r["concept_name"]) for r in rows if r["concept_class_id"] == "Ingredient" and r["vocabulary_id"] == "RxNorm" and r["standard_concept"] == "S" and r["concept_name"]]
    left, kept = names[::10], [n for i, n in enumerate(names) if i % 10]
    m = NameMatcher(kept)

    def damage(s):
        i = rng.randrange(1, len(s) - 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + "x" + s[i + 1 :]])
        return rng.choice([s, s.upper(), f"{s} 20 mg", f"Tab. {s} sodium", f"{s} (Mino brand)"])

    right = sum(m.match(damage(n))[0] == i for i, n in kept) / len(kept)
    wrong = sum(m.match(damage(n))[0] != 0 for _, n in left) / len(left)
    assert right > 0.97 and wrong < 0.1


def test_long_values_and_turned_names():
    m = NameMatcher([n for n in NAMES if n[1]], [(5, "Tophepi Forte")])
    words = " ".join(f"filler{i}" for i in range(30))
    assert m.match(f"{words} relaeqimirtan")[0] == 1 and m.match(f"{words} bratiferonx insulin {words}")[0] == 3
    assert m.match(f"{words} zelbrai mglusat")[0] == 5 and m.match("sulfat 10 ml zinc")[0] == 6
    # the longest mention wins, be it a name or an alias
    assert m.match("tophepi forte (bratiferon)") == (5, "alias", 1.0) and m.match("lyovaquicellopram beta tophepi forte")[0] == 7


def test_close_names_are_all_tried():
    """Among ten thousand names that look alike, what a full search finds is found."""
    rng = random.Random(6)
    names = sorted({"".join(rng.choice(["ra", "la", "mi", "to", "ne"]) for _ in range(rng.randint(2, 6))) for _ in range(14_000)})[:10_000]
    m = NameMatcher(list(enumerate(names, 1)))
    for _ in range(120):
        word = list(rng.choice(names))
        for _ in range(rng.randint(1, 3)):
            word.insert(rng.randrange(len(word)), rng.choice("aeimnort"))
        word = "".join(word)
        want = {t: d for t in names if (d := edit_distance(word, t, 2)) <= min(2, len(t) // 4)}
        assert {m.index.tokens[i]: d for i, d in m.index.near(word)} == want


# ------------------------------------------------------------------ encoding


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def test_encoding_of_documents(reference):
    xs = texts("sf0.01")
    enc = encoder(rank_file())
    assert [enc.encode(x) for x in xs] == reference(xs)


def test_encoding_of_odd_texts(reference):
    rng = random.Random(1)
    parts = ["a", "e", "t", "in", "ing", " the", " ", "\n", "\t", "ß", "é", "漢", "😊", "12", "...", "--", "'s", "'LL", "\x00", "‍", "İ", " ", "<|endoftext|>", "qz"]
    xs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    xs += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDE") for _ in range(rng.randint(1, 80))) for _ in range(6000)]
    xs += ["a" * 4000, " " * 3000, "-=" * 2500, "xyzzy" * 900, "﻿" * 50]
    enc = encoder(rank_file())
    assert [enc.encode(x) for x in xs] == reference(xs)


def test_encode_corpus_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5), (None, " ", 5), (6, "word " * 100_000, 5)], "doc_id long, text string, n_tokens int")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df, doc_id="doc_id", text="text").collect()]
    by = {k: v for k, v in got}
    assert len(got) == 6 and by[1] == [] and by[2] == [] and len(by[3]) == 2 and len(by[6]) > 100_000
    n = {r["doc_id"]: r["n_tokens"] for r in encode_corpus(df, doc_id="doc_id", text="text", count_only=True).collect()}
    assert all(n[k] == len(v) for k, v in got)
    assert encode_corpus(df.limit(0), doc_id="doc_id", text="text").count() == 0


# ------------------------------------------------------------------ mixing


def test_temperature():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    x, w = mixing.temperature_weights(sizes, target_entropy=0.9)
    assert 0 < x < 1 and abs(mixing.entropy(w) - 0.9) < 1e-6
    x, w = mixing.temperature_weights(sizes, max_repeats=4)
    assert max(w[s] * 1110 / n for s, n in sizes.items()) == pytest.approx(4)
    assert mixing.temperature_weights(sizes, max_repeats=1)[0] == pytest.approx(1.0)
    assert mixing.temperature_weights({})[1] == {} and mixing.temperature_weights({"a": 0.0, "b": 5.0})[1] == {"b": 1.0}
    assert mixing.temperature_weights(sizes)[0] == 0.0


def test_target_weights():
    sizes = {"a": 1000.0, "b": 100.0, "c": 10.0}
    x, got = mixing.target_weights(sizes, {"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 5000.0, "b": 400.0, "c": 20.0}, 1110.0)
    # b and c stop at their caps, a takes the rest; one exponent alone would have had to stop at the first cap
    assert got == pytest.approx({"a": 690.0, "b": 400.0, "c": 20.0}) and 0 < x < 1
    one = mixing.toward(sizes, {"a": 0.2, "b": 0.5, "c": 0.3}, x)
    assert one["c"] * 1110 == pytest.approx(20.0) and one["b"] * 1110 < 400
    x, got = mixing.target_weights(sizes, {"a": 0.6, "b": 0.4}, {"a": 9e9, "b": 9e9}, 500.0)
    assert x == 1 and got == pytest.approx({"a": 300.0, "b": 200.0})
    assert mixing.target_weights({}, {}, {}, 10.0)[1] == {}
    assert sum(mixing.target_weights(sizes, {"a": 0.2, "b": 0.5, "c": 0.3}, sizes, 1e9)[1].values()) == 1110.0


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaaaab"), rng.randint(0, 60), 1) for i in range(20_000)] + [(50_000 + i, "c", 40, 1) for i in range(20)] + [(60_000, None, 9, 1), (60_001, "unlisted", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, whole int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 5), ("c", 0.2, 3), ("none", 0.1, 3), (None, 0.1, 1)], TARGETS)
    for block in (4096, 64):
        sized = docs.select("doc_id", "source", "n_tokens")
        sizes = mixing.source_sizes(sized)
        here = {s: sizes[s] for s in "abc"}
        _, budgets = mixing.target_weights({s: float(t) for s, (t, _) in here.items()}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": here["a"][0], "b": 5 * here["b"][0], "c": 3 * here["c"][0]}, sum(t for t, _ in here.values()))
        got = mixing.realise(sized, budgets, here, block_docs=block).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("m")).collect()
        for r in got:
            assert budgets[r["source"]] - 200 <= r["t"] <= budgets[r["source"]] + 1e-6
    mixture, report = mixing.mix(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"]["mixed_tokens"] == 0 and rep["c"]["repeats"] == pytest.approx(3)
    assert rep["a"]["reached_share"] / rep["b"]["reached_share"] == pytest.approx(5 / 3, rel=0.01)
    assert sum(r["reached_share"] for r in rep.values()) == pytest.approx(1)
    limit = {"a": 1, "b": 5, "c": 3}
    assert all(r["copies"] <= limit[r["source"]] for r in mixture.collect())
    # the same documents come out however the input is partitioned
    again = mixing.mix(docs.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.collect()))


def test_tempered_mixture(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "a" if i % 50 else rng.choice("bc"), rng.randint(1, 60)) for i in range(20_000)] + [(90_000, None, 5)], "doc_id long, source string, n_tokens long")
    mixture, report = mixing.mix_tempered(docs, max_repeats=3)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c"} and max(r["repeats"] for r in rep.values()) == pytest.approx(3, abs=0.05)
    assert all(abs(r["reached_share"] - r["target_share"]) < 0.01 for r in rep.values())
    assert max(r["copies"] for r in mixture.collect()) <= 3
    assert mixing.mix_tempered(docs.limit(0))[0].count() == 0


def test_mixture_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1)], TARGETS)
    m, r = mixing.mix(none, targets)
    assert m.count() == 0 and r.first()["reached_share"] == 0.0
    one = spark.createDataFrame([(1, "a", 0), (2, "b", 5)], "doc_id long, source string, n_tokens long")
    assert mixing.mix(one, targets)[0].count() == 0
    assert mixing.mix(one, targets.limit(0))[0].count() == 0


# ------------------------------------------------------------------ personal information


def test_tagger_on_held_out_documents():
    xs = texts("sf0.01")
    labels = pii_train.Labeller(texts("sf0.1") + xs)
    got = pii_train.score(pii.find(xs), [labels.spans(x) for x in xs])
    for kind, (precision, recall, n) in got.items():
        assert n > 50 and precision > 0.97 and recall > 0.97, (kind, precision, recall)


def test_tagger_on_other_names():
    """Names and towns that no training document holds."""
    cases = {
        "Consent taken by Maribel Quenthorpe on 2017-12-19. The exposure was plausible.": ("person", "Maribel Quenthorpe"),
        "Seen today with Mrs Ploughwright, who reports poor sleep.": ("person", "Ploughwright"),
        "Please send results to m.quenthorpe@surgery.example as soon as possible.": ("email", "m.quenthorpe@surgery.example"),
        "Lives at 77 Willowmere Lane, Castlebrook 00713 with family.": ("address", "77 Willowmere Lane, Castlebrook 00713"),
        "MRN 14 221 224 checked at registration. No nausea since the last visit.": ("id_number", "14 221 224"),
        "Call back on (202) 555-0177 after 14:15.": ("phone", "(202) 555-0177"),
    }
    right = 0
    for (text, (kind, part)), spans in zip(cases.items(), pii.find(list(cases))):
        right += any(pii.KINDS[k] == kind and text[a:z] == part for a, z, k in spans)
    assert right >= len(cases) - 1
    quiet = ["Lot 763-28-6867 of melstruimoxane dispensed, concept 40100651.", "Brannock-Tull score not applicable.", "retry 5/9 user=batch@job3", "Takes lorikamirtan @ bedtime, 40 mg twice daily.", "Two prescribers at Ward 3 Road Unit tested the draft."]
    assert pii.find(quiet) == [[]] * len(quiet)


def test_gradients():
    rng = np.random.default_rng(0)
    m = pii_train.init(5, 3, rng)
    for k, v in vars(m).items():
        vars(m)[k] = v.astype(np.float64)
    t = 3 * pii.FRAME
    ids = rng.integers(1, pii.SIZE, (3, t)).astype(np.uint8)
    ids[1, t - 4 :] = 0
    length = np.array([t, t - 4, t])
    gold = rng.integers(0, pii.LABELS, (3, t))
    gold[1, t - 4 :] = 0
    _, grads = pii_train.step(m, ids, gold, length, alone=0.0)
    for k in grads:
        at = tuple(int(rng.integers(0, s)) for s in vars(m)[k].shape)
        if k == "embed":
            at = (int(ids[0, 3]), 2)
        eps, keep = 1e-2, vars(m)[k][at]
        vars(m)[k][at] = keep + eps
        up = pii_train.step(m, ids, gold, length)[0]
        vars(m)[k][at] = keep - eps
        down = pii_train.step(m, ids, gold, length)[0]
        vars(m)[k][at] = keep
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3, k


def test_training_learns(tmp_path):
    """In a process of its own, as training forks and this one holds a JVM's connections."""
    xs, out = texts("sf0.001"), str(tmp_path / "m.npz")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = [sys.executable, "-m", "cohortloom.llm.pii_train", f"{DATA}/sf0.001/documents.parquet", out, "25"]
    subprocess.run(run, cwd=root, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"}, check=True, timeout=180, stdout=subprocess.DEVNULL)
    m = pii.Tagger.load(out)
    labels = pii_train.Labeller(xs)
    em = m.text_scores(xs[:50])
    truth = np.concatenate([np.array([any(a <= i < z for a, z, _ in labels.spans(t)) for i in range(len(t))]) for t in xs[:50]])
    found = np.concatenate([e.argmax(1) > 0 for e in em])
    assert (found == truth).mean() > 0.93


def marked(passage):
    text, spans = "", []
    for piece in re.split(r"(\[\[\w+:.*?\]\])", passage):
        m = re.fullmatch(r"\[\[(\w+):(.*)\]\]", piece)
        if m:
            spans.append((len(text), len(text) + len(m[2]), pii.KINDS.index(m[1])))
        text += m[2] if m else piece
    return text, spans


def test_tagger_on_texts_of_another_make():
    """Hand-written passages of other kinds, with names, numbers and streets from no training text."""
    from tests.llm.foreign_texts import PASSAGES

    cases = [marked(p) for p in PASSAGES]
    got = pii_train.score(pii.find([t for t, _ in cases]), [s for _, s in cases])
    hits = sum(round(r * n) for _, r, n in got.values())
    assert hits / sum(n for *_, n in got.values()) >= FOREIGN_RECALL


def test_decoding_by_stretches_is_exact():
    t = pii.Tagger.load()
    scores = [x for x in t.text_scores(texts("sf0.001")) if len(x)]
    rng = np.random.default_rng(1)
    scores += [x + rng.normal(0, 3, x.shape).astype(np.float32) for x in scores]
    scores.sort(key=len)
    assert sum(t.sure_outside(x).sum() for x in scores) > 0.3 * sum(map(len, scores))
    for a, b in zip(t.viterbi(scores), t.paths(scores)):
        assert np.array_equal(a, b)


def test_emails_and_surnames_of_any_length():
    user = "a" * 90
    text = f"Please write to {user}@{'b' * 80}.example.org today."
    a = text.index(user)
    assert pii.snap(text, a + 100, a + 120, pii.KINDS.index("email")) == (a, text.index(" today"))
    text = "Seen by Dr. Wu today; Wu left."
    assert pii.snap(text, 12, 14, pii.KINDS.index("person")) == (12, 14) and pii.snap(text, 22, 24, pii.KINDS.index("person")) is None


def test_windows_agree():
    """Labels of a long text do not depend on where the windows begin, nor on how a text is cut into pieces."""
    t = pii.Tagger.load()
    long = "\n".join(texts("sf0.001")[:12])
    shifted = "x" * 50 + "\n" + long
    here, there = {s for s in t.spans([long])[0]}, {(a - 51, z - 51, k) for a, z, k in t.spans([shifted])[0]}
    assert len(here & there) > 0.97 * len(here) > 0
    assert pii._raw_spans(t, [long], core=700, margin=300) == pii._raw_spans(t, [long])


def test_find_and_redact_edges(spark):
    text = "Consent taken by Auberon Eisenlohn on 2017-12-19."
    rows = [(1, None), (2, ""), (3, "   "), (4, text), (4, text), (None, text), (5, "No itching since the last visit. " * 3000 + text), (6, "​😊 " + text)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pii_type string")
    got = sorted((str(r["doc_id"]), r["pii_type"], r["start_pos"], r["end_pos"]) for r in pii.find_personal(df, doc_id="doc_id", text="text").collect())
    a = text.index("Auberon") + 1
    z = a + len("Auberon Eisenlohn") - 1
    off = len("No itching since the last visit. ") * 3000
    assert got == sorted([("4", "person", a, z), ("4", "person", a, z), ("None", "person", a, z), ("5", "person", off + a, off + z), ("6", "person", a + 3, z + 3)])
    red = {str(r["doc_id"]): (r["text"], r["n_places"]) for r in pii.redact_personal(df, doc_id="doc_id", text="text").collect()}
    assert red["1"] == (None, 0) and red["2"] == ("", 0) and red["4"] == ("Consent taken by [PERSON] on 2017-12-19.", 1)
    assert pii.find_personal(df.limit(0), doc_id="doc_id", text="text").count() == 0
