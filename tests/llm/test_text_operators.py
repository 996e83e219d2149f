"""Quality rules, BPE, PII, classifier and mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlake.llm import bpe, mixing, pii, quality_classifier, quality_rules

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- BPE ---


@pytest.mark.parametrize("options", [{}, {"chunk_chars": 64, "overlap": 24}, {"chunk_chars": 10, "overlap": 3}])
def test_bpe_equals_the_library(edge, edge_rows, options):
    enc = bpe.encoder(VOCAB, public_tokenizers.PATTERN)
    want = Counter()
    for i, t, *_ in edge_rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in bpe.digest(edge, VOCAB, public_tokenizers.PATTERN, **options).collect())
    assert got == want


def test_bpe_keeps_columns_and_empty_tables(edge, empty):
    out = bpe.encode(edge, VOCAB, public_tokenizers.PATTERN)
    assert out.columns == [c for c in edge.columns if c != "text"] + ["ids_le"]
    assert bpe.digest(empty, VOCAB, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_decoding_gives_the_bytes_back(text):
    ids = bpe.encoder(VOCAB, public_tokenizers.PATTERN).encode_ordinary(text)
    assert bpe.unpack(bpe.pack(ids)) == ids
    assert bpe.decode_bytes(bpe.pack(ids), VOCAB) == text.encode()


# --- quality rules ---


def plain_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if tri[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_equal_plain_counts(edge, edge_rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.report(edge).collect())
    want = Counter()
    for i, t, *_ in edge_rows:
        n = plain_rules(t)
        want[(i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert got == want


def test_rules_sort_windows_only_where_some_repeat_and_look_up_no_single_characters(spark):
    measures = str(quality_rules.base_measures())
    assert "translate" not in measures and "array_distinct" in str(quality_rules.base_measures()["_q_words"])
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcé") for _ in range(n)) for n in range(12)] + ["\x0b\x0c\r\n\t x\x0by z\n \x0c\n\x0b#<é>&&|$%*\r", "a b c a b c", "a b c d a b c\u00a0", "p q r s t u v"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.report(docs).collect()}
    assert got == {i: plain_rules(t) for i, t in enumerate(texts)}


def test_lines_are_folded_in_ascii_only(spark):
    lines = ["ABC Z 19", "abc\t z 05 ", "ÀBC É 1", "Àbc  É 7", "àbc É 1", "İSTANBUL", "istanbul", "ẞ K", "ẞ k", "\u212a k", "k K"]
    fold = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in x))).strip(" ")
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", quality_rules.normalised(F.col("line")).alias("n")).collect()
    assert {r.line: r.n for r in got} == {x: fold(x) for x in lines}


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    line = "accept all cookies to read on"
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line} \n{body} {'abcdef'[i]}", "h") for i in range(6)] + [(9, "\n".join([line.upper()] * 12), "h"), (10, f"{line}\n{body} other", "g"), (10, f"{line}\n{body} other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.judge(docs, min_docs=3).collect()}
    assert out[0].kept and out[0].n_removed_lines == 1 and not out[9].kept and out[9].n_removed_lines == 12
    left = sorted((r.doc_id, r.text) for r in quality_rules.clean(docs, min_docs=3).collect())
    assert left == [(i, f"{body} {'abcdef'[i]}") for i in range(6)] + [(10, f"{line}\n{body} other")] * 2  # another host


def test_cleaning_keeps_what_the_rules_keep(edge):
    kept = sorted(str(r.doc_id) for r in quality_rules.judge(edge).where("kept").collect())
    out = quality_rules.clean(edge)
    assert out.columns == edge.columns and sorted(str(r.doc_id) for r in out.collect()) == kept


def test_copies_count_once(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"x\n{body}", "h") for i in range(9)], "doc_id long, text string, source string")
    assert all(r.kept and r.n_removed_lines == 0 for r in quality_rules.judge(docs, min_docs=3).collect())


def test_rules_on_an_empty_table(empty):
    assert quality_rules.report(empty).collect() == []


# --- PII ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii._luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]
            if ok():
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(BASE).index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1234567890 @@..--+()é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def model():
    return pii.fit(pii.training_windows(1500), 150)


def test_model_finds_held_out_spans(model):
    hit = want = extra = 0
    for text, spans in pii.training_windows(150, 120, seed=77):
        inner = {s for s in spans if s[1] > 0 and s[2] < 120}
        found = {s for s in pii.find_all([text], model)[0][1] if s[1] > 0 and s[2] < 120}
        hit, want, extra = hit + len(inner & found), want + len(inner), extra + len(found - inner)
    assert hit / want > 0.75 and extra / want < 0.3


def test_crf_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    e, move, first = rng.normal(size=(5, 2, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS)
    tags = rng.integers(0, pii.TAGS, (5, 2))
    _, d_e, d_move, _ = pii.crf_gradient(e, tags, move, first)
    for at, d in ((e, d_e), (move, d_move)):
        for _ in range(5):
            i = tuple(rng.integers(0, n) for n in at.shape)
            old = at[i]
            at[i] = old + 1e-5
            up = pii.crf_gradient(e, tags, move, first)[0]
            at[i] = old - 1e-5
            down = pii.crf_gradient(e, tags, move, first)[0]
            at[i] = old
            assert math.isclose((up - down) / 2e-5, d[i], abs_tol=1e-6)


def test_pii_rows(edge, edge_rows, empty, model):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(edge, model).collect())
    want = Counter()
    for i, t, *_ in edge_rows:
        b = plain_base(t or "")
        n = Counter(k for k, *_ in b)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest())] += 1
    assert got == want
    assert pii.find(empty, model).collect() == []


def test_base_spans_stay_and_windows_cover_long_texts(model):
    text = ("word " * 50 + "a@b.example.com 10.1.2.3 ") * 30 + "1" * 3000
    base, every = pii.find_all([text], model)[0]
    assert set(base) <= set(every) and len([b for b in base if b[0] == "email"]) == 30
    covered = set()
    for s, e, *_ in pii.windows_of(text):
        covered |= set(range(s, e))
    assert all(i in covered for i, c in enumerate(text) if c in "0123456789@")


@pytest.mark.parametrize("length", [100, 200, 1000])
def test_secrets_longer_than_a_window_come_whole(model, length):
    rng, whole = np.random.default_rng(length), 0
    for i in range(20):
        key = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, length))
        before = "words that go on " * (i % 5) + "x" * i + " "
        whole += ("secret", len(before), len(before) + length) in pii.find_all([f"{before}{key} and more of them " * (1 + i % 2)], model)[0][1]
    assert whole >= 12  # the model itself misses some


def test_cut_spans_are_joined_over_windows():
    text, at = 600, range(70, 430)
    pieces = []
    for w in range(0, text - pii.WINDOW + 1, pii.STRIDE):
        s, e = max(w, at.start), min(w + pii.WINDOW, at.stop)
        if s < e:
            pieces.append((w, "secret", s, e, s == w and s > 0, e == w + pii.WINDOW, np.ones(e - s, np.float32)))
    assert set(pii.stitched(pieces)) == {("secret", 70, 430, 360.0)}
    assert pii.stitched([p for p in pieces if p[0] != 192]) == []  # one window sees nothing: cut on both sides
    assert pii.stitched([(0, "ip", 90, 99, False, False, np.ones(9)), (64, "ip", 90, 99, False, False, np.ones(9))]) == [("ip", 90, 99, 9.0)] * 2


def test_best_together_is_optimal():
    found = [("ip", 0, 5, 3.0), ("card", 4, 9, 5.0), ("ip", 8, 12, 3.0), ("phone", 12, 14, 1.0)]
    assert [f[1] for f in pii.best_together(found)] == [0, 8, 12]


# --- classifier ---


def test_classifier_learns_marks_and_repeats(spark):
    rng = np.random.default_rng(1)
    w = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        words = [w() for _ in range(60)]
        text = " ".join(words) if good else (" ".join(x + "$$$" for x in words) if i % 2 else " ".join(x for x in words[:5] for _ in range(12)))
        rows.append((i, text))
        labels.append((i, int(good)))
    docs, lab = spark.createDataFrame([*rows, (900, None), (901, ""), (901, ""), (None, "a b")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, quality int")
    out = quality_classifier.report(docs, lab).collect()
    assert len(out) == 244
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    taken = quality_classifier.training_rows(docs, lab, "quality", 40, lambda i: ~quality_classifier.held_out(i))
    assert Counter(y for *_, y in taken) == {0: 40, 1: 40}
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1


def test_classifier_without_labels(edge, empty):
    out = quality_classifier.report(edge, empty.selectExpr("doc_id", "label AS quality")).collect()
    assert len(out) == edge.count() and {r.score for r in out} == {0.5}
    assert quality_classifier.score(empty, quality_classifier.Model(np.zeros(quality_classifier.BUCKETS, np.float32), 0.0)).collect() == []


# --- mixing ---


def test_raking_meets_the_margins(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(1, 9000)), ["en", "fr", None][rng.integers(3)], f"s{rng.integers(4)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    share = spark.createDataFrame([(f"s{i}", 0.25) for i in range(4)], "_m_source string, share double")
    out = mixing.calibrated(docs, {"_m_source": share}).collect()
    kept = Counter()
    for r in out:
        kept[r.source] += r["_m_tokens"] * r["_m_p"]
    total = sum(kept.values())
    assert all(abs(v / total - 0.25) < 0.01 for v in kept.values())
    assert max(r["_m_p"] for r in out) == pytest.approx(1)


def test_texts_without_weight_are_kept(spark):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "word " * (i % 200), "en", f"s{i % 7 % 3}") for i in range(900)]
    out = mixing.calibrated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert min(r["_m_p"] for r in out) < 1
    assert all(r["_m_kept"] and r["_m_p"] == 1 for r in out if not r.text)


def test_sampling_is_the_same_again_and_keeps_columns(edge, empty):
    a, b = mixing.sample(edge), mixing.sample(edge.repartition(1))
    assert a.columns == edge.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert mixing.sample(empty).collect() == [] and mixing.report(empty).collect() == []
    assert mixing.report(edge).count() == edge.count()
