"""Suffix-array dedup, line dedup, n-gram join and nearest neighbours against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlake.llm import ann, line_dedup, ngram_join, suffix_dedup
from loomlake.llm.suffix_array import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_sorts_suffixes(symbols):
    assert suffix_array(np.array(symbols, int)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def plain_bytes(rows):
    """Per row: bytes covered by 50-byte strings of documents with smaller ids."""
    first: dict = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[i, len(b), sum(gone), sum(bool(g and (k == 0 or not gone[k - 1])) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("most", [400, 1])
def test_suffix_dedup_on_edges(edge, edge_rows, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(edge).collect()) == plain_bytes(edge_rows)


def test_suffix_dedup_on_overlapping_copies(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    rows = [(rng.randint(0, 60), "".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for _ in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.dedup(docs).collect()) == plain_bytes(rows)


def test_contexts_cover_every_string_across_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    raw = random.Random(1).randbytes(1000)
    _, _, starts, counts, *_ = suffix_dedup.contexts(raw)
    assert sorted(i for s, n in zip(starts, counts) for i in range(s, s + n)) == list(range(951))


def test_contexts_of_several_texts_are_those_of_each_and_share_calls(monkeypatch):
    rng = random.Random(4)
    raws = [bytes(rng.choices(b"ab c", k=rng.choice([0, 1, 49, 50, 51, 66, 99, 300]))) for _ in range(60)] + [b"a" * 400]
    for piece, beside in ((1 << 20, 1 << 16), (100, 1 << 16), (100, 200)):
        calls = []
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "BESIDE", beside)
        each = [suffix_dedup.contexts(r) for r in raws]
        monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda codes, f=suffix_dedup._gram_hashes: calls.append(len(codes)) or f(codes))
        text, *rest = suffix_dedup.contexts_of(raws)
        monkeypatch.undo()
        assert text.tolist() == [i for i, e in enumerate(each) for _ in e[0]]
        assert [c.tolist() for c in rest] == [np.concatenate(c).tolist() for c in zip(*each)]
        assert len(calls) == 1 if beside == 1 << 16 else len(calls) > 5


def test_contexts_that_meet_no_other_document_go_in_one_pass():
    rng = random.Random(6)
    rows = sorted(((rng.randrange(40), rng.randrange(3), rng.randrange(2), rng.randrange(2)) for _ in range(300)), key=lambda r: r[0])
    seen = lambda key: {k for k in map(key, rows) if len({r[1] for r in rows if key(r) == k}) > 1}
    by_after, by_before = seen(lambda r: (r[0], r[2])), seen(lambda r: (r[0], r[3]))
    want = [r[0] == 7 or (r[0], r[2]) in by_after or (r[0], r[3]) in by_before for r in rows]  # 7 is hot
    a, i, after, before = map(np.array, zip(*rows))
    table = pa.table({"doc_id": i, "tk": np.arange(300), "anchor": a, "ctx": a, "place": (after << 22) + (before << 12), "id": i, "hot": a == 7})
    for size in (1, 3, 50, 300):
        out = [t for b in suffix_dedup._met(table.to_batches(size), 1000) for t in b.column("tk").to_pylist()]
        assert sorted(out) == [k for k in range(300) if want[k]]
        out = [t for b in suffix_dedup._met(table.to_batches(size), 4) for t in b.column("tk").to_pylist()]
        assert len(out) == len(set(out)) and {k for k in range(300) if want[k]} <= set(out)


def test_suffix_dedup_keeps_anchors_with_many_rows_unseen(spark, edge, edge_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_HELD", 2)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(edge).collect()) == plain_bytes(edge_rows)


def test_suffix_dedup_of_hot_passages_and_alike_contexts(spark, monkeypatch):
    """Passages that most documents share, spliced at odd places, with their anchors known as hot."""
    for k, v in {"SAMPLE": 1, "HOT_SHARE": 0.0, "HOT_LEAST": 10, "MOST_CONTEXTS": 8, "PIECE": 700}.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = []
    for i in range(40):
        a, n = rng.randrange(500), rng.randint(30, 400)
        rows.append((i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + passage[a : a + n] + rng.choice(["", "x" * 130, "tail"]) + passage[a // 2 : a // 2 + 47]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in suffix_dedup.dedup(docs).collect()) == plain_bytes(rows)


def test_suffix_dedup_on_an_empty_table(empty):
    assert suffix_dedup.dedup(empty).collect() == []


# --- lines ---


def plain_lines(rows):
    """The same definition, with all anchors in one dictionary."""
    docs = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            docs[i, t] = line_dedup.solid_lines(t)
    order = sorted(docs, key=lambda k: k[0])
    first, places = {}, []
    for key in order:
        lines = docs[key][1]
        for a, p in line_dedup.anchors(lines, line_dedup.line_hashes(lines)):
            places.append((a, key, p))
    for a, key, p in sorted(places, key=lambda x: (x[1][0], x[2])):
        first.setdefault(a, (key, p))
    gone = {k: set() for k in docs}
    for a, key, p in places:
        if first[a] != (key, p):
            k0, q = first[a]
            mine, theirs = docs[key][1], docs[k0][1]
            lo = hi = 0
            while p - lo > 0 and q - lo > 0 and mine[p - lo - 1] == theirs[q - lo - 1]:
                lo += 1
            while p + hi < len(mine) and q + hi < len(theirs) and mine[p + hi] == theirs[q + hi]:
                hi += 1
            gone[key] |= set(range(p - lo, p + hi))
    out = Counter()
    for i, t, *_ in rows:
        at = {docs[i, t][0][g] for g in gone[i, t]} if (i, t) in docs else set()
        left = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in at)
        out[i, len(line_dedup.solid_lines(t or "")[0]), len(at), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def test_line_dedup_on_edges(edge, edge_rows, empty):
    assert Counter(tuple(r) for r in line_dedup.report(edge).collect()) == plain_lines(edge_rows)
    assert line_dedup.report(empty).collect() == []


def test_line_dedup_on_many_runs(spark):
    rng = random.Random(4)
    pool = [f"line number {i}" for i in range(25)] + [" ".join(f"v{i}w{j}" for j in range(55)) for i in range(3)]
    rows = []
    for i in range(60):
        s = rng.randint(0, 20)
        lines = rng.choices(pool, k=2) + pool[s : s + rng.randint(1, 8)]
        rows.append((i, "\n".join(rng.choice(pool) if rng.random() < 0.3 else x for x in lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in line_dedup.report(docs).collect()) == plain_lines(rows)


def test_every_repeated_run_of_three_lines_goes(spark):
    rng = random.Random(9)
    own = lambda n: [f"own {rng.random()}" for _ in range(n)]
    run = own(3)
    rows = [(i, "\n".join(own(rng.randint(0, 4)) + run + own(rng.randint(0, 4)))) for i in range(20)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(all(x in r.text.split("\n") for x in run) for r in out) == 1
    assert all(r.n_removed_lines == 3 for r in out if r.doc_id)


def runs_of(text, n):
    lines = line_dedup.solid_lines(text)[1]
    return [tuple(lines[k : k + n]) for k in range(len(lines) - n + 1)]


def plain_runs(rows, n=2, long=50):
    """Lines left when every run of ``n`` lines, and every long line, keeps its first place only."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = line_dedup.solid_lines(t)[1]
        gone = set()
        for k in range(len(lines)):
            for size in (n, 1):
                run = tuple(lines[k : k + size])
                if len(run) == size and (size > 1 or len(run[0].split()) >= long):
                    if run in seen:
                        gone |= set(range(k, k + size))
                    seen.add(run)
        out[i] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_a_common_opening_does_not_hide_longer_repeats(spark):
    rows = [(1, "a\nb\nx"), (2, "a\nb\nc"), (3, "a\nb\nc")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nx", 2: "c", 3: ""}  # b, c is new in 2 and no longer in 3


def test_line_dedup_equals_all_repeated_runs(spark):
    rng = random.Random(21)
    pool = [f"line {i}" for i in range(9)] + [" ".join(f"v{i}w{j}" for j in range(55)) for i in range(2)]
    rows = [(i, "\n".join(["head", "licence"] + rng.choices(pool, k=rng.randint(1, 7)) + [f"own {i}"])) for i in range(80)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: line_dedup.solid_lines(r.text)[1] for r in out} == plain_runs(rows)


def test_repeated_passages_of_fifty_words_go_however_they_are_broken(spark):
    rng = random.Random(17)
    rows, i = [], 0
    for sizes in [(30, 30), (49, 1), (25, 25), (20, 20, 20), (60,), (5, 50), (10,) * 6]:
        passage = [" ".join(f"w{rng.random()}" for _ in range(n)) for n in sizes]
        for _ in range(8):  # own lines around it, so that hashes nearby differ from document to document
            rows.append((i, "\n".join([f"own {rng.random()}", *passage, f"own {rng.random()}"]), len(sizes)))
            i += 1
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.dedup(docs).collect()}
    assert got == {i: 0 if i % 8 == 0 else n for i, _, n in rows}


# --- n-gram join ---


def plain_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) if i is not None else None for i in sets}, {i: sorted(map(len, s)) for i, s in sets.items()}


def check_join(spark_rows, rows):
    parts, sizes = plain_components(rows)
    got = spark_rows.collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == set(parts.items())
    for i, n in sizes.items():
        assert sorted(r.n_shingles for r in got if r.doc_id == i) == n


def test_join_on_edges(edge, edge_rows, empty):
    check_join(ngram_join.link(edge), edge_rows)
    assert ngram_join.link(empty).collect() == []


def test_join_on_chains_of_edits(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(60)] = f"e{rng.random()}"
            rows.append((n, " ".join(text)))
            n += 1
            if rng.random() < 0.3:
                base = text
    check_join(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_join_threshold_is_exact(spark):
    a = [f"w{i}" for i in range(104)]  # 100 shingles; an edit at the end takes one, in the middle five
    rows = [(1, " ".join(a)), (2, " ".join(a[:90] + [f"x{i}" for i in range(14)])), (3, " ".join(a[:89] + [f"y{i}" for i in range(15)]))]
    check_join(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("settings", [{}, {"SAMPLE": 1, "HOT_SHARE": 0.0, "HOT_LEAST": 20}, {"BLOCK_TOKENS": 400, "BLOCK_DOCS": 7}, {"JUMPS": 0, "PAIRS_SHARE": 0}, {"JUMPS": 0, "SAMPLE": 1, "HOT_SHARE": 0.0, "HOT_LEAST": 2, "MEMORY": 3}])
def test_join_on_a_large_group_of_near_copies(spark, monkeypatch, settings):
    """Copies of one text around the threshold, by hot shingles, in many blocks, in many clusters."""
    for k, v in settings.items():
        monkeypatch.setattr(ngram_join, k, v)
    rng = random.Random(8)
    base, other = [f"w{i}" for i in range(80)], [f"v{rng.randint(0, 30)}" for _ in range(70)]
    rows = []
    for n in range(150):
        text = list(base if n % 5 else other)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"e{rng.randint(0, 300)}"
        rows.append((n * 3 % 150, " ".join(text[: rng.choice((60, 66, 70, 80))])) if n % 9 else (n * 3 % 150, " ".join(rows[-1][1].split()) if rows else "one two"))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    check_join(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


@pytest.mark.parametrize("seed", range(3))
def test_join_across_clusters_of_their_own(spark, monkeypatch, seed):
    """Chains of edits, with every node a cluster: all links come from pairs, met either way round."""
    monkeypatch.setattr(ngram_join, "clusters", lambda posts, scratch, percent: posts.select("nid", "n", "weight", F.col("nid").alias("cluster")))
    monkeypatch.setattr(ngram_join, "PAIRS_SHARE", 0)
    rng = random.Random(seed)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice((40, 70)))]
        for _ in range(15):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 50)}"
            rows.append((len(rows), " ".join(text)))
            base = text if rng.random() < 0.4 else base
    check_join(ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)


def test_linked_connects_what_links_connect():
    rng = np.random.default_rng(4)
    for _ in range(40):
        core = rng.choice(1 << 40, 40, replace=False).astype(np.uint64)
        sets = [np.unique(np.concatenate([core[rng.random(40) < 0.9], rng.choice(1 << 40, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(30)]
        nids = rng.permutation(1000)[:30]
        up = list(range(30))
        for i in range(30):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * len(np.union1d(sets[i], sets[j])):
                    up = [up[i] if u == up[j] else u for u in up]
        want = {int(nids[i]): min(int(nids[j]) for j in range(30) if up[j] == up[i]) for i in range(30)}
        got = {int(i): int(i) for i in nids} | dict(ngram_join.linked(nids, sets, rng.permutation(30), 75))
        assert got == want


# --- nearest neighbours ---


def plain_nearest(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            best = sorted((-round(float((ok[q] * v).sum() / (np.sqrt((ok[q] ** 2).sum()) * np.sqrt((v**2).sum()))), 12), i) for i, v in ok.items() if i != q)[:k]
            out[q] = [i for _, i in best]
    return out


def test_neighbours_on_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, None), (2050, [0.0] * 8), (2100, [None] + [1.0] * 7), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, [1.0] * 8), (2250, rows[1][1])]
    rows.append(rows[50])
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, part string")
    got: dict = {}
    for r in sorted(ann.report(vectors).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == plain_nearest(rows)


def test_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=8)
    order = rng.permutation(np.arange(1, 41))
    rows = [(0, v.tolist())] + [(int(i), (v * (j + 1)).tolist()) for j, i in enumerate(order)]  # multiples of one vector
    rows += [(100 + i, rng.normal(size=8).tolist()) for i in range(30)]
    got = ann.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1000).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(n, n) for n in range(1, 6)]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.report(spark.createDataFrame([], schema)).collect() == []
    got = ann.report(spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (9, [0.0, 1.0])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 9)]


def test_recall_with_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.6 * rng.normal(size=16)).tolist()) for i in range(3000)]
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    monkeypatch.setattr(ann, "BLOCK", 64)
    got: dict = {}
    for r in ann.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_nearest(rows)
    assert np.mean([len(got[q] & set(v)) / 5 for q, v in want.items()]) >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(800, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sizes = np.bincount(ann.balanced_parts(x, ann.neighbours(x, 8), 8), minlength=8)
    assert sizes.max() <= 111 and sizes.sum() == 800
