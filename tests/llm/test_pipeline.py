"""The corpus pipeline, stage by stage, each held against brute force over its own input."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from loomlake.llm import bpe, line_dedup, mixing, queries
from loomlake.llm.common import Scratch

from .test_duplicate_operators import plain_components, plain_lines
from .test_text_operators import plain_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    w = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    out, notice = [], "\n".join(w(12) for _ in range(3))
    for i in range(40):
        text = "\n".join(w(25) for _ in range(4))
        if i % 5 == 0:
            text += "\n" + notice
        if i % 7 == 3:
            words = out[-1][1].split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        if i % 11 == 4:
            text = "few words"
        if i % 13 == 5:
            text = "again and again " * 40
        out.append((i, text, ["en", "de", None][i % 3], f"s{i % 4}", len(text)))
    return out + [(100, out[1][1], "en", "s1", 1), (101, None, None, None, None), (102, "", "en", "s1", 0), out[2]]


def test_stages_equal_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        after[name] = (docs.collect(), [r.asDict() for r in out.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame([tuple(r.values()) for r in after[name][1]], SCHEMA)

    given, kept = after["quality rules"]  # no line is common enough here, so the base rules decide
    n = {r.text: plain_rules(r.text) for r in given}
    assert Counter(r["text"] for r in kept) == Counter(r.text for r in given if n[r.text][0] >= 50 and 100 * n[r.text][4] <= 50 * n[r.text][0])

    given, kept = after["line dedup"]
    want = Counter()
    for (i, lines, gone, digest), m in plain_lines([(r.doc_id, r.text) for r in given]).items():
        if not gone or gone < lines:
            want[i, digest] += m
    assert Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in kept) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept) and any(line_dedup.solid_lines(r["text"])[0] for r in kept)

    given, kept = after["n-gram Jaccard join"]
    parts, _ = plain_components([(r.doc_id, r.text) for r in given])
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, c in parts.items() if i == c)

    given, kept = after["mixing"]
    db = duckdb.connect()
    frame = spark.createDataFrame(given, SCHEMA).toPandas()  # noqa: F841  read by name below
    db.register("frame", frame)
    assert sorted(r["doc_id"] for r in kept) == sorted(r[0] for r in db.execute(f"SELECT doc_id FROM ({mixing.oracle('frame')}) WHERE kept").fetchall())

    given, kept = after["byte-level BPE"]
    enc = bpe.encoder(public_tokenizers.path(queries.VOCAB), public_tokenizers.PATTERN)
    want = {r.doc_id: np.array(enc.encode_ordinary(r.text), "<u4").tobytes() for r in given}
    assert {r["doc_id"]: bytes(r["ids_le"]) for r in kept} == want and len(kept) == len(given)


def test_texts_under_one_id_are_decided_apart(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.random()}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, d), (3, c), (4, d), (5, e), (5, e + " tail"), (6, None), (6, ""), (6, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "unused")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    one_of_five = [(5, x) for x in (e, e + " tail") if got[5, x]]
    assert len(one_of_five) == 1
    assert got == Counter([(1, a), (2, b), (3, c), (3, d), (6, None), (6, ""), (None, a), (None, a), *one_of_five])


def test_mixing_makes_small_plans_only(spark, rows, monkeypatch):
    """The driver holds a description of every plan, made anew at each of its stages."""
    docs, written, table = spark.createDataFrame(rows, SCHEMA), [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: written.append(df) or table(self, df, name))
    out = corpus_pipeline.mix(spark, docs, "unused")
    assert max(df._jdf.queryExecution().executedPlan().toString().count("Exchange ") for df in [*written, out]) <= 12
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixing.sample(docs).collect())


def test_run_over_the_smallest_table(spark, small):
    out = corpus_pipeline.run(spark, small)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 50 and "ids_le" in out.columns


def test_an_empty_table_goes_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.collect() == []
        docs = spark.createDataFrame([], out.schema)
