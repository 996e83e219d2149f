"""Removal of byte strings that an earlier document holds, by suffix arrays of shared contexts.

Every 50-byte string of a text is assigned to an anchor inside it: the leftmost 16-gram with
the least hash. Equal strings have equal anchors at equal places, so they meet under the
anchor's hash. A run of neighbouring strings with one anchor is a context: the bytes they
cover. Contexts are dropped unless another document has the anchor with the same gram right
after or right before it, one of which every string holds. Contexts equal as a whole count once,
with the smallest doc_id that has them. Where others of an anchor are alike, contexts are cut to
the strings that what they have in common around the anchor allows; equal cuts count once, and
are laid out as a text with separators, groups of anchors to a block of bounded size. Its suffix
array (``suffix_array``: linear grouping by Lyndon prefixes) brings equal 50-byte strings
together, and each gets the smallest doc_id among its contexts. An anchor with more than
``MOST_CONTEXTS`` such contexts is dealt out by the strings themselves, so that equal ones
still meet. Each document then drops the bytes of strings that a smaller doc_id has.

Null text counts as empty. Rows with a null doc_id keep their bytes and count for nobody.
Rows that share a doc_id are one document: they never match each other, and repeated rows get
the same result each. Texts of any length are read whole, in overlapping pieces. An empty table
gives an empty result. Columns other than doc_id and text are not read. Every row is returned.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, narrowed
from .hashing import BASE, mix
from .suffix_array import suffix_array

LENGTH, GRAM, BLOCK_BYTES, MOST_CONTEXTS, PIECE = 50, 16, 1 << 15, 8192, 1 << 20
SAMPLE, HOT_SHARE, HOT_LEAST, MOST_HOT = 32, 0.005, 128, 4096
BESIDE, MOST_HELD = 1 << 16, 1 << 18
_MIXED = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    h, width, base = _MIXED[codes], 1, BASE
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        width, base = 2 * width, np.uint64(int(base) ** 2 % (1 << 64))
    return mix(h)


def _leftmost_least(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` values, the place of its leftmost least one (by their upper 43 bits).
    Places stand in the lower bits, so that a least value brings its place along."""
    low = np.uint64((1 << 21) - 1)
    v, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if rest := span - width:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & low).astype(np.int64)


@lru_cache(maxsize=32)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse, modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


def contexts(raw: bytes):
    """Arrays (anchor, context hash, first string's start, strings, anchor's place in the first string,
    sides). Sides are 10 bits each of the hashes of the grams right after and before the anchor."""
    return contexts_of([raw])[1:]


def contexts_of(raws: list[bytes]):
    """The same of several texts, behind an array of each context's text. Pieces of texts stand side by
    side while they are hashed, so that short texts share the calls; no string or gram crosses them."""
    out, row, pieces, size = [], [], [], 0
    for i, raw in enumerate(raws):
        for base in range(0, len(raw) - LENGTH + 1, PIECE):
            pieces.append(raw[base : base + PIECE + LENGTH - 1])
            row.append((i, base))
            size += len(pieces[-1])
            if size >= BESIDE:
                out.append(_contexts(pieces, row))
                row, pieces, size = [], [], 0
    if pieces:
        out.append(_contexts(pieces, row))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 7


def _contexts(pieces: list[bytes], row: list[tuple[int, int]]):
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    h = _gram_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    span = LENGTH - GRAM + 1
    at = _leftmost_least(h, span)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[begins] = True
    # what starts in the last bytes of a piece is no string of it
    past = (ends[:-1, None] + np.arange(1 - LENGTH, 0)).ravel()
    new[past] = False
    cut = np.flatnonzero(new)
    of = np.searchsorted(begins, cut, side="right") - 1
    count = np.minimum(np.append(cut[1:], len(at)), ends[of] - LENGTH + 1) - cut
    # a polynomial over the gram hashes of the context, freed of its place
    up, down = _powers(1 << len(h).bit_length())
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=sums[1:])
    whole = (sums[cut + count + span - 1] - sums[cut]) * down[cut]
    where, mask = at[cut], np.uint64(1023)
    after = np.where(where + GRAM < ends[of] - GRAM + 1, h[np.minimum(where + GRAM, len(h) - 1)] & mask, np.uint64(0)).astype(np.int64)
    before = np.where(where >= begins[of] + GRAM, h[np.maximum(where - GRAM, 0)] & mask, np.uint64(0)).astype(np.int64)
    text, base = (np.array(x, np.int64)[of] for x in zip(*row))
    return text, h[where].view(np.int64), mix(whole + count.astype(np.uint64)).view(np.int64), cut - begins[of] + base, count, where - cut, (after << 10) + before


def _raw(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, anchor, ctx, place) of every context; ``place`` packs the first string's start, the
    sides, the number of strings and the anchor's place in the first."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                text, anchor, ctx, start, count, at, sides = contexts_of(_raw(part.column("text")))
                take = pa.array(text)
                place = (start << 32) + (sides << 12) + (count << 6) + at
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("tk").take(take), pa.array(anchor), pa.array(ctx), pa.array(place)], names=["doc_id", "tk", "anchor", "ctx", "place"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tk"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, tk long, anchor long, ctx long, place long")


START, AFTER, BEFORE, STRINGS, AT = "shiftright(place, 32)", "shiftright(place, 22) & 1023", "shiftright(place, 12) & 1023", "int(shiftright(place, 6) & 63)", "int(place & 63)"
NAMES = ["doc_id", "tk", "anchor", "ctx", "place"]


def _shared(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The contexts that may hold a string of two documents: two have the anchor, and with it the gram
    right after or right before it. One of these grams is part of any string of 50 bytes around the
    anchor. Anchors that a sample shows in more than ``HOT_SHARE`` of the documents are kept
    unseen, so that no anchor has a large share of the rows."""
    part = docs.where(f"pmod(xxhash64(doc_id), {SAMPLE}) = 0")
    least = max(HOT_LEAST, int(HOT_SHARE * part.count()))
    seen = _occurrences(part).select("doc_id", "tk", "anchor").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hot = scratch.table(seen.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    rows = _occurrences(docs).join(F.broadcast(hot), "anchor", "left")  # at most MOST_HOT rows
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(0)
    rows = rows.repartition("anchor", spread).sortWithinPartitions("anchor")  # by one number
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = rows.select(*NAMES, F.col("doc_id").cast("long").alias("id"), F.col("hot").isNotNull().alias("hot"))
    most = MOST_HELD
    return scratch.table(rows.mapInArrow(lambda batches: _met(batches, most), f"doc_id {kind}, tk long, anchor long, ctx long, place long"), "shared")


def _differ(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row, whether rows of its key have different ids. Equal keys stand together."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    differ = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    return np.repeat(differ, np.diff(first, append=len(keys)))


def meetings(anchor: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of the rows that meet another id under their anchor and a side. Equal anchors stand together."""
    left = np.flatnonzero(_differ(anchor, ids))
    if not len(left):
        return left
    group = np.cumsum(np.concatenate([[0], anchor[left][1:] != anchor[left][:-1]])) << 10
    met = np.zeros(len(left), bool)
    for shift in (22, 12):
        key = group + ((place[left] >> shift) & 1023)
        order = np.argsort(key, kind="stable")
        met[order] |= _differ(key[order], ids[left][order])
    return left[met]


def _met(batches, most: int):
    """Drops contexts that meet no other document, a few anchors at a time. Hot anchors are kept unseen, and
    so are those with over ``most`` rows, which are not held together."""
    held, rows, unseen = [], 0, None  # rows of the last anchor, which may go on

    def judged(found):
        part = pa.Table.from_batches(found).combine_chunks()
        anchor, ids, place = (part.column(c).to_numpy() for c in ("anchor", "id", "place"))
        return part.take(pa.array(meetings(anchor, ids, place))).select(NAMES).to_batches()

    for b in batches:
        if not len(b):
            continue
        anchor, hot = b.column("anchor").to_numpy(), b.column("hot").to_numpy(zero_copy_only=False)
        loose = hot | (anchor == unseen) if unseen is not None else hot
        if loose.any():
            yield b.filter(pa.array(loose)).select(NAMES)
            b = b.filter(pa.array(~loose))
            if not len(b):
                continue
            anchor = b.column("anchor").to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last or held and held[0].column("anchor")[0].as_py() != anchor[0]:
            yield from judged([*held, b.slice(0, last)])
            held, rows = [], 0
        held.append(b.slice(last))
        rows += len(held[-1])
        if rows > most:
            unseen = int(anchor[-1])
            yield from (x.select(NAMES) for x in held)
            held, rows = [], 0
    if held:
        yield from judged(held)


def smallest_owner(pieces: list[bytes], owners: list[int]) -> list[list[int]]:
    """For each context, the smallest owner of each of its 50-byte strings, by one suffix array."""
    sizes = np.array([len(p) for p in pieces])
    text = np.zeros(int(sizes.sum()) + len(pieces), np.int64)  # 0 separates
    raw = np.zeros(len(text), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    for p, s in zip(pieces, starts):
        raw[s : s + len(p)] = np.frombuffer(p, np.uint8)
        text[s : s + len(p)] = raw[s : s + len(p)].astype(np.int64) + 1
    whose = np.full(len(text), -1)
    for i, (s, n) in enumerate(zip(starts, sizes)):
        whose[s : s + n - LENGTH + 1] = i
    order = suffix_array(text)
    order = order[whose[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
    least = np.minimum.reduceat(np.array(owners, np.int64)[whose[order]], np.flatnonzero(new))
    of = np.empty(len(text), np.int64)
    of[order] = least[np.cumsum(new) - 1]
    return [of[s : s + n - LENGTH + 1].tolist() for s, n in zip(starts, sizes)]


def _reach(parts: list[bytes]) -> list[int]:
    """For each of one anchor's parts, the longest beginning that it has in common with another one."""
    width = LENGTH - GRAM
    values = [int.from_bytes(x.ljust(width, b"\0"), "big") for x in parts]
    order = sorted(range(len(values)), key=values.__getitem__)
    out = [0] * len(values)
    for i, j in zip(order, order[1:]):
        common = width - (((values[i] ^ values[j]).bit_length() + 7) >> 3)
        out[i] = max(out[i], common)
        out[j] = common
    return out


def common_strings(pieces: list[bytes], places: list[int]) -> list[tuple[int, int]]:
    """For contexts of one anchor (bytes, and the anchor's place in them), the range of strings that another
    one may hold: what stands before and after the anchor in them must stand so elsewhere. Empty: (0, 0)."""
    width = LENGTH - GRAM
    after = _reach([p[o + GRAM : o + LENGTH] for p, o in zip(pieces, places)])
    before = _reach([p[max(0, o - width) : o][::-1] for p, o in zip(pieces, places)])
    out = []
    for p, o, a, b in zip(pieces, places, after, before):
        first, end = max(0, o - b), min(len(p) - LENGTH + 1, o - (width - a) + 1)
        out.append((first, end) if first < end else (0, 0))
    return out


def _by_suffix_array(rows: DataFrame, tasks: int) -> DataFrame:
    """(anchor, ctx, owners) of contexts (anchor, ctx, owner, at, bytes) whose anchors have few. Contexts
    are cut to the strings that others may hold; equal cuts of one anchor are laid out once."""

    def run(batches):
        done, group, cuts, pieces, least, size = [], [], [], [], [], 0

        def close():
            nonlocal size
            own: dict[tuple[int, bytes], int] = {}
            for g, (first, end) in zip(group, common_strings([g[4] for g in group], [g[3] for g in group])):
                if first == end:
                    done.append((g[0], g[1], [g[2]] * (len(g[4]) - LENGTH + 1)))
                    continue
                key = g[3] - first, g[4][first : end + LENGTH - 1]
                if key not in own:
                    own[key] = len(pieces)
                    pieces.append(key[1])
                    least.append(g[2])
                    size += len(key[1]) + 1
                least[own[key]] = min(least[own[key]], g[2])
                cuts.append((g, first, end, own[key]))
            group.clear()

        def flush():
            nonlocal size
            found = smallest_owner(pieces, least) if pieces else []
            done.extend((g[0], g[1], [g[2]] * first + found[i] + [g[2]] * (len(g[4]) - LENGTH + 1 - end)) for g, first, end, i in cuts)
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int64()))], names=["anchor", "ctx", "owners"])
            for x in (done, cuts, pieces, least):
                x.clear()
            size = 0
            return out

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "ctx", "owner", "at", "bytes"))):
                if group and r[0] != group[0][0]:  # an anchor's contexts stay together
                    close()
                    if size >= BLOCK_BYTES or len(done) >= 4096:
                        yield flush()
                group.append(r)
        if group:
            close()
        yield flush()

    ordered = rows.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "anchor long, ctx long, owners array<long>")


def _by_string(rows: DataFrame) -> DataFrame:
    """The same for anchors with many contexts: equal strings meet by their own 128-bit hash."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                out = []
                for a, c, o, raw in zip(*(b.column(x).slice(i, 256).to_pylist() for x in ("anchor", "ctx", "owner", "bytes"))):
                    out += [(a, c, o, j, xxhash.xxh3_128_digest(raw[j : j + LENGTH])) for j in range(len(raw) - LENGTH + 1)]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "ctx", "owner", "j", "string"])

    strings = rows.mapInArrow(run, "anchor long, ctx long, owner long, j int, string binary")
    least = strings.groupBy("string").agg(F.min("owner").alias("least"))
    return strings.join(least, "string").groupBy("anchor", "ctx").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "least"))), lambda x: x["least"]).alias("owners"))


def _context_bytes(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, ctx, owner, at, m, bytes) of contexts given as a table of (anchor, ctx, owner, tk, s, n, at, m)."""
    lists = wanted.groupBy("owner", "tk").agg(F.collect_list(F.struct("anchor", "ctx", "s", "n", "at", "m")).alias("spans"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("owner"), F.xxhash64("text").alias("tk"), "text")
    full = narrowed(texts, "tk", wanted).join(lists, ["owner", "tk"])

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                out = {}
                part = b.slice(i, 64)
                for o, raw, spans in zip(part.column("owner").to_pylist(), _raw(part.column("text")), part.column("spans").to_pylist()):
                    for x in spans:
                        out[x["anchor"], x["ctx"], o, x["at"], x["m"]] = raw[x["s"] : x["s"] + x["n"] + LENGTH - 1]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[j] for k in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))), pa.array(list(out.values()), pa.binary())], names=["anchor", "ctx", "owner", "at", "m", "bytes"])

    return full.select("owner", "text", "spans").mapInArrow(run, "anchor long, ctx long, owner long, at int, m long, bytes binary")


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, tk, runs): byte ranges that smaller documents hold too, per document."""
    spark = docs.sparkSession
    shared = _shared(docs, scratch)
    kinds = shared.groupBy("anchor", "ctx").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "tk", "place")).alias("f"))
    kinds = kinds.select("anchor", "ctx", F.col("f.doc_id").alias("owner"), F.col("f.tk").alias("tk"), F.col("f.place").alias("place")).withColumns({"after": F.expr(AFTER), "before": F.expr(BEFORE)})
    # a context that no other one of its anchor has a side with shares strings with its equals only
    like = lambda side: F.count("*").over(Window.partitionBy("anchor", side)) > 1
    kinds = kinds.repartition("anchor").withColumn("a", like("after")).withColumn("b", like("before")).withColumn("open", F.expr("a OR b"))
    kinds = kinds.withColumn("m", F.count_if("open").over(Window.partitionBy("anchor")))
    kinds = scratch.table(kinds.selectExpr("anchor", "ctx", "owner", "tk", f"{START} AS s", f"{STRINGS} AS n", f"{AT} AS at", "open", "m"), "kinds")
    full = scratch.table(_context_bytes(kinds.where("open").drop("open"), docs), "contexts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    none = F.lit(None)
    owners = _by_suffix_array(full.where(f"m <= {MOST_CONTEXTS}"), tasks).unionByName(_by_string(full.where(f"m > {MOST_CONTEXTS}").drop("at", "m")))
    single = kinds.where("NOT open").select("anchor", "ctx", none.cast("array<long>").alias("owners"), F.col("owner").alias("only"))
    owners = scratch.table(owners.withColumn("only", none.cast("long")), "owners")
    scratch.drop(full)
    owners = owners.unionByName(single)
    found = shared.join(owners, ["anchor", "ctx"]).withColumns({"s": F.expr(START), "n": F.expr(STRINGS)})
    found = found.where("coalesce(only, array_min(owners)) < doc_id")
    # strings whose smallest owner is smaller, as runs: a new one where the place does not follow on
    at = "filter(transform(owners, (o, i) -> CASE WHEN o < doc_id THEN i END), i -> i IS NOT NULL)"
    begin = "filter(at, (x, i) -> i = 0 OR get(at, i - 1) <> x - 1)"
    last = "filter(at, (x, i) -> get(at, i + 1) IS NULL OR get(at, i + 1) <> x + 1)"
    found = found.withColumn("at", F.expr(at)).withColumns({"begin": F.expr(f"coalesce({begin}, array(0))"), "last": F.expr(f"coalesce({last}, array(n - 1))")})
    hit = found.select("doc_id", "tk", "s", F.explode(F.arrays_zip("begin", "last")).alias("r"))
    hit = hit.select("doc_id", "tk", (F.col("s") + F.col("r.begin")).alias("a"), (F.col("s") + F.col("r.last") + LENGTH).alias("e"))
    runs = scratch.table(hit.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", "e")).alias("runs")), "runs")
    for used in (shared, kinds, owners):
        scratch.drop(used)
    return runs


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _pairs(runs: pa.Array) -> list[list[tuple[int, int]]]:
    """The runs (a, e) of each row; none where the list is null."""
    pairs = list(zip(*(x.to_pylist() for x in runs.flatten().flatten())))
    ends = np.cumsum(runs.value_lengths().fill_null(0).to_numpy())
    return [pairs[a:e] for a, e in zip([0, *ends.tolist()], ends.tolist())]


def dedup(docs: DataFrame, scratch: Scratch | None = None, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``with_bytes`` also the kept bytes."""
    runs = covered(docs, scratch or Scratch(docs.sparkSession)).select(F.col("doc_id").alias("rid"), F.col("tk").alias("rtk"), "runs")
    keyed = docs.select("doc_id", "text").withColumn("tk", F.xxhash64("text"))
    rows = keyed.join(runs, (F.col("doc_id") == F.col("rid")) & (F.col("tk") == F.col("rtk")), "left").select("doc_id", "text", "runs")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                out = []
                for raw, r in zip(_raw(part.column("text")), _pairs(part.column("runs"))):
                    gone = merged(r)
                    kept, at = [], 0
                    for a, e in gone:
                        kept.append(raw[at:a])
                        at = e
                    left = b"".join(kept) + raw[at:] if gone else raw
                    out.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left))
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), *([pa.array(c[4], pa.binary())] if with_bytes else [])], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
