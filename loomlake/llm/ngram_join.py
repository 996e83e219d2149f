"""Word n-gram Jaccard join with adaptive multi-match prefixes.

Each text is a set of hashed ``N``-word shingles (ASCII lower case). Equal sets are one node.
For any total order of shingles: if a document's prefix is its first ``n - ceil(t n) + l``
shingles, two documents of similarity ``t`` share at least the smaller of their two ``l`` inside
their prefixes, and no fewer than the overlap they need less the larger of their two rests.

1. Hash order, ``l`` a tenth of the set. A document fewer of whose prefix shingles are shared
   with anybody than any partner would need links with nothing.
2. The whole sets of the others are counted. A document with less than ``ceil(t n)`` shared
   shingles links with nothing. What is left are copies and their like.
3. Order by document frequency, rarest first, over shared shingles only. Each document takes the
   ``l`` with the least estimated cost of postings and verifications.
4. Each document votes for the heaviest holder of each prefix shingle; following the winners a
   few steps gives clusters of alike texts; clusters that share much become one. A cluster is compared inside tasks, in blocks of
   bounded size, against its hub first: those the hub links need no comparison among themselves.
   Pairs inside clusters are never written.
5. Prefix shingles with documents of several clusters give the remaining pairs, counted, cut by
   the matches they need, and verified.

Every link between two components is found, so components are exact; links within one are not
needed. Shingles that a sample shows in over ``HOT_SHARE`` of the documents count as shared
unseen: steps 1 and 2 may then keep more, never less. Shingles and nodes are 64-bit hashes.

Null or empty text, or text without words: an empty set, linked with nothing. Fewer than ``N``
words: the whole sequence is the only shingle. A null doc_id links with nothing and has a null
component. Repeated rows link with each other; every row is returned. Texts of any length are
read whole. An empty table gives an empty result. Other columns are not read but for ``carry``,
which may not hold doc_id, nid, n, brings or tokens.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, narrowed, salted_join
from .components import components
from .hashing import shingles, words_of

N, PERCENT, SLACK, MAX_MATCHES, VERIFY_COST, JUMPS, PAIRS_SHARE = 5, 75, 10, 4, 30.0, 2, 8
SAMPLE, HOT_SHARE, HOT_LEAST, MOST_HOT = 16, 0.005, 256, 4096
BLOCK_TOKENS, BLOCK_DOCS, MEMORY = 1 << 20, 4096, 1 << 16


def shingle_set(text: str, n: int = N) -> np.ndarray:
    return shingles(words_of(text, fold=True), n)


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def first_matches(n: int, percent: int) -> tuple[int, int]:
    """Prefix length in hash order, and how many of its shingles must be shared for any partner."""
    least = -(-percent * n // 100)
    l = min(least, max(1, -(-SLACK * n // 100)))
    return n - least + l, max(1, -(-SLACK * n // 100) - 1)


def _flat(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def hashed(docs: DataFrame, n: int, percent: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, nid, n, brings, tokens) of every row, and the columns in ``carry``: node, size and
    hash-order prefix of its set. Of equal sets that a task has seen only the first brings its prefix."""
    none = np.zeros(0, np.uint64)

    def run(batches):
        by_text: dict[bytes, tuple[int, int]] = {}
        nodes: set[int] = set()
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                ids, sizes, tokens = [], [], []
                for text, doc in zip(part.column("text"), part.column("doc_id")):
                    text = text.as_py() or ""
                    key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    took = none
                    if key in by_text:
                        node, size = by_text[key]
                    else:
                        found = shingle_set(text, n)
                        size = len(found)
                        node = node_of(found) if size else 0
                        if doc.is_valid and size:
                            if len(by_text) >= MEMORY:
                                by_text.clear()
                                nodes.clear()
                            by_text[key] = node, size
                            if node not in nodes:
                                nodes.add(node)
                                took = found[: first_matches(size, percent)[0]]
                    ids.append(node if size and doc.is_valid else None)
                    sizes.append(size)
                    tokens.append(took)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(t) > 0 for t in tokens]), _flat(tokens), *(part.column(x) for x in carry)], names=["doc_id", "nid", "n", "brings", "tokens", *carry])

    kept = docs.select("doc_id", "text", *carry)
    kind, also = kept.schema[0].dataType.simpleString(), "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema[2:])
    return kept.mapInArrow(run, f"doc_id {kind}, nid long, n long, brings boolean, tokens array<long>{also}")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(nid, n, tokens): the whole sets of the rows whose doc_id is wanted."""

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 256):
                found = [f for t in b.column("text").slice(i, 256) if len(f := shingle_set(t.as_py() or "", n))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64()), _flat(found)], names=["nid", "n", "tokens"])

    ids = wanted.select("doc_id").distinct()  # an inner join, since Spark would push a semi-join below the narrowing
    return narrowed(docs.select("doc_id", "text"), "doc_id", ids).join(ids, "doc_id").select("text").mapInArrow(run, "nid long, n long, tokens array<long>")


def counted(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(nid, token, df) of the tokens that two nodes of ``sets`` (nid, tokens) have or that are hot:
    df is then estimated. Without the hot ones no token has a large share of the rows."""
    part = sets.where(f"pmod(nid, {SAMPLE}) = 0")
    least = max(HOT_LEAST, int(HOT_SHARE * part.count()))
    hot = part.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen")).where(F.col("seen") >= least)
    hot = scratch.table(hot.orderBy(F.desc("seen"), "token").limit(MOST_HOT).select("token", (F.col("seen") * SAMPLE).alias("df")), "hot")
    rows = sets.select("nid", F.explode("tokens").alias("token")).join(F.broadcast(hot), "token", "left")  # at most MOST_HOT rows
    same = Window.partitionBy("token")
    rest = rows.where("df IS NULL").select("nid", "token", F.count("*").over(same).alias("df"), F.min("nid").over(same).alias("lo"), F.max("nid").over(same).alias("hi"))
    return rows.where("df IS NOT NULL").select("nid", "token", "df").unionByName(rest.where("lo <> hi").select("nid", "token", "df"))


def chosen(df: np.ndarray, size: int, percent: int) -> tuple[int, int]:
    """Prefix length and matches ``l`` of a node of ``size`` tokens whose shared ones have these counts."""
    least = -(-percent * size // 100)
    load = np.cumsum(df - 1.0)
    cost = [load[len(df) - least + l - 1] * (1 + VERIFY_COST / l**2) for l in range(1, min(MAX_MATCHES, least) + 1)]
    l = int(np.argmin(cost)) + 1
    return len(df) - least + l, l


def postings(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(nid, n, weight, l, tokens) of the nodes of ``sets`` with enough shared tokens (nid, token, df):
    the prefix, rarest first, and how many of it must match. A row of df 0 before them holds n."""

    def run(batches):
        held: list[np.ndarray] = []  # of one node, which may go on in the next batch

        def lists(rows):
            out, tokens = [], []
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            for r in np.split(rows, cuts):
                size = int(r[0, 2])
                r = r[r[:, 1] > 0]
                r = r[np.diff(r[:, 2], prepend=~r[:1, 2]) != 0]  # a repeated row brings its tokens twice
                if 100 * len(r) >= percent * size:
                    length, l = chosen(r[:, 1], size, percent)
                    out.append((int(r[0, 0]), size, int(r[:, 1].sum()), l))
                    tokens.append(r[:length, 2].view(np.uint64))
            c = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c), _flat(tokens)], names=["nid", "n", "weight", "l", "tokens"])

        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in ("nid", "df", "token")], 1)
            ends = np.flatnonzero(np.diff(rows[:, 0], prepend=held[0][0, 0] if held else rows[:1, 0]))
            if len(ends):
                yield lists(np.concatenate([*held, rows[: ends[-1]]]))
                held, rows = [], rows[ends[-1] :]
            held.append(rows)
        if held:
            yield lists(np.concatenate(held))

    sizes = sets.select("nid", F.col("n").alias("token"), F.lit(0).cast("long").alias("df"))
    rows = shared.unionByName(sizes).select("nid", "df", "token").repartition("nid").sortWithinPartitions("nid", "df", "token")
    return rows.mapInArrow(run, "nid long, n long, weight long, l long, tokens array<long>")


def clusters(posts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(nid, n, weight, cluster) of all nodes of ``posts``. A node's pointer goes to a heavier one, the
    one most of its prefix tokens have for heaviest holder; JUMPS doublings follow it."""
    rows = posts.select("nid", "n", "weight", F.explode("tokens").alias("token"))
    heaviest = rows.groupBy("token").agg(F.max(F.struct("weight", "nid", "n")).alias("c"), F.count("*").alias("k")).where("k > 1").select("token", F.col("c.nid").alias("hub"), F.col("c.n").alias("m"))
    votes = rows.select("nid", "n", "token").join(scratch.table(heaviest, "heaviest"), "token").where(f"nid <> hub AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    chosen = votes.groupBy("nid", "hub").agg(F.count("*").alias("votes")).groupBy("nid").agg(F.max(F.struct("votes", "hub")).alias("v")).select("nid", F.col("v.hub").alias("to"))
    at = scratch.table(posts.select("nid", "n", "weight").join(chosen, "nid", "left").withColumn("to", F.coalesce("to", "nid")), "pointers")
    for _ in range(JUMPS):
        further = at.select(F.col("nid").alias("to"), F.col("to").alias("next"))
        at = scratch.table(salted_join(at, further, ["to"], F.col("nid")).select("nid", "n", "weight", F.col("next").alias("to")), "pointers")
    return at.withColumnRenamed("to", "cluster")


def gathered(posts: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with clusters joined where that is cheaper: a cluster goes into a larger one if their
    common prefix tokens would form more than a part of all pairs between the two."""
    rows = posts.select("nid", "tokens").join(members.select("nid", "cluster"), "nid").select("cluster", F.explode("tokens").alias("token"))
    held = scratch.table(rows.groupBy("token", "cluster").agg(F.count("*").alias("k")), "held")
    top = held.groupBy("token").agg(F.max(F.struct("k", "cluster")).alias("top"), F.count("*").alias("many")).where("many > 1").select("token", F.col("top.k").alias("j"), F.col("top.cluster").alias("to"))
    pairs = held.join(scratch.table(top, "tops"), "token").where("cluster <> to").groupBy("cluster", "to").agg(F.sum(F.col("k") * F.col("j")).alias("pairs"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    costs = salted_join(pairs.join(size, "cluster"), size.select(F.col("cluster").alias("to"), F.col("size").alias("room")), ["to"], F.col("cluster"))
    costs = costs.where(f"struct(room, to) > struct(size, cluster) AND pairs * {PAIRS_SHARE} >= size * room")
    moves = scratch.table(costs.groupBy("cluster").agg(F.max(F.struct("pairs", "to")).alias("m")).select("cluster", F.col("m.to").alias("to")), "moves")
    onward = moves.select(F.col("cluster").alias("to"), F.col("to").alias("next"))
    moves = salted_join(moves, onward, ["to"], F.col("cluster"), "left").select("cluster", F.coalesce("next", "to").alias("to"))
    moves = scratch.table(moves, "moves")
    return scratch.table(salted_join(members, moves, ["cluster"], F.col("nid"), "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to"), "gathered")


def linked(nids: np.ndarray, tokens: list[np.ndarray], first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Enough links (node, smallest node of its part) of distinct nodes to connect each component among
    them, where only pairs with one of the places ``first`` are compared, in that order; the first
    is compared with all, later ones unless they are in its component by then."""
    sizes = np.array([len(t) for t in tokens])
    every, start = np.concatenate(tokens), np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(every, kind="stable")
    new = np.diff(every[order], prepend=every[order[:1]] - np.uint64(1)) != 0
    run = np.empty(len(every), np.int64)
    run[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(every))
    holders = np.repeat(np.arange(len(nids)), sizes)[order]
    part = np.arange(len(nids))
    hub = None
    for i in first.tolist():
        if hub is not None and part[i] == part[hub]:
            continue
        hub = i if hub is None else hub
        mine = run[start[i] : start[i + 1]]
        mine = mine[end[mine] - begin[mine] > 1]
        if 100 * len(mine) < percent * sizes[i]:
            continue
        both = np.bincount(np.concatenate([holders[begin[r] : end[r]] for r in mine]), minlength=len(nids))
        near = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
        labels = np.unique(np.append(part[near], part[i]))
        if len(labels) > 1:
            part[np.isin(part, labels)] = part[i]
    out = []
    for p in np.unique(part):
        members = nids[part == p]
        out += [(int(x), int(members.min())) for x in members if x != members.min()]
    return out


def _compared(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) within groups of rows (*keys, nid, rank, tokens): those with a rank are compared
    with all of their group, highest rank first. Groups are of bounded size."""

    def run(batches):
        key, nids, ranks, tokens = None, [], [], []

        def links():
            got = []
            if len(nids) > 1:
                kept = list({x: i for i, x in sorted(enumerate(nids), key=lambda p: (ranks[p[0]] is not None, -p[0]))}.values())
                who, rank = np.array([nids[i] for i in kept]), [ranks[i] for i in kept]
                first = np.array(sorted((i for i, r in enumerate(rank) if r is not None), key=lambda i: (-rank[i], nids[kept[i]])), np.int64)
                got = linked(who, [tokens[i] for i in kept], first, percent)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

        for b in batches:
            lists = b.column("tokens")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for j, r in enumerate(zip(*(b.column(k).to_pylist() for k in keys))):
                if r != key:
                    if len(nids) > 1:
                        yield links()
                    key, nids, ranks, tokens = r, [], [], []
                nids.append(b.column("nid")[j].as_py())
                ranks.append(b.column("rank")[j].as_py())
                tokens.append(values[at[j] : at[j + 1]].copy())
        yield links()

    rows = rows.select(*keys, "nid", "rank", "tokens")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def within(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) that connect every component inside each cluster of (nid, n, weight, cluster)."""
    blocks = lambda n, m: F.expr(f"bigint(ceil(greatest({n} / {BLOCK_TOKENS}D, {m} / {BLOCK_DOCS}D)))")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("all_n"), F.count("*").alias("m"), F.max(F.struct("weight", "nid")).alias("h")).where("m > 1")
    sizes = scratch.table(sizes.select("cluster", "m", F.col("h.nid").alias("hub"), blocks("all_n", "m").alias("k")), "clusters")
    of = salted_join(members, sizes, ["cluster"], F.col("nid")).withColumn("block", F.expr("pmod(xxhash64(nid), k)"))
    of = scratch.table(of.select("cluster", "nid", "n", "weight", "hub", "k", "block"), "members")
    whole = narrowed(sets.select("nid", "tokens"), "nid", of.select("nid"))
    hubs = of.where("nid = hub AND k > 1").select("cluster", "nid", "weight", F.explode(F.expr("filter(sequence(0L, k - 1), x -> x <> block)")).alias("block"))
    rows = of.select("cluster", "nid", "weight", "block").unionByName(hubs)
    links = scratch.table(_compared(rows.join(whole, "nid").withColumnRenamed("weight", "rank"), ["cluster", "block"], percent), "links")
    if not sizes.where("k > 1").limit(1).count():
        return links
    # clusters of several blocks: what the hub does not reach is compared with all other blocks
    labels = components(links, scratch)
    big = of.where("k > 1").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    heads = big.where("nid = hub").select("cluster", F.col("label").alias("head"))
    big = scratch.table(salted_join(big, heads, ["cluster"], F.col("nid")).withColumn("open", F.expr("label <> head")), "blocks")
    opens = big.where("open").groupBy("cluster").agg(blocks("sum(n)", "count(*)").alias("ko"))
    both = salted_join(big, opens, ["cluster"], F.col("nid"))
    left = both.where("open").select("cluster", F.expr("pmod(xxhash64(nid, 1), ko)").alias("i"), F.explode(F.expr("sequence(0L, k - 1)")).alias("j"), "nid", F.col("weight").alias("rank"))
    right = both.select("cluster", F.explode(F.expr("sequence(0L, ko - 1)")).alias("i"), F.col("block").alias("j"), "nid", F.lit(None).cast("long").alias("rank"))
    return links.unionByName(scratch.table(_compared(left.unionByName(right).join(whole, "nid"), ["cluster", "i", "j"], percent), "links"))


def across(posts: DataFrame, members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different clusters that share as many prefix tokens as a link needs.
    Of each token's clusters all but the largest are paired, with each other and with that."""
    rows = posts.select("nid", "n", "l", "tokens").join(members.select("nid", "cluster"), "nid").select("nid", "n", "l", "cluster", F.explode("tokens").alias("token"))
    major = rows.groupBy("token", "cluster").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "cluster")).alias("top"), F.count("*").alias("many")).where("many > 1")
    rows = scratch.table(rows.join(scratch.table(major.select("token", F.col("top.cluster").alias("major")), "major"), "token"), "open")
    right = rows.where("cluster <> major").select("token", F.col("nid").alias("b"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("cluster").alias("other"))
    least = lambda size: f"(({percent} * {size} + 99) div 100)"
    overlap = f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"
    need = F.expr(f"greatest(least(l, k), {overlap} - greatest({least('n')} - l, {least('m')} - k))")
    pairs = rows.withColumnRenamed("nid", "a").join(right, "token").where(f"cluster <> other AND (cluster = major OR a < b) AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})  # a pair comes either way round
    return pairs.groupBy("a", "b").agg(F.count("*").alias("hits"), F.first(need).alias("need")).where("hits >= need").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, x: narrowed(sets.select(F.col("nid").alias(k), F.col("tokens").alias(x)), k, pairs)
    full = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def link(docs: DataFrame, n: int = N, percent: int = PERCENT, scratch: Scratch | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. With columns in ``carry`` these too, and
    ``leads``: whether (doc_id, *carry) is the smallest of the row's component; true if it has none."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.table(hashed(docs, n, percent, carry), "prefixes")
    own = F.struct("doc_id", *carry)
    nodes = found.where("nid IS NOT NULL").groupBy("nid").agg(F.min(own).alias("own"), F.first("n").alias("n"), F.count_if("brings").alias("brought"), F.count("*").alias("copies"))

    hits = counted(found.where("brings").select("nid", "tokens"), scratch).groupBy("nid").agg(F.count("*").alias("hits"))
    need = f"greatest(1, ({SLACK} * n + 99) div 100 - 1)"
    open_nodes = scratch.table(nodes.join(hits, "nid").where(f"hits >= brought * {need}").select("nid", F.col("own.doc_id").alias("doc_id"), "n"), "candidates")
    sets = scratch.table(whole_sets(docs, open_nodes, n), "sets")
    posts = scratch.table(postings(sets, counted(sets, scratch), percent), "postings")
    members = gathered(posts, clusters(posts, scratch, percent), scratch)
    links = within(members, sets, scratch, percent)
    pairs = scratch.table(across(posts, members, scratch, percent), "pairs")
    labels = components(links.unionByName(verified(pairs, sets, percent)), scratch)
    scratch.drop(sets)

    # one row for each node with copies or links; all other rows stand alone
    known = nodes.select("nid", "own", "copies").join(labels.withColumnRenamed("node", "nid"), "nid", "left").where("copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "nid"))
    least = known.groupBy("label").agg(F.min("own").alias("least"))
    known = scratch.table(salted_join(known.select("nid", "label"), least, ["label"], F.col("nid")).select("nid", "least"), "components")
    out = salted_join(found.select("doc_id", "nid", "n", *carry), known, ["nid"], own, "left")
    leads = [*carry, F.coalesce(own == F.col("least"), F.lit(True)).alias("leads")] if carry else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"), *leads)
