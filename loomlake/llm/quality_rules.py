"""Quality rules and cross-document line frequency, in DataFrame functions only.

Lines are normalised (ASCII lower case, digits to 0, runs of white space to one
space) and hashed. Per host, each distinct text counts once for each of its
lines; a line found in more texts than the limit is boilerplate and is removed.
The limit is the larger of ``min_docs`` and ``doc_share`` of the host's distinct
texts. A document left with less than ``keep_share`` of its words is rejected,
as is one that fails the base rules.

A null text has no words (and fails the base rules); a null host is a host of its
own. Repeated rows count once and all get the same verdict. Other columns pass
through; names starting with ``_q`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, content_key, let

MIN_DOCS, DOC_SHARE, KEEP_SHARE = 30, 0.001, 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = WORD_GAP.replace("\\", "\\\\")
WORDS = f"array_remove(split(t, '{GAP}'), '')"
BLANKS = "' \\t\\n\\u000b\\u000c\\r'"

#: Words covered by three-word windows that occur twice or more: where hashes of windows are not
#: distinct, sort them with their positions, keep those equal to a neighbour, and measure the union
#: of the windows.
REPEATED = let(
    "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))",
    "h",
    "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
    + let(
        "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))",
        "s",
        let(
            "sort_array(transform(filter(s, (e, j) -> e.h = get(s, j - 1).h OR e.h = get(s, j + 1).h), e -> e.i))",
            "p",
            "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, b) -> a + b)",
        ),
    )
    + " END",
)
DUPLICATE_LINES = let(f"filter(split(t, '\\n', -1), x -> ltrim({BLANKS}, x) <> '')", "l", "size(l) - size(array_distinct(l))")


def base_measures(text: str = "text") -> dict[str, Column]:
    """The contract's counts, as columns over ``text``."""
    over = lambda sql: F.expr(let(f"coalesce({text}, '')", "t", sql))
    words = over(let(WORDS, "w", f"struct(bigint(size(w)) AS n, bigint(length(array_join(w, ''))) AS c, bigint({REPEATED}) AS r)"))
    return {
        "_q_words": words,
        "n_symbols": over("bigint(regexp_count(t, '[#*$%&|<>]'))"),
        "n_dup_lines": over(f"bigint({DUPLICATE_LINES})"),
    }


def normalised(line: Column) -> Column:
    ascii_only = F.octet_length(line) == F.length(line)  # translate takes each character by itself
    lower = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, "[0-9]", "0"), WORD_GAP, " "))


def line_removals(docs: DataFrame, host: str, text: str, min_docs: int, doc_share: float) -> DataFrame:
    """(_q_host, ck1, ck2, removed): for each distinct text with boilerplate, its removed lines
    as an array of (position, words)."""
    keyed = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("\u0000")).alias("_q_host"), *content_key(F.col(text)), F.coalesce(text, F.lit("")).alias("t"))
    lines = (
        keyed.select("_q_host", "ck1", "ck2", F.posexplode(F.expr("split(t, '\\n', -1)")).alias("pos", "line"))
        .select("_q_host", "ck1", "ck2", "pos", normalised(F.col("line")).alias("line"))
        .where("line <> ''")
        .select("_q_host", "ck1", "ck2", "pos", F.xxhash64("line").alias("lh"), (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("words"))
    )
    each = lines.groupBy("_q_host", "lh", "ck1", "ck2").agg(F.lit(1).alias("one"))
    limits = keyed.groupBy("_q_host", "ck1", "ck2").agg(F.lit(1).alias("one")).groupBy("_q_host").agg(F.greatest(F.lit(min_docs), F.ceil(F.count("*") * doc_share)).alias("most"))
    common = each.groupBy("_q_host", "lh").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).join(limits, "_q_host").where("n > most").select("_q_host", "lh")
    return lines.join(common, ["_q_host", "lh"]).groupBy("_q_host", "ck1", "ck2").agg(F.collect_set(F.struct("pos", "words")).alias("removed"))


def _judged(docs: DataFrame, host: str, text: str, min_docs: int, doc_share: float, keep_share: float) -> DataFrame:
    """Every row of ``docs`` without its text, with its counts, verdict and ``_q`` keys."""
    removals = line_removals(docs, host, text, min_docs, doc_share)
    left = keyed(docs, host, text).withColumns(base_measures(text)).drop(text)
    removals = removals.select("_q_host", F.col("ck1").alias("_q_ck1"), F.col("ck2").alias("_q_ck2"), F.col("removed").alias("_q_removed"))
    out = left.join(removals, KEYS, "left").withColumns(
        {
            "n_words": F.col("_q_words.n"),
            "word_chars": F.col("_q_words.c"),
            "n_repeat_words": F.col("_q_words.r"),
            "n_removed_lines": F.expr("bigint(coalesce(size(_q_removed), 0))"),
            "n_removed_words": F.expr("aggregate(coalesce(_q_removed, array()), 0L, (a, x) -> a + x.words)"),
        }
    )
    out = out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.expr(f"n_removed_words > 0 AND n_words - n_removed_words < {keep_share}D * n_words"))


KEYS = ["_q_host", "_q_ck1", "_q_ck2"]


def keyed(docs: DataFrame, host: str, text: str) -> DataFrame:
    return docs.withColumns(dict(zip(KEYS[1:], content_key(F.col(text)))) | {"_q_host": F.coalesce(F.col(host).cast("string"), F.lit("\u0000"))})


def judge(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Every row of ``docs`` without its text, with the base counts, base_failed, n_removed_lines,
    n_removed_words and kept."""
    return _judged(docs, host, text, min_docs, doc_share, keep_share).drop(*KEYS, "_q_removed", "_q_words")


def clean(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The kept rows of ``docs``, their texts without the removed lines. A verdict depends on host
    and text alone, so it is reduced to one row for each before texts are joined to it; a plain
    filter would be pushed down and count every text again."""
    given = docs.select(host, text) if host != text else docs.select(text)
    verdicts = _judged(given, host, text, min_docs, doc_share, keep_share).groupBy(*KEYS).agg(F.bool_or("kept").alias("_q_kept"), F.first("_q_removed").alias("_q_removed")).where("_q_kept")
    rest = let(f"split(coalesce({text}, ''), '\\n', -1)", "l", "array_join(transform(array_except(sequence(0, size(l) - 1), transform(_q_removed, x -> x.pos)), i -> get(l, i)), '\\n')")
    rows = keyed(docs, host, text).join(verdicts, KEYS)
    return rows.withColumn(text, F.when(F.col("_q_removed").isNotNull(), F.expr(rest)).otherwise(F.col(text))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "source", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


#: For DuckDB: the same over the table ``documents`` (an expression for it may be given).
def oracle(documents: str = "documents") -> str:
    gap, blanks = "[ \\t-\\r]+", "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM {documents}),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
raw AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE translate(line, {blanks}, '') <> '' GROUP BY r),
nl AS (SELECT r, host, t, trim(regexp_replace(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '{gap}', ' ', 'g'), ' ') AS line FROM raw),
lim AS (SELECT host, greatest({MIN_DOCS}, ceil(count(DISTINCT t) * {DOC_SHARE}::DOUBLE)) AS most FROM d GROUP BY host),
common AS (SELECT host, line FROM nl JOIN lim USING (host) WHERE line <> '' GROUP BY host, line, most HAVING count(DISTINCT t) > most),
rem AS (SELECT r, count(*) AS n, sum(length(line) - length(replace(line, ' ', '')) + 1) AS words FROM nl JOIN common USING (host, line) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(rem.words, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN rem USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_words > 0 AND n_words - n_removed_words < {KEEP_SHARE}::DOUBLE * n_words) AS kept, n_removed_lines, n_removed_words FROM f
"""
