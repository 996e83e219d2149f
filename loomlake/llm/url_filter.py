"""URL verdicts from rules and a per-host tree of path templates, in DataFrame functions only.

Rules decide first. Pages they decide label the templates of their own paths: segments that
look variable (numbers, dates, hex ids, long slugs) become wildcards; under a parent with more
than ``max_children`` different segments, at any depth, each rare one becomes ``*``. Sibling
templates of one host and parent with labelled pages, whose share of allowed pages does not
differ significantly from that of the other ones, are merged: their labels count together.

A page that no rule fits is blocked where the smoothed purity of its branch is below
``min_purity``. Purity is taken down the tree of templates over all hosts, from the share of
allowed pages among all labelled ones (plus one of each) through the first segment to the
template, and then to the branch of the host itself: at each node (allowed + weight * purity
above) / (labelled + weight). So a branch without labels has the purity of its template
elsewhere, and a template that is labelled nowhere that of its closest labelled ancestor.

A null url, or one without ``://``, has empty host and path and template '/'. Repeated rows
each get their own row; an empty table gives an empty result; paths may be of any length. Other
columns pass through, but for those named host, path, rule, verdict, template or purity, which
are replaced; names starting with ``_u`` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MAX_CHILDREN, RARE_SHARE, WEIGHT, MIN_PURITY, Z = 64, 0.01, 4.0, 0.3, 1.96

#: Variable segments, first match wins; a file ending such as .html stays.
VARIABLE = [("^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", "{date}"), ("^[0-9]+", "{n}"), ("^[0-9a-f]*[0-9][0-9a-f]{7,}", "{hex}"), ("^[A-Za-z0-9]+([-_][A-Za-z0-9]+){3,}", "{slug}")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.coalesce(rest, F.lit("")), F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct of (verdict, rule), else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def generalised(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(VARIABLE):
        out = F.when(F.regexp_extract(segment, pattern, 0) != "", F.concat(F.lit(name), F.regexp_extract(segment, r"\.[a-z]{1,5}$", 0))).otherwise(out)
    return out


def _widened(leaves: DataFrame, max_children: int, rare_share: float) -> DataFrame:
    """``leaves`` with ``template``: rare segments under parents with too many children as ``*``. What is
    rare is told from the paths as they are, so that all levels are widened at once."""
    at = leaves.select("host", "_u_raw", "n", "segs", F.posexplode("segs").alias("i", "seg")).withColumn("parent", F.expr("array_join(slice(segs, 1, i), '/')")).drop("segs")
    kids = at.groupBy("host", "parent", "i", "seg").agg(F.sum("n").alias("kn"))
    wide = kids.groupBy("host", "parent", "i").agg(F.count("*").alias("kids"), F.sum("kn").alias("all_n")).where(F.col("kids") > max_children)
    rare = kids.join(wide, ["host", "parent", "i"]).where(F.col("kn") < rare_share * F.col("all_n")).select("host", "parent", "i", "seg")
    places = at.join(rare, ["host", "parent", "i", "seg"]).groupBy("host", "_u_raw").agg(F.collect_set("i").alias("stars"))
    out = leaves.join(places, ["host", "_u_raw"], "left")
    return out.withColumn("template", F.expr("concat('/', array_join(transform(segs, (x, i) -> CASE WHEN array_contains(stars, i) THEN '*' ELSE x END), '/'))")).drop("segs", "stars")


def _merged(branches: DataFrame, z: float) -> DataFrame:
    """``branches`` (host, template, lab, ok) with the labels they count with, ``pool_lab`` and ``pool_ok``."""
    b = branches.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    family = b.groupBy("host", "parent").agg(F.sum("lab").alias("all_lab"), F.sum("ok").alias("all_ok"))
    b = b.join(family, ["host", "parent"])
    rest, rest_ok = F.col("all_lab") - F.col("lab"), F.col("all_ok") - F.col("ok")
    share = F.col("all_ok") / F.col("all_lab")
    gap = F.abs(F.col("ok") / F.col("lab") - rest_ok / rest)
    alike = gap <= z * F.sqrt(share * (1 - share) * (1 / F.col("lab") + 1 / rest))
    b = b.withColumn("merged", F.when((F.col("lab") > 0) & (rest > 0), alike).otherwise(F.lit(False)))
    pools = b.where("merged").groupBy("host", "parent", "merged").agg(F.sum("lab").alias("p_lab"), F.sum("ok").alias("p_ok"))
    b = b.join(pools, ["host", "parent", "merged"], "left")
    return b.select("host", "template", F.coalesce("p_lab", "lab").alias("pool_lab"), F.coalesce("p_ok", "ok").alias("pool_ok"))


def _elsewhere(branches: DataFrame, weight: float) -> DataFrame:
    """(template, above): purity of each template over all hosts, smoothed down from the root."""
    whole = branches.groupBy("template").agg(F.sum("lab").alias("lab"), F.sum("ok").alias("ok"))
    above = F.expr("transform(sequence(1, size(split(template, '/')) - 1), d -> struct(d AS depth, array_join(slice(split(template, '/'), 1, d + 1), '/') AS node))")
    steps = whole.select("template", "lab", "ok", F.explode(above).alias("at")).select("template", "lab", "ok", "at.depth", "at.node")
    nodes = steps.groupBy("node").agg(F.sum("lab").alias("node_lab"), F.sum("ok").alias("node_ok"))
    prior = whole.agg(((F.sum("ok") + 1) / (F.sum("lab") + 2)).alias("prior"))
    chains = steps.join(nodes, "node").groupBy("template").agg(F.sort_array(F.collect_list(F.struct("depth", "node_lab", "node_ok"))).alias("chain"))
    down = F.expr(f"aggregate(chain, prior, (p, x) -> (x.node_ok + {weight}D * p) / (x.node_lab + {weight}D))")
    return chains.join(F.broadcast(prior)).select("template", down.alias("above"))  # one row


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", max_children: int = MAX_CHILDREN, rare_share: float = RARE_SHARE, weight: float = WEIGHT, min_purity: float = MIN_PURITY, z: float = Z) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, verdict, template and purity."""
    if taken := [c for c in pages.columns if c.startswith("_u")]:
        raise ValueError(f"columns named {taken}: names starting with _u are reserved")
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict", "template", "purity")
    rows = rows.withColumn("_u_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_u_raw", F.array_join(F.transform(F.split(F.col("path"), "/"), generalised), "/"))
    leaves = (
        rows.groupBy("host", "_u_raw")
        .agg(F.count("*").alias("n"), F.count("_u_rule").alias("lab"), F.count_if(F.col("_u_rule.verdict") == "allow").alias("ok"))
        .withColumn("segs", F.split(F.regexp_replace("_u_raw", "^/", ""), "/"))
    )
    scratch = Scratch(pages.sparkSession)
    leaves = scratch.table(_widened(scratch.table(leaves, "leaves"), max_children, rare_share), "templates")
    branches = scratch.table(leaves.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("ok").alias("ok")), "branches")
    b = _merged(branches, z).join(_elsewhere(branches, weight), "template")
    b = b.withColumn("purity", (F.col("pool_ok") + weight * F.col("above")) / (F.col("pool_lab") + weight))
    verdicts = scratch.table(leaves.select("host", "_u_raw", "template").join(b.select("host", "template", "purity"), ["host", "template"]), "verdicts")
    out = salted_join(rows, verdicts, ["host", "_u_raw"], F.col(url), "left")
    return out.withColumns({"rule": F.col("_u_rule.rule"), "verdict": F.coalesce(F.col("_u_rule.verdict"), F.when(F.col("purity") < min_purity, "block").otherwise("allow"))}).drop("_u_rule", "_u_raw")


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


def oracle(pages: str = "pages") -> str:
    def fits(rule: str) -> str:
        h, _, p = rule.partition("/")
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"

    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ordered) + " END"
    seg = "CASE " + " ".join(f"WHEN regexp_extract(s, '{p}', 0) <> '' THEN '{n}' || regexp_extract(s, '\\.[a-z]{{1,5}}$', 0)" for p, n in VARIABLE) + " ELSE s END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM {pages}),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0) AS raw_host, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, translate(raw_host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0) AS path FROM h),
q AS (SELECT *, {rule} AS rule FROM p),
v AS (SELECT *, {verdict} AS rv, array_to_string(list_transform(string_split(path, '/'), lambda s: {seg}), '/') AS raw FROM q),
t0 AS (SELECT host, raw, count(*) AS n, count(rv) AS lab, count(*) FILTER (rv = 'allow') AS ok, string_split(regexp_replace(raw, '^/', ''), '/') AS segs FROM v GROUP BY host, raw),
pos AS (SELECT host, raw, n, i, array_to_string(segs[1:i - 1], '/') AS parent, segs[i] AS seg FROM (SELECT *, unnest(generate_series(1, len(segs))) AS i FROM t0)),
kids AS (SELECT host, parent, i, seg, sum(n) AS kn FROM pos GROUP BY ALL),
wide AS (SELECT host, parent, i, sum(kn) AS all_n FROM kids GROUP BY ALL HAVING count(*) > {MAX_CHILDREN}),
rare AS (SELECT host, parent, i, seg FROM kids JOIN wide USING (host, parent, i) WHERE kn < {RARE_SHARE}::DOUBLE * all_n),
leaf AS (SELECT host, raw, any_value(lab) AS lab, any_value(ok) AS ok, '/' || string_agg(s, '/' ORDER BY i) AS template FROM (
  SELECT t.host, t.raw, t.lab, t.ok, pos.i, CASE WHEN rare.seg IS NULL THEN pos.seg ELSE '*' END AS s
  FROM t0 t JOIN pos USING (host, raw) LEFT JOIN rare ON rare.host = pos.host AND rare.parent = pos.parent AND rare.i = pos.i AND rare.seg = pos.seg) GROUP BY host, raw),
b AS (SELECT host, template, regexp_replace(template, '/[^/]*$', '') AS parent, sum(lab) AS lab, sum(ok) AS ok FROM leaf GROUP BY ALL),
b2 AS (SELECT *, sum(lab) OVER (PARTITION BY host, parent) AS hl, sum(ok) OVER (PARTITION BY host, parent) AS ho FROM b),
b3 AS (SELECT *, CASE WHEN lab > 0 AND hl - lab > 0 THEN abs(ok / lab - (ho - ok) / (hl - lab)) <= {Z} * sqrt(greatest(0, (ho / hl) * (1 - ho / hl)) * (1 / lab + 1 / (hl - lab))) ELSE false END AS merged FROM b2),
b4 AS (SELECT *, CASE WHEN merged THEN sum(lab) OVER (PARTITION BY host, parent, merged) ELSE lab END AS pl, CASE WHEN merged THEN sum(ok) OVER (PARTITION BY host, parent, merged) ELSE ok END AS po FROM b3),
step AS (SELECT template, lab, ok, d, array_to_string(string_split(template, '/')[1:d + 1], '/') AS node FROM (SELECT *, unnest(generate_series(1, len(string_split(template, '/')) - 1)) AS d FROM b)),
node AS (SELECT node, d, regexp_replace(node, '/[^/]*$', '') AS parent, sum(lab) AS lab, sum(ok) AS ok FROM step GROUP BY ALL),
down AS (SELECT '' AS node, 0 AS d, ((SELECT sum(ok) FROM b) + 1) / ((SELECT sum(lab) FROM b) + 2)::DOUBLE AS p
  UNION ALL SELECT n.node, n.d, (n.ok + {WEIGHT} * down.p) / (n.lab + {WEIGHT})::DOUBLE FROM node n JOIN down ON n.parent = down.node AND n.d = down.d + 1),
b5 AS (SELECT host, template, (po + {WEIGHT} * down.p) / (pl + {WEIGHT}) AS purity FROM b4 JOIN down ON down.node = template AND down.d = len(string_split(template, '/')) - 1)
SELECT page_id, v.host, path, rule, coalesce(rv, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity::DOUBLE, 6) AS purity
FROM v JOIN leaf USING (host, raw) JOIN b5 USING (host, template)
"""
