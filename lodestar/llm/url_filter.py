"""URL filtering by listed rules and, beyond them, a path-template tree per host.

The distinct paths of a host are counted with the verdicts that rules give as labels, and a tree of templates
grows over them, segment by segment, as deep as paths branch. At a node, a segment stays a branch if it is the
only one or, with LEAST_PATHS paths or more, differs from its siblings: it holds more paths than they do on
average, other shares of blocked labels, or of paths that end there. All other siblings, among them segments that
vary from path to path, merge into '*'. A node of fewer paths takes what is left of them as '**'. A template is
rejected by the share of blocked labels under it, smoothed towards its parent's share, that towards the
grandparent's, and so on to the host and the whole table: one without labels goes by its nearest ancestor with
some.

All of it is DataFrame operations. Branches have several paths each and are few; what is joined with all paths is
they and the nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: (verdict, host, path) of the listed rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Paths of a branch, and labels for a test of their shares.
LEAST_PATHS, LEAST_LABELS = 5, 5
#: Standard deviations from which on a sibling differs.
DIFFERENT = 2.576
#: Labels that the parent's share counts for, and the share of blocked labels that rejects.
PRIOR_LABELS, REJECTED = 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for a url without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, else null; of equally long ones, block comes first."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(of + start).alias("rule"))).otherwise(found)
    return found


def _differs(part: Column, whole: Column, part_of: Column, whole_of: Column) -> Column:
    """Whether part of part_of is another share than whole of whole_of, by a test without a root or a division by zero."""
    share = F.try_divide(whole.cast("double"), whole_of)
    gap = part - part_of * share
    return F.coalesce(gap * gap > DIFFERENT**2 * part_of * share * (1 - share), F.lit(False))


def _smoothed(blocked: Column, labels: Column, towards: Column) -> Column:
    return (blocked + PRIOR_LABELS * towards) / (labels + PRIOR_LABELS)


def _grown(tree: DataFrame, level: int) -> DataFrame:
    """The open paths of the tree with their nodes one level deeper."""
    paths = tree.where(~F.col("done")).withColumn("segment", F.get("parts", F.lit(level)))
    sums = [F.sum(c).alias(c) for c in ("blocked", "labels")]
    siblings = paths.groupBy("host", "node", "segment").agg(F.count("*").alias("paths"), F.count_if(F.size("parts") == level + 1).alias("ends"), *sums, F.min("purity").alias("purity"))
    nodes = siblings.groupBy("host", "node").agg(F.count("*").alias("segments"), *(F.sum(c).alias(f"all_{c}") for c in ("paths", "ends", "blocked", "labels")), F.min("purity").alias("above"))
    mean = F.col("all_paths") / F.col("segments")
    more = F.col("paths") - mean
    stays = (
        (F.col("segments") == 1)
        | ((more > 0) & (more * more > DIFFERENT**2 * mean))
        | ((F.col("labels") >= LEAST_LABELS) & _differs(F.col("blocked"), F.col("all_blocked"), F.col("labels"), F.col("all_labels")))
        | _differs(F.col("ends"), F.col("all_ends"), F.col("paths"), F.col("all_paths"))
    )
    branches = siblings.where(F.col("paths") >= LEAST_PATHS).join(nodes, ["host", "node"]).where(stays)
    branches = saved(branches.select("host", "node", "segment", "paths", "blocked", "labels"), "branches")
    held = branches.groupBy("host", "node").agg(*(F.sum(c).alias(f"held_{c}") for c in ("paths", "blocked", "labels")))
    rest = [(F.col(f"all_{c}") - F.coalesce(F.col(f"held_{c}"), F.lit(0))).alias(f"rest_{c}") for c in ("paths", "blocked", "labels")]
    others = nodes.join(held, ["host", "node"], "left").select("host", "node", "above", *rest)
    own = branches.select("host", "node", "segment", F.lit(True).alias("stays"), *(F.col(c).alias(f"own_{c}") for c in ("paths", "blocked", "labels")))
    paths = paths.join(own, ["host", "node", "segment"], "left").join(others, ["host", "node"])
    of = {c: F.coalesce(F.col(f"own_{c}"), F.col(f"rest_{c}")) for c in ("paths", "blocked", "labels")}
    few, more_left = of["paths"] < LEAST_PATHS, F.size("parts") > level + 1
    node = F.concat("node", F.lit("/"), F.when(F.col("stays"), F.col("segment")).otherwise("*"), F.when(few & more_left, "/**").otherwise(""))
    return paths.select("host", "path", "parts", "blocked", "labels", node.alias("node"), _smoothed(of["blocked"], of["labels"], F.col("above")).alias("purity"), (few | ~more_left).alias("done"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, method) for urls of (host, path, label): template of each path, and the method's verdict."""
    counted = urls.groupBy("host", "path").agg(F.count_if(F.col("label") == "block").alias("blocked"), F.count("label").alias("labels"))
    counted = saved(counted, "paths")
    total = counted.agg(F.coalesce(F.try_divide(F.sum("blocked").cast("double"), F.sum("labels")), F.lit(0.0)).alias("p"))
    hosts = counted.groupBy("host").agg(F.count("*").alias("paths"), F.sum("blocked").alias("b"), F.sum("labels").alias("l"))
    hosts = hosts.select("host", "paths", _smoothed(F.col("b"), F.col("l"), total.scalar()).alias("purity"))
    few = F.col("paths") < LEAST_PATHS
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    tree = counted.join(hosts, "host").select("host", "path", parts.alias("parts"), "blocked", "labels", F.when(few, "/**").otherwise("").alias("node"), "purity", few.alias("done"))
    closed, level = [], 0
    while True:
        closed.append(tree.where("done"))
        if tree.where("NOT done").isEmpty():
            break
        tree = saved(_grown(tree, level), "tree")
        level += 1
    method = F.when(F.col("purity") >= REJECTED, "block").otherwise("allow")
    return reduce(DataFrame.unionByName, closed).select("host", "path", F.col("node").alias("template"), method.alias("method"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict (the rule's, else the template's), template.

    A null url and one without '://' have an empty host and path and are judged as such; repeated rows are
    judged each and count as labels each, but as one path; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("found", found).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("label"))
    return urls.join(templates(urls), ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template")


#: Levels of the tree that oracle_sql() writes out; it is for tables whose trees are no deeper.
SQL_LEVELS = 6


def oracle_sql() -> str:
    """DuckDB SQL with judge()'s rows over `pages`."""

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}')"

    def differs(part: str, whole: str, part_of: str, whole_of: str) -> str:
        share = f"(CAST({whole} AS DOUBLE) / nullif({whole_of}, 0))"
        gap = f"({part} - {part_of} * {share})"
        return f"coalesce({gap} * {gap} > {z} * {part_of} * {share} * (1 - {share}), false)"

    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "block"), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    label = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    k, z = f"CAST({PRIOR_LABELS} AS DOUBLE)", f"CAST({DIFFERENT**2!r} AS DOUBLE)"
    mean = "(CAST(x.paths AS DOUBLE) / x.segments)"
    steps = ""
    for level in range(SQL_LEVELS):
        steps += f"""
o{level} AS (SELECT *, parts[{level + 1}] AS segment, len(parts) > {level + 1} AS more FROM t{level} WHERE NOT done),
g{level} AS (SELECT host, node, segment, count(*) AS paths, count(*) FILTER (NOT more) AS ends, sum(b) AS b, sum(l) AS l, min(p) AS p FROM o{level} GROUP BY host, node, segment),
x{level} AS (SELECT host, node, count(*) AS segments, sum(paths) AS paths, sum(ends) AS ends, sum(b) AS b, sum(l) AS l, min(p) AS p FROM g{level} GROUP BY host, node),
k{level} AS (SELECT g.* FROM g{level} g JOIN x{level} x ON g.host = x.host AND g.node = x.node WHERE g.paths >= {LEAST_PATHS} AND (x.segments = 1
  OR (g.paths > {mean} AND (g.paths - {mean}) * (g.paths - {mean}) > {z} * {mean})
  OR (g.l >= {LEAST_LABELS} AND {differs("g.b", "x.b", "g.l", "x.l")}) OR {differs("g.ends", "x.ends", "g.paths", "x.paths")})),
h{level} AS (SELECT host, node, sum(paths) AS paths, sum(b) AS b, sum(l) AS l FROM k{level} GROUP BY host, node),
r{level} AS (SELECT x.host, x.node, x.p, x.paths - coalesce(h.paths, 0) AS paths, x.b - coalesce(h.b, 0) AS b, x.l - coalesce(h.l, 0) AS l FROM x{level} x LEFT JOIN h{level} h ON x.host = h.host AND x.node = h.node),
j{level} AS (SELECT o.host, o.path, o.parts, o.b, o.l, o.more, o.node || '/' || CASE WHEN k.paths IS NULL THEN '*' ELSE o.segment END AS node, coalesce(k.paths, r.paths) < {LEAST_PATHS} AS few, (coalesce(k.b, r.b) + {k} * r.p) / (coalesce(k.l, r.l) + {k}) AS p
  FROM o{level} o LEFT JOIN k{level} k ON o.host = k.host AND o.node = k.node AND o.segment = k.segment JOIN r{level} r ON o.host = r.host AND o.node = r.node),
t{level + 1} AS (SELECT host, path, parts, b, l, node || CASE WHEN few AND more THEN '/**' ELSE '' END AS node, p, few OR NOT more AS done FROM j{level}),"""
    closed = " UNION ALL ".join(f"SELECT host, path, node, p FROM t{level} WHERE done" for level in range(SQL_LEVELS + 1))
    return f"""
WITH q AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
j AS (SELECT *, {rule} AS rule, {label} AS label FROM u),
c AS (SELECT host, path, count(*) FILTER (label = 'block') AS b, count(label) AS l FROM j GROUP BY host, path),
w AS (SELECT coalesce(CAST(sum(b) AS DOUBLE) / nullif(sum(l), 0), 0) AS p FROM c),
h AS (SELECT host, count(*) AS paths, (sum(b) + {k} * (SELECT p FROM w)) / (sum(l) + {k}) AS p FROM c GROUP BY host),
t0 AS (SELECT c.host, c.path, string_split(substr(c.path, 2), '/') AS parts, c.b, c.l, CASE WHEN h.paths < {LEAST_PATHS} THEN '/**' ELSE '' END AS node, h.p, h.paths < {LEAST_PATHS} AS done FROM c JOIN h ON c.host = h.host),{steps}
v AS ({closed})
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.label, CASE WHEN v.p >= {REJECTED} THEN 'block' ELSE 'allow' END) AS verdict, v.node AS template
FROM j LEFT JOIN v ON j.host = v.host AND j.path = v.path
"""
