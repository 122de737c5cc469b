"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity. DataFrame operations alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

#: (verdict, host, path) of each rule; a child under one in RARE of its parent's urls is variable; labelled urls a branch needs to be
#: compared with others; squared deviation beyond which two blocked shares differ (5 % by chance); weight of a parent's purity.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
RARE, LABELLED, DIFFERENT, PRIOR = 50, 20, 3.841, 4
#: Levels that the SQL spells out; the operator goes as deep as the paths.
SQL_LEVELS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end); both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path as one text) that fits, and its verdict; null without one.

    A rule fits its host and all subdomains if the path starts with the rule's. The rules are a short list, tried from the longest.
    """
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grown(live: DataFrame, depth: int) -> DataFrame:
    """live (host, shape, parts, n, nb, nl, template), one segment deeper.

    Rare children become *. Of the others (at most RARE a node) those with enough labels are ordered by their smoothed blocked share; each is
    compared with the one before it by a test of two proportions, and runs without a difference are one branch {number of the run}.
    """
    s = F.when(F.size("parts") > depth, F.element_at("parts", depth + 1)).otherwise("$")
    live = live.withColumn("s", s)
    sums = [F.sum(c).alias(c) for c in ("n", "nb", "nl")]
    child = live.groupBy("host", "template", "s").agg(*sums)
    parent = child.groupBy("host", "template").agg(*[F.sum(c).alias(f"p{c}") for c in ("n", "nb", "nl")])
    child = child.join(parent, ["host", "template"]).withColumn("rare", F.col("n") * RARE < F.col("pn"))
    told = child.where(~F.col("rare") & (F.col("nl") >= LABELLED))
    smooth = (F.col("nb") + 2 * (F.col("pnb") + 1) / (F.col("pnl") + 2)) / (F.col("nl") + 2)
    order = Window.partitionBy("host", "template").orderBy(smooth, "s")
    told = told.withColumn("nb0", F.lag("nb").over(order)).withColumn("nl0", F.lag("nl").over(order))
    pooled = (F.col("nb") + F.col("nb0")) / (F.col("nl") + F.col("nl0"))
    apart = F.pow(F.col("nb") / F.col("nl") - F.col("nb0") / F.col("nl0"), 2) > DIFFERENT * pooled * (1 - pooled) * (1 / F.col("nl") + 1 / F.col("nl0"))
    told = told.withColumn("run", F.sum(F.when(F.col("nb0").isNull() | apart, 1).otherwise(0)).over(order))
    together = F.count("*").over(Window.partitionBy("host", "template", "run"))
    runs = told.withColumn("together", together).where("together > 1").select("host", "template", "s", "run")
    label = F.when(F.col("rare"), "*").when(F.col("run").isNotNull(), F.concat(F.lit("{"), F.col("run").cast("string"), F.lit("}"))).otherwise(F.col("s"))
    named = child.select("host", "template", "s", "rare").join(runs, ["host", "template", "s"], "left").select("host", "template", "s", label.alias("label"))
    grown = live.join(named, ["host", "template", "s"])
    grown = grown.select("host", "shape", "parts", "n", "nb", "nl", F.concat("template", F.lit("/"), "label").alias("template"))
    # below a node of one shape there is nothing to generalise or compare: the rest of its path stands as it is
    alone = grown.groupBy("host", "template").agg(F.count("*").alias("shapes")).where("shapes = 1").select("host", "template", F.lit(True).alias("alone"))
    grown = grown.join(alone, ["host", "template"], "left").withColumn("over", F.col("alone").isNotNull() | (F.size("parts") == depth))
    rest = F.array_join(F.concat(F.slice("parts", F.lit(depth + 2), F.size("parts")), F.array(F.lit("$"))), "/")
    return grown.withColumn("template", F.when(F.col("alone") & (F.size("parts") > depth), F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))).drop("alone")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity.

    Urls that a rule decides are the labels. Urls are counted by host and shape (the path with digits as N); level by level, as deep as
    paths go, a node turns its rare children into * and joins those whose blocked shares do not differ (see _grown). $ ends a path. A
    template's purity is its blocked share, drawn to its host's, which is drawn to that of the template on all hosts, drawn to the whole;
    0.5 or more blocks what no rule decides. A null url, or one without ://, has an empty host and path and is a template like any other;
    of equal shares the lesser segment comes first; repeated rows count each; an empty table gives no rows; a long path costs a job for
    each segment that it shares with another. Counts are combined before they are shuffled, so a host with a third of all pages costs no more than another.
    Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    base = pick(pages, "page_id", "url").withColumn("url", F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", name.alias("rule"), verdict.alias("decided"), F.regexp_replace("path", "[0-9]+", "N").alias("shape"))
    counts = [F.count("*").alias("n"), F.count_if(F.col("decided") == "block").alias("nb"), F.count_if(F.col("decided").isNotNull()).alias("nl")]
    live = base.groupBy("host", "shape").agg(*counts).select("host", "shape", F.split("shape", "/", -1).alias("parts"), "n", "nb", "nl", F.lit("").alias("template"))
    live, depth, done = materialize(live, "shapes"), 0, []
    while True:
        depth += 1
        grown = materialize(_grown(live, depth), "tree")
        done.append(grown.where("over").drop("parts", "over"))
        live = grown.where("not over").drop("over")
        if not live.limit(1).count():
            break
    tree = functools.reduce(DataFrame.union, done)
    labels = [F.sum("nb").alias("b"), F.sum("nl").alias("l")]
    of_all = tree.agg(F.sum("nb").alias("ab"), F.sum("nl").alias("al"))
    whole = F.col("ab") / F.greatest("al", F.lit(1))
    of_path = tree.groupBy("template").agg(*labels).crossJoin(F.broadcast(of_all)).select("template", ((F.col("b") + PRIOR * whole) / (F.col("l") + PRIOR)).alias("by_path"))  # one row of sums
    of_host = tree.groupBy("host").agg(F.sum("nb").alias("hb"), F.sum("nl").alias("hl"))
    own = tree.groupBy("host", "template").agg(*labels).join(of_path, "template").join(of_host, "host")
    by_host = (F.col("hb") + PRIOR * F.col("by_path")) / (F.col("hl") + PRIOR)
    own = own.select("host", "template", F.round((F.col("b") + PRIOR * by_host) / (F.col("l") + PRIOR), 6).alias("purity"))
    judged = materialize(tree.select("host", "shape", "template").join(own, ["host", "template"]), "purity")
    out = base.join(judged, ["host", "shape"])
    final = F.coalesce("decided", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "template", "purity")


def judge_sql() -> str:
    """The same as SQL over a view of pages."""
    rule = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rule]
    name = " ".join(f"{f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rule, strict=True))
    kind = " ".join(f"{f} THEN '{k}'" for f, (k, _, _) in zip(fits, rule, strict=True))
    sql = f"""
WITH rests AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
base AS (SELECT *, CASE {name} END AS rule, CASE {kind} END AS decided, regexp_replace(path, '[0-9]+', 'N', 'g') AS shape FROM split),
tree0 AS (SELECT host, shape, string_split(shape, '/') AS parts, count(*) AS n, count(*) FILTER (WHERE decided = 'block') AS nb, count(decided) AS nl, '' AS template FROM base GROUP BY ALL)"""
    for d in range(1, SQL_LEVELS + 1):
        sql += f""",
live{d} AS (SELECT *, CASE WHEN len(parts) > {d} THEN parts[{d + 1}] ELSE '$' END AS s FROM tree{d - 1} WHERE len(parts) >= {d}),
child{d} AS (SELECT host, template, s, CAST(sum(n) AS BIGINT) AS n, CAST(sum(nb) AS BIGINT) AS nb, CAST(sum(nl) AS BIGINT) AS nl FROM live{d} GROUP BY ALL),
both{d} AS (SELECT *, sum(n) OVER w AS pn, sum(nb) OVER w AS pnb, sum(nl) OVER w AS pnl FROM child{d} WINDOW w AS (PARTITION BY host, template)),
told{d} AS (SELECT *, lag(nb) OVER w AS nb0, lag(nl) OVER w AS nl0, (nb + 2 * (pnb + 1) / (pnl + 2)) / (nl + 2) AS smooth FROM both{d} WHERE n * {RARE} >= pn AND nl >= {LABELLED}
    WINDOW w AS (PARTITION BY host, template ORDER BY (nb + 2 * (pnb + 1) / (pnl + 2)) / (nl + 2), s)),
apart{d} AS (SELECT *, nb0 IS NULL OR power(nb / nl - nb0 / nl0, 2) > {DIFFERENT}::DOUBLE * ((nb + nb0) / (nl + nl0)) * (1 - (nb + nb0) / (nl + nl0)) * (1 / nl + 1 / nl0) AS apart FROM told{d}),
run{d} AS (SELECT *, CAST(sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY smooth, s) AS BIGINT) AS run FROM apart{d}),
together{d} AS (SELECT host, template, s, run, count(*) OVER (PARTITION BY host, template, run) AS together FROM run{d}),
named{d} AS (SELECT b.host, b.template, b.s, CASE WHEN b.n * {RARE} < b.pn THEN '*' WHEN r.together > 1 THEN '{{' || CAST(r.run AS VARCHAR) || '}}' ELSE b.s END AS label FROM both{d} b LEFT JOIN together{d} r USING (host, template, s)),
tree{d} AS (SELECT host, shape, parts, n, nb, nl, template || '/' || label AS template FROM live{d} JOIN named{d} USING (host, template, s)
    UNION ALL SELECT host, shape, parts, n, nb, nl, template FROM tree{d - 1} WHERE len(parts) < {d})"""
    last = f"tree{SQL_LEVELS}"
    return sql + f""",
of_path AS (SELECT template, (sum(nb) + {PRIOR} * ((SELECT sum(nb) FROM {last}) / greatest((SELECT sum(nl) FROM {last}), 1))) / (sum(nl) + {PRIOR}) AS by_path FROM {last} GROUP BY template),
of_host AS (SELECT host, sum(nb) AS hb, sum(nl) AS hl FROM {last} GROUP BY host),
own AS (SELECT host, template, sum(nb) AS b, sum(nl) AS l FROM {last} GROUP BY ALL),
pure AS (SELECT host, template, round((b + {PRIOR} * ((hb + {PRIOR} * by_path) / (hl + {PRIOR}))) / (l + {PRIOR}), 6) AS purity FROM own JOIN of_path USING (template) JOIN of_host USING (host))
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM base JOIN {last} USING (host, shape) JOIN pure USING (host, template)
"""
