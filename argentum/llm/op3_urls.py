"""URL filters: host and path rules, then a path-template tree per host that is judged by labelled purity.

Rules decide first: a rule fits its host and all subdomains if the url's path begins with the rule's; the
longest wins. The urls that rules decide are also the labelled ones of the tree.

The tree: a path's segments lose their numbers (`<n>`), equal shapes of a host are counted together, and
from the root down, to the deepest shape, each node's branches are made general. A branch that holds too small a
part of its node is variable and becomes a wildcard. Of the rest, those with labels enough are put in the order of
their purity, and neighbours are merged unless a two-proportion z-test tells them apart. Branches with too few labels
to tell stay as they are. A host's purity is smoothed by a few votes for allowing and counts by half, a node's by as
many votes of its parent's: so a branch without labels goes where nearly all that is known of its host is bad. Templates below
the limit are rejected.

A giant host or a very common shape is one key of the joins here; its rows meet a broadcast.

Cases: a null url, or one without `://`, has empty host and path and belongs to the template of empty
paths; an empty path fits no rule; urls of any length and depth are taken whole; repeated rows count each; branches of
one purity are merged by name; null ids are kept; only the two named columns are read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argentum.llm import common

#: (rule, allowed): host/path.
RULES = [("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False)]
#: The part of its node, and the rows, that a constant branch has at least.
MIN_SHARE, MIN_ROWS = 0.02, 3
#: Labelled rows from which a branch's purity is compared, and the z from which it differs.
MIN_LABELLED, DIFFERS = 5, 2.0
#: Smoothing: votes of the prior, the purity that hosts start from, and the purity under which a template is rejected.
PRIOR_VOTES, PRIOR_PURITY, LIMIT = 10.0, 0.7, 0.5
#: The part of a host's purity that its labels make, as the prior of its tree; the rest is PRIOR_PURITY.
BACK_OFF = 0.5

#: What becomes <n>: long hexadecimal words and runs of digits.
NUMBERS = r"\b[0-9a-f]{8,}\b|[0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, bool]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
    return found if found is not None else F.lit(None).cast("string")


def shapes(path: Column) -> Column:
    """The path's segments with numbers made general."""
    return F.transform(F.slice(F.split(path, "/"), 2, 1 << 30), lambda s: F.regexp_replace(s, NUMBERS, "<n>"))


SUMS = ["n", "n_labelled", "n_good"]
NODE = ["host", "template"]


def _smoothed(parent: Column) -> Column:
    return (F.sum("n_good") + PRIOR_VOTES * parent) / (F.sum("n_labelled") + PRIOR_VOTES)


def merged(told: DataFrame) -> DataFrame:
    """(host, template, segment, _name): a node's branches by rising purity, neighbours merged that the test can't tell apart.

    A constant branch has a share of MIN_SHARE, so a node has 50 of them at most.
    """
    order = W.partitionBy(*NODE).orderBy(F.col("n_good") / F.col("n_labelled"), "segment")
    before = F.lag(F.struct("n_good", "n_labelled")).over(order)
    told = told.withColumn("_b", before)
    g, n = F.col("_b.n_good") + F.col("n_good"), F.col("_b.n_labelled") + F.col("n_labelled")
    apart = F.abs(F.col("n_good") / F.col("n_labelled") - F.col("_b.n_good") / F.col("_b.n_labelled"))
    spread = F.sqrt((g / n) * (1 - g / n) * (1.0 / F.col("n_labelled") + 1.0 / F.col("_b.n_labelled")))
    told = told.withColumn("_new", F.coalesce((spread > 0) & (apart >= DIFFERS * spread), F.lit(True)).cast("int"))
    told = told.withColumn("_cluster", F.sum("_new").over(order))
    all_ = F.array_sort(F.collect_list("segment").over(W.partitionBy(*NODE, "_cluster")))
    return told.select(*NODE, "segment", F.array_join(all_, "|").alias("_name"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, shape, n, template, purity) from counted shapes (host, shape array, n, n_labelled, n_good)."""
    paths = common.cut(paths)
    hosts = paths.groupBy("host").agg(((1 - BACK_OFF) * PRIOR_PURITY + BACK_OFF * _smoothed(F.lit(PRIOR_PURITY))).alias("purity"), F.count("*").alias("_rows"))
    now = common.cut(common.meet(paths, hosts, ["host"], "_rows").withColumn("template", F.lit("")))
    deepest = now.agg(F.max(F.size("shape"))).first()[0] or 0
    for depth in range(deepest):
        here = now.filter(F.size("shape") > depth).withColumn("segment", F.get("shape", F.lit(depth)))
        sums = [F.sum(c).alias(c) for c in SUMS]
        branches = common.cut(here.groupBy(*NODE, "segment").agg(*sums, F.max("purity").alias("purity"), F.count("*").alias("_rows")))
        nodes = branches.groupBy(*NODE).agg(F.sum("n").alias("_all"), F.count("*").alias("_branches"))
        constant = (F.col("n") >= MIN_ROWS) & (F.col("n") >= MIN_SHARE * F.col("_all"))
        rated = common.meet(branches, nodes, NODE, "_branches").withColumn("_constant", constant)
        told = merged(rated.filter(F.col("_constant") & (F.col("n_labelled") >= MIN_LABELLED)))
        # few rows a node, so broadcast or not this join has no hot key: wildcards don't take part in it
        firm = rated.filter("_constant").join(told, [*NODE, "segment"], "left").withColumn("_name", F.coalesce("_name", "segment"))
        named = common.cut(firm.unionByName(rated.filter(~F.col("_constant")).withColumn("_name", F.lit("*"))))
        purity = named.groupBy(*NODE, "_name").agg(_smoothed(F.max("purity")).alias("_purity"), F.count("*").alias("_branches"))
        names = common.meet(named.select(*NODE, "segment", "_name", "_rows"), purity, [*NODE, "_name"], "_branches")
        deeper = common.meet(here.drop("purity"), names, [*NODE, "segment"], "_rows")
        deeper = deeper.select("host", "shape", *SUMS, F.concat("template", F.lit("/"), "_name").alias("template"), F.col("_purity").alias("purity"))
        now = common.cut(deeper.unionByName(now.filter(F.size("shape") <= depth).select(deeper.columns)))
    return now.select("host", "shape", "n", "template", "purity")


def judge(df: DataFrame, key: str, url: str, rules: list[tuple[str, bool]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, template, purity of each row."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = df.select(F.col(key), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "shape": shapes(F.col("path"))})
    allowed = F.col("rule").isin([r for r, ok in rules if ok])
    counted = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("rule").alias("n_labelled"), F.coalesce(F.sum(allowed.cast("bigint")), F.lit(0)).alias("n_good"))
    out = common.meet(rows, templates(counted), ["host", "shape"], "n")
    verdict = F.when(F.coalesce(allowed, F.col("purity") >= LIMIT), F.lit("allow")).otherwise(F.lit("block"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "url")


#: Levels of the SQL's tree, which has no loop; the tables' paths have four.
SQL_LEVELS = 12


def oracle(rules: list[tuple[str, bool]] = RULES) -> str:
    """The same judgement in DuckDB's SQL, one level of the tree after another."""
    cases = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule}'")
    good = ", ".join(f"'{r}'" for r, ok in rules if ok)
    votes = f"{PRIOR_VOTES}::DOUBLE"
    steps = [
        "rest AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS r FROM pages)",
        f"u0 AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest)",
        f"u AS (SELECT *, CASE {' '.join(cases)} END AS rule, [regexp_replace(x, '{NUMBERS}', '<n>', 'g') FOR x IN string_split(path, '/')[2:]] AS shape FROM u0)",
        f"s AS (SELECT host, shape, count(rule)::DOUBLE AS nl, coalesce(count(*) FILTER (WHERE rule IN ({good})), 0)::DOUBLE AS ng, count(*) AS n FROM u GROUP BY host, shape)",
        f"t0 AS MATERIALIZED (SELECT *, '' AS template, {(1 - BACK_OFF) * PRIOR_PURITY}::DOUBLE + {BACK_OFF}::DOUBLE * ((sum(ng) OVER w + {votes} * {PRIOR_PURITY}::DOUBLE) / (sum(nl) OVER w + {votes})) AS purity FROM s WINDOW w AS (PARTITION BY host))",
    ]
    for k in range(SQL_LEVELS):
        spread = "sqrt(((ng + g0) / (nl + l0)) * (1 - (ng + g0) / (nl + l0)) * (1::DOUBLE / nl + 1::DOUBLE / l0))"
        steps += [
            f"h{k} AS (SELECT *, shape[{k + 1}] AS segment FROM t{k} WHERE len(shape) > {k})",
            f"b{k} AS (SELECT host, template, segment, sum(n) AS n, sum(nl) AS nl, sum(ng) AS ng, max(purity) AS purity FROM h{k} GROUP BY ALL)",
            f"r{k} AS MATERIALIZED (SELECT *, n >= {MIN_ROWS} AND n >= {MIN_SHARE}::DOUBLE * sum(n) OVER (PARTITION BY host, template) AS firm FROM b{k})",
            f"o{k} AS (SELECT *, lag(ng) OVER w AS g0, lag(nl) OVER w AS l0 FROM r{k} WHERE firm AND nl >= {MIN_LABELLED} WINDOW w AS (PARTITION BY host, template ORDER BY ng / nl, segment))",
            f"z{k} AS (SELECT *, sum(CASE WHEN l0 IS NULL OR ({spread} > 0 AND abs(ng / nl - g0 / l0) >= {DIFFERS}::DOUBLE * {spread}) THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY ng / nl, segment ROWS UNBOUNDED PRECEDING) AS c FROM o{k})",
            f"y{k} AS (SELECT host, template, unnest(list(segment)) AS segment, string_agg(segment, '|' ORDER BY segment) AS merged FROM z{k} GROUP BY host, template, c)",
            f"m{k} AS (SELECT r{k}.*, CASE WHEN firm THEN coalesce(merged, segment) ELSE '*' END AS name FROM r{k} LEFT JOIN y{k} USING (host, template, segment))",
            f"p{k} AS (SELECT host, template, segment, name, (sum(ng) OVER w + {votes} * max(purity) OVER w) / (sum(nl) OVER w + {votes}) AS p FROM m{k} WINDOW w AS (PARTITION BY host, template, name))",
            f"t{k + 1} AS MATERIALIZED (SELECT host, shape, nl, ng, n, template || '/' || name AS template, p AS purity FROM h{k} JOIN p{k} USING (host, template, segment) UNION ALL SELECT host, shape, nl, ng, n, template, purity FROM t{k} WHERE len(shape) <= {k})",
        ]
    return f"WITH {', '.join(steps)} SELECT page_id, host, path, rule, CASE WHEN coalesce(rule IN ({good}), purity >= {LIMIT}) THEN 'allow' ELSE 'block' END AS verdict, template, purity FROM u JOIN t{SQL_LEVELS} USING (host, shape)"
