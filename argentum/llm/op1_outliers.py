"""Quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

Every text gets counts, and from them a vector of transformed statistics. For each group (language and
source) a robust centre and scatter are estimated by concentration steps: the 75 % of the group with the
smallest distances give a new mean and covariance, which give new distances, and so on; each step lowers
the covariance's determinant. There are two starts, medians with median absolute deviations and plain means
with covariances; steps end when no group's determinant falls any more, and the start with the least
determinant counts. A document whose Mahalanobis distance is too large is rejected.

Every group is judged, however small: a language is estimated over all its rows too, and so is the whole table.
A group's estimate is shrunk towards its language's, and that towards the table's, by n / (n + SHRINK).

All of it is DataFrame work. Quantiles come from counts by bin, so that a group of any size costs sums
only; the estimates are one row per group.

Cases: a null text has no words, and texts of any length are counted whole; null language or source is a group of
its own; rows on the edge of a quantile's bin all belong to it; repeated rows count as often as they come; an empty
table gives an empty result; columns that aren't named are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argentum.llm import common

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: Share of a group that gives the estimate, concentration steps at most, and the part of a determinant that counts as a fall.
CORE, STEPS, FALL = 0.75, 5, 1e-9
#: Rows of the language (of the table) that a group's (a language's) estimate is mixed with.
SHRINK = 50.0
#: The cutoff of the squared distance is the 0.9999 quantile of chi-square with 4 degrees of freedom; and its median.
CUTOFF, CHI2_MEDIAN = 23.5127, 3.3567
#: The tolerance of each statistic: a standard deviation below which no group is taken to vary, as clean prose has no
#: symbols or repeats at all. Half of a text's lines repeated, or a fifth of its words, are some three of them.
FLOORS = {"x_length": 0.04, "x_symbols": 0.05, "x_lines": 0.15, "x_repeats": 0.12}
X = list(FLOORS)
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
#: Groups up to which their estimates are broadcast (some 300 bytes a row).
BROADCAST_GROUPS = 50_000
#: Bins of a statistic for the medians, and of a squared distance's logarithm.
FINE, COARSE = 1 / 256, 1 / 32


def counts(df: DataFrame, text: str) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words beside them.

    Windows of eight words are compared by hashes that are built up by doubling (1, 2, 4, 8 words);
    the exact positions are looked for only in texts that hold some window twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pair = lambda name, step: F.transform(name, lambda x, i: F.xxhash64(x, F.get(F.col(name), i + step)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_words": common.words(F.col(text)), "_lines": lines, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint")})
    df = df.withColumns({"n_words": F.size("_words").cast("bigint"), "word_chars": F.length(F.array_join("_words", "")).cast("bigint"), "n_lines": F.size("_lines").cast("bigint"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "_h": F.transform("_words", lambda x: F.xxhash64(x))}).drop("_words", "_lines")
    df = df.withColumn("_h", pair("_h", 1)).withColumn("_h", pair("_h", 2)).withColumn("_h", pair("_h", 4))
    df = df.withColumn("_h", F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_h", F.when(twice, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_h"), i)["h"]
    same = F.filter("_h", lambda x, i: (x["h"] == F.when(i > 0, at(i - 1))) | (x["h"] == at(i + 1)))
    df = df.withColumn("_h", F.sort_array(F.transform(same, lambda x: x["i"])))
    cover = F.aggregate("_h", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("bigint")).drop("_h")


def statistics() -> dict[str, Column]:
    """Transformed statistics. Ratios are shrunk by additive terms, so that short texts don't stray by chance."""
    n = F.col("n_words").cast("double")
    return {
        "x_length": F.log((F.col("word_chars") + 300.0) / (n + 50.0)),
        "x_symbols": F.log1p(10.0 * F.col("n_symbols") / (n + 50.0)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 4.0)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (n + 50.0)),
    }


def binned(value: Column, step: float) -> Column:
    return F.floor(value / step).cast("bigint")


#: Groups whose counts and estimates one task takes.
TASK_GROUPS = 16


def _few(df: DataFrame, n_groups: int) -> DataFrame:
    """Counts or estimates by group in as many tasks as their groups need; a few small rows aren't spread over hundreds of files."""
    return df.coalesce(1 + n_groups // TASK_GROUPS)


def quantile_bins(df: DataFrame, group: str, bins: dict[str, Column], share: float, n_groups: int) -> DataFrame:
    """(group, one column for each of bins): the first bin up to which at least that share of the group's rows lies."""
    stacked = df.select(group, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.alias("b")) for k, b in bins.items()])).alias("_s")).select(group, "_s.*")
    n = _few(stacked.groupBy(group, "k", "b").agg(F.count("*").alias("n")), n_groups)
    up, all_ = F.sum("n").over(W.partitionBy(group, "k").orderBy("b")), F.sum("n").over(W.partitionBy(group, "k"))
    found = n.withColumns({"_up": up, "_all": all_}).filter(F.col("_up") >= share * F.col("_all"))
    return _few(_few(found, n_groups).groupBy(group).agg(*[F.min(F.when(F.col("k") == k, F.col("b"))).alias(k) for k in bins]), n_groups)


def _join(df: DataFrame, small: DataFrame, on: str, n_small: int) -> DataFrame:
    return df.join(F.broadcast(small) if n_small <= BROADCAST_GROUPS else small, on)


def _distance() -> Column:
    """The squared Mahalanobis distance from m_* by forward substitution through the Cholesky factor l_*."""
    y: list[Column] = []
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * y[j]
        y.append(rest / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _far() -> Column:
    """The bin of the squared distance's logarithm."""
    return binned(F.log(_distance() + 1e-6), COARSE)


def _moments() -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]]


def _covariance(df: DataFrame) -> DataFrame:
    """From the sums of a core's rows: means m_* and covariances c_*."""
    df = df.withColumns({f"m_{x}": F.col(f"s_{x}") / F.col("n") for x in X})
    return df.withColumns({f"c_{i}_{j}": F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{X[i]}") * F.col(f"m_{X[j]}") for i, j in PAIRS})


def _cholesky(df: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_* of the covariances plus the squared floors, and the determinant's root."""
    for i, j in PAIRS:
        v = F.greatest(F.col(f"c_{i}_{j}"), F.lit(0.0)) + FLOORS[X[i]] ** 2 if i == j else F.col(f"c_{i}_{j}")
        for k in range(j):
            v = v - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[X[i]] ** 2 / 4))) if i == j else v / F.col(f"l_{j}_{j}"))
    return df.withColumn("det", reduce(lambda a, b: a * b, [F.col(f"l_{i}_{i}") for i in range(len(X))]))


M, C, L = [f"m_{x}" for x in X], [f"c_{i}_{j}" for i, j in PAIRS], [f"l_{i}_{j}" for i, j in PAIRS]


def grouped(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their group _g (all columns of by) and language _p (the first of them) beside them."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return df.withColumns({"_g": F.concat_ws("\u0001", F.lit("g"), *map(name, by)), "_p": F.concat_ws("\u0001", F.lit("p"), name(by[0]))})


#: The group of all rows.
ALL = "a"


def mcd(use: DataFrame, n_groups: int) -> DataFrame:
    """(_k, n, m_*, c_*) for each value of _k in the rows (_k, X): the estimate from the start with the least determinant."""
    middle = quantile_bins(use, "_k", {x: binned(F.col(x), FINE) for x in X}, 0.5, n_groups)
    middle = common.cut(_few(middle, n_groups).select("_k", *[((F.col(x) + 0.5) * FINE).alias(f"m_{x}") for x in X]))
    spread = quantile_bins(_join(use, middle, "_k", n_groups), "_k", {x: binned(F.abs(F.col(x) - F.col(f"m_{x}")), FINE) for x in X}, 0.5, n_groups)
    spread = spread.select("_k", *[F.greatest(1.4826 * (F.col(x) + 0.5) * FINE, F.lit(FLOORS[x])).alias(f"d_{x}") for x in X])
    medians = middle.join(spread, "_k").select(F.lit(0).alias("_s"), "_k", *M, *[(F.col(f"d_{X[i]}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in PAIRS])
    means = _cholesky(_covariance(use.groupBy("_k").agg(*_moments())))
    now = common.cut(_few(medians.unionByName(means.select(F.lit(1).alias("_s"), "_k", *M, *L)), 2 * n_groups))
    before = None
    for _ in range(STEPS):
        far = _join(use, now, "_k", 2 * n_groups).select(F.struct("_s", "_k").alias("_id"), _far().alias("b"), *X)
        edge = quantile_bins(far, "_id", {"edge": F.col("b")}, CORE, 2 * n_groups)
        core = _join(far, edge, "_id", 2 * n_groups).filter("b <= edge")
        now = common.cut(_few(_cholesky(_covariance(core.groupBy("_id").agg(*_moments()))).select("_id._s", "_id._k", *M, *C, *L, "det"), 2 * n_groups))
        if before is not None:
            fell = now.join(before.select("_s", "_k", F.col("det").alias("_before")), ["_s", "_k"]).filter(F.col("det") < F.col("_before") * (1 - FALL))
            if not fell.limit(1).count():
                break
        before = now
    one, other = [now.filter(F.col("_s") == s).drop("_s").select("_k", *[F.col(c).alias(f"{c}_{s}") for c in [*M, *C, "det"]]) for s in (0, 1)]
    better = F.col("det_1") < F.col("det_0") * (1 - FALL)
    best = one.join(other, "_k").select("_k", *[F.when(better, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")).alias(c) for c in [*M, *C]])
    return _few(best.join(_few(use.groupBy("_k").agg(F.count("*").cast("double").alias("n")), n_groups), "_k"), n_groups)


def _shrunk(df: DataFrame, towards: DataFrame, on: str) -> DataFrame:
    """The estimates mixed with those of their parents, which are found by the column on."""
    parents = towards.select(F.col("_k").alias(on), *[F.col(c).alias(f"_{c}") for c in [*M, *C]])
    mix = [((F.col("n") * F.col(c) + SHRINK * F.col(f"_{c}")) / (F.col("n") + SHRINK)).alias(c) for c in [*M, *C]]
    return df.join(parents, on).select(*[c for c in df.columns if c not in (*M, *C)], *mix)


def robust_estimates(df: DataFrame, n_groups: int) -> DataFrame:
    """(_g, m_*, l_*, scale): the estimate of each group from rows of which base_failed is false.

    scale makes a language's median distance that of chi-square, if it is more; it is shrunk towards the table's.
    """
    rows = df.filter("not base_failed").select("_g", "_p", *X)
    use = rows.select(F.explode(F.array(F.lit(ALL), "_p", "_g")).alias("_k"), *X)
    found = common.cut(mcd(use, n_groups))
    top = found.filter(F.col("_k") == ALL)
    languages = _shrunk(found.filter(F.startswith("_k", F.lit("p"))).withColumn("_a", F.lit(ALL)), top, "_a")
    parents = _few(rows.select(F.col("_g").alias("_k"), "_p").distinct(), n_groups)
    groups = _shrunk(found.join(parents, "_k"), languages, "_p")
    groups = common.cut(_few(_cholesky(groups).select(F.col("_k").alias("_g"), "_p", *M, *L), n_groups))
    judged = _join(rows, groups.drop("_p"), "_g", n_groups).select(F.explode(F.array(F.lit(ALL), "_p")).alias("_k"), _far().alias("b"))
    scales = quantile_bins(judged, "_k", {"b": F.col("b")}, 0.5, n_groups).join(_few(judged.groupBy("_k").agg(F.count("*").cast("double").alias("n")), n_groups), "_k")
    scales = common.cut(_few(scales, n_groups).select("_k", "n", F.log(F.greatest(F.exp((F.col("b") + 1) * COARSE) / CHI2_MEDIAN, F.lit(1.0))).alias("v")))
    whole = scales.filter(F.col("_k") == ALL).select(F.lit(True).alias("_one"), F.col("v").alias("_v"))
    scales = scales.filter(F.col("_k") != ALL).withColumn("_one", F.lit(True)).join(whole, "_one")
    scales = scales.select(F.col("_k").alias("_p"), F.exp((F.col("n") * F.col("v") + SHRINK * F.col("_v")) / (F.col("n") + SHRINK)).alias("scale"))
    return common.cut(_few(groups.join(scales, "_p").drop("_p"), n_groups))


def judge(df: DataFrame, key: str, text: str, by: list[str]) -> DataFrame:
    """key, the counts, base_failed, distance (squared, scaled; null if base_failed) and kept."""
    slim = df.select(F.col(key), *[F.col(c) for c in by if c != key], F.col(text).cast("string").alias("_text"))
    slim = counts(slim, "_text").drop("_text").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    slim = common.cut(grouped(slim.withColumns(statistics()), by))
    n = sum(slim.agg(F.approx_count_distinct("_g"), F.approx_count_distinct("_p")).first()) * 11 // 10 + 1
    estimates = robust_estimates(slim, n)
    out = slim.join(F.broadcast(estimates) if n <= BROADCAST_GROUPS else estimates, "_g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF)).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"), "distance")


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source")
    return judge(docs, "doc_id", "text", ["lang", "source"]).withColumn("distance", F.round(F.coalesce("distance", F.lit(-1.0)), 4))


def oracle() -> str:
    """The same estimates in DuckDB's SQL, one concentration step after another (steps past the last fall change nothing)."""
    word = r"[^\x20\x09-\x0D]+"
    name = lambda c: f"coalesce('=' || {c}, '-')"
    real = lambda v: f"{v!r}::DOUBLE"

    def quantiles(table: str, key: str, bins: dict[str, str], share: float) -> str:
        stacked = " UNION ALL ".join(f"SELECT {key}, '{k}' AS k, {b} AS b FROM {table}" for k, b in bins.items())
        up = f"SELECT *, sum(n) OVER (PARTITION BY {key}, k ORDER BY b) AS up, sum(n) OVER (PARTITION BY {key}, k) AS al FROM (SELECT {key}, k, b, count(*) AS n FROM ({stacked}) GROUP BY ALL)"
        return f"SELECT {key}, {', '.join(f"min(b) FILTER (WHERE k = '{k}') AS b_{k}" for k in bins)} FROM ({up}) WHERE up >= {real(share)} * al GROUP BY {key}"

    def distance() -> str:
        y: list[str] = []
        for i, x in enumerate(X):
            rest = f"({x} - m_{x}" + "".join(f" - l_{i}_{j} * {y[j]}" for j in range(i)) + ")"
            y.append(f"({rest} / l_{i}_{i})")
        return " + ".join(f"{v} * {v}" for v in y)

    def factor() -> str:
        parts = []
        for i, j in PAIRS:
            v = f"(greatest(c_{i}_{j}, 0::DOUBLE) + {real(FLOORS[X[i]] ** 2)})" if i == j else f"c_{i}_{j}"
            v += "".join(f" - l_{i}_{h} * l_{j}_{h}" for h in range(j))
            parts.append(f"sqrt(greatest({v}, {real(FLOORS[X[i]] ** 2 / 4)})) AS l_{i}_{j}" if i == j else f"({v}) / l_{j}_{j} AS l_{i}_{j}")
        return ", ".join(parts) + ", " + " * ".join(f"l_{i}_{i}" for i in range(len(X))) + " AS det"

    far = f"floor(ln({distance()} + 1e-6::DOUBLE) / {real(COARSE)})::BIGINT"
    sums = ", ".join(["count(*)::DOUBLE AS n", *[f"sum({x}) AS s_{x}" for x in X], *[f"sum({X[i]} * {X[j]}) AS q_{i}_{j}" for i, j in PAIRS]])
    moments = ", ".join([f"s_{x} / n AS m_{x}" for x in X] + [f"q_{i}_{j} / n - (s_{X[i]} / n) * (s_{X[j]} / n) AS c_{i}_{j}" for i, j in PAIRS])
    fine = real(FINE)
    steps = [
        f"d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source, regexp_extract_all(coalesce(text, ''), '{word}') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{word}')] AS ls FROM documents)",
        f"win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d))",
        "rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1)",
        f"cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY doc_id)",
        f"c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id))",
        f"x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, ln((word_chars + 300::DOUBLE) / (n_words + 50::DOUBLE)) AS x_length, ln(1 + 10::DOUBLE * n_symbols / (n_words + 50::DOUBLE)) AS x_symbols, sqrt(n_dup_lines / (n_lines + 4::DOUBLE)) AS x_lines, sqrt(n_repeat_words / (n_words + 50::DOUBLE)) AS x_repeats FROM c)",
        f"a AS MATERIALIZED (SELECT *, 'g' || chr(1) || {name('lang')} || chr(1) || {name('source')} AS g, 'p' || chr(1) || {name('lang')} AS p FROM x)",
        f"u AS MATERIALIZED (SELECT unnest(['{ALL}', p, g]) AS k, {', '.join(X)} FROM a WHERE NOT base_failed)",
        f"mq AS ({quantiles('(SELECT k AS _k, * FROM u)', '_k', {x: f'floor({x} / {fine})::BIGINT' for x in X}, 0.5)})",
        f"mid AS MATERIALIZED (SELECT _k AS k, {', '.join(f'(b_{x} + 0.5::DOUBLE) * {fine} AS m_{x}' for x in X)} FROM mq)",
        f"sq AS ({quantiles('(SELECT u.k AS _k, * EXCLUDE (k) FROM u JOIN mid USING (k))', '_k', {x: f'floor(abs({x} - m_{x}) / {fine})::BIGINT' for x in X}, 0.5)})",
        "e0a AS (SELECT 0 AS s, mid.k, " + ", ".join(M) + ", " + ", ".join(f"greatest(1.4826::DOUBLE * (b_{X[i]} + 0.5::DOUBLE) * {fine}, {real(FLOORS[X[i]])}) AS l_{i}_{j}" if i == j else f"0::DOUBLE AS l_{i}_{j}" for i, j in PAIRS) + " FROM mid JOIN sq ON mid.k = sq._k)",
        f"e0b AS (SELECT 1 AS s, k, {', '.join(M)}, {factor()} FROM (SELECT k, {moments} FROM (SELECT k, {sums} FROM u GROUP BY k)))",
        f"e0 AS MATERIALIZED (SELECT s, k, {', '.join([*M, *L])} FROM e0a UNION ALL SELECT s, k, {', '.join([*M, *L])} FROM e0b)",
    ]
    for t in range(STEPS):
        steps += [
            f"b{t} AS MATERIALIZED (SELECT s || u.k AS id, s, u.k, {', '.join(X)}, {far} AS b FROM u JOIN e{t} USING (k))",
            f"k{t} AS ({quantiles(f'b{t}', 'id', {'edge': 'b'}, CORE)})",
            f"c{t} AS (SELECT s, k, {sums} FROM b{t} JOIN k{t} USING (id) WHERE b <= b_edge GROUP BY s, k)",
            f"e{t + 1} AS MATERIALIZED (SELECT s, k, {', '.join([*M, *C])}, {factor()} FROM (SELECT s, k, {moments} FROM c{t}))",
        ]
    e = f"e{STEPS}"
    mix = ", ".join(f"(y.n * y.{c} + {real(SHRINK)} * z.{c}) / (y.n + {real(SHRINK)}) AS {c}" for c in [*M, *C])
    steps += [
        f"best AS MATERIALIZED (SELECT o.k, n, {', '.join(f'CASE WHEN t.det < o.det * (1 - {real(FALL)}) THEN t.{c} ELSE o.{c} END AS {c}' for c in [*M, *C])} FROM (SELECT * FROM {e} WHERE s = 0) o JOIN (SELECT * FROM {e} WHERE s = 1) t USING (k) JOIN (SELECT k, count(*)::DOUBLE AS n FROM u GROUP BY k) USING (k))",
        f"lang_ AS (SELECT y.k, {mix} FROM best y JOIN best z ON z.k = '{ALL}' WHERE starts_with(y.k, 'p'))",
        f"grp AS (SELECT y.k, q.p, {mix} FROM best y JOIN (SELECT DISTINCT g, p FROM a) q ON y.k = q.g JOIN lang_ z ON z.k = q.p)",
        f"est AS MATERIALIZED (SELECT k AS g, {', '.join(M)}, {factor()} FROM grp)",
        f"j AS MATERIALIZED (SELECT doc_id, p, {distance()} AS d2, floor(ln({distance()} + 1e-6::DOUBLE) / {real(COARSE)})::BIGINT AS b FROM a JOIN est USING (g) WHERE NOT base_failed)",
        f"jk AS (SELECT unnest(['{ALL}', p]) AS k_, b AS bb FROM j)",
        f"sc AS (SELECT q.k_, n, ln(greatest(exp((b_b + 1) * {real(COARSE)}) / {real(CHI2_MEDIAN)}, 1::DOUBLE)) AS v FROM ({quantiles('jk', 'k_', {'b': 'bb'}, 0.5)}) q JOIN (SELECT k_, count(*)::DOUBLE AS n FROM jk GROUP BY 1) USING (k_))",
        f"scale AS (SELECT y.k_ AS p, exp((y.n * y.v + {real(SHRINK)} * z.v) / (y.n + {real(SHRINK)})) AS scale FROM sc y JOIN sc z ON z.k_ = '{ALL}' WHERE y.k_ <> '{ALL}')",
        "r AS (SELECT a.*, j.d2 / scale AS dist FROM a LEFT JOIN j USING (doc_id) LEFT JOIN scale ON scale.p = a.p)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND dist <= {real(CUTOFF)}, false) AS kept, round(coalesce(dist, -1::DOUBLE), 4) AS distance FROM r"
