"""Queries over strings, files, parameters and other small relations, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from argentum.functions import colour, text
from argentum.operators import aggregates as agg
from argentum.operators import relations as rel
from argentum.sources import pixels

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES_SQL = "files AS (SELECT p_partkey AS id, '/scans/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.3fr' ELSE '.txt' END AS path FROM part)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('/scans/', replace(p_brand, '#', '-'), '/', replace(p_name, ' ', '_'), '_', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.3fr' ELSE '.txt' END) AS path")


@query(f"WITH {FILES_SQL} SELECT id, path FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('tif', 'tiff', '3fr')")
def ext_filter(spark, sf_dir):
    return files(spark, sf_dir).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("tif", "tiff", "3fr"))


@query(f"WITH {FILES_SQL}, f AS (SELECT id, regexp_extract(path, '([^/]*)$', 1) AS name FROM files) SELECT id, name FROM f WHERE regexp_matches(lower(name), '1.*5.*t', 's') OR regexp_matches(lower(regexp_extract(name, '\\.([^.]*)$', 1)), '1.*5.*t', 's')")
def fuzzy_filter(spark, sf_dir):
    return files(spark, sf_dir).select("id", F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).filter(text.fuzzy_file(F.col("name"), "15T"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(lang), 'e') OR contains(lower(source), 'e')")
def tag_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(text.contains_any([F.col("lang"), F.col("source")], "E")).select("doc_id", "lang", "source")


def _size_sql(n: str) -> str:
    """Decimals in whole numbers, ties to the even digit."""

    def part(unit: int, k: int) -> str:
        q, r = f"({n} * {k} // {unit})", f"({n} * {k} % {unit})"
        up = f"({q} + CASE WHEN {r} > {unit // 2} OR ({r} = {unit // 2} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
        return f"({up} // {k}) || '.' || lpad(({up} % {k})::VARCHAR, {len(str(k)) - 1}, '0')"

    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {part(1 << 10, 10)} || ' KB' WHEN {n} < 1073741824 THEN {part(1 << 20, 10)} || ' MB' ELSE {part(1 << 30, 100)} || ' GB' END"


SIZE = "(n_chars * (doc_id % 7 + 1) * 1500)::BIGINT"


@query(f"SELECT doc_id, {SIZE} AS n, {_size_sql(SIZE)} AS size FROM documents")
def file_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(n_chars * (doc_id % 7 + 1) * 1500 AS BIGINT) AS n")
    return d.withColumn("size", text.file_size(F.col("n")))


ESC = "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT page_id, md5({ESC}) AS escaped, md5(replace(replace(replace(replace({ESC}, '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')) AS back, md5(html) AS plain FROM pages")
def xml_escape(spark, sf_dir):
    e = text.xml_escape(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(e).alias("escaped"), F.md5(text.xml_unescape(e)).alias("back"), F.md5("html").alias("plain"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', '''')) AS decoded FROM pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.entity_decode(F.col("html"))).alias("decoded"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') AS title, nullif(regexp_extract(html, 'lang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def tag_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.tag_text(F.col("html"), "title").alias("title"), text.attribute(F.col("html"), "lang").alias("lang"))


@query("SELECT doc_id, replace(replace('{name}_{n}.tif', '{name}', source), '{n}', (doc_id % 12 + 1)::VARCHAR) AS name FROM documents")
def name_template(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.filled_template(F.lit("{name}_{n}.tif"), F.col("source"), F.col("doc_id") % 12 + 1).alias("name"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN printf('%04d-%02d-%02d %02d:%02d:%02d', 2000 + doc_id % 5, doc_id % 13, doc_id % 29, doc_id % 24, doc_id % 60, doc_id % 59) ELSE '—' END AS shown FROM documents")
def date_display(spark, sf_dir):
    d = lambda m: (F.col("doc_id") % m).cast("int")
    year = F.when(d(5) > 0, d(5) + 2000).otherwise(F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", text.shown_date(year, d(13), d(29), d(24), d(60), d(59)).alias("shown"))


@query("SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def scan_stats(spark, sf_dir):
    """How many rows each kind has."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT l_quantity::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT max(n) AS top FROM c) SELECT q, round(n / top::DOUBLE, 9) AS linear, round(sqrt(n) / sqrt(top), 9) AS root, round(ln(1 + n) / ln(1 + top), 9) AS log, round(cbrt(n) / cbrt(top), 9) AS cube FROM c, t")
def height_map(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("q")).agg(F.count("*").alias("n"))
    c = c.join(F.broadcast(c.agg(F.max("n").alias("top"))), F.lit(True))  # one row
    h = {"linear": "linear", "root": "sqrt", "log": "log", "cube": "cbrt"}
    return c.select("q", *[F.round(text.height(F.col("n"), F.col("top"), k), 9).alias(a) for a, k in h.items()])


@query("WITH t AS (SELECT i.range AS i, least(greatest((i.range - 100) / 800::DOUBLE, 0), 1) AS t FROM range(1001) i) SELECT i, floor(least(greatest(CASE WHEN t < 0.5 THEN 0 WHEN t < 0.75 THEN (t - 0.5::DOUBLE) / 0.25::DOUBLE ELSE 1 END, 0), 1) * 255)::INT AS r, floor(least(greatest(CASE WHEN t < 0.25 THEN t / 0.25::DOUBLE WHEN t < 0.75 THEN 1 ELSE 1 - (t - 0.75::DOUBLE) / 0.25::DOUBLE END, 0), 1) * 255)::INT AS g, floor(least(greatest(CASE WHEN t < 0.25 THEN 1 WHEN t < 0.5 THEN 1 - (t - 0.25::DOUBLE) / 0.25::DOUBLE ELSE 0 END, 0), 1) * 255)::INT AS b FROM t")
def colour_ramp(spark, sf_dir):
    r, g, b = colour.ramp((F.col("id") - 100) / 800.0)
    return spark.range(1001).select(F.col("id").alias("i"), r.alias("r"), g.alias("g"), b.alias("b"))


def _lab(df: DataFrame, suffix: str) -> DataFrame:
    u = [F.col(f"{c}{suffix}") / 65535.0 for c in "rgb"]
    return df.withColumns({f"{n}{suffix}": c for n, c in zip(("L", "A", "B"), colour.lab(*u), strict=True)})


def _lab_sql(s: str) -> str:
    lin = [f"(CASE WHEN {c}{s} / 65535::DOUBLE <= 0.04045::DOUBLE THEN {c}{s} / 65535::DOUBLE / 12.92::DOUBLE ELSE power(({c}{s} / 65535::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)" for c in "rgb"]
    f = []
    for row, w in zip(colour.TO_XYZ, colour.WHITE):
        t = "((" + " + ".join(f"{k!r}::DOUBLE * {x}" for k, x in zip(row, lin)) + f") / {w!r}::DOUBLE)"
        f.append(f"(CASE WHEN {t} > 0.008856::DOUBLE THEN cbrt({t}) ELSE 7.787037::DOUBLE * {t} + 16::DOUBLE / 116 END)")
    return f"116 * {f[1]} - 16 AS \"L{s}\", 500 * ({f[0]} - {f[1]}) AS \"A{s}\", 200 * ({f[1]} - {f[2]}) AS \"B{s}\""


@query(f"WITH {pixels.POINTS_SQL}, l AS (SELECT k_order, k_line, k_part, image_id, k_price, {_lab_sql('')} FROM px) SELECT k_order, k_line, k_part, image_id, k_price, round(\"L\", 6) AS \"L\", round(\"A\", 6) AS \"A\", round(\"B\", 6) AS \"B\" FROM l".replace('"L"', "lab_l").replace('"A"', "lab_a").replace('"B"', "lab_b"))
def srgb_lab(spark, sf_dir):
    return _lab(pixels.points(spark, sf_dir).withColumns({"r0": F.col("r"), "g0": F.col("g"), "b0": F.col("b")}), "0").select(*pixels.KEY, F.round("L0", 6).alias("lab_l"), F.round("A0", 6).alias("lab_a"), F.round("B0", 6).alias("lab_b"))


def _delta_sql() -> str:
    import re

    steps, before = [f"d0 AS (SELECT image_id, {_lab_sql('')}, {_lab_sql('_ref')} FROM px)"], "d0"
    for i, step in enumerate(colour.ciede2000_steps(('"L"', '"A"', '"B"'), ('"L_ref"', '"A_ref"', '"B_ref"'), "de"), 1):
        sql = {k: re.sub(r"(\d+(?:\.\d+)?)D\b", r"\1::DOUBLE", e).replace("pow(", "power(") for k, e in step.items()}
        steps.append(f"d{i} AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in sql.items())} FROM {before})")
        before = f"d{i}"
    # Names of columns differ by more than case in DuckDB's eyes only if they do.
    text_ = ", ".join(steps)
    for old, new in (("L", "q_l"), ("A", "q_a"), ("B", "q_b"), ("L_ref", "s_l"), ("A_ref", "s_a"), ("B_ref", "s_b")):
        text_ = text_.replace(f'"{old}"', new)
    return (
        f"WITH {pixels.POINTS_SQL}, {text_}, n AS (SELECT image_id, de, count(*) AS n FROM {before} GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY de) AS up, sum(n) OVER (PARTITION BY image_id) AS al FROM n) "
        "SELECT image_id, round(sum(de * n) / sum(n), 6) AS mean, round(min(de) FILTER (WHERE up >= least(ceil(al * 0.95::DOUBLE) + 1, al)), 6) AS p95, sum(n)::BIGINT AS n FROM u GROUP BY 1"
    )


@query(_delta_sql())
def delta_e(spark, sf_dir):
    """CIEDE2000 of each image against its reference: mean, and the value at index ceil(0.95 n), from 0, of the sorted ones."""
    px = pixels.points(spark, sf_dir).withColumns({f"{c}0": F.col(c) for c in "rgb"})
    d = colour.ciede2000(_lab(_lab(px, "0"), "_ref"), ("L0", "A0", "B0"), ("L_ref", "A_ref", "B_ref"), "de")
    # one pass over the formula; its values are counted and put in order as they are
    counts = d.groupBy("image_id", "de").agg(F.count("*").alias("n"))
    image = W.partitionBy("image_id")
    up = counts.withColumns({"_up": F.sum("n").over(image.orderBy("de")), "_all": F.sum("n").over(image)})
    at = F.least(F.ceil(F.col("_all") * 0.95) + 1, F.col("_all"))
    return up.groupBy("image_id").agg(F.round(F.sum(F.col("de") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.round(F.min(F.when(F.col("_up") >= at, F.col("de"))), 6).alias("p95"), F.sum("n").alias("n"))


@query(f"WITH {FILES_SQL}, n AS (SELECT regexp_extract(path, '^(.*)_[0-9]+\\.[^./]*$', 1) AS stem, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM files) SELECT a.stem, a.path AS path_one, b.path AS path_two FROM n a JOIN n b ON a.stem = b.stem AND a.ext = '3fr' AND b.ext = 'tif'")
def file_pair(spark, sf_dir):
    f = files(spark, sf_dir).select(F.regexp_replace("path", r"_[0-9]+(\.[^./]*)$", "$1").alias("path"), F.col("path").alias("full"))
    return rel.file_pairs(f, "3fr", "tif", "full")


@query("WITH n AS (SELECT o_orderkey AS id, o_totalprice AS mae FROM orders), b AS (SELECT o_orderkey AS id, o_totalprice + (o_orderkey % 5 - 2) * 0.03::DOUBLE AS mae FROM orders WHERE o_orderkey % 4 > 0) SELECT n.id, n.mae, b.mae AS old, CASE WHEN b.mae IS NULL THEN '' WHEN abs(n.mae - b.mae) < 0.05 THEN '=' WHEN n.mae < b.mae THEN '↓' ELSE '↑' END AS mark FROM n LEFT JOIN b USING (id)")
def baseline_diff(spark, sf_dir):
    now = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_totalprice AS mae")
    base = table(spark, sf_dir, "orders").filter("o_orderkey % 4 > 0").selectExpr("o_orderkey AS id", "o_totalprice + (o_orderkey % 5 - 2) * 0.03D AS mae")
    return rel.baseline_diff(now, base, ["id"], "mae")


WORDS = ["x1", "x5", "848", "949"]
PROF = "p AS (SELECT s_suppkey AS ord, 'Unit' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN ' X1' WHEN 1 THEN ' X5' WHEN 2 THEN ' 848' WHEN 3 THEN ' 949' ELSE '' END || CASE s_suppkey % 2 WHEN 0 THEN '.icc' ELSE '' END AS name FROM supplier), f AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN (SELECT any_value(name) FROM p WHERE ord = c_custkey % 90 + 1) ELSE 'none' END AS wanted, CASE c_custkey % 7 WHEN 0 THEN 'Scanner X1' WHEN 1 THEN 'scanner x5' WHEN 2 THEN 'S848' WHEN 3 THEN 'Model 949' ELSE 'other' END AS model FROM customer)"


def _profiles(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ord", "concat('Unit', s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN ' X1' WHEN 1 THEN ' X5' WHEN 2 THEN ' 848' WHEN 3 THEN ' 949' ELSE '' END, CASE s_suppkey % 2 WHEN 0 THEN '.icc' ELSE '' END) AS name")
    f = table(spark, sf_dir, "customer").selectExpr("c_custkey AS path", "c_custkey % 90 + 1 AS w", "CASE c_custkey % 7 WHEN 0 THEN 'Scanner X1' WHEN 1 THEN 'scanner x5' WHEN 2 THEN 'S848' WHEN 3 THEN 'Model 949' ELSE 'other' END AS model")
    f = f.join(p.selectExpr("ord AS w", "name AS _n"), "w", "left").selectExpr("path", "CASE WHEN path % 3 = 0 THEN _n ELSE 'none' END AS wanted", "model")
    return f, p


@query(
    f"WITH {PROF}, e AS (SELECT path, 0 AS kind, ord, name FROM f JOIN p ON p.name = f.wanted OR p.name = f.wanted || '.icc'), k(w) AS (VALUES ('x1'), ('x5'), ('848'), ('949')), l AS (SELECT path, 1 AS kind, ord, name FROM f JOIN k ON contains(lower(model), w) JOIN p ON contains(lower(name), w)), "
    "b AS (SELECT path, arg_min(name, kind * 1000000 + ord) AS profile FROM (SELECT * FROM e UNION ALL SELECT * FROM l) GROUP BY 1) SELECT f.path, b.profile FROM f LEFT JOIN b USING (path)"
)
def profile_select(spark, sf_dir):
    return rel.select_profile(*_profiles(spark, sf_dir), WORDS)


SETTINGS = "s AS (SELECT o_custkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS setting, o_orderpriority AS name FROM orders), w AS (SELECT path, ['current', 'index', 'name'][path % 3 + 1] AS source, path % 20 AS n, '3-MEDIUM' AS wanted_name, path % (max(setting) + 1) AS cur FROM s GROUP BY 1)"


@query(f"WITH {SETTINGS}, m AS (SELECT path, max(setting) AS last FROM s GROUP BY 1) SELECT s.path, min(setting) AS setting FROM s JOIN w USING (path) JOIN m USING (path) WHERE CASE source WHEN 'current' THEN setting = cur WHEN 'index' THEN setting = least(n, last) ELSE name = wanted_name END GROUP BY 1")
def preset_resolve(spark, sf_dir):
    from pyspark.sql import Window as W

    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("setting"), F.col("o_orderpriority").alias("name"))
    s = s.withColumn("is_current", F.col("setting") == F.col("path") % (F.max("setting").over(W.partitionBy("path")) + 1))
    w = s.select("path").distinct().selectExpr("path", "element_at(array('current', 'index', 'name'), CAST(path % 3 + 1 AS INT)) AS source", "path % 20 AS n", "'3-MEDIUM' AS wanted_name")
    return rel.resolve(s, w)


@query(f"WITH {FILES_SQL}, d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/roll' || (id % 3) AS dir FROM files), r(root) AS (VALUES ('/scans'), ('/scans/Brand-11'), ('/scans/Brand-12/roll1'), ('/other')) SELECT d.dir, (SELECT arg_max(root, length(root)) FROM r WHERE d.dir = root OR starts_with(d.dir, root || '/')) AS root FROM d")
def longest_root(spark, sf_dir):
    d = files(spark, sf_dir).select(F.concat(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("/roll"), (F.col("id") % 3).cast("string")).alias("dir")).distinct()
    roots = spark.createDataFrame([("/scans",), ("/scans/Brand-11",), ("/scans/Brand-12/roll1",), ("/other",)], "root string")
    return rel.longest_root(d, roots)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def reference_exists(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def favourites_removed(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


ADJ = "cur AS (SELECT p_partkey AS id, p_size AS contrast, p_brand AS curve, CASE WHEN p_partkey % 4 > 0 THEN p_size * 2 END AS gamma FROM part), base AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS contrast, 'Brand#11' AS curve, CASE WHEN p_partkey % 5 > 0 THEN p_size * 2 END AS gamma FROM part)"
ADJ_DIFF = "ov AS (SELECT cur.id, CASE WHEN cur.contrast IS DISTINCT FROM base.contrast THEN cur.contrast END AS contrast, CASE WHEN cur.curve IS DISTINCT FROM base.curve THEN cur.curve END AS curve, CASE WHEN cur.gamma IS DISTINCT FROM base.gamma THEN cur.gamma END AS gamma FROM cur JOIN base USING (id))"


def _adjustments(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cur = part.selectExpr("p_partkey AS id", "p_size AS contrast", "p_brand AS curve", "CASE WHEN p_partkey % 4 > 0 THEN p_size * 2 END AS gamma")
    return cur, part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS contrast", "'Brand#11' AS curve", "CASE WHEN p_partkey % 5 > 0 THEN p_size * 2 END AS gamma")


@query(f"WITH {ADJ}, {ADJ_DIFF} SELECT id, coalesce(contrast, -1) AS contrast, curve, coalesce(gamma, -1) AS gamma, contrast IS NOT NULL OR curve IS NOT NULL OR gamma IS NOT NULL AS any_set FROM ov")
def overlay_diff(spark, sf_dir):
    columns = ["contrast", "curve", "gamma"]
    found = rel.overlay_diff(*_adjustments(spark, sf_dir), "id", columns).withColumn("any_set", rel.any_set(columns))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("contrast", "gamma")})


@query(f"WITH {ADJ}, {ADJ_DIFF} SELECT base.id, coalesce(ov.contrast, base.contrast) AS contrast, coalesce(ov.curve, base.curve) AS curve, coalesce(ov.gamma, base.gamma, -1) AS gamma FROM base LEFT JOIN ov USING (id)")
def overlay_apply(spark, sf_dir):
    cur, base = _adjustments(spark, sf_dir)
    columns = ["contrast", "curve", "gamma"]
    return rel.overlay_apply(base, rel.overlay_diff(cur, base, "id", columns), "id", columns).withColumn("gamma", F.coalesce("gamma", F.lit(-1)))




@query(f"WITH {PROF} SELECT f.path, f.wanted, (SELECT min(ord) FROM p WHERE p.name = f.wanted) AS index FROM f")
def name_index(spark, sf_dir):
    """The place of each wanted name in a catalogue; null if it isn't there."""
    f, p = _profiles(spark, sf_dir)
    return rel.looked_up(f.select("path", "wanted"), "wanted", p)


@query("SELECT doc_id, CASE WHEN length(h) > 12 THEN left(h, 11) || '…' ELSE h END AS short FROM (SELECT doc_id, regexp_replace(CASE WHEN starts_with(n, 'user-') THEN substr(n, 6) ELSE n END, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***', 'g') AS h FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'user-' ELSE '' END || source || CASE WHEN doc_id % 3 = 0 THEN ' a.b' || doc_id || '@mail.example' ELSE '' END AS n FROM documents))")
def short_folders(spark, sf_dir):
    n = F.concat(F.when(F.col("doc_id") % 2 == 0, "user-").otherwise(""), "source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" a.b"), F.col("doc_id").cast("string"), F.lit("@mail.example"))).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_folder(n, "user-", 12).alias("short"))


@query("SELECT doc_id, try_cast(nullif(regexp_extract(t, 'cx=\"([^\"]*)\"', 1), '') AS FLOAT) AS cx, try_cast(nullif(regexp_extract(t, 'angle=\"([^\"]*)\"', 1), '') AS FLOAT) AS angle FROM (SELECT doc_id, '<region cx=\"' || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE (doc_id / 8::DOUBLE)::VARCHAR END || CASE WHEN doc_id % 2 = 0 THEN '\" angle=\"0.5\"/>' ELSE '\"/>' END AS t FROM documents)")
def attribute_numbers(spark, sf_dir):
    t = F.concat(F.lit('<region cx="'), F.when(F.col("doc_id") % 5 == 0, "x").otherwise((F.col("doc_id") / 8.0).cast("string")), F.when(F.col("doc_id") % 2 == 0, '" angle="0.5"/>').otherwise('"/>'))
    return table(spark, sf_dir, "documents").select("doc_id", text.attribute_number(t, "cx").alias("cx"), text.attribute_number(t, "angle").alias("angle"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 13 END::INT AS month, (2000 + event_id % 20)::INT AS year, 0 AS hour FROM events")
def date_parts(spark, sf_dir):
    """Parts of dates from maps of texts; what is missing or unreadable is 0."""
    e = F.col("event_id")
    parts = F.create_map(F.lit("Year"), (2000 + e % 20).cast("string"), F.lit("Month"), F.when(e % 3 == 0, "no month").otherwise((e % 13).cast("string")))
    got = table(spark, sf_dir, "events").select("event_id", text.date_parts(parts).alias("d"))
    return got.select("event_id", "d.month", "d.year", "d.hour")
