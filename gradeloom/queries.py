"""The engine's queries over the test tables, each with the same result in DuckDB's SQL where SQL can express it.

The tables hold no exam data, so they stand in: documents are essays (lang the prompt, source the course), lineitem
grouped by l_orderkey are ratings of essays (l_suppkey the rater, l_quantity / 5 the score), embeddings are semantic
vectors, benchmark texts are retrieval chunks, events an audit log, conversations instruction records.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import quality, text
from gradeloom.functions.pii import anonymized
from gradeloom.operators import agreement, dedup, evaluation, retrieval, sampling, stores
from gradeloom.plans.rules import apply_rules
from gradeloom.session import app_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity") / 5
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("essay_id"),
        F.col("l_suppkey").alias("rater_id"),
        score.alias("gold"),
        F.least(F.lit(10.0), F.greatest(F.lit(0.0), score + (F.round(F.col("l_tax") * 100) - 4) / 5)).alias("pred"),
        (1 - F.round(F.col("l_discount") * 100) / 12).alias("confidence"),
        F.col("l_returnflag").alias("exam"),
        F.col("l_linestatus").alias("split"),
    )


RATINGS = """ratings AS (SELECT l_orderkey AS essay_id, l_suppkey AS rater_id, l_quantity / 5 AS gold,
    least(10.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 5 + (round(l_tax * 100) - 4) / 5)) AS pred,
    1 - round(l_discount * 100) / 12 AS confidence, l_returnflag AS exam, l_linestatus AS split FROM lineitem)"""


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums in another order differ in the last ones."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


# --- agreement -------------------------------------------------------------------------------------------------------


@query(f"""WITH {RATINGS}, s AS (SELECT essay_id, gold, lead(gold) OVER (PARTITION BY essay_id ORDER BY gold) - gold AS gap FROM ratings),
a AS (SELECT essay_id, count(*) AS n, avg(gold) AS mean, max(gold) - min(gold) AS spread, stddev_samp(gold) AS sd,
             min(CASE WHEN gap IS NOT NULL THEN {{'gap': gap, 'at': gold}} END) AS pair FROM s GROUP BY essay_id)
SELECT essay_id, n AS n_raters, round(CASE WHEN n <= 2 THEN mean ELSE pair.at + pair.gap / 2 END, 4) AS gold_total,
       CASE WHEN n = 1 THEN 'single_scored' WHEN n = 2 THEN CASE WHEN spread <= 1.0 THEN 'agreed' ELSE 'needs_adjudication' END
            WHEN pair.gap <= 1.0 THEN 'closest_pair' ELSE 'needs_adjudication' END AS status,
       round(spread, 6) AS rater_range, round(coalesce(sd, 0), 6) AS rater_std FROM a""")
def resolve_gold(spark, sf_dir):
    return rounded(agreement.resolve(ratings(spark, sf_dir), "essay_id", "gold"), "gold_total")


_QWK = """i * i AS ii FROM b"""


@query(f"""WITH {RATINGS}, b AS (SELECT split, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings),
a AS (SELECT split, count(*) AS n, sum((i - j) ** 2) AS d, sum(i ** 2) AS ii, sum(j ** 2) AS jj, sum(i) AS si, sum(j) AS sj FROM b GROUP BY split)
SELECT split, n, round(CASE WHEN n * (ii + jj) - 2 * si * sj > 0 THEN 1 - n * d / (n * (ii + jj) - 2 * si * sj) ELSE 1 END, 6) AS qwk FROM a""")
def qwk_contiguous(spark, sf_dir):
    return rounded(agreement.qwk(ratings(spark, sf_dir), "gold", "pred", ("split",)))


@query(f"""WITH {RATINGS}, b AS (SELECT split, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings),
l AS (SELECT DISTINCT split, x FROM (SELECT split, i AS x FROM b UNION ALL SELECT split, j FROM b)),
r AS (SELECT split, x, CAST(dense_rank() OVER (PARTITION BY split ORDER BY x) AS DOUBLE) AS k FROM l),
p AS (SELECT b.split, p.k AS x, q.k AS y FROM b JOIN r p ON p.split = b.split AND p.x = b.i JOIN r q ON q.split = b.split AND q.x = b.j),
a AS (SELECT split, CAST(count(*) AS DOUBLE) AS t, sum((x - y) ** 2) AS d, sum(x * x) AS xx, sum(y * y) AS yy, sum(x) AS sx, sum(y) AS sy FROM p GROUP BY split)
SELECT split, CAST(t AS BIGINT) AS n, round(CASE WHEN t * xx > sx * sx AND t * yy > sy * sy THEN 1 - t * d / (t * (xx + yy) - 2 * sx * sy) END, 6) AS qwk FROM a""")
def qwk_observed(spark, sf_dir):
    return rounded(agreement.qwk_observed(ratings(spark, sf_dir), "gold", "pred", ("split",)))


@query(f"""WITH {RATINGS}, c AS (SELECT essay_id, gold AS v, CAST(count(*) AS DOUBLE) AS c FROM ratings GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY essay_id) AS m FROM c), k AS (SELECT * FROM m WHERE m > 1),
o AS (SELECT a.v, b.v AS w, sum(a.c * (b.c - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) / (a.m - 1)) AS o FROM k a JOIN k b USING (essay_id) GROUP BY a.v, b.v),
n AS (SELECT v, sum(o) AS n FROM o GROUP BY v), l AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS cum FROM n),
g AS (SELECT x.n AS xn, y.n AS yn, (y.cum - x.cum + x.n / 2 - y.n / 2) ** 2 AS dist, o.o FROM l x JOIN l y ON x.v < y.v LEFT JOIN o ON o.v = x.v AND o.w = y.v),
t AS (SELECT sum(n) AS t FROM n)
SELECT CAST(round(t) AS BIGINT) AS n_pairable, round(1 - (sum(2 * o * dist) / t) / (sum(2 * xn * yn * dist) / (t * (t - 1))), 6) AS alpha FROM g, t GROUP BY t""")
def krippendorff_alpha(spark, sf_dir):
    return rounded(agreement.alpha_ordinal(ratings(spark, sf_dir), "essay_id", "gold"))


@query(f"""WITH {RATINGS} SELECT essay_id, count(gold) AS n_raters, min(gold) AS lowest, max(gold) AS highest, round(max(gold) - min(gold), 6) AS rater_range
FROM ratings GROUP BY essay_id HAVING count(gold) >= 2 AND max(gold) - min(gold) > 4""")
def disagreements(spark, sf_dir):
    return rounded(agreement.disagreements(ratings(spark, sf_dir), "essay_id", "gold", 4.0))


@query(f"""WITH {RATINGS}, g AS (SELECT essay_id, avg(gold) AS ref FROM ratings GROUP BY essay_id HAVING count(*) >= 2)
SELECT rater_id, count(*) AS n, round(avg(gold - ref), 6) AS bias, round(avg(abs(gold - ref)), 6) AS mae FROM ratings JOIN g USING (essay_id) GROUP BY rater_id""")
def rater_drift(spark, sf_dir):
    r = ratings(spark, sf_dir)
    gold = r.groupBy("essay_id").agg(F.avg("gold").alias("ref"), F.count("*").alias("k")).where("k >= 2")
    return rounded(agreement.rater_drift(r, gold.select("essay_id", "ref"), "essay_id", "rater_id", "gold", "ref"))


@query(f"""WITH {RATINGS} SELECT essay_id, rater_id, gold, (SELECT arg_min(v, (abs(v - gold), v)) FROM (VALUES (0.0::DOUBLE), (2.5), (5.0), (7.5), (10.0)) t(v)) AS level,
round_even(pred / 0.25, 0) * 0.25 AS stepped FROM ratings""")
def snapped_levels(spark, sf_dir):
    return ratings(spark, sf_dir).select("essay_id", "rater_id", "gold", agreement.snap(F.col("gold"), [0.0, 2.5, 5.0, 7.5, 10.0]).alias("level"), agreement.to_step(F.col("pred")).alias("stepped"))


# --- evaluation ------------------------------------------------------------------------------------------------------

METRICS = """count(*) AS n, round(avg(abs(gold - pred)), 6) AS mae, round(sqrt(avg((gold - pred) ** 2)), 6) AS rmse,
round(avg(CAST(round_even(gold / 0.25, 0) = round_even(pred / 0.25, 0) AS INT)), 6) AS exact_agreement,
round(avg(CAST(abs(gold - pred) <= 1 AS INT)), 6) AS adjacent_agreement,
round((avg(pred) - avg(gold)) / sqrt((var_samp(gold) + var_samp(pred)) / 2), 6) AS smd, round(avg(pred - gold), 6) AS bias,
round(covar_pop(gold, pred) / (stddev_pop(gold) * stddev_pop(pred)), 6) AS pearson, round(stddev_pop(pred), 6) AS pred_std,
round(stddev_pop(gold), 6) AS true_std, round(stddev_pop(pred) / stddev_pop(gold), 6) AS std_ratio"""
_KAPPA = """b AS (SELECT exam, round_even(gold / 0.25, 0) AS i, round_even(pred / 0.25, 0) AS j FROM ratings),
k AS (SELECT exam, round(1 - count(*) * sum((i - j) ** 2) / (count(*) * (sum(i ** 2) + sum(j ** 2)) - 2 * sum(i) * sum(j)), 6) AS qwk FROM b GROUP BY exam)"""


@query(f"WITH {RATINGS}, {_KAPPA}, m AS (SELECT exam, {METRICS} FROM ratings GROUP BY exam) SELECT m.*, k.qwk FROM m JOIN k USING (exam)")
def score_metrics(spark, sf_dir):
    return rounded(evaluation.metrics(ratings(spark, sf_dir), "gold", "pred", ("exam",)))


@query(f"""WITH {RATINGS}, {_KAPPA}, m AS (SELECT exam, {METRICS} FROM ratings GROUP BY exam HAVING count(*) >= 10)
SELECT exam, n, qwk, mae, smd, bias, abs(smd) > 0.25 AS warn_bias, mae > min(mae) OVER () + 0.5 AS warn_mae FROM m JOIN k USING (exam)""")
def fairness_by_group(spark, sf_dir):
    return rounded(evaluation.fairness(ratings(spark, sf_dir), "exam", "gold", "pred"))


_REVIEW = """round(avg(rev), 6) AS review_rate, round(avg(err), 6) AS error_rate_overall,
round(coalesce(sum(err * (1 - rev)) / nullif(sum(1 - rev), 0), 0), 6) AS error_rate_auto_accepted, round(coalesce(sum(err * rev) / nullif(sum(err), 0), 1), 6) AS recall_of_errors,
round(coalesce(sum(err * rev) / nullif(sum(rev), 0), 0), 6) AS precision_of_review, CAST(sum(1 - rev) AS DOUBLE) AS n_auto_accepted, round(sum(1 - rev) / count(*), 6) AS workload_saved"""
_CURVE = f"""r AS (SELECT threshold, CAST(abs(gold - pred) > 0.5 AS INT) AS err, CAST(confidence < threshold AS INT) AS rev FROM ratings, (SELECT 0.3::DOUBLE + unnest(range(14)) * (0.3::DOUBLE + 0.05::DOUBLE - 0.3::DOUBLE) AS threshold)),
curve AS (SELECT round(threshold, 6) AS threshold, {_REVIEW} FROM r GROUP BY threshold)"""


@query(f"WITH {RATINGS}, {_CURVE} SELECT * FROM curve")
def review_curve(spark, sf_dir):
    return rounded(evaluation.threshold_curve(ratings(spark, sf_dir), "gold", "pred", "confidence", 0.5))


@query(f"""WITH {RATINGS}, {_CURVE} SELECT * FROM curve ORDER BY CASE WHEN recall_of_errors >= 0.8 THEN 0 ELSE 1 END,
CASE WHEN recall_of_errors >= 0.8 THEN review_rate ELSE abs(review_rate - 0.15) END, threshold LIMIT 1""")
def suggested_threshold(spark, sf_dir):
    return evaluation.suggest_threshold(rounded(evaluation.threshold_curve(ratings(spark, sf_dir), "gold", "pred", "confidence", 0.5)))


@query(f"""WITH {RATINGS}, a AS (SELECT gold AS v, count(*) AS n FROM ratings GROUP BY gold), b AS (SELECT pred AS v, count(*) AS n FROM ratings GROUP BY pred),
ra AS (SELECT v, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2 AS r FROM a), rb AS (SELECT v, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2 AS r FROM b)
SELECT round(covar_pop(ra.r, rb.r) / (stddev_pop(ra.r) * stddev_pop(rb.r)), 6) AS spearman FROM ratings JOIN ra ON ra.v = gold JOIN rb ON rb.v = pred""")
def spearman(spark, sf_dir):
    return rounded(evaluation.spearman(ratings(spark, sf_dir), "gold", "pred"))


@query(f"""WITH {RATINGS} SELECT split, exam, count(*) AS n, round(avg(abs(pred - gold)), 6) AS mae, round(avg(pred - gold), 6) AS bias FROM ratings GROUP BY GROUPING SETS ((split), (split, exam))""")
def metrics_by_split(spark, sf_dir):
    return rounded(evaluation.by_split(ratings(spark, sf_dir), "gold", "pred", "split", "exam"))


# --- sampling, bands, splits -----------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, o_orderkey, ('0x' || substr(sha256('42:' || o_custkey), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12) AS u FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM o""")
def student_split(spark, sf_dir):
    return sampling.hash_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(f"""WITH {RATINGS}, b AS (SELECT CASE WHEN gold > -0.01 AND gold <= 4 THEN 0 WHEN gold > 4 AND gold <= 6 THEN 1 WHEN gold > 6 AND gold <= 8 THEN 2 WHEN gold > 8 AND gold <= 10.01 THEN 3 ELSE -1 END AS band, exam FROM ratings)
SELECT band, count(*) FILTER (exam = 'A') AS n_a, count(*) FILTER (exam = 'N') AS n_n, count(*) FILTER (exam = 'R') AS n_r FROM b GROUP BY band""")
def band_crosstab(spark, sf_dir):
    banded = ratings(spark, sf_dir).withColumn("band", sampling.band(F.col("gold")))
    counts = banded.groupBy("band").pivot("exam", ["A", "N", "R"]).count().na.fill(0)
    return counts.select("band", *(F.col(x).alias(f"n_{x.lower()}") for x in "ANR"))


@query(f"""WITH {RATINGS}, g AS (SELECT essay_id, avg(gold) AS mean, stddev_samp(gold) AS sd FROM ratings GROUP BY essay_id HAVING count(gold) >= 2),
l AS (SELECT *, greatest(0.0::DOUBLE, least(10.0::DOUBLE, round_even(mean, 0))) AS level FROM g), q AS (SELECT essay_id, level, round(sd + abs(mean - level), 6) AS quality FROM l)
SELECT *, CAST(row_number() OVER (PARTITION BY level ORDER BY quality, essay_id) AS INT) AS place FROM q QUALIFY place <= 3""")
def anchor_essays(spark, sf_dir):
    return sampling.anchors(ratings(spark, sf_dir), "essay_id", "gold")


@query("""SELECT c_custkey, c_mktsegment, c_acctbal, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS rank FROM customer""")
def first_ranks(spark, sf_dir):
    return sampling.first_rank(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_custkey", "c_mktsegment")


_UNIT = "('0x' || substr(sha256('{0}:' || doc_id), 1, 12))::BIGINT / pow(16.0::DOUBLE, 12)".format


@query(f"""WITH r AS (SELECT doc_id, CAST(floor({_UNIT("42a")} * 5) AS INT) AS first, CAST(floor({_UNIT("42b")} * 4) AS INT) AS step, {_UNIT("42")} AS u FROM documents)
SELECT doc_id, first AS rater, 'primary' AS part FROM r UNION ALL SELECT doc_id, (first + 1 + step) % 5, 'secondary' FROM r WHERE u < 0.25::DOUBLE""")
def double_scoring_plan(spark, sf_dir):
    return sampling.double_scoring(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


# --- text ------------------------------------------------------------------------------------------------------------

# written from the list of letters, not from the pattern that the query uses
_VN = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_DIA = f"length(translate(t, '{_VN}{_VN.upper()}', ''))"
_LET = r"(length(t) - length(regexp_replace(t, '\pL', '', 'g')))"


# Cleaning in SQL, step by step. RE2 has no references and doesn't look around, so repeats are told by neighbours in a list,
# and what needs its neighbour is replaced twice.
_sql = lambda s: "'" + s.replace("'", "''") + "'"


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_sql(a)}, {_sql(b)})"
    return x


_SPACES = r"\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FACE = lambda x: rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])[:;=8][\-o*'']?[)\](\[dDpP/\\:}}{{@|]+($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \2', 'g')"
_APART = lambda x: rf"regexp_replace({x}, '([,.;:!?])([^{_SPACES}\p{{Nd}})\]}}…])', '\1 \2', 'g')"
_CLEAN = rf"""c1 AS (SELECT doc_id, regexp_replace(regexp_replace(translate(regexp_replace({_replaced("coalesce(text, '')", text.ENTITIES)}, '{text.TAG}', ' ', 'g'), '{text.INVISIBLE}', ''), '\r\n?', chr(10), 'g'), '{text.CONTROL}', '', 'g') AS t FROM documents),
c2 AS (SELECT doc_id, {_FACE(_FACE(f"regexp_replace(regexp_replace(t, '{text.URL}', '<URL>', 'g'), '{text.EMOJI}', ' ', 'g')"))} AS t FROM c1),
c3 AS (SELECT doc_id, string_split(t, '') AS cs FROM c2),
c4 AS (SELECT doc_id, array_to_string(list_filter(cs, lambda c, i: i = 1 OR c = chr(10) OR cs[i - 1] <> c OR NOT (coalesce(cs[i - 2] = c AND i > 2, false) OR coalesce(cs[i + 1] = c, false))), '') AS t FROM c3),
c5 AS (SELECT doc_id, translate(translate({_replaced("t", [p for a, b in text.TONES for p in ((a, b), (a.upper(), b.upper()))])}, {_sql(text.QUOTES)}, {_sql(text.PLAIN_QUOTES)}), {_sql(text.DASHES)}, {_sql(text.PLAIN_DASHES)}) AS t FROM c4),
c6 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!+', '!', 'g'), '\?+', '?', 'g'), '\.+', '.', 'g'), ',+', ',', 'g'), ';+', ';', 'g'), ':+', ':', 'g') AS t FROM c5),
c7 AS (SELECT doc_id, regexp_replace({_APART(_APART(rf"regexp_replace(t, '[{_SPACES}]+([,.;:!?%)\]}}…])', '\1', 'g')"))}, '([(\[{{])[{_SPACES}]+', '\1', 'g') AS t FROM c6),
c8 AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(t, '[ \t\x{{A0}}]+', ' ', 'g'), chr(10)), lambda x: trim(x, {_STRIP})), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}) AS text FROM c7)"""


@query(f"WITH {_CLEAN} SELECT doc_id, text FROM c8")
def clean_texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_text(F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[\pL\pN_]+') AS ws, list_filter(list_transform(string_split(lower(t), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM d)
SELECT doc_id, CAST(len(ws) AS DOUBLE) AS n_words, CAST(len(ls) AS INT) AS n_lines,
       round(CASE WHEN {_LET} > 0 THEN (length(t) - {_DIA}) / {_LET} ELSE 0 END, 4) AS diacritic_ratio,
       round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END, 4) AS unique_word_ratio,
       round(CASE WHEN {_LET} > 0 THEN (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) / {_LET} ELSE 0 END, 4) AS upper_ratio,
       round(CASE WHEN len(ls) > 0 THEN 1 - len(list_distinct(ls)) / len(ls) ELSE 0 END, 4) AS repeat_line_ratio FROM w""")
def text_figures(spark, sf_dir):
    d = quality.figures(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_lines", "diacritic_ratio", "unique_word_ratio", "upper_ratio", "repeat_line_ratio")


@query()
def anonymized_texts(spark, sf_dir):
    return anonymized(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""WITH d AS (SELECT doc_id, sha1(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS fingerprint FROM documents)
SELECT doc_id, fingerprint, count(*) OVER w AS n_copies, min(doc_id) OVER w AS keeper FROM d WINDOW w AS (PARTITION BY fingerprint)""".replace("\\\\", "\\"))
def exact_duplicates(spark, sf_dir):
    return dedup.exact_groups(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN source END AS source, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS ws, sha1(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS f FROM documents),
k AS (SELECT min(doc_id) AS doc_id, source, f FROM d GROUP BY source, f),
s AS (SELECT DISTINCT d.doc_id, d.source, array_to_string(ws[i:i + 4], ' ') AS h FROM d JOIN k USING (doc_id), LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.source, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.source IS NOT DISTINCT FROM b.source AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT id_a, id_b, source, round(c / (x.n + y.n - c), 4) AS jaccard, round(c / x.n, 4) AS containment_a, round(c / y.n, 4) AS containment_b
FROM p JOIN n x ON x.doc_id = id_a JOIN n y ON y.doc_id = id_b WHERE c / (x.n + y.n - c) >= 0.5
UNION ALL SELECT k.doc_id, d.doc_id, d.source, 1, 1, 1 FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.f = k.f AND d.doc_id > k.doc_id""")
def near_duplicate_pairs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    groups = written(dedup.exact_groups(d, "doc_id", "text", ("source",)))
    return dedup.with_copies(dedup.near_pairs(d, "doc_id", "text", ("source",), groups=groups), d, "doc_id", "text", ("source",), groups)


_ROUNDS = 12
_ROUND = lambda r: f"""t{r} AS MATERIALIZED (SELECT id FROM u{r} WHERE id NOT IN (SELECT id_b FROM e JOIN u{r} x ON x.id = id_a JOIN u{r} y ON y.id = id_b)),
u{r + 1} AS MATERIALIZED (SELECT id FROM u{r} WHERE id NOT IN (SELECT id FROM t{r}) AND id NOT IN (SELECT id_b FROM e JOIN t{r} ON t{r}.id = id_a))"""  # noqa: E731


@query(ORACLES["near_duplicate_pairs"].split("SELECT id_a, id_b, source, round")[0].rstrip() + f""",
e AS MATERIALIZED (SELECT id_a, id_b, c / (x.n + y.n - c) AS j FROM p JOIN n x ON x.doc_id = id_a JOIN n y ON y.doc_id = id_b WHERE c / (x.n + y.n - c) >= 0.5),
u0 AS MATERIALIZED (SELECT doc_id AS id FROM k), {", ".join(_ROUND(r) for r in range(_ROUNDS))},
leads AS ({" UNION ALL ".join(f"SELECT id FROM t{r}" for r in range(_ROUNDS))}),
best AS (SELECT id_b, id_a, j FROM e JOIN leads ON id = id_a WHERE id_b NOT IN (SELECT id FROM leads) QUALIFY row_number() OVER (PARTITION BY id_b ORDER BY j DESC, id_a) = 1)
SELECT d.doc_id, d.source, coalesce(id_a, k.doc_id) AS leader, round(coalesce(j, 1), 4) AS jaccard FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.f = k.f LEFT JOIN best ON best.id_b = k.doc_id""")
def near_duplicate_families(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    return dedup.near_families(d, "doc_id", "text", ("source",))


@query("""SELECT doc_id, round((CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'der') OR contains(t, 'die') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'ciones') THEN 1 ELSE 0 END) / 3, 6) AS coverage
FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def keyword_coverage(spark, sf_dir):
    words = F.array(F.lit("the"), F.lit("der|die"), F.lit("ciones"))
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(text.keyword_coverage(F.coalesce("text", F.lit("")), words), 6).alias("coverage"))


@query("""WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT v.vec_id, v.label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS sim_prompt FROM v JOIN c USING (label, i) GROUP BY v.vec_id, v.label""")
def prompt_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.transform("c", lambda s: s["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", "label", F.round(text.cosine(F.col("embedding"), F.col("centre")), 6).alias("sim_prompt"))


@query(r"""WITH c AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN_]{2,}') AS ws FROM benchmark WHERE trim(text) <> ''),
ct AS (SELECT item_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM c),
tf AS (SELECT item_id, term, count(*) AS tf FROM ct GROUP BY ALL), n AS (SELECT count(*) AS n FROM c),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
r AS (SELECT item_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term)), nr AS (SELECT item_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY item_id),
w AS (SELECT item_id, term, raw / norm AS w FROM r JOIN nr USING (item_id)),
q0 AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_extract_all(lower(text), '[\pL\pN_]{2,}') AS ws FROM conversations),
qt AS (SELECT turn_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM q0),
qf AS (SELECT turn_id, term, count(*) AS tf FROM qt GROUP BY ALL), qr AS (SELECT turn_id, term, (1 + ln(tf)) * idf AS raw FROM qf JOIN idf USING (term)),
qn AS (SELECT turn_id, sqrt(sum(raw * raw)) AS norm FROM qr GROUP BY turn_id),
s AS (SELECT turn_id, item_id, round(sum(raw / norm * w), 6) AS score FROM qr JOIN qn USING (turn_id) JOIN w USING (term) GROUP BY turn_id, item_id)
SELECT turn_id, item_id, score, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, item_id) AS INT) AS place FROM s WHERE score > 0 QUALIFY place <= 4""")
def retrieve_passages(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return retrieval.search(turns, "turn_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")


@query(ORACLES["retrieve_passages"].replace("FROM benchmark WHERE trim(text) <> ''", "FROM benchmark WHERE trim(text) <> '' AND item_id % 7 <> 0").replace("FROM s WHERE score > 0", "FROM s WHERE score > 0 AND item_id % 3 = turn_id % 3 AND (item_id % 2 = 1 OR turn_id % 5 = 0 OR item_id % 4 = turn_id % 4)"))
def retrieve_of_course(spark, sf_dir):
    """Chunks of the query's course, and of its prompt or of none, compete; chunks that aren't approved are in no index."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    turns = turns.withColumns({"course": (F.col("turn_id") % 3).cast("string"), "prompt": F.when(F.col("turn_id") % 5 != 0, (F.col("turn_id") % 4).cast("string"))})
    item = F.col("item_id")
    chunks = read(spark, sf_dir, "benchmark").withColumns({"course": (item % 3).cast("string"), "prompt": F.when(item % 2 == 0, (item % 4).cast("string")), "approved": F.when(item % 7 != 0, "true").otherwise("no")})
    return retrieval.search(turns, "turn_id", "text", chunks, "item_id", "text", course="course", prompt="prompt", approved="approved")


@query(ORACLES["retrieve_passages"])
def retrieve_by_segments(spark, sf_dir):
    """The same from a store to which the chunks came in three batches, one of them from another store."""
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    chunks, folder = read(spark, sf_dir, "benchmark"), f"{app_folder(spark)}/index-{uuid4().hex}"
    store, other = stores.TermIndex(spark, f"{folder}/a"), stores.TermIndex(spark, f"{folder}/b")
    for part, to in enumerate((store, store, other)):
        to.add(chunks.where(F.pmod("item_id", F.lit(3)) == part), "item_id", "text")
    store.merge(other)
    return retrieval.search(turns, "turn_id", "text", chunks, "item_id", "text", indexed=store.view())


# --- rules, joins, reports -------------------------------------------------------------------------------------------

RULES = [
    {"id": "R1", "when": "confidence < 0.4", "action": "review", "flag": "LOW_CONFIDENCE", "reason": "not sure"},
    {"id": "R2", "when": "pred - gold > 0.5 and exam == 'R'", "action": "subtract", "value": 0.5, "flag": "TOO_HIGH"},
    {"id": "R3", "when": "exam in ['A', 'R'] and not (gold >= 9)", "action": "cap_total", "value_expr": "gold + 1"},
    {"id": "R4", "when": "missing_name > 1", "action": "set_total", "value": 0},
    {"id": "R5", "when": "open('x')", "action": "set_total", "value": 0},
    {"id": "R6", "when": "confidence > 0.9", "action": "set_total", "value": 12},
    {"id": "R7", "action": "set_total", "value": 0},
]


@query(f"""WITH {RATINGS}, a AS (SELECT *, confidence < 0.4::DOUBLE AS r1, pred - gold > 0.5::DOUBLE AND exam = 'R' AS r2, exam IN ('A', 'R') AND NOT gold >= 9 AS r3 FROM ratings),
b AS (SELECT *, CASE WHEN r2 THEN greatest(0.0::DOUBLE, pred - 0.5::DOUBLE) ELSE pred END AS t FROM a)
SELECT essay_id, rater_id, gold, pred, CASE WHEN confidence > 0.9::DOUBLE THEN 12.0 WHEN r3 THEN least(t, gold + 1) ELSE t END AS final_total,
       array_to_string(list_filter([CASE WHEN r1 THEN 'LOW_CONFIDENCE' END, CASE WHEN r2 THEN 'TOO_HIGH' END], lambda x: x IS NOT NULL), '|') AS flags,
       array_to_string(list_filter([CASE WHEN r1 THEN 'R1' END, CASE WHEN r2 THEN 'R2' END, CASE WHEN r3 THEN 'R3' END, CASE WHEN confidence > 0.9::DOUBLE THEN 'R6' END], lambda x: x IS NOT NULL), '|') AS applied_rules,
       'R4: missing_name is not defined; R5: not allowed' AS skipped_rules, r1 AS needs_review, CASE WHEN r1 THEN 'R4: missing_name is not defined; R5: not allowed; not sure' ELSE '' END AS review_reason FROM b""")
def scoring_rules(spark, sf_dir):
    found = apply_rules(ratings(spark, sf_dir), RULES, "pred")
    return found.select("essay_id", "rater_id", "gold", "pred", "final_total", "flags", "applied_rules", "skipped_rules", "needs_review", "review_reason")


@query("""SELECT source, lang, count(*) AS n_docs, count(l.doc_id) AS n_labelled, sum(quality) AS n_good, round(avg(n_chars), 6) AS mean_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source, lang""")
def labelled_summary(spark, sf_dir):
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), F.col("quality").cast("long").alias("quality"))
    joined = d.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return joined.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count("l_id").alias("n_labelled"), F.sum("quality").alias("n_good"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def unlabelled(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS INT) AS place FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY place <= 2""")
def audit_top_events(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type"))).where("place <= 2")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS record, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def instruction_records(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda s: F.concat(s["role"], F.lit(": "), s["text"])
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, line), "\n").alias("record"), F.count("*").alias("n_turns"))
