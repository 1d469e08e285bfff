"""Registered queries over text metrics and version comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import grounding, metrics
from tessella.plans import fixtures as fx
from tessella.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P = "WITH " + fx.PAIRS_SQL.strip()
_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_T = _P + f", t AS (SELECT pair_id, version, mode, topic, subject, generated, {_TOK.format(c='context')} AS r, {_TOK.format(c='generated')} AS c FROM pairs)"
_GRAM = "SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest(list_transform(range(1, len({s}) - {m} + 1), lambda i : array_to_string({s}[i:i+{m}], ' '))) AS g FROM t) GROUP BY 1, 2"
_PREC = "p{k} AS (SELECT a.pair_id, sum(least(a.n, coalesce(b.n, 0))) / sum(a.n) AS p{k} FROM (" + _GRAM.format(s="c", m="{m}") + ") a LEFT JOIN (" + _GRAM.format(s="r", m="{m}") + ") b USING (pair_id, g) GROUP BY 1)"
_BLEU = _T + ", " + _PREC.format(k=1, m=0) + ", " + _PREC.format(k=2, m=1) + ", bleu AS (SELECT t.pair_id, CASE WHEN len(r) > 0 AND len(c) > 0 AND coalesce(p1, 0) > 0 AND coalesce(p2, 0) > 0 THEN round(least(1.0, exp(1 - len(r) / len(c))) * exp((ln(p1) + ln(p2)) / 2), 4) ELSE 0 END AS bleu FROM t LEFT JOIN p1 USING (pair_id) LEFT JOIN p2 USING (pair_id))"
_COS = _BLEU + ", co AS (SELECT t.pair_id, coalesce(round(dot / (sqrt(aa) * sqrt(bb)), 4), 0) AS cosine FROM t LEFT JOIN (SELECT pair_id, sum(a.n * b.n) AS dot, sum(a.n * a.n) AS aa, sum(b.n * b.n) AS bb FROM (" + _GRAM.format(s="r", m=0) + ") a FULL JOIN (" + _GRAM.format(s="c", m=0) + ") b USING (pair_id, g) GROUP BY 1) USING (pair_id))"
_READ = """round(greatest(0.0, least(1.0, (206.835 - 1.015 * (nw / ns) - 84.6 * (sy / nw)) / 100)), 4)"""
_FL = _COS + f""", fl AS (SELECT pair_id, CASE WHEN nw = 0 OR ns = 0 THEN 0.5 ELSE {_READ} END AS readability FROM (SELECT pair_id, len(ws) AS nw, len(list_filter(string_split_regex(generated, '[.!?]+'), lambda s : regexp_matches(s, '\\S'))) AS ns,
  list_sum(list_transform(ws, lambda w : greatest(1, len(regexp_extract_all(w, '[aeiouyAEIOUY]+'))))) AS sy FROM (SELECT pair_id, generated, regexp_extract_all(generated, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM pairs)))"""
_FEATURES = """, word AS (SELECT pair_id, version, mode, topic, subject, list_distinct(regexp_extract_all(lower(generated), '[a-z]+')) AS toks, len(regexp_extract_all(generated, '[\\p{L}\\p{N}_]+')) AS wc, length(generated) AS chars FROM pairs),
feat AS (SELECT *, len(list_filter(toks, lambda x : NOT list_contains({stop}, x))) AS uq, CASE subject {vocab} ELSE NULL END AS voc FROM word),
features AS (SELECT pair_id, version, mode, topic, wc::INT AS word_count, uq::INT AS unique_tokens, CASE WHEN voc IS NULL THEN 0 ELSE round(len(list_intersect(toks, voc)) / len(voc), 4) END AS specificity, CASE WHEN wc = 0 THEN 0 ELSE round(uq / wc * 100, 2) END AS density, chars::INT AS chars FROM feat)""".replace(
    "{stop}", "[" + ", ".join(f"'{w}'" for w in metrics.tx.FEATURE_STOP_WORDS) + "]"
).replace("{vocab}", " ".join(f"WHEN '{s}' THEN [" + ", ".join(f"'{w}'" for w in v) + "]" for s, v in metrics.SUBJECT_TERMS.items()))


_LCS = """lcs AS (SELECT pair_id, 0 AS i, list_transform(range(0, len(r) + 1), lambda x : 0) AS p, r, c FROM t
  UNION ALL SELECT pair_id, i + 1, list_transform(range(1, len(q) + 1), lambda j : list_max(q[1:j])), r, c FROM (
    SELECT pair_id, i, r, c, list_transform(range(1, len(p) + 1), lambda j : CASE WHEN j > 1 AND r[j - 1] = c[i + 1] THEN greatest(p[j], p[j - 1] + 1) ELSE p[j] END) AS q FROM lcs WHERE i < len(c))),
rouge AS (SELECT pair_id, CASE WHEN p[len(p)] = 0 THEN 0 ELSE round(2 * p[len(p)] / (len(r) + len(c)), 4) END AS rouge_l FROM lcs WHERE i = len(c))"""
_ROUGE = _T.replace("WITH", "WITH RECURSIVE", 1) + ", " + _LCS
_SAMPLES = _FL.replace("WITH", "WITH RECURSIVE", 1) + ", " + _LCS + """,
base AS (SELECT pair_id, p.version, pair_id % 6 AS sections, pair_id % 6 = 5 AS valid, len(regexp_extract_all(p.generated, '\\S+')) AS words, bleu, rouge_l, cosine, readability, pair_id % 3 = 0 AS grounded, pair_id % 2 = 0 AS aligned
  FROM pairs p JOIN bleu USING (pair_id) JOIN rouge USING (pair_id) JOIN co USING (pair_id) JOIN fl USING (pair_id)),
s1 AS (SELECT pair_id, version, sections, CASE WHEN valid THEN 0.95 ELSE 0.75 END::DOUBLE AS accuracy, least(1.0::DOUBLE, cosine::DOUBLE * 1.5::DOUBLE) AS context_usage, CASE WHEN grounded THEN 0.05 ELSE 0.35 END::DOUBLE AS hallucination,
  CASE WHEN valid THEN 1.0::DOUBLE ELSE sections / 5 END AS structure, readability::DOUBLE AS readability, CASE WHEN aligned THEN 0.92 ELSE 0.60 END::DOUBLE AS alignment, CASE WHEN words BETWEEN 250 AND 320 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs(285 - words) / 285) END AS length,
  0.90::DOUBLE AS stability, 0.92::DOUBLE AS consistency, bleu::DOUBLE AS bleu, rouge_l::DOUBLE AS rouge_l, cosine::DOUBLE AS cosine FROM base),
samples AS (SELECT *, floor((2 * (30 * round(accuracy * 100000)::BIGINT + 25 * round(structure * 100000)::BIGINT + 20 * round(context_usage * 100000)::BIGINT + 10 * round(readability * 100000)::BIGINT + 15 * round(pair_id % 6 / 5 * 100000)::BIGINT) + 1000) / 2000) / 10000 AS manual FROM s1)"""
_SCORES = _SAMPLES + ", means AS (SELECT version, " + ", ".join(f"floor((2 * sum(round({m} * 1000000)::BIGINT) + 100 * count(*)) / (200 * count(*))) / 10000 AS {m}" for m in metrics.METRICS) + """ FROM samples GROUP BY 1),
scores AS (SELECT *, floor((2 * (20 * round(accuracy * 10000)::BIGINT + 15 * round(context_usage * 10000)::BIGINT + 20 * (10000 - round(hallucination * 10000)::BIGINT) + 15 * round(structure * 10000)::BIGINT + 15 * round(alignment * 10000)::BIGINT + 15 * round(length * 10000)::BIGINT) + 100) / 200) / 10000 AS overall FROM means)"""
_BARS = "repeat('█', floor(overall * 30)::INT) || repeat('░', 30 - floor(overall * 30)::INT)"
_MATRIX = _SCORES + f""", cells AS (SELECT version, metric, printf('%.4f', value) AS cell FROM (UNPIVOT scores ON overall, {", ".join(metrics.METRICS)} INTO NAME metric VALUE value) UNION ALL SELECT version, 'bar', {_BARS} FROM scores)
SELECT metric, """ + ", ".join(f"max(cell) FILTER (version = '{v}') AS {v}" for v in ("v1", "v2", "v3")) + " FROM cells GROUP BY 1"


def _features(s, d):
    return metrics.prompt_features(fx.pairs(s, d), "generated")


def _samples(s, d):
    rows = fx.pairs(s, d).withColumns({"sections": F.expr("cast(pair_id % 6 AS int)"), "is_valid": F.expr("pair_id % 6 = 5"), "is_grounded": F.expr("pair_id % 3 = 0"), "is_aligned": F.expr("pair_id % 2 = 0")})
    return metrics.sample_scores(rows)


@query("bleu2", _BLEU + " SELECT * FROM bleu")
def _(s, d):
    return metrics.bleu2(fx.pairs(s, d))


@query("rouge_l", _ROUGE + " SELECT * FROM rouge")
def _(s, d):
    return metrics.rouge_l(fx.pairs(s, d))


@query("tf_cosine", _COS + " SELECT * FROM co")
def _(s, d):
    return metrics.tf_cosine(fx.pairs(s, d))


@query("flesch_readability", _FL + " SELECT * FROM fl")
def _(s, d):
    return fx.pairs(s, d).select("pair_id", metrics.flesch_readability(F.col("generated")).alias("readability"))


@query("sample_scores", _SAMPLES + " SELECT pair_id, version, " + ", ".join(metrics.METRICS) + " FROM samples")
def _(s, d):
    return _samples(s, d)


@query("version_scores", _SCORES + " SELECT * FROM scores")
def _(s, d):
    return metrics.version_scores(_samples(s, d))


@query("winning_version", _SCORES + " SELECT version, overall FROM scores ORDER BY overall DESC, regexp_extract(version, '([0-9]+)', 1)::INT LIMIT 1")
def _(s, d):
    return metrics.winning_version(metrics.version_scores(_samples(s, d)))


@query("metric_matrix", _MATRIX)
def _(s, d):
    return metrics.metric_matrix(metrics.version_scores(_samples(s, d)), ["v1", "v2", "v3"])


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '\\S+'))"


@query("ab_compare", _P + f", f AS (SELECT version, least(1.0, len(list_intersect({_WORDS.format(c='generated')}, {_WORDS.format(c='context')})) / greatest(len({_WORDS.format(c='generated')}), 1) * 2) AS f FROM pairs), m AS (SELECT round(avg(f) FILTER (version = 'v1'), 4) AS mean_a, round(avg(f) FILTER (version = 'v2'), 4) AS mean_b FROM f) SELECT mean_a, mean_b, CASE WHEN coalesce(mean_b, 0) > coalesce(mean_a, 0) THEN 'v2' ELSE 'v1' END AS winner FROM m")
def _(s, d):
    return metrics.ab_compare(grounding.faithfulness_overlap(fx.pairs(s, d)), "v1", "v2")


@query("prompt_features", _P + _FEATURES + " SELECT pair_id, word_count, unique_tokens, specificity, density, chars FROM features")
def _(s, d):
    return _features(s, d).select("pair_id", "word_count", "unique_tokens", "specificity", "density", "chars")


@query(
    "paired_delta",
    _P + _FEATURES + """, long AS (SELECT topic, mode, metric, value FROM (SELECT topic, mode, word_count::DOUBLE AS word_count, specificity::DOUBLE AS specificity, density::DOUBLE AS density FROM features) UNPIVOT (value FOR metric IN (word_count, specificity, density))),
e AS (SELECT topic, metric, avg(value) FILTER (mode = 0) AS a, avg(value) FILTER (mode = 1) AS b FROM long GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL),
u AS (SELECT * FROM e UNION ALL SELECT NULL, metric, avg(a), avg(b) FROM e GROUP BY 2)
SELECT topic, metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta, CASE WHEN round(b - a, 4) > 0 THEN 'B' WHEN round(b - a, 4) < 0 THEN 'A' ELSE 'Tie' END AS winner FROM u""",
)
def _(s, d):
    rows = _features(s, d).withColumn("word_count", F.col("word_count").cast("double"))
    return metrics.paired_delta(rows, ["word_count", "specificity", "density"])
