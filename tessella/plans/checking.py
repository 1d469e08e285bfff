"""Registered queries over grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.operators import grounding as g
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


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_RAW = "|".join(tx.ABBREVIATIONS)
_SENT = rf"""list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({{t}}, '([0-9])\.([0-9])', '\1' || chr(2) || '\2', 'g'), '(?i)(^|[^\p{{{{L}}}}\p{{{{N}}}}_])({_RAW})\.', '\1\2' || chr(3), 'g'), '([.!?])\s+([A-Z"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s : regexp_replace(translate(s, chr(2) || chr(3), '..'), '^\s+|\s+$', '', 'g'))"""
_SPLIT = """SELECT pair_id, CASE WHEN len(k) > 0 THEN k ELSE [trim({c})] END AS s FROM (SELECT pair_id, {c}, list_filter({e}, lambda s : len(regexp_extract_all(s, '\\S+')) >= 3) AS k FROM pairs WHERE trim(context) <> '' AND trim(generated) <> '')"""
_BASE = (
    fx.PAIRS_SQL.strip().join(["WITH ", ""])
    + ", gs AS (SELECT pair_id, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS idx FROM (" + _SPLIT.format(c="generated", e=_SENT.format(t="generated")) + "))"
    + ", cs AS (SELECT pair_id, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS idx FROM (" + _SPLIT.format(c="context", e=_SENT.format(t="context")) + "))"
)
_TOK = f"list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), lambda t : length(t) > 1 AND NOT list_contains({_sql_list(tx.STOP_WORDS)}, t))"
_COUNTS = "{n}t AS (SELECT pair_id, idx, term, total, count(*) AS n FROM (SELECT pair_id, idx, unnest({tok}) AS term, len({tok}) AS total FROM {n}s) GROUP BY ALL)"
_IDF = _BASE + ", " + _COUNTS.format(n="g", tok=_TOK) + ", " + _COUNTS.format(n="c", tok=_TOK) + ", idf AS (SELECT pair_id, term, df, ln((s + 1) / (df + 1)) + 1 AS idf FROM (SELECT pair_id, term, count(*) AS df FROM ct GROUP BY 1, 2) JOIN (SELECT pair_id, count(*) AS s FROM cs GROUP BY 1) USING (pair_id))"
_W = ", {n}w AS (SELECT pair_id, idx, term, round(n / total * coalesce(idf, ln(2) + 1), 6) AS w FROM {n}t LEFT JOIN idf USING (pair_id, term))"
_BEST = (
    _IDF + _W.format(n="g") + _W.format(n="c")
    + """, gn AS (SELECT pair_id, idx, sqrt(sum(w * w)) AS norm FROM gw GROUP BY 1, 2), cn AS (SELECT pair_id, idx, sqrt(sum(w * w)) AS norm FROM cw GROUP BY 1, 2),
dots AS (SELECT a.pair_id, a.idx, b.idx AS best_idx, sum(a.w * b.w) AS dot FROM gw a JOIN cw b ON a.pair_id = b.pair_id AND a.term = b.term GROUP BY ALL),
scored AS (SELECT d.pair_id, d.idx, d.best_idx, CASE WHEN gn.norm * cn.norm > 0 THEN round(dot / (gn.norm * cn.norm), 6) ELSE 0 END AS cosine FROM dots d JOIN gn ON gn.pair_id = d.pair_id AND gn.idx = d.idx JOIN cn ON cn.pair_id = d.pair_id AND cn.idx = d.best_idx),
best AS (SELECT pair_id, idx, best_idx, cosine FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, idx ORDER BY cosine DESC, best_idx) AS r FROM scored WHERE cosine > 0) WHERE r = 1),
ev AS (SELECT pair_id, idx, list(term ORDER BY -round(wg + wc, 6), term)[1:5] AS evidence FROM (SELECT b.pair_id, b.idx, x.term, x.w AS wg, y.w AS wc FROM best b JOIN gw x ON x.pair_id = b.pair_id AND x.idx = b.idx JOIN cw y ON y.pair_id = b.pair_id AND y.idx = b.best_idx AND y.term = x.term) GROUP BY 1, 2)"""
)
_GRAMS = "list_distinct(list_transform(range(1, len(tok{s}) - {m} + 1), lambda i : array_to_string(tok{s}[i:i+{m}], ' ')))"
_MATCHED = (
    _BEST
    + """, mt AS (SELECT gs.pair_id, gs.idx, gs.sentence, coalesce(cs.sentence, '') AS best, coalesce(b.cosine, 0) AS cosine, coalesce(ev.evidence, []::VARCHAR[]) AS evidence,
  regexp_extract_all(lower(gs.sentence), '[a-z0-9]+') AS toka, regexp_extract_all(lower(coalesce(cs.sentence, '')), '[a-z0-9]+') AS tokb
  FROM gs LEFT JOIN best b ON b.pair_id = gs.pair_id AND b.idx = gs.idx LEFT JOIN cs ON cs.pair_id = b.pair_id AND cs.idx = b.best_idx LEFT JOIN ev ON ev.pair_id = gs.pair_id AND ev.idx = gs.idx),
grams AS (SELECT *, """ + _GRAMS.format(s="a", m=1) + " AS ga, " + _GRAMS.format(s="b", m=1) + """ AS gb FROM mt),
matched AS (SELECT pair_id, idx, sentence, best, cosine, evidence, jaccard, least(1.0, floor((70 * round(cosine * 1000000)::BIGINT + 30 * round(jaccard * 1000000)::BIGINT + 5000) / 10000) / 10000) AS similarity FROM (
  SELECT *, CASE WHEN best = '' OR len(list_distinct(list_concat(ga, gb))) = 0 THEN 0 ELSE round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))), 6) END AS jaccard FROM grams))"""
)


#: letters beyond ASCII as a digit, so that the SQL engine's ASCII word boundaries act like Unicode ones
_MASKED = "regexp_replace(sentence, '[À-ÖØ-öø-ɏͰ-Ͽ]', '0', 'g')"


def _esc(pattern: str) -> str:
    return "'" + pattern.replace(g.BEFORE, r"\b").replace(g.AFTER, r"\b").replace("'", "''") + "'"


_CORE = f"regexp_replace(regexp_replace(string_split(regexp_replace(lower(regexp_replace(e, '^\\s+|\\s+$', '', 'g')), {_esc(g.EQUATION_END)}, chr(1), 'g'), chr(1))[1], '^[ .,;:]+|[ .,;:]+$', '', 'g'), '\\s+', '', 'g')"
_CHECKS = {
    "equation": f"len(list_filter(regexp_extract_all(sentence, {_esc(g.EQUATION)}), lambda e : NOT contains(regexp_replace(lower(context), '\\s+', '', 'g'), {_CORE}))) > 0",
    "unit": f"len(list_filter(range(1, len(regexp_extract_all(sentence, {_esc(g.QUANTITY)}, 1)) + 1), lambda i : NOT contains(lower(context), lower(regexp_extract_all(sentence, {_esc(g.QUANTITY)}, 1)[i] || ' ' || regexp_extract_all(sentence, {_esc(g.QUANTITY)}, 2)[i])) AND NOT contains(lower(context), regexp_extract_all(sentence, {_esc(g.QUANTITY)}, 1)[i]))) > 0",
    "citation": f"NOT (regexp_matches(sentence, {_esc(g.LABEL)}) OR len(regexp_extract_all(sentence, '\\S+')) < 5 OR regexp_matches({_MASKED}, {_esc(g.CITATION)}))",
    "definition": f"CASE WHEN NOT regexp_matches({_MASKED}, {_esc(g.DEFINITION)}) THEN false ELSE len(db) > 0 AND len(list_intersect(db, dc)) / greatest(len(db), 1) < 0.30 END",
    "reaction": f"len(list_filter(regexp_extract_all(sentence, {_esc(g.REACTION)}), lambda r : NOT contains(lower(context), replace(lower(trim(r)), '→', '->')) AND NOT contains(lower(context), lower(trim(r))))) > 0",
    "biology": "len(terms) > 0",
}
_NAMES = f"list_filter(regexp_extract_all({_MASKED}, {_esc(g.BINOMIAL)}, 1), lambda x : NOT list_contains({_sql_list(g.PROCESS_TERMS)}, lower(regexp_extract(x, '^(\\S+)', 1))) AND NOT list_contains({_sql_list(g.COMMON_SECOND)}, regexp_extract(x, '\\s+(\\S+)$', 1)))"
_PROCS = f"regexp_extract_all({_MASKED}, " + "'(?i)\\b(" + "|".join(g.PROCESS_PHRASES + g.PROCESS_TERMS) + ")\\b', 1)"
_TRI = "list_distinct(list_transform(range(1, len({t}) - 1), lambda i : array_to_string({t}[i:i+2], ' ')))"
_CHECKED_FROM = (
    _MATCHED
    + f""", prep AS (SELECT m.*, p.subject, p.context, regexp_extract_all(lower(CASE WHEN regexp_matches({_MASKED}, {_esc(g.DEFINITION)}) THEN substr(sentence, length(string_split(regexp_replace({_MASKED}, {_esc(g.DEFINITION)}, chr(1)), chr(1))[1]) + length(regexp_extract({_MASKED}, {_esc(g.DEFINITION)})) + 1) ELSE '' END), '[a-z0-9]+') AS dt,
  regexp_extract_all(lower(p.context), '[a-z0-9]+') AS ctok, list_sort(list_distinct(list_filter(list_concat({_NAMES}, {_PROCS}), lambda x : NOT contains(lower(p.context), lower(x))))) AS terms FROM matched m JOIN pairs p USING (pair_id)),
tri AS (SELECT *, """ + _TRI.format(t="dt") + " AS db, " + _TRI.format(t="ctok") + """ AS dc FROM prep),
flags AS (SELECT *, """ + ", ".join(f"{v} AS f_{k}" for k, v in _CHECKS.items()) + " FROM tri)"
)
_RULES = "CASE subject " + " ".join(f"WHEN '{s}' THEN {_sql_list(r)}" for s, r in g.SUBJECT_RULES.items()) + f" ELSE {_sql_list(g.SUBJECT_RULES['General'])} END"
_VERDICTS = (
    _CHECKED_FROM
    + f""", fl AS (SELECT *, list_filter(['reaction', 'equation', 'unit', 'biology', 'definition', 'citation'], lambda k : list_contains({_RULES}, k) AND CASE k WHEN 'reaction' THEN f_reaction WHEN 'equation' THEN f_equation WHEN 'unit' THEN f_unit WHEN 'biology' THEN f_biology WHEN 'definition' THEN f_definition ELSE f_citation END) AS flagged FROM flags),
sup AS (SELECT *, round(greatest(0.0, least(1.0, similarity - coalesce(list_sum(list_transform(flagged, lambda k : CASE k WHEN 'equation' THEN 0.35 WHEN 'unit' THEN 0.25 WHEN 'definition' THEN 0.30 WHEN 'reaction' THEN 0.40 WHEN 'biology' THEN 0.30 ELSE 0.0 END::DOUBLE)), 0))), 4) AS support FROM fl),
ty AS (SELECT *, list_concat(list_transform(flagged, lambda k : CASE k WHEN 'equation' THEN 'wrong_equation' WHEN 'unit' THEN 'wrong_unit' WHEN 'citation' THEN 'missing_citation' WHEN 'definition' THEN 'wrong_definition' WHEN 'reaction' THEN 'wrong_reaction' ELSE 'wrong_biological_term' END),
  CASE WHEN len(flagged) = 0 AND support < 0.45 THEN ['unsupported_fact'] ELSE []::VARCHAR[] END, CASE WHEN support < 0.20 AND len(evidence) = 0 THEN ['external_knowledge'] ELSE []::VARCHAR[] END) AS t0 FROM sup),
verdict AS (SELECT pair_id, idx, sentence, support, CASE WHEN len(t0) = 0 THEN ['supported'] ELSE t0 END AS types, support < 0.45 AS is_hallucination, least(1.0, floor((10001 + 3 * abs(round(support * 10000)::BIGINT - 4500)) / 2) / 10000) AS confidence,
  CASE WHEN support < 0.30 THEN 'critical' WHEN support < 0.50 THEN 'high' WHEN support < 0.70 THEN 'medium' WHEN support < 0.85 THEN 'low' ELSE 'none' END AS risk FROM ty)"""
)
_REPORT = (
    _VERDICTS
    + """, sums AS (SELECT pair_id, count(*) AS sentences, floor((2 * sum(round(support * 10000)::BIGINT) + count(*)) / (2 * count(*))) / 10000 AS support, round(avg(is_hallucination::INT), 4) AS hallucination_rate, count(*) FILTER (NOT is_hallucination) AS supported, count(*) FILTER (is_hallucination) AS hallucinated,
  count(*) FILTER (is_hallucination AND risk = 'critical') AS critical, count(*) FILTER (is_hallucination AND risk = 'high') AS high, """
    + ", ".join(f"coalesce(list(sentence ORDER BY idx) FILTER (list_contains(types, '{t}')), []::VARCHAR[]) AS {t}" for t in g.TYPES)
    + """ FROM verdict GROUP BY 1), ccount AS (SELECT pair_id, count(*)::INT AS context_sentences FROM cs GROUP BY 1),
report AS (SELECT p.pair_id, p.subject, p.topic, context_sentences, len(regexp_extract_all(context, '\\S+'))::INT AS context_words, len(regexp_extract_all(generated, '\\S+'))::INT AS generated_words, s.* EXCLUDE (pair_id) FROM pairs p JOIN sums s USING (pair_id) JOIN ccount USING (pair_id))"""
)


def _sentences(s, d, side):
    return g.segment_sentences(fx.pairs(s, d), side)


def _weights(s, d):
    pairs = fx.pairs(s, d)
    generated, context = g.segment_sentences(pairs, "generated"), g.segment_sentences(pairs, "context")
    idf = g.tfidf_fit(context)
    return g.tfidf_transform(generated, idf), g.tfidf_transform(context, idf)


@query("segment_sentences", _BASE + " SELECT pair_id, idx, sentence FROM gs")
def _(s, d):
    return _sentences(s, d, "generated")


@query("tokenize", _BASE + f" SELECT pair_id, idx, {_TOK} AS tokens FROM gs")
def _(s, d):
    return _sentences(s, d, "generated").select("pair_id", "idx", tx.tokenize(F.col("sentence")).alias("tokens"))


@query("tfidf_fit", _IDF + " SELECT pair_id, term, df, round(idf, 4) AS idf FROM idf")
def _(s, d):
    return g.tfidf_fit(_sentences(s, d, "context")).withColumn("idf", F.round("idf", 4))


@query("tfidf_transform", _IDF + _W.format(n="g") + " SELECT pair_id, idx, term, w AS weight FROM gw")
def _(s, d):
    return _weights(s, d)[0]


@query("best_context_match", _BEST + " SELECT pair_id, idx, best_idx, round(cosine, 4) AS cosine FROM best")
def _(s, d):
    return g.best_context_match(*_weights(s, d)).withColumn("cosine", F.round("cosine", 4))


@query("evidence_terms", _BEST + " SELECT pair_id, idx, evidence FROM ev")
def _(s, d):
    return g.evidence_terms(*_weights(s, d))


@query("bigram_jaccard", _MATCHED + " SELECT pair_id, idx, round(jaccard, 4) AS jaccard FROM matched")
def _(s, d):
    return g.matched_sentences(fx.pairs(s, d)).select("pair_id", "idx", F.round("jaccard", 4).alias("jaccard"))


@query("support_similarity", _MATCHED + " SELECT pair_id, idx, similarity FROM matched")
def _(s, d):
    return g.matched_sentences(fx.pairs(s, d)).select("pair_id", "idx", "similarity")


def _check(name: str, key: str, column):
    @query(name, _CHECKED_FROM + f" SELECT pair_id, idx, f_{key} AS flagged FROM flags")
    def _(s, d):
        return g.each_sentence(fx.pairs(s, d), lambda s, c, _: column(s, c), "flagged").drop("sentence")


_check("check_equations", "equation", g.check_equations)
_check("check_units", "unit", g.check_units)
_check("check_citations", "citation", lambda s, c: g.check_citations(s))
_check("check_definitions", "definition", g.check_definitions)
_check("check_reactions", "reaction", g.check_reactions)


@query("check_biology_terms", _CHECKED_FROM + " SELECT pair_id, idx, terms FROM flags")
def _(s, d):
    return g.each_sentence(fx.pairs(s, d), lambda s, c, _: g.biology_terms(s, c), "terms").drop("sentence")


@query("subject_rules", _BASE + f" SELECT pair_id, {_RULES} AS rules FROM pairs")
def _(s, d):
    return fx.pairs(s, d).select("pair_id", g.subject_rules(F.col("subject")).alias("rules"))


@query("sentence_verdict", _VERDICTS + " SELECT pair_id, idx, support, types, is_hallucination, confidence, risk FROM verdict")
def _(s, d):
    return g.verdicts(fx.pairs(s, d)).select("pair_id", "idx", "support", "types", "is_hallucination", "confidence", "risk")


@query("grounding_report", _REPORT + " SELECT * FROM report")
def grounding_report(s: SparkSession, d: str) -> DataFrame:
    pairs = fx.pairs(s, d)
    return g.grounding_report(pairs, g.verdicts(pairs))


@query("grounding_summary", _REPORT + " SELECT pair_id, subject, topic, support, hallucination_rate, supported, hallucinated, critical, high, " + ", ".join(f"len({t})::INT AS {t}_count" for t in g.TYPES) + " FROM report")
def _(s, d):
    pairs = fx.pairs(s, d)
    return g.grounding_summary(g.grounding_report(pairs, g.verdicts(pairs))).drop("json")


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '\\S+'))"


@query("faithfulness_overlap", "WITH " + fx.PAIRS_SQL.strip() + f", f AS (SELECT pair_id, least(1.0, len(list_intersect({_WORDS.format(c='generated')}, {_WORDS.format(c='context')})) / greatest(len({_WORDS.format(c='generated')}), 1) * 2) AS f FROM pairs) SELECT pair_id, round(f, 4) AS faithfulness, f >= 0.7 AS is_faithful, f >= 0.85 AS passes FROM f")
def _(s, d):
    return g.faithfulness_overlap(fx.pairs(s, d)).select("pair_id", F.round("faithfulness", 4).alias("faithfulness"), "is_faithful", "passes")
