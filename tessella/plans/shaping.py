"""Registered queries over structured outputs and templates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import outputs, templates
from tessella.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(s, d):
    return read_table(s, d, "documents")


_SCRIPT = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'HOOK: ' || text || chr(10) || '[Concept] one two' || chr(10) || 'EXAMPLE: three' || chr(10) || 'Memory: ' || text || chr(10) || 'NEET ALERT: end'
 WHEN 2 THEN 'HOOK: a' || chr(10) || 'HOOK: b ' || text ELSE text || chr(10) || 'CONCEPT: ' || text END"""
_S = f"s AS (SELECT doc_id AS id, {_SCRIPT} AS text, CASE WHEN doc_id % 5 = 0 THEN source ELSE text END AS context FROM documents)"
_PARSED = f"""WITH {_S}, m AS (SELECT id, regexp_replace(chr(10) || text, '(?i)\\n\\[?(HOOK|CONCEPT|EXAMPLE|MEMORY|NEET ALERT)\\]?:?', chr(1) || '\\1' || chr(2), 'g') AS t, text FROM s),
p AS (SELECT id, text, string_split(t, chr(1))[2:] AS parts FROM m),
e AS (SELECT id, unnest(parts) AS x, generate_subscripts(parts, 1)::INT - 1 AS pos FROM p WHERE len(parts) > 0),
sections AS (SELECT id, pos, upper(string_split(x, chr(2))[1]) AS name, regexp_replace(string_split(x, chr(2))[2], '^\\s+|\\s+$', '', 'g') AS content FROM e
  UNION ALL SELECT id, 0, 'CONCEPT', regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM p WHERE len(parts) = 0)"""


def _scripts(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("id"), F.expr(_SCRIPT.replace("chr(10)", "'\\n'")).alias("text"), F.expr("CASE WHEN doc_id % 5 = 0 THEN source ELSE text END").alias("context"))


@query("parse_sections", _PARSED + " SELECT id, pos, name, md5(content) AS content_md5, len(regexp_extract_all(content, '\\S+'))::INT AS words FROM sections")
def _(s, d):
    return outputs.parse_sections(_scripts(s, d)).select("id", "pos", "name", F.md5("content").alias("content_md5"), "words")


@query(
    "validate_script",
    _PARSED + """, lastc AS (SELECT id, name, max_by(content, pos) AS content FROM sections GROUP BY 1, 2),
miss AS (SELECT s.id, list(n.n ORDER BY n.o) FILTER (coalesce(l.content, '') = '') AS missing FROM s CROSS JOIN (VALUES ('HOOK', 1), ('CONCEPT', 2), ('EXAMPLE', 3), ('MEMORY', 4), ('NEET ALERT', 5)) n(n, o) LEFT JOIN lastc l ON l.id = s.id AND l.name = n.n GROUP BY 1),
w AS (SELECT id, len(regexp_extract_all(text, '\\S+'))::INT AS word_count, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda x : NOT list_contains(['hook', 'concept', 'example', 'memory', 'neet', 'alert'], x)) AS own, list_distinct(regexp_extract_all(lower(context), '[\\p{L}\\p{N}_]+')) AS ctx FROM s),
o AS (SELECT id, word_count, round(len(list_intersect(own, ctx)) / greatest(len(own), 1), 4) AS overlap FROM w)
SELECT o.id, coalesce(missing, []::VARCHAR[]) AS missing, word_count, overlap, missing IS NULL AND word_count BETWEEN 250 AND 320 AND overlap >= 0.35 AS is_valid FROM o JOIN miss USING (id)""",
)
def _(s, d):
    return outputs.validate_script(_scripts(s, d)).select("id", "missing", "word_count", "overlap", "is_valid")


@query(
    "token_cost",
    """WITH c AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' ELSE 'other' END AS model, length(text) // 4 AS tin, length(role || text) // 4 AS tout FROM conversations)
SELECT model, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(sum(tin / 1000 * CASE model WHEN 'm1' THEN 0.002 ELSE 0.005 END + tout / 1000 * CASE model WHEN 'm1' THEN 0.006 ELSE 0.015 END), 6) AS cost FROM c GROUP BY 1""",
)
def _(s, d):
    calls = read_table(s, d, "conversations").selectExpr("CASE conv_id % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' ELSE 'other' END AS model", "text AS prompt", "role || text AS completion")
    prices = s.createDataFrame([("m0", 0.005, 0.015), ("m1", 0.002, 0.006)], "model string, price_in double, price_out double")
    return outputs.token_cost(calls, prices, "m0")


_RAW = f"""CASE doc_id % 6 WHEN 0 THEN j WHEN 1 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || j || ' as asked' WHEN 3 THEN rtrim(j, '}}') || ', }}' WHEN 4 THEN left(j, length(j) - 2) ELSE text END"""
_TRIMMED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_FIX = r"""regexp_replace(CASE WHEN starts_with(f, '{') OR starts_with(f, '[') OR regexp_extract(f, '(?s)(\{.*\}|\[.*\])', 1) = '' THEN f ELSE regexp_extract(f, '(?s)(\{.*\}|\[.*\])', 1) END, ',\s*([\]}])', '\1', 'g')"""


@query(
    "repair_json",
    f"WITH j AS (SELECT doc_id, text, to_json({{'title': text, 'n': doc_id}})::VARCHAR AS j FROM documents), r AS (SELECT doc_id, {_RAW} AS raw FROM j), f AS (SELECT *, CASE WHEN starts_with({_TRIMMED}, '```') THEN regexp_replace(regexp_replace({_TRIMMED}, '(?i)^```(?:json)?\\s*', ''), '\\s*```$', '') ELSE {_TRIMMED} END AS f FROM r), x AS (SELECT *, {_FIX} AS fixed FROM f) "
    "SELECT doc_id, md5(CASE WHEN ok THEN raw WHEN json_valid(fixed) THEN fixed END) AS json_md5, NOT ok AND json_valid(fixed) AS was_repaired, CASE WHEN NOT ok AND NOT json_valid(fixed) THEN 'malformed' END AS error FROM (SELECT *, json_valid(raw) AND NOT regexp_matches(raw, ', \\}$') AS ok FROM x)",
)
def _(s, d):
    rows = _docs(s, d).select("doc_id", "text", F.to_json(F.struct(F.col("text").alias("title"), F.col("doc_id").alias("n"))).alias("j")).select("doc_id", F.expr(_RAW.replace("chr(10)", "'\n'").replace("rtrim(j, '}')", "rtrim('}', j)")).alias("raw"))
    return outputs.repair_json(rows).select("doc_id", F.md5("json").alias("json_md5"), "was_repaired", "error")


_SCENE = "named_struct('scene_id', CASE WHEN i % 2 = 0 THEN i END, 'title', 'T' || i || ' ' || source, 'narration', 'Scene ' || i || '. ' || text, 'bullets', cast(NULL AS array<string>), 'visual_type', CASE WHEN i % 3 = 0 THEN 'diagram' END, 'formula', CASE WHEN i = 2 THEN 'F=ma' END, 'animation', CASE WHEN i % 2 = 0 THEN 'Zoom' ELSE 'Pan' END, 'background', 'bg ' || lang, 'subtitle', CASE WHEN i % 4 = 0 THEN 'sub' END, 'duration', CASE WHEN i % 3 = 1 THEN i * 2.5D END)"
_SQL_SCENES = """WITH sc AS (SELECT doc_id AS id, i AS pos, CASE WHEN i <= 3 + doc_id % 5 THEN i END AS have, CASE WHEN i % 2 = 0 THEN i ELSE i END AS scene_id, 'T' || i || ' ' || source AS title, 'Scene ' || i || '. ' || text AS narration, CASE WHEN i % 4 = 0 THEN 'sub' END AS subtitle, CASE WHEN i % 3 = 1 THEN i * 2.5 END AS duration,
  CASE WHEN i = 2 THEN 'F=ma' END AS formula, CASE WHEN i % 2 = 0 THEN 'Zoom' ELSE 'Pan' END AS animation, 'bg ' || lang AS background, list_extract(['HOOK', 'CONCEPT', 'EXAMPLE', 'MEMORY', 'NEET ALERT'], i) AS dt FROM documents, unnest(range(1, 6)) r(i)),
ns AS (SELECT id, pos::INT AS pos, scene_id::INT AS scene_id, CASE WHEN have IS NULL THEN dt ELSE title END AS title, CASE WHEN have IS NULL THEN 'Overview of ' || dt || ' for the lesson.' ELSE narration END AS narration, CASE WHEN have IS NULL THEN 'Overview of ' || dt ELSE coalesce(subtitle, narration) END AS subtitle,
  CASE WHEN have IS NULL THEN 15.0 ELSE coalesce(duration, round(greatest(5.0, len(regexp_extract_all(narration, '\\S+')) * 0.4), 1)) END AS duration, CASE WHEN have IS NULL THEN 'Static' ELSE animation END AS animation, CASE WHEN have IS NULL THEN 'Clean educational graphic explaining ' || dt ELSE background END AS background, CASE WHEN have IS NOT NULL THEN formula END AS formula FROM sc)"""


def _lessons(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("id"), F.expr(f"transform(sequence(1, cast(3 + doc_id % 5 AS int)), i -> {_SCENE})").alias("scenes"))


@query("normalize_scenes", _SQL_SCENES + " SELECT id, pos, scene_id, title, md5(narration) AS narration_md5, md5(subtitle) AS subtitle_md5, duration::DOUBLE AS duration FROM ns")
def _(s, d):
    return outputs.normalize_scenes(_lessons(s, d)).select("id", "pos", "scene_id", "title", F.md5("narration").alias("narration_md5"), F.md5("subtitle").alias("subtitle_md5"), "duration")


@query("scene_totals", _SQL_SCENES + " SELECT id, count(*) AS scenes, round(sum(duration), 1)::DOUBLE AS total FROM ns GROUP BY 1")
def _(s, d):
    return outputs.total_duration(outputs.normalize_scenes(_lessons(s, d)))


@query("scene_defaults_alt", """SELECT doc_id AS id, (i - 1)::INT AS pos, CASE WHEN i % 3 = 0 THEN 'DIAGRAM' ELSE 'CONCEPT' END AS part, 'T' || i || ' ' || source AS title, 'bg ' || lang AS visual, CASE WHEN i % 2 = 0 THEN 'Zoom' ELSE 'Pan' END AS animation FROM documents, unnest(range(1, 8)) r(i) WHERE i <= 3 + doc_id % 5""")
def _(s, d):
    return outputs.scene_defaults_alt(_lessons(s, d)).select("id", "pos", "part", "title", "visual", "animation")


@query("scene_export", _SQL_SCENES + """ SELECT id, pos, '{"id":"scene_' || scene_id || '","text_prompt":"' || background || '","motion_score":5,"duration":' || duration::DOUBLE || '}' AS motion_payload FROM ns""")
def _(s, d):
    return outputs.scene_export(outputs.normalize_scenes(_lessons(s, d))).select("id", "pos", "motion_payload")


@query("scene_script", _SQL_SCENES + " SELECT id, string_agg('scene ' || scene_id || ': show ' || title || CASE WHEN formula IS NULL THEN '' ELSE ' with ' || formula END || ', hold ' || duration::DOUBLE, chr(10) ORDER BY pos) AS script FROM ns GROUP BY 1")
def _(s, d):
    return outputs.scene_script(outputs.normalize_scenes(_lessons(s, d)))


_QUIZ = "named_struct('difficulty', element_at(array('Easy', 'Medium', 'Hard', 'Easy'), CASE WHEN doc_id % 2 = 0 THEN i ELSE 1 END), 'topic', CASE WHEN i = 1 THEN source END, 'question', CASE WHEN doc_id % 7 = 0 THEN 'Q' || i ELSE 'Q' || i || ' ' || text END, 'options', array('A) one', 'B: two', 'C. three', CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'D four' END), 'correct_answer', element_at(array('A', 'B', 'E', 'D'), i), 'explanation', text, 'reference', CASE WHEN i = 2 THEN lang || ' ' || source ELSE text END)"
_SQL_QUIZ = """WITH q AS (SELECT doc_id AS id, i::INT AS question_id, CASE WHEN doc_id % 2 = 0 THEN ['Easy', 'Medium', 'Hard'][i] ELSE ['Easy', 'Medium', 'Hard'][i] END AS difficulty, CASE WHEN i = 1 THEN source ELSE 'general' END AS topic, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 4 END AS options,
  ['Understand', 'Apply', 'Analyze'][i] AS bloom, CASE WHEN doc_id % 5 <> 0 AND i <> 3 AND doc_id % 7 <> 0 AND length('Q' || i || ' ' || text) >= 5 AND length(text) >= 5 AND length(CASE WHEN i = 2 THEN lang || ' ' || source ELSE text END) >= 5 THEN true ELSE false END AS is_valid, CASE WHEN i = 2 THEN lang || ' ' || source ELSE text END AS reference, text AS context FROM documents, unnest(range(1, 4)) r(i))"""


def _quiz(s, d):
    rows = _docs(s, d).select(F.col("doc_id").alias("id"), F.expr(f"transform(sequence(1, 4), i -> {_QUIZ})").alias("quiz"))
    return outputs.normalize_quiz(rows, F.lit("general"))


@query("normalize_quiz", _SQL_QUIZ + " SELECT id, question_id, difficulty, topic, options, bloom, is_valid FROM q")
def _(s, d):
    return _quiz(s, d).select("id", "question_id", "difficulty", "topic", F.size("options").alias("options"), "bloom", "is_valid")


@query(
    "quiz_grounding",
    _SQL_QUIZ + ", o AS (SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(reference), '[\\p{L}\\p{N}_]+')), list_distinct(regexp_extract_all(lower(context), '[\\p{L}\\p{N}_]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(reference), '[\\p{L}\\p{N}_]+'))), 1) < 0.30 AS low FROM q) SELECT id, bool_and(NOT low) AS is_grounded, count(*) FILTER (low) AS errors FROM o GROUP BY 1",
)
def _(s, d):
    return outputs.quiz_grounding(_quiz(s, d), _docs(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("context")))


_BODY = """CASE doc_id % 4 WHEN 0 THEN 'SYSTEM: teach {topic} well. ' || text || ' USER: tell {subject} and {topic}' WHEN 1 THEN text || ' {retrieved_context} {1bad} {x-y}' WHEN 2 THEN text || ' {topic}' ELSE text END"""
_T = f"t AS (SELECT source AS name, 'v' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version, {_BODY} AS content, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)"


def _templates(s, d):
    """t in Spark: versions are numbered without the texts, which join by document."""
    docs = _docs(s, d)
    numbers = s.sql("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM {docs}", docs=docs.select("doc_id", "source"))
    return docs.join(numbers, "doc_id").select(F.col("source").alias("name"), F.concat(F.lit("v"), "rn").alias("version"), F.expr(_BODY).alias("content"), "doc_id", "lang", "rn")


@query("discover_templates", f"WITH {_T} SELECT name, version, md5(content) AS content_md5 FROM t WHERE doc_id % 9 <> 0")
def _(s, d):
    files = _templates(s, d).select(F.concat(F.when(F.col("doc_id") % 9 == 0, F.lit("drafts/")).otherwise(F.concat("version", F.lit("/"))), "name", F.lit(".prompt")).alias("path"), F.col("content").alias("text"))
    return templates.discover_templates(files).select("name", "version", F.md5("content").alias("content_md5"))


@query("latest_version", f"WITH {_T} SELECT name, 'v' || max(rn) AS latest, 'v' || ((SELECT max(rn) FROM t) + 1) AS next_version FROM t GROUP BY 1")
def _(s, d):
    return templates.latest_version(_templates(s, d))


@query("semver_latest", f"WITH {_T} SELECT name, max_by('v' || (rn % 3) || '.' || (rn % 12) || '.' || rn, [rn % 3, rn % 12, rn]) AS latest FROM t GROUP BY 1")
def _(s, d):
    return templates.semver_latest(_templates(s, d).withColumn("version", F.expr("'v' || (rn % 3) || '.' || (rn % 12) || '.' || rn")))


_PH = "list_sort(list_distinct(regexp_extract_all(content, '\\{([a-zA-Z_][a-zA-Z0-9_]*)\\}', 1)))"


@query("placeholders", f"WITH {_T} SELECT name, version, {_PH} AS names FROM t")
def _(s, d):
    return _templates(s, d).select("name", "version", templates.placeholders(F.col("content")).alias("names"))


@query("missing_variables", f"WITH {_T} SELECT name, version, list_filter({_PH}, lambda x : x <> 'topic') AS missing FROM t")
def _(s, d):
    return _templates(s, d).select("name", "version", templates.missing_variables(F.col("content"), F.create_map(F.lit("topic"), F.lit("light"))).alias("missing"))


@query(
    "render_templates",
    f"WITH {_T}, a AS (SELECT version, lang AS subject, 'More on {{topic}}: ' || lang AS addendum FROM (SELECT DISTINCT version, lang FROM t WHERE rn % 2 = 0)), w AS (SELECT t.name, t.version, a.addendum IS NOT NULL AS has_addendum, CASE WHEN a.addendum IS NULL THEN content ELSE content || chr(10) || chr(10) || addendum END AS whole FROM t LEFT JOIN a ON a.version = t.version AND a.subject = lower(t.lang)) SELECT name, version, has_addendum, CASE WHEN contains(whole, '{{retrieved_context}}') THEN NULL ELSE md5(replace(replace(whole, '{{subject}}', 'physics'), '{{topic}}', 'light')) END AS rendered_md5 FROM w".replace("{{", "{").replace("}}", "}"),
)
def _(s, d):
    t = _templates(s, d)
    addenda = t.where("rn % 2 = 0").select("version", F.col("lang").alias("name")).distinct().withColumn("content", F.concat(F.lit("More on {topic}: "), "name"))
    base = t.select("name", "version", "content", F.upper("lang").alias("subject"), F.create_map(F.lit("topic"), F.lit("light"), F.lit("subject"), F.lit("physics")).alias("variables"))
    return templates.render_templates(base, addenda).select("name", "version", "has_addendum", F.md5("rendered").alias("rendered_md5"))


@query("split_roles", f"WITH {_T} SELECT name, version, CASE WHEN contains(content, 'SYSTEM:') THEN md5(trim(replace(substr(content, 1, instr(content, 'USER:') - 1), 'SYSTEM:', ''))) ELSE md5('') END AS system_md5, md5(trim(CASE WHEN contains(content, 'SYSTEM:') THEN substr(content, instr(content, 'USER:') + 5) ELSE content END)) AS user_md5 FROM t")
def _(s, d):
    return templates.split_roles(_templates(s, d)).select("name", "version", F.md5("system").alias("system_md5"), F.md5("user").alias("user_md5"))


def _registry(s, d):
    return _templates(s, d).where("doc_id % 3 <> 0").select("name", "version", F.sha2(F.when(F.col("doc_id") % 3 == 1, F.col("content")).otherwise("old"), 256).alias("hash"), F.lit("ann").alias("author"), F.lit("n").alias("notes"), F.lit("2024-01-01").alias("saved_at"))


@query("sync_registry", f"WITH {_T} SELECT name, version, sha256(content) AS hash, CASE WHEN doc_id % 3 = 0 THEN 'system' ELSE 'ann' END AS author, CASE doc_id % 3 WHEN 0 THEN 'discovered' WHEN 1 THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN doc_id % 3 = 0 THEN '2025-01-01' ELSE '2024-01-01' END AS saved_at FROM t")
def _(s, d):
    return templates.sync_registry(_registry(s, d), _templates(s, d), F.lit("2025-01-01")).select("name", "version", "hash", "author", "state", "saved_at")


_ASKED = "rn <= 5 OR rn % 10 = 0"
_ASK = "CASE WHEN rn IN (1, 3) THEN NULL WHEN rn IN (2, 4) THEN 'v9001' ELSE version END"
_NEW = "CASE WHEN rn % 20 = 0 THEN ' ' ELSE 'new ' || rn || ' ' || name END"
_LINES = "len(regexp_extract_all(content, '[^\\n]*\\n|[^\\n]+$'))::INT"


def _requests(s, d):
    return _templates(s, d).where(_ASKED).select("name", F.expr(_ASK).alias("version"), F.expr(_NEW).alias("content"), F.lit("bob").alias("author"))


@query(
    "save_version",
    f"""WITH {_T}, last AS (SELECT name, max(rn) AS m FROM t GROUP BY 1), old AS (SELECT name, version AS source_version, {_LINES} AS removed FROM t JOIN last USING (name) WHERE rn = m),
free AS (SELECT name, 'v' || (9001 + row_number() OVER (ORDER BY name, rn)) AS version FROM t WHERE rn IN (1, 3)), fixed AS (SELECT name, 'v9001' AS version FROM t WHERE rn = 2)
SELECT name, version, NULL AS operation, NULL AS source_version, NULL AS added, NULL AS removed FROM t UNION ALL SELECT name, version, 'save', source_version, 1, removed FROM (SELECT * FROM free UNION ALL SELECT * FROM fixed) JOIN old USING (name)""",
)
def _(s, d):
    return templates.save_version(_templates(s, d).select("name", "version", "content"), _requests(s, d)).select("name", "version", "operation", "source_version", "added", "removed")


@query("rejected_requests", f"WITH {_T} SELECT name, {_ASK} AS version, CASE WHEN rn % 20 = 0 THEN 'empty' WHEN rn = 4 THEN 'repeated' ELSE 'exists' END AS reason FROM t WHERE ({_ASKED}) AND rn NOT IN (1, 2, 3)")
def _(s, d):
    return templates.rejected_requests(_templates(s, d), _requests(s, d)).select("name", "version", "reason")


def _successive(s, d):
    t = _templates(s, d).select("name", "version", "content")

    def perf(c: str, shift: int):
        """Lengths and lines of both versions, a number that only every other version has, and a tag that always changes."""
        n = F.substring("to_version", 2, 20).cast("int") - shift
        pairs = [(F.lit("length"), F.length(c).cast("double")), (F.lit("lines"), F.regexp_count(F.col(c), F.lit("\n")).cast("double")), (F.lit("tag"), F.concat(F.lit("t"), n % 3)), (F.when(n % 2 == 0, "even").otherwise(""), n.cast("double"))]
        return F.map_filter(F.create_map(*[x.cast("string") for p in pairs for x in p]), lambda k, _: k != "")

    return templates.successive_pairs(t).where("from_version IS NOT NULL").withColumns({"old_performance": perf("old", 1), "new_performance": perf("new", 0)})


@query(
    "compare_versions",
    f"""WITH {_T}, k AS (SELECT name, rn, tok, count(*) AS n FROM (SELECT name, rn, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS tok FROM t) GROUP BY ALL), sq AS (SELECT name, rn, sum(n * n) AS q FROM k GROUP BY 1, 2),
dots AS (SELECT b.name, b.rn, sum(a.n * b.n) AS dot FROM k a JOIN k b ON a.name = b.name AND a.rn = b.rn - 1 AND a.tok = b.tok GROUP BY 1, 2)
SELECT n.name, o.version AS from_version, n.version AS to_version, ({_LINES.replace('content', 'n.content')} - {_LINES.replace('content', 'o.content')})::INT AS net_lines, coalesce(round(dot / (sqrt(qa.q) * sqrt(qb.q)), 4), 0) AS similarity,
  list_concat(CASE WHEN n.rn % 2 = 0 THEN ['even:,null,' || n.rn::DOUBLE] ELSE ['even:,' || o.rn::DOUBLE || ',null'] END,
    ['length:' || (length(n.content) - length(o.content))::DOUBLE || ',null,null', 'lines:' || (len(regexp_extract_all(n.content, chr(10))) - len(regexp_extract_all(o.content, chr(10))))::DOUBLE || ',null,null', 'tag:,t' || (o.rn % 3) || ',t' || (n.rn % 3)]) AS performance_delta
FROM t n JOIN t o ON n.name = o.name AND o.rn = n.rn - 1 LEFT JOIN dots d ON d.name = n.name AND d.rn = n.rn LEFT JOIN sq qa ON qa.name = n.name AND qa.rn = o.rn LEFT JOIN sq qb ON qb.name = n.name AND qb.rn = n.rn""",
)
def _(s, d):
    """Lines added less lines removed stand for the diff here; the diff itself is held against the standard library's in the tests."""
    out = templates.compare_versions(_successive(s, d)).withColumn("net_lines", F.col("added") - F.col("removed"))
    shown = lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"]["delta"].cast("string"), F.lit("")), F.lit(","), F.coalesce(e["value"]["from"], F.lit("null")), F.lit(","), F.coalesce(e["value"]["to"], F.lit("null")))
    return out.select("name", "from_version", "to_version", "net_lines", "similarity", F.transform(F.map_entries("performance_delta"), shown).alias("performance_delta"))


@query("rollback_version", f"WITH {_T} SELECT name, version, NULL AS operation, NULL AS source_version, NULL AS notes FROM t UNION ALL SELECT name, 'v' || ((SELECT max(rn) FROM t) + row_number() OVER (ORDER BY name, content, version)), 'rollback', version, 'Rollback to ' || version || '.' FROM t WHERE rn <= 2")
def _(s, d):
    t = _templates(s, d)
    return templates.rollback_version(t.select("name", "version", "content"), t.where("rn <= 2"), "eve").select("name", "version", "operation", "source_version", "notes")


_RECORD = "'ann' AS author, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2024-01-0' || (1 + doc_id % 3) END AS saved_at, CASE WHEN doc_id % 2 = 0 THEN 'save' END AS operation, CASE WHEN rn > 1 THEN 'v' || (rn - 1) END AS source_version, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'note ' || lang END AS notes, cast(length(content) % 50 AS int) AS added, cast(doc_id % 7 AS int) AS removed"


@query(
    "changelog",
    f"""WITH {_T}, r AS (SELECT name, version, rn, doc_id, {_RECORD} FROM t) SELECT rn::INT AS number, name, version, '## ' || name || ' ' || version || chr(10) || '- Author: ann' || chr(10) || '- Timestamp: ' || coalesce(saved_at, '') || chr(10) || '- Operation: ' || coalesce(operation, 'save')
 || coalesce(chr(10) || '- Source Version: ' || source_version, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '- Performance: {{"accuracy":' || (doc_id % 10) || '.5,"speed":2.0}}' ELSE '' END || CASE WHEN coalesce(notes, '') = '' THEN '' ELSE chr(10) || '- Notes: ' || notes END || chr(10) || '- Changes: +' || added || ' / -' || removed || ' lines' AS entry FROM r""",
)
def _(s, d):
    figures = F.expr("CASE WHEN doc_id % 5 = 0 THEN map('speed', 2.0D, 'accuracy', doc_id % 10 + 0.5D) ELSE map() END")
    return templates.changelog(_templates(s, d).select("name", "version", figures.alias("performance"), F.expr("struct(" + _RECORD + ")").alias("r")).select("name", "version", "performance", "r.*")).select("number", "name", "version", "entry")
