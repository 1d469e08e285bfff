"""Registered queries over speech text and word timing, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions import notation as n
from tessella.operators import speech, timing
from tessella.sources.tables import read_table, spread

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NOTES = """CASE doc_id % 6 WHEN 0 THEN ' The force is 20 N over 5 m and v² = u² + 2as.' WHEN 1 THEN ' Add 3H2SO4 (aq) to AgNO3, remember Na+ and O3 at 300 K.' WHEN 2 THEN ' The mRNA meets the 70S ribosome near the 5'' end, important: ATP.' WHEN 3 THEN ' **Note** \\\\frac{a}{b} and x_1 with α ≤ 90° or 5 kg 3.' WHEN 4 THEN ' m 1 m 2 and 9.8 m/s2 or 50 Hz' ELSE '' END"""


_SUBJECTS = ("physics", "chemistry", "biology", "Other")
_W, _N = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {_lit(pattern)}, {_lit(by)}, 'g')"


def _all(t: str, rules) -> str:
    for pattern, by in rules:
        t = _sub(t, pattern, by)
    return t


def _plain(t: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        t = f"replace({t}, {_lit(k)}, {_lit(v)})"
    return t


def _cases(x: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def _by_word(t: str, spoken: str) -> str:
    """t with every run of word characters w replaced by the expression spoken."""
    return f"array_to_string(list_transform(regexp_extract_all({t}, '{_W}+|{_N}+'), lambda w : {spoken}), '')"


def _escaped(k: str) -> str:
    return re.sub(r"([/^()'.])", r"\\\1", k).replace("\\'", "'").replace("\\/", "/")


def _sql_units(t: str) -> str:
    guarded = f"regexp_replace({t}, '(\\s[A-Za-z]\\s[0-9])', '\\1' || chr(3), 'g')"
    return f"replace({_all(guarded, [(rf'([0-9])\s*{_escaped(k)}($|[^\p{{L}}\p{{N}}_\s]|\s+$|\s+[^\s0-9])', rf'\1 {v}\2') for k, v in n.UNITS.items()])}, chr(3), '')"


_EL = "(?:" + "|".join(n.ELEMENTS) + ")"
_NUMBERED = "array_to_string(list_transform(string_split(ltrim(regexp_replace(regexp_replace({x}, '([A-Z])', ' \\1', 'g'), '([0-9]+)', ' \\1', 'g')), ' '), lambda y : " + _cases("y", n.NUMBER_WORDS, "y") + "), ' ') || ' '"
_FORMULA = f"CASE WHEN regexp_full_match(w, '(?:{_EL}[0-9]*){{2,}}') THEN {_NUMBERED.replace('{x}', 'w')} WHEN regexp_matches(w, '^{_EL}[0-9]') THEN {_NUMBERED.replace('{x}', f"regexp_extract(w, '^{_EL}[0-9]+')")} || regexp_replace(w, '^{_EL}[0-9]+', '') ELSE w END"
_ION = (rf"(^|{_N})([A-Z][a-z]?)\s*\+(?:\s*($)|\s*([^\p{{L}}\p{{N}}_\s])|\s*(\s)({_W}))", r"\1\2 ion \3\4\5\6")
_NAMED = {k: f" {v} " for k, v in n.COMPOUNDS.items()} | n.MECHANISMS


def _steps(src: str, name: str, *steps: str) -> str:
    """CTEs that put column t of src through the steps, each an expression over t; name holds the last."""
    out = []
    for i, step in enumerate(steps):
        out.append(f"{name if i == len(steps) - 1 else f'{name}_{i}'} AS MATERIALIZED (SELECT doc_id, subject, {step} AS t FROM {src if i == 0 else f'{name}_{i - 1}'})")
    return ", ".join(out)


def _sql_pass(src: str, name: str) -> str:
    """name: the subject pass over src."""
    chemistry = [_sub("t", "(^|[^A-Za-z0-9])([0-9]+)([A-Z])", r"\1\2 \3"), _by_word("t", _cases("w", _NAMED, "w")), _all(_plain("t", {k: f" {v} " for k, v in n.STATES.items()}), [_ION, _ION]), _by_word("t", _FORMULA), _sql_units("t")]
    biology = [_all("t", [(rf"{_escaped(k)}($|[^A-Za-z])", rf"{v}\1") for k, v in sorted(n.BIOLOGY.items(), key=lambda kv: -len(kv[0]))]), _sql_units("t")]
    physics = [_sql_units("t"), _by_word("t", "CASE WHEN regexp_full_match(w, '[0-9][a-z]{1,3}') THEN ltrim(regexp_replace(w, '(.)', ' \\1', 'g')) ELSE w END")]
    parts = [(f"(SELECT * FROM {src} WHERE subject = 'chemistry')", chemistry), (f"(SELECT * FROM {src} WHERE subject = 'biology')", biology), (f"(SELECT * FROM {src} WHERE subject NOT IN ('chemistry', 'biology'))", physics)]
    return ", ".join(_steps(p, f"{name}_p{i}", *steps) for i, (p, steps) in enumerate(parts)) + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_p{i}" for i in range(3)) + ")"


_SQL_SPACE = [(r"\s+", " "), (r" ([,.;:!?])", r"\1"), ("^ | $", "")]


def _sql_prosody(src: str, name: str) -> str:
    quiet = {*n.PAUSE_STOPS, *n.NUMBER_WORDS.values()}
    key = "CASE WHEN subject IN ('chemistry', 'biology') THEN subject ELSE 'physics' END"
    lists = lambda words: "[" + ", ".join(_lit(w.lower()) for w in sorted(words)) + "]"
    words = "CASE key " + " ".join(f"WHEN '{k}' THEN {lists(v)}" for k, v in n.EMPHASIS.items()) + " END"
    tail = _all("coalesce(t, '')", [(r"\s*:\s*", ", "), (r",\s*,+", ", "), *_SQL_SPACE])
    return f"""{name}_w AS (SELECT doc_id, subject, {key} AS key, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(t, '{_W}+|{_N}+') AS ws FROM {src})),
{name}_c AS (SELECT doc_id, subject, i, CASE WHEN regexp_full_match(w, '\\s+') AND list_contains({words}, lower(coalesce(nxt, ''))) AND length(coalesce(prv, '')) >= 2 AND NOT list_contains(list_concat({lists(quiet)}, {words}), lower(prv)) THEN ', ' ELSE w END AS w
  FROM (SELECT *, lag(w) OVER o AS prv, lead(w) OVER o AS nxt FROM {name}_w WINDOW o AS (PARTITION BY doc_id ORDER BY i))),
{name}_j AS (SELECT s.doc_id, s.subject, j.t FROM {src} s LEFT JOIN (SELECT doc_id, string_agg(w, '' ORDER BY i) AS t FROM {name}_c GROUP BY 1) j USING (doc_id)),
{name}_t AS (SELECT doc_id, subject, {tail} AS t FROM {name}_j), {name} AS (SELECT doc_id, subject, CASE WHEN t = '' OR right(t, 1) IN ('.', '!', '?') THEN t ELSE t || '.' END AS t FROM {name}_t)"""


_SQL_ROWS = f"WITH src AS (SELECT doc_id, [{', '.join(map(_lit, _SUBJECTS))}][doc_id % 4 + 1] AS subject, text || {_NOTES} AS t FROM documents)".replace("\\\\frac", "\\frac")
_HEAD = _all("coalesce(t, '')", [(r"\*\*(.+?)\*\*", r"\1"), ("[*#`]", " "), (r"(?i)^\s*(?:HOOK|CONCEPT|EXAMPLE|MEMORY|NEET[ _]?ALERT)\s*:\s*", "")])
_TEX = _all("t", [(r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r" \1 upon \2 "), (r"\\sqrt\s*\{([^{}]+)\}", r" square root of \1 "), (r"\\vec\s*\{([^{}]+)\}", r" vector \1 "), *[(rf"\\{k}($|{_N})", rf" {v} \1") for k, v in n.COMMANDS.items()], (r"\\[a-zA-Z]+|[${}]", " ")])
_LOW = _sub(f"translate(t, '{n.SUBSCRIPTS}', '0123456789')", r"_\s*\{?\s*([A-Za-z0-9]+)\s*\}?", r" \1 ")
_POWERS = _all("t", [(r"\^\s*\{?\s*2\s*\}?", " squared "), (r"\^\s*\{?\s*3\s*\}?", " cubed "), (r"\^\s*\{?\s*-\s*([0-9]+)\s*\}?", r" to the power minus \1 "), (r"\^\s*\{?\s*([0-9]+)\s*\}?", r" to the power \1 ")])
_SIGNS = _plain("t", {k: f" {v} " for table in (n.SUPERSCRIPTS, n.FRACTIONS, n.GREEK, n.MATH) for k, v in table.items()})
_OPERATORS = _all("t", [rule for rule in ((r"([\p{L}\p{N}_)])\s*\+\s*([\p{L}\p{N}_(])", r"\1 plus \2"), (r"([\p{L}\p{N}_)])\s+-\s+([\p{L}\p{N}_(])", r"\1 minus \2"), (r"([0-9])\s*/\s*([0-9])", r"\1 over \2")) for _ in range(2)])
_SPOKEN = ", ".join([_SQL_ROWS, _steps("src", "head", _HEAD, _TEX, _LOW), _sql_pass("head", "own"), _steps("own", "signs", _POWERS, _SIGNS, _OPERATORS, _all("t", _SQL_SPACE)), _sql_prosody("signs", "spoken")])


def _rows(s, d):
    subject = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return spread(read_table(s, d, "documents")).select("doc_id", subject.alias("subject"), F.concat("text", F.expr(_NOTES)).alias("text"))


@query("normalize_notation", _SPOKEN + " SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS chars FROM spoken")
def _(s, d):
    return speech.normalize_notation(_rows(s, d)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query("expand_units", _SQL_ROWS + f" SELECT doc_id, md5({_sql_units('t')}) AS text_md5 FROM src")
def _(s, d):
    return _rows(s, d).select("doc_id", F.md5(speech.expand_units(F.col("text"))).alias("text_md5"))


@query("subject_pass", ", ".join([_SQL_ROWS, _sql_pass("src", "own")]) + " SELECT doc_id, md5(t) AS text_md5 FROM own")
def _(s, d):
    return speech.subject_pass(_rows(s, d)).select("doc_id", F.md5("text").alias("text_md5"))


@query("inject_prosody", ", ".join([_SQL_ROWS, _sql_prosody("src", "spoken")]) + " SELECT doc_id, md5(t) AS text_md5 FROM spoken")
def _(s, d):
    return speech.inject_prosody(_rows(s, d)).select("doc_id", F.md5("text").alias("text_md5"))


_WORDS = """words AS (SELECT conv_id * 1000 + turn AS clip_id, i::INT - 1 AS idx, w AS word, (0.4 * (i - 1))::DOUBLE AS start_sec, (0.4 * (i - 1) + 0.36)::DOUBLE AS end_sec FROM (
  SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations)))"""


def _words(s, d):
    rows = read_table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("idx", "word"))
    return rows.withColumn("start_sec", 0.4 * F.col("idx")).withColumn("end_sec", F.col("start_sec") + 0.36)


@query("ticks_to_seconds", f"WITH {_WORDS} SELECT clip_id, idx, round(idx * 4000000 * 1e-7, 4) AS start_sec, round(idx * 4000000 * 1e-7 + 3600000 * 1e-7, 4) AS end_sec, round(3600000 * 1e-7, 4) AS duration_sec FROM words")
def _(s, d):
    rows = _words(s, d).select("clip_id", "idx", (F.col("idx").cast("long") * 4000000).alias("offset_ticks"), F.lit(3600000).alias("duration_ticks"))
    return timing.ticks_to_seconds(rows).select("clip_id", "idx", *[F.round(c, 4).alias(c) for c in ("start_sec", "end_sec", "duration_sec")])


@query("shift_words", f"WITH {_WORDS}, o AS (SELECT DISTINCT clip_id, ((clip_id % 4) * 0.7)::DOUBLE AS off FROM words WHERE clip_id % 5 <> 4), j AS (SELECT w.*, coalesce(o.off, 0.0::DOUBLE) AS b FROM words w LEFT JOIN o USING (clip_id)) SELECT clip_id, idx, round(CASE WHEN b = 0 THEN start_sec ELSE greatest(0, start_sec - b) END, 4) AS start_sec, round(end_sec - b, 4) AS end_sec FROM j WHERE b = 0 OR end_sec - b > 0")
def _(s, d):
    w = _words(s, d)
    offsets = w.select("clip_id").distinct().where("clip_id % 5 <> 4").withColumn("offset_sec", F.col("clip_id") % 4 * 0.7)
    return timing.shift_words(w, offsets).select("clip_id", "idx", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


@query("active_word_at", f"WITH {_WORDS}, n AS (SELECT clip_id, count(*) AS n FROM words GROUP BY 1), p AS (SELECT clip_id, unnest(range(0, n * 2)) * 0.25 AS t FROM n), a AS (SELECT p.clip_id, p.t, w.idx, w.end_sec FROM p ASOF LEFT JOIN words w ON p.clip_id = w.clip_id AND p.t >= w.start_sec) SELECT clip_id, t::DOUBLE AS t, CASE WHEN t <= end_sec THEN idx ELSE -1 END AS idx FROM a")
def _(s, d):
    w = _words(s, d)
    probes = w.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).select("clip_id", F.explode(F.sequence(F.lit(0), F.col("n") * 2 - 1)).alias("k")).select("clip_id", (F.col("k") * 0.25).alias("t"))
    return timing.active_word_at(w, probes)


_SCENES = """scenes AS (SELECT conv_id AS lesson_id, turn AS pos, CASE WHEN turn % 7 = 6 THEN 0.0 ELSE 0.4 * len(regexp_extract_all(text, '\\S+')) END AS audio, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 2.0 ELSE 40.0 END AS hint FROM conversations),
dur AS (SELECT lesson_id, pos, CASE WHEN audio <= 0 THEN greatest(0.1, coalesce(hint, 0.1)) WHEN hint IS NULL OR hint <= audio THEN audio ELSE least(hint, audio + 3.0) END::DOUBLE AS duration FROM scenes)"""


def _scenes(s, d):
    audio = F.when(F.col("turn") % 7 == 6, 0.0).otherwise(0.4 * F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))
    hint = F.when(F.col("turn") % 3 == 1, 2.0).when(F.col("turn") % 3 == 2, 40.0)
    return read_table(s, d, "conversations").select(F.col("conv_id").alias("lesson_id"), F.col("turn").alias("pos"), timing.scene_duration(audio, hint).alias("duration"))


@query("scene_duration", f"WITH {_SCENES} SELECT lesson_id, pos, round(duration, 4) AS duration FROM dur")
def _(s, d):
    return _scenes(s, d).withColumn("duration", F.round("duration", 4))


@query("scene_timeline", f"WITH {_SCENES}, b AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY lesson_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2.5 AS s, sum(duration) OVER (PARTITION BY lesson_id) + 5 AS total FROM dur) SELECT lesson_id, pos, round(s, 4) AS start_sec, round(s + duration, 4) AS end_sec, round(total, 4) AS total_sec FROM b")
def _(s, d):
    return timing.scene_timeline(_scenes(s, d)).select("lesson_id", "pos", *[F.round(c, 4).alias(c) for c in ("start_sec", "end_sec", "total_sec")])
