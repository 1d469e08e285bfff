"""Structured outputs: parsing, repair, validation, defaults and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.sources.tables import small_side

SECTIONS = ("HOOK", "CONCEPT", "EXAMPLE", "MEMORY", "NEET ALERT")
TIERS = ("Easy", "Medium", "Hard")
SCENES = 5
SCENE_SCHEMA = "array<struct<scene_id:int,title:string,narration:string,bullets:array<string>,visual_type:string,formula:string,animation:string,background:string,subtitle:string,duration:double>>"
QUIZ_SCHEMA = "array<struct<difficulty:string,topic:string,question:string,options:array<string>,correct_answer:string,explanation:string,reference:string>>"
_HEADER = r"(?i)(?:^|\n)\[?(HOOK|CONCEPT|EXAMPLE|MEMORY|NEET ALERT)\]?:?"


def parse_sections(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, name, content, words): the sections in order; a text without headers is one CONCEPT section."""
    names = F.transform(tx.find_all(F.col(text), _HEADER, 1), lambda n: F.upper(n))
    bodies = F.slice(F.split(F.col(text), _HEADER), 2, F.size(names) + 1)
    found = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("content")))
    whole = F.array(F.struct(F.lit("CONCEPT").alias("name"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("content")))
    out = rows.select(key, F.posexplode(F.when(F.size(names) > 0, found).otherwise(whole)).alias("pos", "s")).select(key, "pos", "s.name", "s.content")
    return out.withColumn("words", F.size(tx.space_words(F.col("content"))))


def section_map(sections: DataFrame, key: str = "id") -> DataFrame:
    """name -> content of each text; of repeated names the last counts."""
    last = sections.groupBy(key, "name").agg(F.max_by("content", "pos").alias("content"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "content")))).alias("sections"))


def validate_script(rows: DataFrame, key: str = "id", text: str = "text", context: str = "context") -> DataFrame:
    """Missing sections, word count in 250..320, and overlap with the context of at least 0.35; valid if all hold."""
    parsed = rows.join(section_map(parse_sections(rows, key, text), key), key, "left")
    missing = F.filter(F.array(*map(F.lit, SECTIONS)), lambda n: ~F.coalesce(F.try_element_at(F.col("sections"), n), F.lit("")).rlike(r"\S"))
    words = F.size(tx.space_words(F.col(text)))
    own = F.array_except(F.array_distinct(tx.word_tokens(F.col(text))), F.array(*map(F.lit, ("hook", "concept", "example", "memory", "neet", "alert"))))
    shared = F.size(F.array_intersect(own, tx.word_tokens(F.coalesce(F.col(context), F.lit("")))))
    out = parsed.withColumns({"missing": missing, "word_count": words, "overlap": F.round(shared / F.greatest(F.size(own), F.lit(1)), 4)})
    fits, grounded = F.col("word_count").between(250, 320), F.col("overlap") >= 0.35
    errors = F.array_compact(F.array(F.when(F.size("missing") > 0, F.lit("missing_sections")), F.when(~fits, F.lit("word_count")), F.when(~grounded, F.lit("low_overlap"))))
    return out.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0).drop("sections")


def token_cost(calls: DataFrame, prices: DataFrame, default: str) -> DataFrame:
    """Tokens (length div 4) and price of each call's model, summed; a model without a price is charged as the default."""
    base = prices.where(F.col("model") == default).agg(F.max("price_in").alias("_in"), F.max("price_out").alias("_out"))  # one row
    rows = calls.join(small_side(prices), "model", "left").join(F.broadcast(base), F.lit(True))
    rows = rows.withColumn("tin", F.expr("length(prompt) div 4")).withColumn("tout", F.expr("length(completion) div 4"))
    cost = F.col("tin") / 1000 * F.coalesce("price_in", "_in") + F.col("tout") / 1000 * F.coalesce("price_out", "_out")
    return rows.groupBy("model").agg(F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))


def repaired(raw: Column) -> Column:
    """A JSON text without code fence, surrounding prose and trailing commas."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)
    inner = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    t = F.when(t.startswith("{") | t.startswith("[") | (inner == ""), t).otherwise(inner)
    return F.regexp_replace(t, r",\s*([\]}])", "$1")


def parses(text: Column) -> Column:
    """Whether the whole of a text is one JSON value; a null text is none.

    Spark's parser stops after the first value. What follows it would have to be ] in the one frame and , or } in the other.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.coalesce((F.size(alone.cast("array<variant>")) == 1) & named.isNotNull(), F.lit(False))


def repair_json(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """json (the text that parses, raw or repaired, else null), was_repaired and error."""
    out = rows.withColumn("_fixed", repaired(F.col(raw))).withColumn("_raw_ok", parses(F.col(raw))).withColumn("_fix_ok", parses(F.col("_fixed")))
    out = out.withColumn("json", F.when(F.col("_raw_ok"), F.col(raw)).when(F.col("_fix_ok"), F.col("_fixed")))
    return out.withColumn("was_repaired", ~F.col("_raw_ok") & F.col("_fix_ok")).withColumn("error", F.when(F.col("json").isNull(), "malformed")).drop("_fixed", "_raw_ok", "_fix_ok")


def normalize_scenes(rows: DataFrame, key: str = "id", scenes: str = "scenes") -> DataFrame:
    """Exactly SCENES scenes of each lesson: defaults filled, missing ones as titled placeholders, further ones cut."""
    titles = F.array(*map(F.lit, SECTIONS))
    slots = rows.select(key, scenes, F.explode(F.sequence(F.lit(1), F.lit(SCENES))).alias("pos"))
    s, title = F.try_element_at(F.col(scenes), F.col("pos")), F.element_at(titles, F.col("pos"))
    words = F.size(tx.space_words(F.coalesce(s["narration"], F.lit(""))))
    over = F.concat(F.lit("Overview of "), title)
    blank = s.isNull()
    return slots.select(
        key, "pos", F.when(blank, F.col("pos")).otherwise(F.coalesce(s["scene_id"], F.col("pos"))).alias("scene_id"), F.when(blank, title).otherwise(s["title"]).alias("title"),
        F.when(blank, F.concat(over, F.lit(" for the lesson."))).otherwise(s["narration"]).alias("narration"), F.when(blank, over).otherwise(F.coalesce(s["subtitle"], s["narration"])).alias("subtitle"),
        F.when(blank, 15.0).otherwise(F.coalesce(s["duration"], F.round(F.greatest(F.lit(5.0), words * 0.4), 1))).alias("duration"),
        F.when(blank, "Static").otherwise(s["animation"]).alias("animation"), F.when(blank, F.concat(F.lit("Clean educational graphic explaining "), title)).otherwise(s["background"]).alias("background"), s["formula"].alias("formula"),
    )


def total_duration(scenes: DataFrame, key: str = "id") -> DataFrame:
    return scenes.groupBy(key).agg(F.count(F.lit(1)).alias("scenes"), F.round(F.sum("duration"), 1).alias("total"))


def scene_defaults_alt(rows: DataFrame, key: str = "id", scenes: str = "scenes") -> DataFrame:
    """The second scene shape: upper-case part, default title, visual and animation; lists under three scenes are rejected."""
    kept = rows.where(F.size(scenes) >= 3).select(key, F.posexplode(scenes).alias("pos", "s"))
    part = F.upper(F.coalesce("s.visual_type", F.lit("concept")))
    return kept.select(key, "pos", part.alias("part"), F.coalesce("s.title", F.initcap(part)).alias("title"), F.coalesce("s.bullets", F.array().cast("array<string>")).alias("bullets"), F.coalesce("s.background", F.lit("slide")).alias("visual"), F.coalesce("s.animation", F.lit("static")).alias("animation"))


def scene_export(scenes: DataFrame, key: str = "id") -> DataFrame:
    """Two JSON payloads for each scene."""
    prompt = F.concat(F.col("background"), F.lit(". Cinematic style, 4k resolution, high educational quality. Motion: "), F.col("animation"), F.lit("."))
    first = F.to_json(F.struct("scene_id", prompt.alias("prompt"), F.col("duration").alias("duration_seconds"), F.col("narration").alias("audio_narration")))
    second = F.to_json(F.struct(F.concat(F.lit("scene_"), F.col("scene_id").cast("string")).alias("id"), F.col("background").alias("text_prompt"), F.lit(5).alias("motion_score"), "duration"))
    return scenes.select(key, "pos", first.alias("prompt_payload"), second.alias("motion_payload"))


def scene_script(scenes: DataFrame, key: str = "id") -> DataFrame:
    """One ordered animation script outline for each lesson."""
    line = F.concat(F.lit("scene "), F.col("scene_id").cast("string"), F.lit(": show "), F.coalesce("title", F.lit("")), F.when(F.col("formula").isNotNull(), F.concat(F.lit(" with "), F.col("formula"))).otherwise(""), F.lit(", hold "), F.col("duration").cast("string"))
    return scenes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("t")))), lambda x: x["t"]), "\n").alias("script"))


def normalize_quiz(rows: DataFrame, topic: Column, key: str = "id", quiz: str = "quiz") -> DataFrame:
    """The first three questions of each quiz, numbered, with Bloom level, parsed options and a full set of tiers.

    A quiz that lacks a tier gets its tiers by position; is_valid tells questions that fit the model.
    """
    each = rows.withColumn("_topic", topic).select(key, "_topic", F.posexplode(quiz).alias("pos", "q"))
    tiers = F.size(F.collect_set(F.when(F.col("q.difficulty").isin(*TIERS), F.col("q.difficulty"))).over(W.partitionBy(key)))
    option = r"^([A-D])[\):.\s]+(.*)$"
    options = F.transform(F.filter(F.coalesce("q.options", F.array().cast("array<string>")), lambda o: o.rlike(option)), lambda o: F.struct(F.regexp_extract(o, option, 1).alias("option_id"), F.trim(F.regexp_extract(o, option, 2)).alias("text")))
    place = F.col("pos") + 1
    bloom = F.when(place == 1, "Understand").when(place == 2, "Apply").otherwise("Analyze")
    out = each.withColumn("_tiers", tiers).select(
        key, place.alias("question_id"), F.when(F.col("_tiers") == 3, F.col("q.difficulty")).otherwise(F.try_element_at(F.array(*map(F.lit, TIERS)), place)).alias("difficulty"),
        F.coalesce("q.topic", "_topic").alias("topic"), F.col("q.question").alias("question"), options.alias("options"), F.col("q.correct_answer").alias("correct_answer"), F.col("q.explanation").alias("explanation"), F.col("q.reference").alias("reference"), bloom.alias("bloom"),
    ).where("question_id <= 3")
    long = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) >= 5
    return out.withColumn("is_valid", (F.size("options") == 4) & F.coalesce(F.col("correct_answer").isin("A", "B", "C", "D"), F.lit(False)) & long("question") & long("explanation") & long("reference"))


def quiz_grounding(questions: DataFrame, contexts: DataFrame, key: str = "id") -> DataFrame:
    """Per quiz whether every reference shares at least 0.30 of its words with the context, and how many do not.

    A quiz's references meet its context together, so a context is sent and cut into words once and not for each question.
    """
    own = F.array_distinct(tx.word_tokens(F.coalesce("reference", F.lit(""))))
    rows = questions.groupBy(key).agg(F.collect_list(own).alias("_own")).join(contexts.select(key, "context"), key)
    found = F.array_intersect(F.flatten("_own"), tx.word_tokens(F.coalesce("context", F.lit(""))))
    low = lambda o, f: F.size(F.array_intersect(o, f)) / F.greatest(F.size(o), F.lit(1)) < 0.30
    errors = tx.bound(found, lambda f: F.size(F.filter("_own", lambda o: low(o, f))))
    return rows.select(key, errors.cast("long").alias("_errors")).groupBy(key).agg(F.bool_and(F.col("_errors") == 0).alias("is_grounded"), F.sum("_errors").alias("errors"))
