"""Template registry: discovery, versions, rendering, comparison, history."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.linediff import unified_lines
from tessella.operators.metrics import version_number

SPLITS = 200
PLACEHOLDER = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"


def discover_templates(files: DataFrame) -> DataFrame:
    """(name, version, content) of files <version>/<name>.prompt whose version is v and a number."""
    found = r"(?:^|/)(v[0-9]+)/([^/]+)\.prompt$"
    return files.where(F.col("path").rlike(found)).select(F.regexp_extract("path", found, 2).alias("name"), F.regexp_extract("path", found, 1).alias("version"), F.col("text").alias("content"))


def latest_version(templates: DataFrame) -> DataFrame:
    """The numerically highest version of each template, and the next free version over all templates.

    Without any template there is one row that names none and has v1 as the next version.
    """
    number = version_number(F.col("version"))
    best = templates.groupBy("name").agg(F.max_by("version", number).alias("latest"))
    top = templates.agg(F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")).alias("next_version"), F.count(F.lit(1)).alias("_n"))
    empty = top.where("_n = 0").select(*[F.lit(None).cast(templates.schema[c].dataType).alias(k) for c, k in (("name", "name"), ("version", "latest"))], "next_version")
    return best.join(F.broadcast(top.drop("_n")), F.lit(True)).unionByName(empty)  # top is one row


def semver_latest(templates: DataFrame) -> DataFrame:
    """The highest vX.Y.Z of each template, part by part."""
    parts = F.transform(F.split(F.regexp_replace("version", "^v", ""), r"\."), lambda p: p.try_cast("int"))
    return templates.where(F.col("version").rlike(r"^v[0-9]+\.[0-9]+\.[0-9]+$")).groupBy("name").agg(F.max_by("version", parts).alias("latest"))


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tx.find_all(text, PLACEHOLDER, 1)))


def missing_variables(text: Column, variables: Column) -> Column:
    return F.array_sort(F.array_except(placeholders(text), F.map_keys(variables)))


def render_templates(base: DataFrame, addenda: DataFrame) -> DataFrame:
    """base (name, version, content, subject, variables) rendered, with the addendum of its subject and version if there is one.

    Rows with missing variables have rendered null and list them in missing.
    """
    extra = addenda.select("version", F.lower("name").alias("_subject"), F.col("content").alias("_addendum"))
    rows = base.withColumn("_subject", F.lower("subject")).join(extra, ["version", "_subject"], "left")
    whole = F.when(F.col("_addendum").isNull(), F.col("content")).otherwise(F.concat("content", F.lit("\n\n"), "_addendum"))
    rows = rows.withColumn("_whole", whole).withColumn("missing", missing_variables(F.col("_whole"), F.col("variables")))
    filled = F.aggregate(F.map_entries("variables"), F.col("_whole"), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return rows.withColumn("has_addendum", F.col("_addendum").isNotNull()).withColumn("rendered", F.when(F.size("missing") == 0, filled)).drop("_subject", "_addendum", "_whole")


def split_roles(rows: DataFrame, text: str = "content") -> DataFrame:
    """System and user parts at the first USER: after a SYSTEM: marker; without both, all is user text."""
    t, s, u = F.col(text), F.instr(text, "SYSTEM:"), F.instr(text, "USER:")
    both = (s > 0) & (u > 0)
    system = F.trim(F.replace(F.substring(t, F.lit(1), u - 1), F.lit("SYSTEM:"), F.lit("")))
    return rows.withColumn("system", F.when(both, system).otherwise("")).withColumn("user", F.trim(F.when(both, F.substring(t, u + 5, F.length(t))).otherwise(t)))


def sync_registry(registry: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Registry after a scan: unchanged hashes stay, new and changed contents get a record that keeps author, notes and time."""
    fresh = found.select("name", "version", F.sha2("content", 256).alias("hash"))
    both = registry.withColumnRenamed("hash", "old_hash").join(fresh, ["name", "version"], "full")
    state = F.when(F.col("hash").isNull(), "kept").when(F.col("old_hash").isNull(), "discovered").when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    return both.select(
        "name", "version", F.coalesce("hash", "old_hash").alias("hash"), F.coalesce("author", F.lit("system")).alias("author"), F.coalesce("notes", F.lit("Discovered existing template.")).alias("notes"),
        F.coalesce("saved_at", now).alias("saved_at"), state.alias("state"),
    )


_DIFF = "name string, from_version string, to_version string, added int, removed int, diff array<string>"


def _diffs(batches: Iterator[pa.RecordBatch], beside: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.select(["name", "from_version", "to_version", "old", "new"]).to_pylist():
            lines = unified_lines((r["old"] or "").splitlines(), (r["new"] or "").splitlines(), r["from_version"] or "", r["to_version"] or "")
            changes = [sum(x.startswith(c) and not x.startswith(3 * c) for x in lines) for c in "+-"]
            rows.append((r["name"], r["from_version"], r["to_version"], *changes, lines))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, types)), *map(batch.column, beside)], names=["name", "from_version", "to_version", "added", "removed", "diff", *beside])


def _with_diffs(pairs: DataFrame, *beside: str) -> DataFrame:
    """line_diffs with further columns of pairs."""
    more = "".join(f", `{c}` {pairs.schema[c].dataType.simpleString()}" for c in beside)
    return pairs.select("name", "from_version", "to_version", "old", "new", *beside).mapInArrow(lambda it: _diffs(it, beside), _DIFF + more)


def line_diffs(pairs: DataFrame) -> DataFrame:
    """Unified line diffs of (name, from_version, to_version, old, new)."""
    return _with_diffs(pairs)


def _token_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dot product of both texts' token counts and their squared lengths; one pair of texts is counted at a time."""
    for batch in batches:
        rows = []
        for texts in zip(batch.column("old"), batch.column("new")):
            a, b = (Counter(re.findall("[a-z0-9]+", (x.as_py() or "").lower())) for x in texts)
            rows.append((sum(n * b[k] for k, n in a.items() if k in b), *(sum(n * n for n in c.values()) for c in (a, b))))
        products = [pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *products], names=[*batch.schema.names, "dot", "aa", "bb"])


def _token_cosine(pairs: DataFrame) -> DataFrame:
    """pairs with similarity, the cosine of both texts' token counts; no token leaves its row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    sums = pairs.mapInArrow(_token_products, f"{schema}, dot long, aa long, bb long")
    return sums.withColumn("similarity", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.round(F.col("dot") / (F.sqrt("aa") * F.sqrt("bb")), 4)).otherwise(0.0)).drop("dot", "aa", "bb")


def performance_delta(old: Column, new: Column) -> Column:
    """Map of (delta, from, to) by name from two maps of performance values: numbers, or texts of any kind.

    Two numbers give their difference rounded to 6 places; else values that differ are kept as texts, null where a side has none.
    """

    def change(_, a: Column, b: Column) -> Column:
        x, y = (v.cast("string").try_cast("double") for v in (a, b))
        numbers = x.isNotNull() & y.isNotNull()
        return F.when(numbers, F.struct(F.round(y - x, 6).alias("delta"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"))).when(
            ~a.cast("string").eqNullSafe(b.cast("string")), F.struct(F.lit(None).cast("double").alias("delta"), a.cast("string").alias("from"), b.cast("string").alias("to"))
        )

    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(*[F.coalesce(v.cast("map<string,string>"), none) for v in (old, new)], change)
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(both, lambda _, v: v.isNotNull()))))


def compare_versions(pairs: DataFrame) -> DataFrame:
    """Line changes, token similarity and performance_delta of version pairs, in one pass over their texts."""
    keys = ["name", "from_version", "to_version"]
    delta = performance_delta(F.col("old_performance"), F.col("new_performance")).alias("performance_delta")
    texts = _token_cosine(pairs.select(*keys, "old", "new", delta))
    return _with_diffs(texts, "similarity", "performance_delta").withColumn("changed", F.col("added") + F.col("removed"))


def successive_pairs(templates: DataFrame) -> DataFrame:
    """Each version with the one before it, the first with an empty text.

    Only version names are put in order; the texts then meet by (name, version), so a template of many versions is many keys.
    """
    order = W.partitionBy("name").orderBy(version_number(F.col("version")))
    before = templates.select("name", "version").withColumn("from_version", F.lag("version").over(order))
    old = templates.select("name", F.col("version").alias("from_version"), F.col("content").alias("old"))
    rows = before.join(templates.select("name", "version", "content"), ["name", "version"]).join(old, ["name", "from_version"], "left")
    return rows.select("name", "from_version", F.col("version").alias("to_version"), F.coalesce("old", F.lit("")).alias("old"), F.col("content").alias("new"))


def _optional(rows: DataFrame, **columns: str) -> DataFrame:
    """rows with null columns of the given types where they are missing."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def _judged(templates: DataFrame, requests: DataFrame, overwrite: bool) -> DataFrame:
    """requests with _known (the version exists) and reason: empty, exists, repeated, or null for those that count."""
    rows = _optional(requests, source_version="string").join(templates.select("name", "version", F.lit(True).alias("_known")).distinct(), ["name", "version"], "left")
    full, known = F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)), F.coalesce("_known", F.lit(False))
    same = F.row_number().over(W.partitionBy("name", "version", full).orderBy("content", "source_version"))
    reason = F.when(~full, "empty").when(known & F.lit(not overwrite), "exists").when(F.col("version").isNotNull() & (same > 1), "repeated")
    return rows.withColumn("_known", known).withColumn("reason", reason)


def _numbered(templates: DataFrame, rows: DataFrame) -> DataFrame:
    """rows in which those without a version get the next ones of all templates, by name and content.

    Names fall into stretches of their order, cut at some of the names: only the stretches, SPLITS at most, are ordered in
    one task; within a stretch its names are, and within a name its own rows.
    """
    number = version_number(F.col("version"))
    top = templates.select("version").union(rows.select("version")).agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    free = rows.where("version IS NULL")
    counts = free.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(r["name"] for r in counts.where("name IS NOT NULL").orderBy(F.xxhash64("name"), "name").limit(SPLITS).select("name").collect())
    counts = counts.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<string>"), lambda c: c <= F.col("name"))))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", earlier(W.orderBy("_part")).alias("_parts"))
    places = counts.withColumn("_names", earlier(W.partitionBy("_part").orderBy("name"))).join(F.broadcast(parts), "_part").select("name", (F.col("_parts") + F.col("_names")).alias("_before"))
    place = F.col("_top") + F.col("_before") + F.row_number().over(W.partitionBy("name").orderBy("content", "source_version"))
    named = free.join(places, "name").join(F.broadcast(top), F.lit(True)).withColumn("version", F.concat(F.lit("v"), place.cast("string"))).drop("_before", "_top")  # top is one row
    return rows.where("version IS NOT NULL").unionByName(named)


def save_version(templates: DataFrame, requests: DataFrame, overwrite: bool = False) -> DataFrame:
    """Templates with accepted requests (name, version or null, content, author, optionally source_version) added.

    Empty contents, existing versions without overwrite, and repeats of a name and version are left out (see
    rejected_requests); each request without a version gets a next one of all templates. Contents are stored without white
    space at their end, with one line feed. Added rows have their operation
    and source version, and the lines added and removed against the source version, else the text they overwrite, else
    the latest version.
    """
    rows = _numbered(templates, _judged(templates, requests, overwrite).where("reason IS NULL").drop("reason"))
    rows = rows.join(latest_version(templates).where("name IS NOT NULL").select("name", "latest"), "name", "left")
    rows = rows.withColumn("_old", F.coalesce("source_version", F.when(F.col("_known"), F.col("version")), "latest")).withColumn("source_version", F.coalesce("source_version", F.when(~F.col("_known"), F.col("latest"))))
    old = templates.select("name", F.col("version").alias("_old"), F.col("content").alias("old"))
    pairs = rows.join(old, ["name", "_old"], "left").select("name", F.col("source_version").alias("from_version"), F.col("version").alias("to_version"), "old", F.col("content").alias("new"))
    changes = line_diffs(pairs).select("name", F.col("to_version").alias("version"), "added", "removed")
    stored = F.concat(F.regexp_replace("content", r"(?U)\s+$", ""), F.lit("\n"))
    new = rows.drop("_old", "_known", "latest").join(changes, ["name", "version"]).withColumn("content", stored).withColumn("operation", F.lit("overwrite" if overwrite else "save"))
    kept = templates.join(new.select("name", "version"), ["name", "version"], "left_anti") if overwrite else templates
    return kept.unionByName(new, allowMissingColumns=True)


def rejected_requests(templates: DataFrame, requests: DataFrame, overwrite: bool = False) -> DataFrame:
    return _judged(templates, requests, overwrite).where("reason IS NOT NULL").drop("_known")


def rollback_version(templates: DataFrame, targets: DataFrame, author: str) -> DataFrame:
    """Templates with a copy of each target (name, version) under a next version of its own; history stays."""
    copies = templates.select("name", "version", "content").join(targets.select("name", "version"), ["name", "version"])
    copies = copies.select("name", F.lit(None).cast("string").alias("version"), "content", F.lit(author).alias("author"), F.col("version").alias("source_version"), F.concat(F.lit("Rollback to "), "version", F.lit(".")).alias("notes"))
    saved = save_version(templates.withColumn("_given", F.lit(True)), copies)
    return saved.withColumn("operation", F.when(F.col("_given"), F.col("operation")).otherwise("rollback")).drop("_given")


def changelog(records: DataFrame, name: str | None = None) -> DataFrame:
    """(number, name, version, entry, json): one entry for each record, to be read in the order of number and name.

    Records have name, version, author, saved_at, operation, source_version, notes, performance (a map), added, removed;
    with name, only that template's. A log of many versions is many rows, never one text.
    """
    rows = records if name is None else records.where(F.col("name") == name)
    said = lambda label, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"- {label}: "), F.col(c)))
    figures = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("performance"))))
    entry = F.concat_ws(
        "\n", F.format_string("## %s %s", "name", "version"), F.concat(F.lit("- Author: "), F.coalesce("author", F.lit("unknown"))), F.concat(F.lit("- Timestamp: "), F.coalesce("saved_at", F.lit(""))),
        F.concat(F.lit("- Operation: "), F.coalesce("operation", F.lit("save"))), said("Source Version", "source_version"), F.when(F.size("performance") > 0, F.concat(F.lit("- Performance: "), figures)), said("Notes", "notes"),
        F.format_string("- Changes: +%d / -%d lines", F.coalesce("added", F.lit(0)), F.coalesce("removed", F.lit(0))),
    )
    return rows.select(version_number(F.col("version")).alias("number"), "name", "version", entry.alias("entry"), F.to_json(F.struct(*rows.columns)).alias("json"))
