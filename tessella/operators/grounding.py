"""Grounding of generated text: sentences against the best context sentence, rule checks, verdicts, reports.

Input is pairs (pair_id, subject, topic, context, generated). Texts are dealt by pair_id once, and a pair is matched and
checked inside its row; term counts, inverse frequencies and weights are also to be had as tables. Sentences meet only
where they share a term. What the checkers need of a context (lower case, trigrams) is made once a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as tx
from tessella.functions.rounding import half_up, mean_of, units
from tessella.sources.tables import dealt

THRESHOLD = 0.45
PRODUCTS = 1 << 20  # products of weights that are held at a time
_FRESH = math.log(2) + 1  # idf of a term that the context lacks
# fixed values: checkers of each subject, in the order their findings are listed
SUBJECT_RULES = {
    "Physics": ("equation", "unit", "definition", "citation"),
    "Biology": ("biology", "definition", "citation"),
    "Chemistry": ("reaction", "equation", "unit", "definition", "citation"),
    "General": ("definition", "unit", "citation"),
}
# fixed values: penalty and finding of each checker
PENALTY = {"equation": 0.35, "unit": 0.25, "citation": 0.0, "definition": 0.30, "reaction": 0.40, "biology": 0.30}
FINDING = {"equation": "wrong_equation", "unit": "wrong_unit", "citation": "missing_citation", "definition": "wrong_definition", "reaction": "wrong_reaction", "biology": "wrong_biological_term"}
TYPES = ("unsupported_fact", "wrong_equation", "wrong_definition", "wrong_unit", "wrong_reaction", "wrong_biological_term", "external_knowledge", "missing_citation")
# word boundaries over all letters, whatever the engine's own rule is
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# fixed values: patterns of the checkers
EQUATION = r"[A-Za-zΑ-Ωα-ω_]+\s*[=≠≈≤≥<>]\s*[A-Za-z0-9Α-Ωα-ω_²³√+\-*/^()\s.]+"
EQUATION_END = BEFORE + "(?:where|for|when|if|because|which|that|and|or)" + AFTER
QUANTITY = r"([0-9][0-9.,]*)\s*(m/s²?|kg/m³?|n/m²?|j/kg|m/s|nm|mm|cm|km|mg|μg|ms|μs|ns|kj|mj|mpa|kpa|kcal|cal|ev|mev|gev|mol|[NKJPAVWTFCΩ]|kg|hz|wb|lm|lx|bq|gy|sv)"
CITATION = r"(?i)(\[[0-9,\-\s]+\]|\([A-Za-z][A-Za-z0-9 _.-]+,\s*[0-9]{4}\)|" + BEFORE + r"(?:source|context|ncert|retrieved context)\s*[:#]?\s*[0-9]*" + AFTER + ")"
LABEL = r"(?i)^\s*(hook|concept|example|memory|neet alert|note|summary)\s*:?\s*$"
DEFINITION = "(?i)" + BEFORE + "(?:is defined as|refers to|is the|is a|is an|is called|is known as|is measured by|is a measure of|represents|denotes|is given by)" + AFTER
_FORMULA = r"[A-Z][A-Za-z0-9₀-₉²³+\-()]*"
REACTION = rf"{_FORMULA}(?:\s*\+\s*{_FORMULA})*\s*(?:→|->|⟶|yields?|produces?|gives?)\s*{_FORMULA}"
BINOMIAL = BEFORE + r"([A-Z][a-z]+\s+[a-z]+)" + AFTER
# fixed values: single-word process terms, terms of more words, and verbs that do not make a species name
PROCESS_TERMS = (
    "photosynthesis", "respiration", "meiosis", "mitosis", "transcription", "translation", "replication", "glycolysis", "osmosis", "diffusion",
    "plasmolysis", "turgidity", "imbibition", "guttation", "transpiration", "germination", "pollination", "fertilization", "cleavage", "gastrulation",
    "metamorphosis", "regeneration", "sporulation", "conjugation", "xylem", "phloem", "stomata", "chloroplast", "mitochondria", "ribosome",
    "nucleolus", "centrosome", "vacuole", "lysosome", "peroxisome",
)
PROCESS_PHRASES = (
    "krebs cycle", "oxidative phosphorylation", "active transport", "endocytosis", "exocytosis", "crossing over", "synapsis", "bivalent", "chiasmata",
    "tracheids", "companion cells", "sieve tubes", "guard cells", "golgi body", "endoplasmic reticulum",
)
COMMON_SECOND = ("occurs", "is", "are", "was", "were", "has", "have", "produces", "converts", "requires", "uses", "forms", "contains", "includes")


def rejected_pairs(pairs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(r"^\s*$")
    return pairs.where(blank("context") | blank("generated"))


def usable_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("context").rlike(r"\S") & F.col("generated").rlike(r"\S"))


def segment_sentences(pairs: DataFrame, side: str) -> DataFrame:
    """(pair_id, idx, sentence) of one side of usable pairs."""
    return usable_pairs(pairs).select("pair_id", F.posexplode(tx.sentences(F.col(side))).alias("idx", "sentence"))


def term_counts(sentences: DataFrame) -> DataFrame:
    """(pair_id, idx, term, n, total)."""
    rows = sentences.withColumn("tokens", tx.tokenize(F.col("sentence")))
    return rows.select("pair_id", "idx", F.size("tokens").alias("total"), F.explode("tokens").alias("term")).groupBy("pair_id", "idx", "total", "term").agg(F.count(F.lit(1)).alias("n"))


def _idf(sentences: Column, df: Column) -> Column:
    return F.log((sentences + 1) / (df + 1)) + 1


def _weight(n: Column, total: Column, idf: Column) -> Column:
    """A term that the context lacks has the idf of a fresh one."""
    return F.round(n / total * F.coalesce(idf, F.lit(_FRESH)), 6)


def tfidf_fit(context: DataFrame) -> DataFrame:
    """(pair_id, term, df, idf) over each pair's context sentences."""
    sizes = context.groupBy("pair_id").agg(F.count(F.lit(1)).alias("sentences"))
    df = term_counts(context).groupBy("pair_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(sizes, "pair_id").select("pair_id", "term", "df", _idf(F.col("sentences"), F.col("df")).alias("idf"))


def tfidf_transform(sentences: DataFrame, idf: DataFrame) -> DataFrame:
    """(pair_id, idx, term, weight) of sentences under a fitted idf."""
    weight = _weight(F.col("n"), F.col("total"), F.col("idf"))
    return term_counts(sentences).join(idf.select("pair_id", "term", "idf"), ["pair_id", "term"], "left").select("pair_id", "idx", "term", weight.alias("weight"))


def _pair_matches(side: np.ndarray, idx: np.ndarray, terms: pa.Array, weight: np.ndarray, n: int) -> list[tuple[int, int, float, list[str]]]:
    """(idx, best_idx, cosine, evidence) of a pair's generated sentences that share a term with the context.

    Products of weights are formed by term, for so many generated sentences at a time that PRODUCTS bounds the products
    and the sums held; only pairs of sentences that share a term have any.
    """
    coded = terms.dictionary_encode()
    term, words = np.asarray(coded.indices), coded.dictionary
    rank = np.empty(len(words), np.int64)
    rank[np.asarray(pc.sort_indices(words))] = np.arange(len(words))
    term, words = rank[term], words.take(pc.sort_indices(words))
    there = np.flatnonzero(side == 1)
    there = there[np.argsort(term[there], kind="stable")]
    first = np.searchsorted(term[there], np.arange(len(words) + 1))
    own = np.flatnonzero(side == 0)
    own = own[(first[term[own] + 1] > first[term[own]])]
    if not len(own) or not len(there):
        return []
    own = own[np.argsort(idx[own], kind="stable")]
    names, place = np.unique(idx[there], return_inverse=True)
    norms = np.sqrt(np.bincount(place, weights=weight[there] ** 2))
    length = np.sqrt(np.bincount(idx[side == 0], weights=weight[side == 0] ** 2))
    count = first[term[own] + 1] - first[term[own]]
    starts = np.flatnonzero(np.append(True, idx[own][1:] != idx[own][:-1]))
    cost = np.add.reduceat(count, starts) + len(names)
    out, block = [], np.cumsum(cost) // PRODUCTS
    for number in np.unique(block):
        mine = np.flatnonzero(block == number)
        lo, hi = starts[mine[0]], starts[mine[-1] + 1] if mine[-1] + 1 < len(starts) else len(own)
        rows, c = own[lo:hi], count[lo:hi]
        local = np.searchsorted(starts[mine], np.arange(lo, hi), side="right") - 1
        left = np.repeat(np.arange(len(rows)), c)
        right = np.repeat(first[term[rows]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        key = local[left] * len(names) + place[right]
        dots = np.bincount(key, weights=weight[rows[left]] * weight[there[right]], minlength=len(mine) * len(names)).reshape(len(mine), -1)
        both = length[idx[own[starts[mine]]]][:, None] * norms[None, :]
        cosine = np.floor(np.divide(dots, both, out=np.zeros_like(dots), where=both > 0) * 1e6 + 0.5) / 1e6
        best = cosine.argmax(axis=1)  # of equal ones the first
        held = np.flatnonzero(best[local[left]] == place[right])
        together = np.rint(weight[rows[left[held]]] * 1e6) + np.rint(weight[there[right[held]]] * 1e6)
        shared = term[rows[left[held]]]
        order = np.lexsort((shared, -together, local[left[held]]))
        edges = np.searchsorted(local[left[held]][order], np.arange(len(mine) + 1))
        for i, (s, e) in enumerate(zip(edges, edges[1:])):
            if cosine[i, best[i]] > 0:
                out.append((int(idx[own[starts[mine[i]]]]), int(names[best[i]]), float(cosine[i, best[i]]), words.take(pa.array(shared[order[s : min(e, s + n)]])).to_pylist()))
    return out


def _match_pairs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Matches of rows (pair_id, side, idx, term, weight) that come pair by pair; a pair is held at a time."""

    def result(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks()
        found = _pair_matches(*(t.column(c).to_numpy() for c in ("side", "idx")), t.column("term").combine_chunks(), t.column("weight").to_numpy(), n)
        idx, best, cosine, evidence = zip(*found) if found else ((), (), (), ())
        ids = t.column("pair_id").combine_chunks().take(pa.array(np.zeros(len(found), np.int64)))
        return pa.RecordBatch.from_arrays([ids, pa.array(idx, pa.int32()), pa.array(best, pa.int32()), pa.array(cosine, pa.float64()), pa.array(evidence, pa.list_(pa.string()))], names=["pair_id", "idx", "best_idx", "cosine", "evidence"])

    held: list[pa.RecordBatch] = []
    done: list[pa.RecordBatch] = []
    for batch in batches:
        codes = np.asarray(batch.column("pair_id").dictionary_encode().indices)
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for lo, hi in zip(edges, edges[1:]):
            if held and lo < hi and held[-1].column("pair_id")[0] != batch.column("pair_id")[lo]:
                done.append(result(held))
                held = []
            if lo < hi:
                held.append(batch.slice(lo, hi - lo))
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0] if sum(d.num_rows for d in done) else done[0]
            done = []
    if held:
        yield result(held)


def matches(weights: DataFrame, n: int = 5) -> DataFrame:
    """(pair_id, idx, best_idx, cosine, evidence): each generated sentence's best context sentence and the n shared terms with the largest weight sums.

    weights is (pair_id, side, idx, term, weight), side 0 being generated and 1 the context. Only positive cosines count, ties go
    to the first sentence.
    """
    kind = weights.schema["pair_id"].dataType.simpleString()
    rows = weights.where("pair_id IS NOT NULL").select("pair_id", F.col("side").cast("int"), F.col("idx").cast("int"), "term", F.col("weight").cast("double"))
    rows = dealt(rows, "pair_id").sortWithinPartitions("pair_id")
    return rows.mapInArrow(lambda it: _match_pairs(it, n), f"pair_id {kind}, idx int, best_idx int, cosine double, evidence array<string>")


def _two_sides(generated: DataFrame, context: DataFrame) -> DataFrame:
    return generated.withColumn("side", F.lit(0)).unionByName(context.withColumn("side", F.lit(1)))


def best_context_match(generated: DataFrame, context: DataFrame) -> DataFrame:
    """(pair_id, idx, best_idx, cosine) from the weight tables of both sides."""
    return matches(_two_sides(generated, context)).select("pair_id", "idx", "best_idx", "cosine")


def evidence_terms(generated: DataFrame, context: DataFrame, n: int = 5) -> DataFrame:
    """(pair_id, idx, evidence) from the weight tables of both sides."""
    return matches(_two_sides(generated, context), n).select("pair_id", "idx", "evidence")


def bigram_jaccard(a: Column, b: Column) -> Column:
    def share(both: Column) -> Column:
        union = F.size(F.array_union(both["x"], both["y"]))
        return F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(both["x"], both["y"])) / union, 6))

    x, y = (F.array_distinct(tx.ngrams(tx.plain_tokens(t), 2)) for t in (a, b))
    return tx.bound(F.struct(x.alias("x"), y.alias("y")), share)


def _weighed(generated: pa.Array, context: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """side, idx, term and weight of a pair's sentences, given as lists of tokens; weights as of tfidf_fit and tfidf_transform."""
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (generated, context)]
    coded = pa.chunked_array([generated.flatten(), context.flatten()], pa.string()).combine_chunks().dictionary_encode()
    words = max(1, len(coded.dictionary))
    total = np.concatenate(sizes)
    place = np.repeat(np.arange(len(total)), total)
    key, count = np.unique(place * words + np.asarray(coded.indices), return_counts=True)
    place, term = key // words, key % words
    there = place >= len(sizes[0])
    df = np.bincount(term[there], minlength=words)
    idf = np.where(df > 0, np.log((len(sizes[1]) + 1) / (df + 1)) + 1, _FRESH)
    weight = np.floor(count / total[place] * idf[term] * 1e6 + 0.5 + 1e-9) / 1e6
    return there.astype(np.int64), np.where(there, place - len(sizes[0]), place), pa.DictionaryArray.from_arrays(pa.array(term, pa.int32()), coded.dictionary), weight


def _match_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Adds the match of every generated sentence to pairs, each in its own row; drops the tokens (the last two columns)."""
    kind = pa.list_(pa.struct([("best_idx", pa.int32()), ("cosine", pa.float64()), ("evidence", pa.list_(pa.string()))]))
    for batch in batches:
        out = []
        for generated, context in zip(batch.column("gt"), batch.column("ct")):
            row: list[dict | None] = [None] * len(generated.values)
            for idx, best, cosine, evidence in _pair_matches(*_weighed(generated.values, context.values), n):
                row[idx] = {"best_idx": best, "cosine": cosine, "evidence": evidence}
            out.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, kind)], names=[*batch.schema.names[:-2], "m"])


def matched_sentences(pairs: DataFrame, result: Callable[[Column, Column, Column], Column] | None = None, name: str = "flagged", n: int = 5) -> DataFrame:
    """Every generated sentence with its best context sentence, cosine, bigram overlap, similarity and evidence.

    With result, also a column `name` as of each_sentence. A pair is worked on inside its row: sentences and tokens are made
    there, matched in linear memory and only then dealt out as rows, so nothing is joined or shuffled but the pairs once.
    """
    rows = dealt(usable_pairs(pairs).select("pair_id", "subject", "context", "generated"), "pair_id")
    rows = rows.select("pair_id", "subject", "context", tx.sentences(F.col("generated")).alias("g"), tx.sentences(F.col("context")).alias("c"))
    rows = rows.withColumns({t: F.transform(s, tx.tokenize) for t, s in (("gt", "g"), ("ct", "c"))})
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pair_id", "subject", "context", "g", "c")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    met = rows.mapInArrow(lambda it: _match_rows(it, n), schema + ", m array<struct<best_idx:int,cosine:double,evidence:array<string>>>")

    def each(ready: Column) -> Column:
        fields = lambda s, m: [s.alias("sentence"), m.alias("m"), F.get("c", m["best_idx"]).alias("best"), *([result(s, ready["c"], ready["rules"]).alias(name)] if result else [])]
        return F.zip_with("g", "m", lambda s, m: F.struct(*fields(s, m)))

    found = tx.bound(F.struct(prepared(F.col("context")).alias("c"), subject_rules(F.col("subject")).alias("rules")), each) if result else each(None)
    out = met.select("pair_id", F.posexplode(found).alias("idx", "x")).select("pair_id", "idx", "x.*").select("*", "m.best_idx", "m.cosine", "m.evidence").drop("m")
    out = out.withColumn("best", F.coalesce("best", F.lit(""))).withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    out = out.withColumn("jaccard", F.when(F.col("best") == "", 0.0).otherwise(bigram_jaccard(F.col("sentence"), F.col("best"))))
    return out.withColumn("similarity", support_similarity(F.col("cosine"), F.col("jaccard"))).withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def support_similarity(cosine: Column, jaccard: Column) -> Column:
    """0.70 cosine + 0.30 bigram overlap to 4 places, in whole units so that ties round up everywhere."""
    return F.least(F.lit(1.0), half_up(70 * units(cosine, 1_000_000) + 30 * units(jaccard, 1_000_000), 10_000))


def prepared(context: Column) -> Column:
    """What the checkers read of a context: it in lower case, that without white space, and its trigrams."""
    grams = tx.ngrams(tx.plain_tokens(context), 3)
    return F.struct(F.lower(context).alias("low"), F.regexp_replace(F.lower(context), r"\s+", "").alias("packed"), grams.alias("grams"))


def check_equations(sentence: Column, ready: Column) -> Column:
    """Whether an equation of the sentence is missing in the context; ready is prepared(context), here and below."""

    def core(eq: Column) -> Column:
        cut = F.split(F.lower(F.regexp_replace(eq, r"^\s+|\s+$", "")), EQUATION_END)[0]
        return F.regexp_replace(F.regexp_replace(cut, r"^[ .,;:]+|[ .,;:]+$", ""), r"\s+", "")

    return F.coalesce(F.exists(tx.find_all(sentence, EQUATION), lambda e: ~F.contains(ready["packed"], core(e))), F.lit(False))


def check_units(sentence: Column, ready: Column) -> Column:
    both = F.zip_with(tx.find_all(sentence, QUANTITY, 1), tx.find_all(sentence, QUANTITY, 2), lambda v, u: F.struct(v.alias("v"), F.lower(F.concat(v, F.lit(" "), u)).alias("q")))
    return F.exists(both, lambda x: ~F.contains(ready["low"], x["q"]) & ~F.contains(ready["low"], x["v"]))


def check_citations(sentence: Column) -> Column:
    return ~(sentence.rlike(LABEL) | (F.size(tx.space_words(sentence)) < 5) | sentence.rlike(CITATION))


def check_definitions(sentence: Column, ready: Column) -> Column:
    def strange(body: Column) -> Column:
        return (F.size(body) > 0) & (F.size(F.array_intersect(body, ready["grams"])) / F.greatest(F.size(body), F.lit(1)) < 0.30)

    body = F.array_distinct(tx.ngrams(tx.plain_tokens(F.split(sentence, DEFINITION, 2)[1]), 3))
    return F.when(~sentence.rlike(DEFINITION), False).otherwise(tx.bound(body, strange))


def check_reactions(sentence: Column, ready: Column) -> Column:
    found = F.transform(tx.find_all(sentence, REACTION), lambda r: F.lower(F.regexp_replace(r, r"^\s+|\s+$", "")))
    return F.exists(found, lambda r: ~F.contains(ready["low"], F.replace(r, F.lit("→"), F.lit("->"))) & ~F.contains(ready["low"], r))


def biology_terms(sentence: Column, ready: Column) -> Column:
    """Sorted distinct species-like names and process terms of the sentence that the context lacks."""
    names = F.filter(tx.find_all(sentence, BINOMIAL, 1), lambda x: ~F.lower(F.split(x, r"\s+")[0]).isin(*PROCESS_TERMS) & ~F.split(x, r"\s+")[1].isin(*COMMON_SECOND))
    terms = tx.find_all(sentence, "(?i)" + BEFORE + "(" + "|".join(PROCESS_PHRASES + PROCESS_TERMS) + ")" + AFTER, 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(names, terms), lambda x: ~F.contains(ready["low"], F.lower(x)))))


def subject_rules(subject: Column) -> Column:
    """The checkers of a subject; an unknown one counts as General."""
    rules = F.create_map(*[x for s, r in SUBJECT_RULES.items() for x in (F.lit(s), F.array(*map(F.lit, r)))])
    return F.coalesce(F.try_element_at(rules, subject), F.array(*map(F.lit, SUBJECT_RULES["General"])))


def each_sentence(pairs: DataFrame, result: Callable[[Column, Column, Column], Column], name: str) -> DataFrame:
    """(pair_id, idx, sentence, name): result(sentence, prepared context, subject's checkers) of every generated sentence.

    A pair's sentences are met inside its row, where the prepared context is made once and never copied.
    """
    ready = F.struct(prepared(F.col("context")).alias("c"), subject_rules(F.col("subject")).alias("rules"))
    found = tx.bound(ready, lambda r: F.transform(tx.sentences(F.col("generated")), lambda s: F.struct(s.alias("sentence"), result(s, r["c"], r["rules"]).alias(name))))
    return dealt(usable_pairs(pairs), "pair_id").select("pair_id", F.posexplode(found).alias("idx", "x")).select("pair_id", "idx", "x.*")


def flagged_by(citations: bool = True) -> Callable[[Column, Column, Column], Column]:
    """The names of the subject's checkers that flag a sentence, for each_sentence and matched_sentences."""

    def flagged(s: Column, c: Column, rules: Column) -> Column:
        flags = {"reaction": check_reactions, "equation": check_equations, "unit": check_units, "biology": lambda s, c: F.size(biology_terms(s, c)) > 0, "definition": check_definitions}
        found = [F.when(F.array_contains(rules, k), F.when(check(s, c), F.lit(k))) for k, check in flags.items()]
        if citations:
            found.append(F.when(F.array_contains(rules, "citation"), F.when(check_citations(s), F.lit("citation"))))
        return F.array_compact(F.array(*found))

    return flagged


def sentence_verdict(checked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """support, types, is_hallucination, confidence and risk of every checked sentence."""
    penalty = F.aggregate(F.transform("flagged", lambda k: F.create_map(*[F.lit(x) for p in PENALTY.items() for x in p])[k]), F.lit(0.0), lambda a, x: a + x)
    names = F.create_map(*[F.lit(x) for p in FINDING.items() for x in p])
    rows = checked.withColumn("support", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity") - penalty)), 4))
    found = F.transform("flagged", lambda k: names[k])
    found = F.concat(found, F.when((F.size(found) == 0) & (F.col("support") < threshold), F.array(F.lit("unsupported_fact"))).otherwise(F.array().cast("array<string>")))
    found = F.concat(found, F.when((F.col("support") < 0.20) & (F.size("evidence") == 0), F.array(F.lit("external_knowledge"))).otherwise(F.array().cast("array<string>")))
    s = F.col("support")
    return rows.withColumn("types", F.when(F.size(found) == 0, F.array(F.lit("supported"))).otherwise(found)).withColumns(
        {
            "is_hallucination": s < threshold,
            "confidence": F.least(F.lit(1.0), F.floor((10_001 + 3 * F.abs(units(s) - round(threshold * 10_000))) / 2) / 10_000),
            "risk": F.when(s < 0.30, "critical").when(s < 0.50, "high").when(s < 0.70, "medium").when(s < 0.85, "low").otherwise("none"),
        }
    )


def verdicts(pairs: DataFrame, threshold: float = THRESHOLD, citations: bool = True) -> DataFrame:
    return sentence_verdict(matched_sentences(pairs, flagged_by(citations)), threshold)


def grounding_report(pairs: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row for each pair: counts, mean support, hallucination rate, and the sentences of each finding in order."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.array_contains("types", t), F.struct("idx", "sentence")))), lambda x: x["sentence"]).alias(t) for t in TYPES]
    bad = F.col("is_hallucination")
    sums = verdict.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("sentences"), mean_of(F.col("support")).alias("support"), F.round(F.avg(bad.cast("int")), 4).alias("hallucination_rate"), F.count_if(~bad).alias("supported"), F.count_if(bad).alias("hallucinated"),
        F.count_if(bad & (F.col("risk") == "critical")).alias("critical"), F.count_if(bad & (F.col("risk") == "high")).alias("high"), *lists,
    )
    base = dealt(usable_pairs(pairs), "pair_id").select("pair_id", "subject", "topic", F.size(tx.sentences(F.col("context"))).alias("context_sentences"), F.size(tx.space_words(F.col("context"))).alias("context_words"), F.size(tx.space_words(F.col("generated"))).alias("generated_words"))
    return base.join(sums, "pair_id")


def grounding_summary(report: DataFrame) -> DataFrame:
    """Key counts only, also as one JSON text."""
    counts = [F.size(t).alias(f"{t}_count") for t in TYPES]
    rows = report.select("pair_id", "subject", "topic", "support", "hallucination_rate", "supported", "hallucinated", "critical", "high", *counts)
    return rows.withColumn("json", F.to_json(F.struct(*rows.columns)))


def faithfulness_overlap(pairs: DataFrame, gate: float = 0.85) -> DataFrame:
    """Distinct-word overlap of generated with context, doubled and capped; faithful from 0.7, passing from gate."""
    words = lambda c: F.array_distinct(tx.space_words(F.lower(F.coalesce(F.col(c), F.lit("")))))
    g = words("generated")
    score = F.least(F.lit(1.0), F.size(F.array_intersect(g, words("context"))) / F.greatest(F.size(g), F.lit(1)) * 2)
    return pairs.withColumn("faithfulness", score).withColumn("is_faithful", F.col("faithfulness") >= 0.7).withColumn("passes", F.col("faithfulness") >= gate)
