"""Text-overlap and quality metrics, and comparison of versions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions import text as tx
from tessella.functions.rounding import half_up, mean_of, units
from tessella.sources.tables import dealt

METRICS = ("accuracy", "context_usage", "hallucination", "structure", "readability", "alignment", "length", "stability", "consistency", "bleu", "rouge_l", "cosine", "manual")
# fixed values: vocabulary of each subject for the template features
SUBJECT_TERMS = {
    "Physics": (
        "vector", "scalar", "force", "mass", "velocity", "acceleration", "momentum", "energy", "work", "power", "newton", "gravitational", "electric", "magnetic",
        "inertia", "friction", "torque", "wave", "frequency", "amplitude",
    ),
    "Biology": (
        "cell", "nucleus", "membrane", "mitosis", "meiosis", "photosynthesis", "respiration", "dna", "rna", "protein", "enzyme", "chromosome", "gene",
        "allele", "organism", "chloroplast", "mitochondria", "ribosome", "transcription",
    ),
    "Chemistry": (
        "atom", "molecule", "bond", "reaction", "electron", "proton", "neutron", "acid", "base", "oxidation", "reduction", "equilibrium", "catalyst", "entropy",
        "enthalpy", "gibbs", "concentration", "mole", "orbital", "polymer",
    ),
}
# fixed values: weights of the overall score, and the two-valued and constant scores of a sample
WEIGHTS = {"accuracy": 0.20, "context_usage": 0.15, "faithful": 0.20, "structure": 0.15, "alignment": 0.15, "length": 0.15}


def gram_sums(pairs: DataFrame) -> DataFrame:
    """Per pair the sums that bleu2 and tf_cosine need, from one count of one- and two-grams of both sides.

    r, c: words of context and generated; p1, p2: clipped precisions; dot, aa, bb: products of word counts. A pair without
    words has no row.
    """
    tokens = F.array(*[F.struct(F.lit(i).alias("side"), tx.word_tokens(F.coalesce(F.col(side), F.lit(""))).alias("t")) for i, side in enumerate(("context", "generated"))])
    sides = dealt(pairs.select("pair_id", "context", "generated"), "pair_id").select("pair_id", F.inline(tokens)).select("pair_id", "side", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.col("t").alias("g")), F.struct(F.lit(2).alias("n"), tx.ngrams(F.col("t"), 2).alias("g")))).alias("x"))
    grams = sides.select("pair_id", "side", "x.n", F.explode("x.g").alias("gram")).groupBy("pair_id", "n", "gram").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    one = F.col("n") == 1
    total = lambda value, test=one: F.coalesce(F.sum(F.when(test, value)), F.lit(0))
    precision = lambda n: total(F.least("a", "b"), F.col("n") == n) / F.nullif(total(F.col("b"), F.col("n") == n), F.lit(0))
    a, b = F.col("a"), F.col("b")
    return grams.groupBy("pair_id").agg(total(a).alias("r"), total(b).alias("c"), precision(1).alias("p1"), precision(2).alias("p2"), total(a * b).alias("dot"), total(a * a).alias("aa"), total(b * b).alias("bb"))


def _bleu() -> Column:
    score = F.least(F.lit(1.0), F.exp(1 - F.col("r") / F.col("c"))) * F.exp((F.log("p1") + F.log("p2")) / 2)
    return F.when((F.col("r") > 0) & (F.col("c") > 0) & (F.col("p1") > 0) & (F.col("p2") > 0), F.round(score, 4)).otherwise(0.0)


def _cosine() -> Column:
    return F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.round(F.col("dot") / (F.sqrt("aa") * F.sqrt("bb")), 4)).otherwise(0.0)


def bleu2(pairs: DataFrame) -> DataFrame:
    """Clipped one- and two-gram precision with the brevity penalty; 0 if a precision or a side is empty."""
    return pairs.select("pair_id").join(gram_sums(pairs), "pair_id", "left").select("pair_id", _bleu().alias("bleu"))


def tf_cosine(pairs: DataFrame) -> DataFrame:
    """Cosine of raw word counts; 0 if a side has no words."""
    return pairs.select("pair_id").join(gram_sums(pairs), "pair_id", "left").select("pair_id", _cosine().alias("cosine"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: one bit for each token of a, one step over all bits for each token of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for w in b:
        hit = free & places.get(w, 0)
        if hit:
            free = (free + hit | free - hit) & whole
    return len(a) - free.bit_count()


@F.pandas_udf(DoubleType())
def _rouge(r: pd.Series, c: pd.Series) -> pd.Series:
    lengths = [(common_length(list(a), list(b)), len(a) + len(b)) for a, b in zip(r, c)]
    return pd.Series([round(2 * n / total, 4) if n else 0.0 for n, total in lengths], dtype="float64")


def _rouge_of(context: str, generated: str) -> Column:
    return _rouge(*[tx.word_tokens(F.coalesce(F.col(c), F.lit(""))) for c in (context, generated)])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Longest-common-subsequence F1 over word tokens; pairs stay where they are, a pair costs its two lengths' product over 64."""
    return pairs.select("pair_id", _rouge_of("context", "generated").alias("rouge_l"))


def flesch_readability(text: Column) -> Column:
    """Reading ease scaled to 0..1; 0.5 for a text without words or sentences."""
    words = tx.find_all(text, tx.WORD)
    parts = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"\S")))
    syllables = F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouyAEIOUY]+"))))
    ease = 206.835 - 1.015 * (F.size(words) / parts) - 84.6 * (syllables / F.size(words))
    return F.when((F.size(words) == 0) | (parts == 0), 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ease / 100)), 4))


def sample_scores(pairs: DataFrame) -> DataFrame:
    """The 13 metrics of each sample, from its texts, section counts and validation flags.

    pairs needs sections (0..5), is_valid, is_grounded and is_aligned beside the pair columns.
    """
    words = F.size(tx.space_words(F.coalesce("generated", F.lit(""))))
    rows = pairs.join(gram_sums(pairs), "pair_id", "left").withColumns({"bleu": _bleu(), "cosine": _cosine(), "rouge_l": _rouge_of("context", "generated")})
    rows = rows.withColumns(
        {
            "accuracy": F.when(F.col("is_valid"), 0.95).otherwise(0.75), "context_usage": F.least(F.lit(1.0), F.col("cosine") * 1.5), "hallucination": F.when(F.col("is_grounded"), 0.05).otherwise(0.35),
            "structure": F.when(F.col("is_valid"), 1.0).otherwise(F.col("sections") / 5), "readability": flesch_readability(F.coalesce("generated", F.lit(""))), "alignment": F.when(F.col("is_aligned"), 0.92).otherwise(0.60),
            "length": F.when(words.between(250, 320), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(285 - words) / 285)), "stability": F.lit(0.90), "consistency": F.lit(0.92),
        }
    )
    parts = {"accuracy": 30, "structure": 25, "context_usage": 20, "readability": 10}
    manual = sum((units(F.col(k), 100_000) * w for k, w in parts.items()), units(F.col("sections") / 5, 100_000) * 15)
    return rows.withColumn("manual", half_up(manual, 1000)).select("pair_id", "version", *METRICS)


def version_scores(samples: DataFrame) -> DataFrame:
    """Means of the metrics of each version and its weighted overall score."""
    rows = samples.groupBy("version").agg(*[mean_of(F.col(m)).alias(m) for m in METRICS])
    points = {m: units(F.col(m)) for m in METRICS} | {"faithful": 10_000 - units(F.col("hallucination"))}
    return rows.withColumn("overall", half_up(sum((round(100 * w) * points[k] for k, w in WEIGHTS.items()), F.lit(0)), 100))


def version_number(version: Column) -> Column:
    return F.regexp_extract(version, r"([0-9]+)", 1).try_cast("int")


def winning_version(scores: DataFrame) -> DataFrame:
    """The version with the highest overall score, the earliest on ties."""
    return scores.agg(F.min_by(F.struct("version", "overall"), F.struct((-F.col("overall")).alias("o"), version_number(F.col("version")).alias("v"))).alias("w")).select("w.*")


def metric_matrix(scores: DataFrame, versions: list[str]) -> DataFrame:
    """Metrics by versions, with a 30-cell bar row of the overall scores."""
    names = ["overall", *METRICS]
    long = scores.unpivot(["version"], names, "metric", "value").withColumn("cell", F.format_string("%.4f", "value"))
    bar = F.concat(F.repeat(F.lit("█"), F.floor(F.col("overall") * 30).cast("int")), F.repeat(F.lit("░"), 30 - F.floor(F.col("overall") * 30).cast("int")))
    bars = scores.select("version", F.lit("bar").alias("metric"), bar.alias("cell"))
    return long.select("version", "metric", "cell").unionByName(bars).groupBy("metric").pivot("version", versions).agg(F.first("cell"))


def ab_compare(scored: DataFrame, a: str, b: str) -> DataFrame:
    """Mean faithfulness of two versions on the same inputs; a wins ties."""
    mean = lambda v: F.round(F.avg(F.when(F.col("version") == v, F.col("faithfulness"))), 4)
    return scored.agg(mean(a).alias("mean_a"), mean(b).alias("mean_b")).withColumn("winner", F.when(F.coalesce("mean_b", F.lit(0.0)) > F.coalesce("mean_a", F.lit(0.0)), b).otherwise(a))


def prompt_features(rows: DataFrame, text: str = "text", subject: str = "subject") -> DataFrame:
    """Word count, distinct meaningful tokens, share of the subject's vocabulary, distinct tokens per 100 words, length."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = F.array_distinct(tx.find_all(F.lower(t), "[a-z]+"))
    vocabulary = F.create_map(*[x for s, v in SUBJECT_TERMS.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
    own = F.try_element_at(vocabulary, F.col(subject))
    words, unique = F.size(tx.find_all(t, tx.WORD)), F.size(F.array_except(tokens, F.array(*map(F.lit, tx.FEATURE_STOP_WORDS))))
    return rows.withColumns(
        {
            "word_count": words, "unique_tokens": unique, "specificity": F.when(own.isNull(), 0.0).otherwise(F.round(F.size(F.array_intersect(tokens, own)) / F.size(own), 4)),
            "density": F.when(words == 0, 0.0).otherwise(F.round(unique / words * 100, 2)), "chars": F.length(t),
        }
    )


def paired_delta(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """For each topic and metric the values of mode 0 and mode 1 and their difference; topic null holds the means."""
    long = rows.unpivot(["topic", "mode"], metrics, "metric", "value")
    value = lambda m: F.avg(F.when(F.col("mode") == m, F.col("value")))
    each = long.groupBy("topic", "metric").agg(value(0).alias("a"), value(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    means = each.groupBy("metric").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).select(F.lit(None).cast("string").alias("topic"), "metric", "a", "b")
    out = each.unionByName(means).withColumn("delta", F.round(F.col("b") - F.col("a"), 4))
    return out.select("topic", "metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "delta", F.when(F.col("delta") > 0, "B").when(F.col("delta") < 0, "A").otherwise("Tie").alias("winner"))
