"""Personal data by weak-supervision aggregation, with SQL functions only.

Candidate spans come from strict patterns (the base, which always stays) and from looser ones. Each candidate is
voted on by regex labelers (strict form, usual grouping), gazetteer labelers (known endings, number ranges,
prefixes) and context labelers (telling words before it, clean edges, other finds in the text).
Expectation-maximisation over the counts of vote patterns (at most 2**VOTES for each kind, so bounded) estimates each
labeler's reliability on true and false candidates; a logistic span classifier, which also sees features of the span and of
its surroundings (2**BITS patterns at most), is fitted to the posteriors and decides on the looser candidates.

Patterns are written so that Java's engine takes time in proportion to the text and no recursion: an atom that
cannot be left early is possessive, and a start inside a run is tried only where the run begins or the last match ended,
since a match from a later start of the run would also match from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, materialize

KINDS = ("email", "ip", "card", "phone")
VOTES = 7
BITS = VOTES + 5  # votes, then features of the span and its surroundings
ACCEPT = 0.9

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (test that a text may hold one, pattern)
STRICT = {
    "email": ("contains(text, '@')", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"rlike(text, '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]')", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"rlike(text, '(?:[0-9][ -]?){11}[0-9]')", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": (r"rlike(text, '[(\\[](?:at|AT)[)\\]]')", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++){1,6}"),
    "ip": (r"rlike(text, '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]')", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    "card": (r"rlike(text, '[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}')", r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    "phone": (r"rlike(text, '[0-9]{3}[ .-][0-9]{4}')", r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])"),
}
#: endings, number ranges and prefixes that the gazetteer labelers know
ENDINGS = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|us|eu|ch|at|it|nl"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6011|65|62|35"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|contacto|correo|courriel|address",
    "ip": "ip|host|server|address|node|gateway|client|login",
    "card": "card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta|account",
    "phone": "phone|tel|call|fax|mobile|cell|contact|sms|telefon|appel|llame",
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "struct<s:int,e:int,v:string,b:string,n:string>"
_PIECE = 64  # elements that a fold appends one by one; lists of so many are then joined


def _fold(items: str, start: dict[str, str], step: str, kind: str) -> str:
    """SQL: the elements, of type kind, that a fold over the array items puts out, in time in proportion to its length.

    step gives the next state from a and x: the fields of start and out, an array that it may append to. The fold goes by
    pieces, since appending copies the array.
    """
    fields = lambda of: ", ".join(f"'{k}', {of}.{k}" for k in start)
    first = ", ".join(f"'{k}', {v}" for k, v in start.items())
    inner = f"aggregate(slice(z, c * {_PIECE} + 1, {_PIECE}), named_struct({fields('w')}, 'out', cast(array() AS array<{kind}>)), (a, x) -> {step})"
    outer = f"transform(array({inner}), r -> named_struct({fields('r')}, 'out', array_append(w.out, r.out)))[0]"
    whole = f"aggregate(sequence(0, size(z) div {_PIECE}), named_struct({first}, 'out', cast(array() AS array<array<{kind}>>)), (w, c) -> {outer}, w -> flatten(w.out))"
    return f"transform(array({items}), z -> {whole})[0]"


def _spans(text: str, guard: str, pattern: str) -> Column:
    """array<struct<s,e,v,b,n>>: code point start, end and text of every leftmost non-overlapping match, the 28 characters before it and the one after."""
    p = _literal(pattern)
    parts = f"transform(array(named_struct('g', split({text}, {p}, -1), 'v', regexp_extract_all({text}, {p}, 0))), q -> transform(q.v, (v, i) -> named_struct('g', q.g[i], 'v', v, 'n', left(coalesce(nullif(q.g[i + 1], ''), get(q.v, i + 1), ''), 1))))[0]"
    span = "named_struct('s', a.at + length(x.g), 'e', a.at + length(x.g) + length(x.v), 'v', x.v, 'b', right(concat(a.tail, x.g), 28), 'n', x.n)"
    step = f"named_struct('at', a.at + length(x.g) + length(x.v), 'tail', right(concat(a.tail, x.g, x.v), 28), 'out', array_append(a.out, {span}))"
    return F.expr(f"CASE WHEN {guard} THEN {_fold(parts, {'at': '0', 'tail': chr(39) * 2}, step, _SPAN)} ELSE cast(array() AS array<{_SPAN}>) END")


def _apart(loose: str, taken: str) -> str:
    """SQL: the spans of loose that overlap none of taken.

    Ends of loose spans and starts of taken ones are put in order; where a loose span ends, those taken that start before
    are known by their greatest end.
    """
    ends = f"transform({loose}, x -> named_struct('p', x.e, 'tag', 0, 'q', x.s, 'x', x))"
    starts = f"transform({taken}, t -> named_struct('p', t.s, 'tag', 1, 'q', t.e, 'x', cast(NULL AS {_SPAN})))"
    step = "CASE WHEN x.tag = 1 THEN named_struct('most', greatest(a.most, x.q), 'out', a.out) WHEN a.most > x.q THEN a ELSE named_struct('most', a.most, 'out', array_append(a.out, x.x)) END"
    return f"CASE WHEN size({loose}) = 0 OR size({taken}) = 0 THEN {loose} ELSE {_fold(f'array_sort(concat({starts}, {ends}))', {'most': '-1'}, step, _SPAN)} END"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn test."""
    return (
        f"aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring({digits}, length({digits}) - i + 1, 1) AS int) "
        f"ELSE (cast(substring({digits}, length({digits}) - i + 1, 1) AS int) * 2) div 10 + (cast(substring({digits}, length({digits}) - i + 1, 1) AS int) * 2) % 10 END) % 10 = 0"
    )


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.v, '\\\\.'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND cast('0' || regexp_replace(p, '^0+', '') AS int) <= 255)",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_luhn(_DIGITS)} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
USUAL = {
    "email": r"rlike(x.v, '^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}[ (\\[@]')",
    "ip": r"rlike(x.v, '^(?:[1-9][0-9]{0,2}(?:\\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f:]+)$')",
    "card": r"rlike(x.v, '^[0-9]{4}([ ._/-]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$')",
    "phone": r"rlike(x.v, '^(?:\\+[0-9]{1,3} ?)?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}$')",
}
KNOWN = {
    "email": rf"rlike(x.v, '(?i)(?:[.]|dot[)\\]] ?)(?:{ENDINGS})$')",
    "ip": r"NOT rlike(x.v, '^(?:0|127|255|22[4-9]|2[34][0-9])[.]')",
    "card": rf"rlike({_DIGITS}, '^(?:{CARD_PREFIXES})')",
    "phone": rf"rlike(x.v, '^(?:\\+(?:{CALLING_CODES})|[(]?[2-9][0-9]{{2}}[^0-9])')",
}


def _voted(kind: str, strict: bool) -> str:
    """SQL: struct<kind, s, e, base, votes> of a candidate x, null for a strict match that fails its test."""
    order = KINDS.index(kind)
    luhn = VALID["card"] if kind == "card" else "true"
    votes = [
        "true" if strict else "false",
        USUAL[kind],
        KNOWN[kind],
        rf"rlike(lower(x.b), '(?:{CONTEXT[kind]})')",
        r"NOT rlike(right(x.b, 1) || ' ' || x.n, '[\\p{L}\\p{N}]')",
        "many > 1",
        luhn,
    ]
    features = [
        r"rlike(right(x.b, 2), '[:=]\\s?$')",
        "x.s = 0 OR right(x.b, 1) = '\\n'",
        r"rlike(x.n, '^(?:[\\s.,;)]|)$')",
        "x.e - x.s >= 16",
        r"rlike(x.v, '[ ._/()-].*[ ._/()-]')",
    ]
    bits = " + ".join(f"CASE WHEN {v} THEN {1 << k} ELSE 0 END" for k, v in enumerate(votes + features))
    return f"named_struct('s', x.s, 'kind', {order}, 'e', x.e, 'base', {'true' if strict else 'false'}, 'votes', {bits})"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: the candidates of each text with their votes; strict matches that fail their test are dropped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for name, patterns in (("strict", STRICT), ("loose", LOOSE)):
        rows = rows.select("*", *[_spans("text", guard, p).alias(f"{name}_{k}") for k, (guard, p) in patterns.items()])
    rows = rows.select("*", *[F.expr(f"filter(strict_{k}, x -> {VALID[k]})").alias(f"base_{k}") for k in KINDS])
    rows = rows.withColumn("many", F.expr(" + ".join(f"size(base_{k}) + size(loose_{k})" for k in KINDS)))
    taken = "concat(" + ", ".join(f"strict_{k}" for k in KINDS) + ")"
    rows = rows.withColumn("taken", F.expr(taken))
    parts = []
    for k in KINDS:
        parts.append(f"transform(base_{k}, x -> {_voted(k, True)})")
        parts.append(f"transform({_apart(f'loose_{k}', 'taken')}, x -> {_voted(k, False)})")
    return rows.select("doc_id", F.expr(f"CASE WHEN many = 0 THEN cast(array() AS array<struct<s:int,kind:int,e:int,base:boolean,votes:int>>) ELSE array_sort(concat({', '.join(parts)})) END").alias("found"))


def fit(found: DataFrame, rounds: int = 50) -> list[list[float]]:
    """For each kind the classifier's weights (votes, features, then the constant), from the counts of their patterns."""
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    table = [(r["kind"], [r["votes"] >> b & 1 for b in range(BITS)], r["n"]) for r in counted.collect()]
    return [_fit_kind([(v, n) for kind, v, n in table if kind == k], rounds) for k in range(len(KINDS))]


def reliabilities(table: list[tuple[tuple[int, ...], int]], rounds: int) -> tuple[list[float], list[float], list[float]]:
    """(P(labeler votes | true), P(labeler votes | false), P(true | votes) of each row) by expectation-maximisation over (votes, count) rows."""
    total = sum(n for _, n in table)
    # a first belief: most labelers for it; a pseudo-count keeps reliabilities inside (0, 1)
    belief = [min(0.98, max(0.02, sum(v) / VOTES)) for v, _ in table]
    for _ in range(rounds):
        true = sum(q * n for q, (_, n) in zip(belief, table))
        prior = (true + 1) / (total + 2)
        yes = [(sum(q * n * v[b] for q, (v, n) in zip(belief, table)) + 0.9) / (true + 1) for b in range(VOTES)]
        no = [(sum((1 - q) * n * v[b] for q, (v, n) in zip(belief, table)) + 0.3) / (total - true + 1) for b in range(VOTES)]
        for i, (v, _) in enumerate(table):
            odds = math.log(prior / (1 - prior))
            for b in range(VOTES):
                p, q = min(yes[b], 0.999), min(no[b], 0.999)
                odds += math.log(p / q) if v[b] else math.log((1 - p) / (1 - q))
            belief[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return yes, no, belief


def _fit_kind(table: list[tuple[list[int], int]], rounds: int) -> list[float]:
    total = sum(n for _, n in table)
    if not total:
        return [0.0] * BITS + [-10.0]
    voted: dict[tuple[int, ...], int] = {}
    for v, n in table:
        voted[tuple(v[:VOTES])] = voted.get(tuple(v[:VOTES]), 0) + n
    belief = dict(zip(voted, reliabilities(list(voted.items()), rounds)[2]))
    w = [0.0] * (BITS + 1)
    for _ in range(400):  # a logistic classifier, by gradient on the pattern table
        step = [0.02 * -x for x in w]
        for v, n in table:
            x = [*v, 1]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            gap = (belief[tuple(v[:VOTES])] - p) * n / total
            for b, on in enumerate(x):
                if on:
                    step[b] += gap
        w = [a + 1.5 * s for a, s in zip(w, step)]
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of base spans by kind, a digest of the base spans, and all spans found.

    Kinds are email, ip, card, phone; a span is kind:start:end in code points, end exclusive; spans are ordered
    by start, then kind, and comma-joined. The classifier only adds spans that no strict match touches.

    Defined cases: null text counts as empty; a text without finds has zero counts, the digest of the empty string and
    spans ''; repeated rows each give a row; null ids are kept; an empty table gives no rows; other columns are
    ignored; texts of any length are read whole.
    """
    with Scratch(docs.sparkSession) as held:
        found = held.keep(candidates(docs, id_col, text_col), "candidates")
        return materialize(_decided(found, fit(found)), "spans")


def _decided(found: DataFrame, weights: list[list[float]]) -> DataFrame:
    linear = "CASE x.kind " + " ".join(f"WHEN {k} THEN {w[-1]!r}D + " + " + ".join(f"{w[b]!r}D * ((x.votes >> {b}) & 1)" for b in range(BITS)) for k, w in enumerate(weights)) + " END"
    kept = found.select("doc_id", F.expr("filter(found, x -> x.base)").alias("base"), F.expr(f"filter(found, x -> x.base OR 1D / (1D + exp(-({linear}))) >= {ACCEPT}D)").alias("all"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    text = lambda c: f"array_join(transform({c}, x -> concat_ws(':', element_at({names}, x.kind + 1), x.s, x.e)), ',')"
    return kept.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.expr(f"sha2({text('base')}, 256)").alias("base_sha256"), F.expr(text("all")).alias("spans"),
    )
