"""Personal data by weak supervision (operator 5); DataFrame expressions only.

Base spans (email, ip, card, phone) come from four fixed patterns. Candidate
spans are these matches and runs that could be secrets (keys, tokens,
passwords). Five labelers vote on each candidate: its pattern, a gazetteer, the
words before it, its shape, and the sign before it. Expectation-maximisation
over the counts of vote patterns, per kind, estimates how reliable each labeler
is; the posteriors train a final span classifier on votes and span features by
weighted counts. Base spans always stay; the classifier adds secrets with a
probability of at least one half that overlap no base span.

Places are code points, ends exclusive: a text is split at its matches, and the
lengths of the pieces and matches add up to the places.

Defined cases: a null text is empty; an empty text has no spans; repeated rows
are searched one by one; an empty table gives no rows and a model that adds
nothing; other columns are ignored. Patterns are written with possessive
repeats, so that very long runs neither recurse nor backtrack.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ["email", "ip", "card", "phone", "secret"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+",
}
#: What a text must hold to be searched at all (each follows from the pattern).
NEEDS = {"email": "@", "phone": "+"}
#: Characters before a candidate that the context labeler reads.
CONTEXT = 40
LABELERS = 5
EM_ROUNDS = 50

# Gazetteers and context words of the labelers.
KNOWN = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"^(AKIA|ASIA|AIza|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|glpat-)",
}
WORDS = {
    "email": r"(e-?mail|contact|write|adresse|correo|courriel)",
    "ip": r"(\bip\b|server|host|address|addr)",
    "card": r"(card|visa|master|amex|karte|carte|tarjeta)",
    "phone": r"(phone|tel|call|mobile|fax|telefon|tél)",
    "secret": r"(password|passwd|pwd|secret|token|api.?key|access.?key|auth|credential)",
}
OTHER_WORDS = r"(version|isbn|doi|page|figure|section|chapter|license|https?:|www\.)"


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^0-9]", ""))


def _valid(kind: str, c: Column) -> Column:
    """Whether a match of a kind's pattern is a base span."""
    if kind == "ip":
        def small_part(p: Column) -> Column:
            bare = F.regexp_replace(p, r"^0+(?=[0-9])", "")
            return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)
        return F.forall(F.split(c, r"\."), small_part)
    if kind == "card":
        bare = F.regexp_replace(c, r"[^0-9]", "")
        return F.when(F.length(bare).between(13, 19), F.call_function("luhn_check", bare)).otherwise(False)
    if kind == "phone":
        return _digits(c).between(9, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, m: Column, before: Column) -> list[Column]:
    """Votes of the labelers (1, -1, 0 to abstain) on a match and the text before it."""
    low = F.lower(before)
    size = F.length(m)
    if kind == "secret":
        own = m.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$") | m.rlike(r"^[0-9a-f]{16,}$")
        share = _digits(m) / size
        shape = _vote((size >= 16) & share.between(0.1, 0.9), (size < 14) | m.rlike(r"^[A-Za-z_-]+[0-9]{1,4}$") | m.rlike("[_-].*[_-]"))
        pattern = _vote(own, m.rlike(r"^[A-Za-z]+[0-9]+$"))
    else:
        pattern = _vote(_valid(kind, m), ~_valid(kind, m))
        shape = _vote(size.between(7, 40), size > 64)
    return [pattern, _vote(m.rlike(KNOWN[kind]), F.lit(False)), _vote(low.rlike(WORDS[kind]), low.rlike(OTHER_WORDS)),
            shape, _vote(before.rlike(r"[=:\"'<(]\s*$"), before.rlike(r"[A-Za-z0-9]$"))]


def _features(m: Column, before: Column) -> list[Column]:
    """Span features of the final classifier, as small whole numbers."""
    size = F.length(m)
    return [F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(8)).cast("int"),
            F.floor(_digits(m) * 4 / F.greatest(size, F.lit(1))).cast("int"),
            F.when(m.rlike("[A-Z]"), 1).otherwise(0) + F.when(m.rlike("[a-z]"), 2).otherwise(0),
            F.when(before.rlike(r"\s$"), 1).when(before == "", 2).when(before.rlike(r"[A-Za-z0-9]$"), 3).otherwise(0)]


N_FEATURES = 4


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates: array of (kind, start, end, base, votes, features)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("number", F.col("text").rlike("[0-9]"))
    none_s = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        some = F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else F.col("number")
        found[f"m_{k}"] = F.when(some, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none_s)
    df = df.withColumns(found)
    df = df.select("doc_id", *[f"m_{k}" for k in KINDS],
                   *[F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none_s).alias(f"p_{k}") for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = {}
    for k in KINDS:
        lengths = F.transform(F.arrays_zip(F.col(f"p_{k}").alias("p"), F.col(f"m_{k}").alias("m")),
                              lambda x: F.struct(F.length(x["p"]).cast("long").alias("p"), F.coalesce(F.length(x["m"]), F.lit(0)).cast("long").alias("m")))
        starts[f"s_{k}"] = F.when(F.size(f"m_{k}") > 0, F.aggregate(
            lengths, zero, lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"),
                                                 F.concat(a["starts"], F.array(a["at"] + x["p"])).alias("starts"))))
    df = df.withColumns(starts)

    def spans(k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = F.get(F.col(f"s_{k}.starts"), i)
            before = F.right(F.get(F.col(f"p_{k}"), i), F.lit(CONTEXT))
            return F.struct(F.lit(KINDS.index(k)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                            _valid(k, m).alias("base"), F.array(*_votes(k, m, before)).alias("votes"),
                            F.array(*_features(m, before)).alias("features"))
        return F.transform(f"m_{k}", one)

    return df.select("doc_id", F.concat(*[spans(k) for k in KINDS]).alias("spans"))


def reliabilities(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern, by expectation-maximisation over the patterns' counts.

    Each labeler has, for true and for false candidates, a probability of each
    vote; it starts as one that is right more often than not.
    """
    total = sum(counts.values())
    prior = 0.5
    table = [{1: {1: 0.6, 0: 0.3, -1: 0.1}, 0: {1: 0.1, 0: 0.3, -1: 0.6}} for _ in range(LABELERS)]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(EM_ROUNDS):
        for v in counts:
            p, q = prior, 1 - prior
            for t, x in zip(table, v):
                p, q = p * t[1][x], q * t[0][x]
            post[v] = p / (p + q)
        prior = min(0.99, max(0.01, sum(post[v] * n for v, n in counts.items()) / total))
        for i in range(LABELERS):
            for truth in (0, 1):
                weight = {x: 1.0 for x in (1, 0, -1)}  # one pseudo-count each
                for v, n in counts.items():
                    weight[v[i]] += n * (post[v] if truth else 1 - post[v])
                table[i][truth] = {x: w / sum(weight.values()) for x, w in weight.items()}
    return post


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of the span classifier by 'kind|feature|value', from the rows of all candidates."""
    rows = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = rows.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 5 * 3**5 rows
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in {r.kind for r in patterns}:
        counts = {tuple(r.votes): r.n for r in patterns if r.kind == kind}
        post |= {(kind, v): p for v, p in reliabilities(counts).items()}
    if not post:
        return {}
    key = F.concat_ws("|", F.col("kind"), F.array_join(F.transform("votes", lambda x: x.cast("string")), ","))
    table = F.create_map(*[F.lit(x) for (k, v), p in sorted(post.items()) for x in (f"{k}|{','.join(map(str, v))}", p)])
    named = F.explode(F.concat(
        F.transform("votes", lambda x, i: F.concat(F.lit("v"), i.cast("string"), F.lit("|"), x.cast("string"))),
        F.transform("features", lambda x, i: F.concat(F.lit("f"), i.cast("string"), F.lit("|"), x.cast("string"))),
        F.array(F.lit("all|0"))))
    sums = rows.withColumn("p", table[key]).select("kind", "p", named.alias("name")).groupBy("kind", "name") \
        .agg(F.sum("p").alias("yes"), F.count("*").alias("n")).collect()  # a fixed number of features and values
    whole = {r.kind: (r.yes, r.n) for r in sums if r.name == "all|0"}
    weights = {}
    for r in sums:
        yes, n = whole[r.kind]
        if r.name == "all|0":
            weights[f"{r.kind}|{r.name}"] = math.log((yes + 1) / (n - yes + 1))
        else:
            weights[f"{r.kind}|{r.name}"] = math.log((r.yes + 1) / (yes + 2)) - math.log((r.n - r.yes + 1) / (n - yes + 2))
    return weights


def _probability(weights: dict[str, float], s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)]) if weights \
        else F.create_map(F.lit(""), F.lit(0.0))
    weight = lambda name: F.coalesce(table[F.concat_ws("|", s["kind"].cast("string"), name)], F.lit(0.0))
    logit = weight(F.lit("all|0"))
    for field, letter, n in (("votes", "v", LABELERS), ("features", "f", N_FEATURES)):
        for i in range(n):
            logit = logit + weight(F.concat(F.lit(f"{letter}{i}|"), s[field][i].cast("string")))
    return 1 / (1 + F.exp(-logit))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, probabilities of every row.

    The counts are of base spans; ``probabilities`` are the classifier's, for
    each span of ``spans``.
    """
    found = saved(candidates(docs))
    weights = train(found)
    base = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    secret = KINDS.index("secret")
    added = F.filter(
        F.filter("spans", lambda s: s["kind"] == secret),
        lambda s: (_probability(weights, s) >= 0.5)
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    # most texts have no candidate that could be added
    some = F.exists("spans", lambda s: s["kind"] == secret)
    none = F.filter("base", lambda s: F.lit(False))
    kept = base.withColumn("added", F.when(some, added).otherwise(none)).withColumn("all", F.concat("base", "added"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return kept.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"),
        F.size("added").cast("long").alias("n_secret"),
        F.array_join(F.transform("all", lambda s: F.round(_probability(weights, s), 4).cast("string")), ",").alias("probabilities"))
