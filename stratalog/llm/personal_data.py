"""Personal data: weak supervision with Spark expressions.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Further candidates
(long tokens of letters and digits: secret; long digit runs: id) are voted on by three labelers:
a regex labeler (form of the value), a gazetteer labeler (known prefixes, hosts and ranges) and a
context labeler (words and signs just before it). The votes of all candidates, base ones too, are
counted per pattern (at most 3^3 patterns a kind); expectation-maximisation over these counts
estimates how reliable each labeler is, its posteriors are the soft labels of a logistic
span classifier over the candidates' own features (again counted per pattern, whose number is
bounded by the buckets), and the classifier decides which further candidates become spans.

Everything that touches rows is a Spark expression; the driver sees only counts of patterns.

Positions are code points, end exclusive. Defined cases: a null text counts as empty; repeated
rows are judged each; with no candidates at all the classifier adds nothing; candidates that
overlap a base span are left out; other columns are passed through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import fresh, quoted, saved

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")
LABELERS = ("by_form", "by_list", "by_context")

#: The base patterns, written so that Java neither recurses over long runs nor restarts inside one:
#: a match can only begin at the start of a run of its characters or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{20})(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]++",
    "id": r"(?<![A-Za-z0-9])[0-9]{9,19}+(?![A-Za-z0-9])",
}
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = r"(?i)(?:token|secret|passw|key|auth|bearer|mail|phone|tel|call|card|visa|account|iban|ssn|passport|address|login|user)[\w\s]{0,12}[=:\"'\s(]*$"
LISTED = {
    "email": r"(?i)[@.](?:example\.(?:com|org|net)|gmail\.com|yahoo\.com|outlook\.com|hotmail\.com)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|3[47]|6011|35|2[2-7])",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk-|pk-|xox[abp]-|eyJ|AIza)",
    "id": r"^(?:4[0-9]{12}|4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}|6011[0-9]{12}|1[0-9]{10}|[1-8][0-9]{8})$",
}
LEFT = 32  # code points of context
TRUST = 10.0  # rows that the labelers' assumed reliabilities weigh


def _matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, left>> of all leftmost non-overlapping matches."""
    pattern = F.lit(PATTERNS[kind])
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("v"), F.split(text, PATTERNS[kind], -1).alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string>>")

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["g"])
        end = start + F.length(p["v"])
        return F.when(p["v"].isNull(), a).otherwise(
            F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["v"].alias("value"), F.right(p["g"], F.lit(LEFT)).alias("left")))).alias("out"))
        )

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    return F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when((digits >= 14) & (digits <= 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return (digits >= 10) & (digits <= 15)
    return F.lit(True)


def _candidate(kind: str, m: Column) -> Column:
    """Votes and features of a match; base matches come here only if valid."""
    value, left, k = m["value"], m["left"], KINDS.index(kind)
    one, none, no = F.lit(1), F.lit(0), F.lit(-1)
    if kind in BASE:
        form = one
    elif kind == "secret":
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        form = F.when(mixed & (value.rlike("^[0-9a-f]{32,}$") | (value.rlike("[A-Z]") & value.rlike("[a-z]") & (F.length(value) >= 24))), one).when(mixed, none).otherwise(no)
    else:
        form = F.when(F.length(value).between(9, 19) & (F.replace(value, F.left(value, F.lit(1)), F.lit("")) != ""), none).otherwise(no)
    listed = F.when(value.rlike(LISTED[kind]), one).otherwise(no if kind in ("ip", "id") else none)
    context = F.when(left.rlike(CUES), one).when(left.rlike(r"[=:]\s*[\"']?$"), one).when(left.rlike(r"[\w-]$"), no).otherwise(none)
    size = F.length(value)
    return F.struct(
        F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end"), form.alias("by_form"), listed.alias("by_list"), context.alias("by_context"),
        F.least(F.floor(size / 8), F.lit(6)).cast("int").alias("size"),
        F.floor(4 * F.length(F.regexp_replace(value, "[^0-9]", "")) / F.greatest(size, F.lit(1))).cast("int").alias("digits"),
        F.when(value.rlike("[A-Z]"), 1).otherwise(0).alias("upper"),
        F.when(left.rlike(r"[=:]\s*[\"']?$"), 2).when(left.rlike(r"\s$"), 1).otherwise(0).alias("before"),
    )


def _judged(kind: str, matches: Column) -> Column:
    return F.transform(F.filter(matches, lambda m: _valid(kind, m["value"])), lambda m: _candidate(kind, m))


FEATURES = {"k": len(KINDS), "size": 7, "digits": 5, "upper": 2, "before": 3}


def candidates(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of base and more, arrays of the candidates with votes and features."""
    text = F.coalesce("text", F.lit(""))
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    valid = {}
    for kind in KINDS:
        matches = _matches(text, kind)
        if kind in may:
            matches = F.when(may[kind], matches).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,left:string>>"))
        valid[kind] = _judged(kind, matches)
    held = fresh(docs.columns, "candidates")
    both = F.struct(F.concat(*[valid[k] for k in BASE]).alias("base"), F.concat(*[valid[k] for k in KINDS if k not in BASE]).alias("more"))
    return docs.select("*", both.alias(held)), held


@dataclass(frozen=True)
class SpanModel:
    prior: dict[int, float]  # of each kind
    reliability: dict[tuple[str, int], dict[tuple[int, int], float]]  # labeler, kind -> (truth, vote) -> probability
    weights: dict[tuple[str, int], float]
    bias: float


def estimate(counts: dict[tuple[int, tuple[int, ...]], float], rounds: int = 30) -> tuple[dict[int, float], dict[tuple[str, int], dict[tuple[int, int], float]]]:
    """Expectation-maximisation over (kind, votes) -> count: priors of kinds and reliabilities of labelers."""
    kinds = sorted({k for k, _ in counts})
    prior = dict.fromkeys(kinds, 0.5)
    first = {(y, v): 0.3 if v == 0 else 0.6 if (v > 0) == (y == 1) else 0.1 for y in (0, 1) for v in (-1, 0, 1)}
    reliability = {(name, k): dict(first) for name in LABELERS for k in kinds}
    for _ in range(rounds):
        share = {k: [TRUST, 2 * TRUST] for k in kinds}
        told = {key: {x: TRUST * p for x, p in first.items()} for key in reliability}
        for (k, votes), n in counts.items():
            p = 1.0 if k < len(BASE) else posterior(prior, reliability, k, votes)  # base spans are known to be right
            share[k][0] += n * p
            share[k][1] += n
            for name, v in zip(LABELERS, votes, strict=True):
                told[name, k][1, v] += n * p
                told[name, k][0, v] += n * (1 - p)
        prior = {k: a / b for k, (a, b) in share.items()}
        reliability = {key: {(y, v): t[y, v] / sum(t[y, u] for u in (-1, 0, 1)) for y in (0, 1) for v in (-1, 0, 1)} for key, t in told.items()}
    return prior, reliability


def posterior(prior, reliability, k: int, votes: tuple[int, ...]) -> float:
    odds = math.log(prior[k] / (1 - prior[k]))
    for name, v in zip(LABELERS, votes, strict=True):
        odds += math.log(reliability[name, k][1, v] / reliability[name, k][0, v])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 300) -> tuple[dict[tuple[str, int], float], float]:
    """Logistic regression on (features, soft label, count) by gradient descent with a small ridge."""
    weights = {(name, v): 0.0 for name, n in FEATURES.items() for v in range(n)}
    bias, total = 0.0, sum(n for _, _, n in rows)
    if not total:
        return weights, -1.0
    for _ in range(steps):
        slope, own = dict.fromkeys(weights, 0.0), 0.0
        for values, label, n in rows:
            keys = list(zip(FEATURES, values, strict=True))
            z = bias + sum(weights[key] for key in keys)
            wrong = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) / total
            own += wrong
            for key in keys:
                slope[key] += wrong
        bias -= 2.0 * own
        weights = {key: w - 2.0 * (slope[key] + 1e-4 * w) for key, w in weights.items()}
    return weights, bias


def fit(found: DataFrame, held: str) -> SpanModel:
    """Counts the patterns of all candidates (as candidates() gives them) and fits reliabilities and the span classifier to them."""
    every = found.select(F.explode(F.concat(F.col(held)["base"], F.col(held)["more"])).alias("c"))
    names = [*FEATURES, *LABELERS]
    rows = every.groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).count().toLocalIterator()
    seen = [(tuple(r[n] for n in FEATURES), tuple(r[n] for n in LABELERS), float(r["count"])) for r in rows]
    counts: dict[tuple[int, tuple[int, ...]], float] = {}
    for values, votes, n in seen:
        counts[values[0], votes] = counts.get((values[0], votes), 0.0) + n
    prior, reliability = estimate(counts)
    weights, bias = train(sorted((values, posterior(prior, reliability, values[0], votes), n) for values, votes, n in seen))
    return SpanModel(prior, reliability, weights, bias)


def _annotated(docs: DataFrame, model: SpanModel | None) -> tuple[DataFrame, Column, Column]:
    """docs with a column more, and the sorted base and all spans as expressions over it. Without a model, candidates are written once and read twice."""
    found, held = candidates(docs)
    if model is None:
        found = saved(found, "personal-data-candidates")
        model = fit(found, held)
    base, more = F.col(held)["base"], F.col(held)["more"]

    def score(c: Column) -> Column:
        z = F.lit(model.bias)
        for name in FEATURES:
            w = F.lit(0.0)
            for v in range(FEATURES[name]):
                w = F.when(c[name] == v, model.weights[name, v]).otherwise(w)
            z = z + w
        return z

    place = lambda c: F.struct(c["start"], c["k"], c["end"])
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    taken = F.transform(F.filter(more, lambda c: (score(c) >= 0) & free(c)), place)
    sure = F.transform(base, place)
    return found, F.sort_array(sure), F.sort_array(F.concat(sure, taken))


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with base and spans (in place of columns so named), both array<struct<start, k, end>> sorted; k is the kind's place in KINDS."""
    found, base, spans = _annotated(docs, model)
    others = [F.col(quoted(c)) for c in docs.columns if c.lower() not in ("base", "spans")]
    return found.select(*others, base.alias("base"), spans.alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with each span of text, overlapping ones together, replaced by the first one's kind in brackets; other columns as they are."""
    found, _, spans = _annotated(docs, model)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")

    def join(a: Column, s: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        wider = F.struct(last["start"], last["k"], F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(a, F.array(s)))

    apart = fresh(docs.columns, "apart")
    found = found.select(*[F.col(quoted(c)) for c in docs.columns], F.aggregate(spans, none, join).alias(apart))

    def piece(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get(apart, i - 1)["end"], F.lit(0))
        return F.concat(F.substr("text", at + 1, s["start"] - at), F.get(names, s["k"]))

    end = F.coalesce(F.get(apart, F.size(apart) - 1)["end"], F.lit(0))
    text = F.concat(F.array_join(F.transform(apart, piece), ""), F.substr("text", end + 1))
    return found.withColumn("text", F.when(F.size(apart) > 0, text).otherwise(F.col("text"))).drop(apart)
