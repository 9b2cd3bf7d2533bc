"""Personal data: fixed rules, and a boosted model over loosely generated candidates, in DataFrame operations only.

The rules give the base spans, which always stay. Generators propose spans that merely look like an address or a number, with
other separators, without a plus sign or written out; they overlap each other and the rules. Each candidate has features of
its format, of its digits and of the text around it. There are no labels, so trees are boosted on what is certain: spans of the
rules, rewritten into loose forms where they stand, are positive; proposed spans that fail the digits' tests, look like a date
or stand behind a word for something else, such as an order number, are negative; the rest is open. The sample for the
fit is bounded for each kind and label. Thresholds come from histograms of the scores over all rewritten spans and all negative
candidates of the corpus: per kind the lowest probability, a half at least, from which on ``PRECISION`` of the certain ones are positive. Open
candidates that reach it and overlap no span of the rules are added.

Positions come from the lengths of the matches and of the text between them. Patterns start at the first character of a run
only and take runs without giving back, so long runs cost one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm.boosting import Boosted, boost
from worklens.llm.common import lowest_hashes, whole_text
from worklens.sources.staging import settle

KINDS = ("email", "ip", "card", "phone")
#: About so many candidates of each kind and label the model is fitted on: those of the lowest hash.
TRAIN_CANDIDATES = 1000
PRECISION = 0.95
#: Steps of the histograms.
STEPS = 1000
CONTEXT = 24
_BLOCK = 64

# Each gives the same matches as the rule's own pattern (in the comment).
RULES = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[ -]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[.:, -][0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[ ./-]{1,2}+\(?[0-9]{2,5}+\)?){1,5}+(?![0-9])",
}
_HINTS = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|pay|account",
    "phone": r"(?i)tel|phone|call|fax|mobil",
}

#: Words before a number that is something else.
_OTHERWISE = r"(?i)(\\b(order|invoice|ref|no|nr|number|id|isbn|issn|version|page|pages|vol|art|item|sku|case|section|chapter|lot|serial)[.:#]? ?|[#§])$"
_DATE = r"^((19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2})"
#: Loose forms of a rule's span, as SQL of its match; those that the generator wouldn't propose whole are left out.
_LOOSE = {
    "email": ["regexp_replace(regexp_replace(m, '[.](?=[^@]*$)', ' (dot) '), '@', ' (at) ')", "regexp_replace(m, '@', '(at)')", "regexp_replace(regexp_replace(m, '[.](?=[^@]*$)', '[dot]'), '@', ' [at] ')"],
    "ip": ["regexp_replace(m, '[.]', '-')", "regexp_replace(m, '[.]', ':')"],
    "card": ["regexp_replace(regexp_replace(m, '[^0-9]', ''), '([0-9]{4})(?=[0-9])', '$1.')"],
    "phone": ["substr(m, 2)", "concat('00', substr(m, 2))", "regexp_replace(substr(m, 2), '[ -]+', '.')"],
}


def _active(kind: str) -> Column:
    if kind == "email":
        return F.col("text").contains("@") | F.lower("text").rlike(r"[(\[]at[)\]]")
    return F.col("has_digit")


def located(df: DataFrame, pattern: str, active: Column, into: str) -> DataFrame:
    """Column ``into``: the matches in ``text`` from left to right, as structs of from, till (code points), match, before, after."""
    df = df.withColumn("m", F.when(active, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("g", F.when(F.size("m") > 0, F.split("text", pattern, -1)))
    # Running sums in blocks, so that a text with many matches costs little more than their number.
    df = df.withColumn("n", F.expr("transform(m, (x, i) -> char_length(g[i]) + char_length(x))"))
    df = df.withColumn("b", F.expr(f"transform(sequence(0, greatest(size(n) - 1, 0) div {_BLOCK}), k -> aggregate(slice(n, k * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"))
    df = df.withColumn("o", F.expr("transform(b, (x, k) -> aggregate(slice(b, 1, k), 0, (a, y) -> a + y))"))
    start = f"o[i div {_BLOCK}] + aggregate(slice(n, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, y) -> a + y) + char_length(g[i])"
    df = df.withColumn("s", F.expr(f"transform(m, (x, i) -> {start})"))
    found = (
        "transform(m, (x, i) -> struct(CAST(s[i] AS BIGINT) AS from, CAST(s[i] + char_length(x) AS BIGINT) AS till, x AS match, "
        f"right(g[i], {CONTEXT}) AS before, left(g[i + 1], 1) AS after))"
    )
    return df.withColumn(into, F.expr(found)).drop("m", "g", "n", "b", "o", "s")


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def holds(kind: str, match: str) -> str:
    """SQL: the rule's test of a match."""
    if kind == "ip":
        parts = f"split({match}, '[.]')"
        return f"forall({parts}, p -> length(ltrim('0', p)) <= 3 AND coalesce(CAST(nullif(ltrim('0', p), '') AS INT), 0) <= 255)"
    if kind == "card":
        d = _digits(match)
        at = f"CAST(substr({d}, length({d}) - k, 1) AS INT)"
        luhn = f"aggregate(sequence(0, length({d}) - 1), 0, (a, k) -> a + IF(k % 2 = 0, {at}, IF({at} > 4, 2 * {at} - 9, 2 * {at})))"
        return f"(length({d}) BETWEEN 12 AND 19 AND {luhn} % 10 = 0)"
    if kind == "phone":
        return f"length({_digits(match)}) BETWEEN 9 AND 15"
    return "true"


def _passes(kind: str, match: str) -> str:
    """SQL: whether the digits, or the last name of an address, are such that a candidate may be of its kind."""
    if kind == "email":
        return f"{match} RLIKE '[A-Za-z]{{2,}}$'"
    if kind == "ip":
        parts = f"split({match}, '[^0-9]+')"
        alike = f"{match} RLIKE '^[0-9]+([.:, -])[0-9]+\\\\1[0-9]+\\\\1[0-9]+$'"
        return f"{alike} AND forall({parts}, p -> length(p) <= 3 AND CAST(nullif(p, '') AS INT) <= 255)"
    return holds(kind, match)


def _negative(kind: str, c: str) -> str:
    """SQL: whether a candidate certainly isn't of its kind."""
    otherwise = "false" if kind == "email" else f"{c}.before RLIKE '{_OTHERWISE}' OR {c}.before RLIKE '[0-9][-.:/]?$' OR {c}.match RLIKE '{_DATE}'"
    return f"(NOT {_passes(kind, f'{c}.match')} OR {otherwise})"


def _features(kind: str) -> str:
    """SQL: the features of candidate ``c``, of its format and its surroundings."""
    x = "c.match"
    count = lambda chars: f"length(regexp_replace({x}, '[^{chars}]', ''))"
    values = [
        str(KINDS.index(kind)),
        f"length({x})",
        count("0-9"),
        count("A-Za-z"),
        count(" "),
        count("."),
        count("-"),
        count("()"),
        f"IF(startswith({x}, '+'), 1, 0)",
        count("@"),
        f"size(filter(split({x}, '[^0-9]+'), y -> y <> ''))",
        f"array_max(transform(split({x}, '[^0-9]+'), y -> length(y)))",
        f"length(regexp_extract({x}, '^[^0-9]*([0-9]*)', 1))",
        f"length(regexp_extract({x}, '([0-9]*)$', 1))",
        "IF(c.before = '' OR c.before RLIKE '[ \\\\n\\\\t]$', 0, IF(c.before RLIKE '[A-Za-z0-9]$', 2, 1))",
        "IF(c.after = '' OR c.after RLIKE '[ \\\\n\\\\t]', 0, IF(c.after RLIKE '[A-Za-z0-9]', 2, 1))",
        *[f"IF(c.before RLIKE '{hint.replace(chr(92), chr(92) * 2)}', 1, 0)" for hint in _HINTS.values()],
        f"IF(c.before RLIKE '{_OTHERWISE}', 1, 0)",
        f"IF({x} RLIKE '{_DATE}', 1, 0)",
        f"IF({_passes(kind, x)}, 1, 0)",
    ]
    return f"array({', '.join(f'CAST({v} AS DOUBLE)' for v in values)})"


SPANS = "array<struct<kind:int,from:bigint,till:bigint>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), proposed (spans with features and whether they are negative), positive (kind and features of
    rewritten spans of the rules) of every whole text."""
    df = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    df = df.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    for kind in KINDS:
        k = KINDS.index(kind)
        df = located(df, RULES[kind], _active(kind), "found")
        df = df.withColumn("right_ones", F.expr(f"filter(found, c -> {holds(kind, 'c.match')})"))
        df = df.withColumn(f"rule_{kind}", F.expr(f"transform(right_ones, c -> struct({k} AS kind, c.from AS from, c.till AS till))"))
        generator = GENERATORS[kind].replace("\\", "\\\\")
        forms = ", ".join(f"transform(right_ones, s -> struct({form.replace('m,', 's.match,').replace('(m)', '(s.match)')} AS match, s.before AS before, s.after AS after))" for form in _LOOSE[kind])
        df = df.withColumn("loose", F.expr(f"filter(concat({forms}), c -> regexp_extract(c.match, '{generator}', 0) = c.match)"))
        df = df.withColumn(f"like_{kind}", F.expr(f"transform(loose, c -> struct({k} AS kind, {_features(kind)} AS x))"))
        df = located(df, GENERATORS[kind], _active(kind), "found")
        df = df.withColumn(f"loose_{kind}", F.expr(f"transform(found, c -> struct({k} AS kind, c.from AS from, c.till AS till, {_features(kind)} AS x, {_negative(kind, 'c')} AS negative))"))
        df = df.drop("right_ones", "loose")
    base = F.concat(*[f"rule_{kind}" for kind in KINDS])
    apart = "NOT exists(base, b -> b.from < c.till AND c.from < b.till)"
    out = df.select("doc_id", base.alias("base"), F.concat(*[f"loose_{kind}" for kind in KINDS]).alias("proposed"), F.concat(*[f"like_{kind}" for kind in KINDS]).alias("positive"))
    return out.withColumn("proposed", F.expr(f"filter(proposed, c -> {apart})"))


def _certain(found: DataFrame) -> DataFrame:
    """kind, x, positive (whether) of rewritten spans and negative candidates."""
    one = found.select(F.inline("positive")).select("kind", "x", F.lit(True).alias("positive"))
    other = found.select(F.explode("proposed").alias("c")).where("c.negative").select("c.kind", "c.x", F.lit(False).alias("positive"))
    return one.unionByName(other)


def fit(found: DataFrame, most: int = TRAIN_CANDIDATES, precision: float = PRECISION) -> tuple[Boosted, list[float]]:
    """The model and a threshold per kind. The fit takes about ``most`` rows of each kind and label, never twice as many; the
    thresholds take all. A kind without positive rows, or where no threshold keeps the precision, adds nothing."""
    rows = _certain(found).select("*", F.xxhash64("x", F.monotonically_increasing_id()).alias("key"))
    counts = rows.groupBy("kind", "positive").count().collect()
    wanted = None
    for r in counts:
        mine = (F.col("kind") == r["kind"]) & (F.col("positive") == r["positive"]) & lowest_hashes(F.col("key"), r["count"], most)
        wanted = mine if wanted is None else wanted | mine
    sample = [] if wanted is None else rows.where(wanted).limit(2 * most * 2 * len(KINDS)).collect()
    if not any(r["positive"] for r in sample):
        return Boosted(0.0), [2.0] * len(KINDS)
    sample.sort(key=lambda r: (r["kind"], r["positive"], r["x"]))
    model = boost(np.array([r["x"] for r in sample], float), np.array([r["positive"] for r in sample], float))
    step = F.floor(F.expr(model.sql("x")) * STEPS).cast("int")
    bins = rows.groupBy("kind", "positive", step.alias("step")).count().collect()  # at most two for each kind and step
    cuts = []
    for k, kind in enumerate(KINDS):
        right, wrong = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
        for r in bins:
            if r["kind"] == k:  # each span of the rules has several loose forms
                (right if r["positive"] else wrong)[r["step"]] += r["count"] / (len(_LOOSE[kind]) if r["positive"] else 1)
        right, wrong = np.cumsum(right[::-1])[::-1], np.cumsum(wrong[::-1])[::-1]
        good = np.flatnonzero((right > 0) & (right >= precision * (right + wrong)))
        cuts.append(max(0.5, float(good[0]) / STEPS) if len(good) else 2.0)
    return model, cuts


def _listed(spans: str) -> str:
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    order = f"array_sort(transform({spans}, c -> struct(c.from AS from, c.kind AS kind, c.till AS till)))"
    return f"array_join(transform({order}, c -> concat({names}[c.kind], ':', c.from, ':', c.till)), ',')"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the rules' spans, spans (all), n_added.

    Spans are kind:start:end in code points, ordered by start and kind. A candidate that isn't certainly negative is added if its
    probability reaches the threshold of its kind and it overlaps no span of the rules. Kinds of which the corpus has no span by the
    rules add nothing. Null and empty texts have no spans; repeated rows give repeated
    results; rows without an id are treated like others; other columns are ignored; an empty table gives no rows.
    """
    found = settle(candidates(docs), "pii-candidates")
    model, cuts = fit(found)
    cut = f"array({', '.join(f'{c!r}D' for c in cuts)})[c.kind]"
    added = f"array_distinct(transform(filter(proposed, c -> NOT c.negative AND {model.sql('c.x')} >= {cut}), c -> struct(c.kind AS kind, c.from AS from, c.till AS till)))"
    out = found.withColumn("added", F.expr(added))
    counts = [F.expr(f"CAST(size(filter(base, b -> b.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("concat(base, added)")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
