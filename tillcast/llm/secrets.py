"""Secret scans with character Markov models (operator 1), DataFrame functions only.

Base kinds are found by pattern: ``assign`` (a key word, a sign, a value of 12
or more characters), ``access`` (key ids, 18 or more) and ``hex`` (runs of 16
or more).  Further, each run of 20 or more key characters outside of the base
spans (what a base span leaves of a longer run counts as a run) is judged by two first-order character Markov models, one of random
strings, one of ordinary identifiers: it is a ``markov`` span if the
log-likelihood ratio is over ``MIN_RATIO`` in all and ``MIN_RATE`` a character.
Both models are trained on a bounded sample of documents (``SAMPLE_DOCS``),
labelled by the base patterns: the values they find (those with letters and
digits) are random strings; what stands outside of all base spans is ordinary, as
it is and joined into identifiers (``identifiers``: snake, kebab, path and camel
case with dates, versions and counters, UUIDs), so that digits and signs are known
to be ordinary there too.  Counts start at one each, so a sample without secrets still gives
a model (random then means uniform).  The table of ratios (67 x 67) becomes a
literal of the plan.

Positions come from the pieces between matches and the matches themselves, so a
scan is one pass over the rows without a shuffle.  Offsets are code points, end
exclusive.

Edge cases: null text is empty and has no span; spans that start together are
ordered by kind; repeated rows give equal rows; an empty table gives no rows;
``scan`` keeps extra columns, and the query ignores them.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_name
from .registry import register

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # same spans as AKIA[A-Z0-9]+ with the shorter ones dropped
HEX = r"[0-9a-f]{16,}"
MIN_RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
WORD = r"[A-Za-z][A-Za-z0-9_-]{7,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN = 12

ALPHABET = string.ascii_letters + string.digits + "+/_="
STATES = len(ALPHABET) + 1  # 0 is any other character
SAMPLE_DOCS = 4096
MIN_RATIO = 12.0  # natural logarithms
MIN_RATE = 0.6
PLACEHOLDERS = (string.ascii_lowercase, "".join(string.ascii_lowercase[i:i + 3].title() for i in range(0, 26, 3)), string.digits)
BY_KIND = 0.35  # weight of the steps between kinds of characters in the ordinary model
MASK = "[SECRET]"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Each match as (start, end, found); nothing is scanned where nothing matches."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["found"]), F.lit(0))
        here = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["found"].alias("found"))
        return F.struct(end.cast("bigint").alias("at"), F.when(x["found"].isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(here))).alias("out"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    walked = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)
    return F.when(text.rlike(pattern), walked["out"]).otherwise(empty)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 x["end"].alias("end")))


def base_matches(text: Column) -> list[Column]:
    assign = F.filter(_matches(text, ASSIGN),
                      lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= MIN_ASSIGN)
    access = F.when(text.contains("AKIA"), _matches(text, ACCESS)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,found:string>>"))
    return [assign, access, _matches(text, HEX)]


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind."""
    parts = [_spans(m, k) for m, k in zip(base_matches(text), KINDS, strict=False)]
    return F.sort_array(F.concat(*parts).cast(_SPANS))


def _state(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def _pair_states(word: Column) -> Column:
    """State pairs of neighbouring characters, the first pair starting from state 0."""
    def pairs(chars: Column) -> Column:
        before = F.concat(F.array(F.lit(" ")), F.slice(chars, 1, F.size(chars) - 1))
        return F.zip_with(before, chars, lambda a, b: _state(a) * STATES + _state(b))
    return let(F.split(word, ""), lambda c: let(F.filter(c, lambda x: x != ""), pairs))


def identifiers(text: Column) -> Column:
    """Labelled ordinary identifiers made of a text's own words: snake, kebab, path and camel case, with years,
    dates, versions and counters, one UUID for the text, and the usual placeholders (runs of the alphabet and of digits)."""
    def form(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            a, b, c = F.lower(w), F.lower(F.coalesce(F.get(words, i + 1), w)), F.lower(F.coalesce(F.get(words, i + 2), w))
            n = F.pmod(F.xxhash64(w, i), F.lit(100_000)).cast("int")
            year, month, day = (1990 + n % 45).cast("string"), F.lpad((1 + n % 12).cast("string"), 2, "0"), F.lpad((1 + n % 28).cast("string"), 2, "0")
            count = (n % 1000).cast("string")
            forms = [F.concat_ws("_", a, b, c), F.concat_ws("-", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)),
                     F.concat(*[F.initcap(F.substring(x, 1, 3)) for x in (a, b, c)]), F.concat_ws("_", a, year, b, count),
                     F.concat_ws("-", a, year, month, day, b, n.cast("string"), c), F.concat_ws("_", a, b, F.concat(F.lit("v"), F.lit("1"), F.lit("_"), (n % 10).cast("string"))),
                     F.concat_ws("/", a, b, c), F.concat_ws("_", F.upper(a), F.upper(b))]
            return F.element_at(F.array(*forms), (i % len(forms) + 1).cast("int"))
        return F.transform(words, one)
    digest = F.md5(text)
    uuid = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(let(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,20}"), F.lit(0)), form), F.array(uuid, *map(F.lit, PLACEHOLDERS)))


def train(docs: DataFrame, text_col: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each state pair, from about ``sample_docs`` documents."""
    total, space = docs.count(), 1 << 30
    place = F.pmod(F.xxhash64(F.lit("markov"), F.col(key)), F.lit(space))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(place < min(space, space * sample_docs // max(total, 1) + 1)).select(text.alias("t"))
    t = F.col("t")
    assign, access, _ = base_matches(t)
    # values of letters only are words as well as passwords: they tell the classes nothing apart
    values = F.filter(F.transform(assign, lambda x: F.regexp_extract(x["found"], ASSIGN, 2)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    # runs of hex digits are found by pattern; as random strings they would make every UUID one
    random = F.filter(F.concat(values, F.transform(access, lambda x: x["found"])), lambda v: ~v.rlike("^[0-9a-fA-F-]+$"))
    # ordinary: what stands outside of the base spans, as it is and joined into identifiers
    outside = F.regexp_replace(t, f"{ASSIGN}|{ACCESS}|{HEX}", "\n")
    ordinary = F.concat(F.regexp_extract_all(outside, F.lit(WORD), F.lit(0)), identifiers(outside))
    words = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("words")),
                                          F.struct(F.lit(0).alias("random"), ordinary.alias("words")))).alias("x"))
    words = words.select("x.random", F.explode("x.words").alias("w"))
    counts = words.select("random", F.explode(_pair_states(F.col("w"))).alias("pair")).groupBy("random", "pair").count()
    seen = {(r.random, r.pair): r["count"] for r in counts.collect()}  # at most 2 x 67 x 67 rows
    rows_of = {k: [sum(seen.get((k, a * STATES + b), 0) for b in range(STATES)) for a in range(STATES)] for k in (0, 1)}
    kinds = [_kind(a) for a in range(STATES)]
    steps = {(x, y): 1.0 for x in set(kinds) for y in set(kinds)}  # ordinary steps from kind to kind of character
    for a in range(STATES):
        for b in range(STATES):
            steps[kinds[a], kinds[b]] += seen.get((0, a * STATES + b), 0)
    out_of = {x: sum(n for (y, _), n in steps.items() if y == x) for x in set(kinds)}
    table = []
    # random strings: prior of one for each character that any key may hold; ordinary ones: any
    # neighbour of the same kind may follow, so a rare pair of letters is not a sign of a key
    for a in range(STATES):
        for b in range(STATES):
            p1 = (seen.get((1, a * STATES + b), 0) + 1) / (rows_of[1][a] + STATES)
            alike = steps[kinds[a], kinds[b]] / out_of[kinds[a]] / kinds.count(kinds[b])
            p0 = BY_KIND * alike + (1 - BY_KIND) * (seen.get((0, a * STATES + b), 0) / rows_of[0][a] if rows_of[0][a] else alike)
            table.append(math.log(p1 / p0))
    return table


def _kind(state: int) -> str:
    c = ALPHABET[state - 1] if state else ""
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else c


def markov_spans(text: Column, base: Column, table: list[float]) -> Column:
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    def outside(x: Column) -> Column:
        """The parts of a run between the base spans that meet it."""
        met = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

        def part(start: Column, end: Column) -> Column:
            piece = F.substring(x["found"], (start - x["start"] + 1).cast("int"), (end - start).cast("int"))
            return F.array(F.struct(start.alias("start"), end.alias("end"), piece.alias("found")))

        def step(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(
                b["start"] - acc["at"] >= MIN_RUN, F.concat(acc["out"], part(acc["at"], b["start"])))
                .otherwise(acc["out"]).alias("out"))

        start = F.struct(x["start"].alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,found:string>>").alias("out"))
        return F.when(F.size(met) == 0, F.array(x)).otherwise(F.aggregate(met, start, step, lambda acc: F.when(
            x["end"] - acc["at"] >= MIN_RUN, F.concat(acc["out"], part(acc["at"], x["end"]))).otherwise(acc["out"])))
    found = F.flatten(F.transform(_matches(text, CANDIDATE), outside))

    def random(x: Column) -> Column:
        ratio = F.aggregate(_pair_states(x["found"]), F.lit(0.0), lambda acc, p: acc + F.get(ratios, p))
        return let(ratio, lambda r: (r >= MIN_RATIO) & (r >= MIN_RATE * F.char_length(x["found"])))
    return _spans(F.filter(found, random), "markov")


def scan(docs: DataFrame, table: list[float], text_col: str = "text", base_col: str = "base_spans",
         spans_col: str = "spans") -> DataFrame:
    """All columns plus the base spans and all spans: arrays of (start, kind, end) by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = let(base_spans(text), lambda base: F.struct(
        base.alias("base"), F.sort_array(F.concat(base, markov_spans(text, base, table))).cast(_SPANS).alias("all")))
    one = fresh_name(docs, "secret_spans")
    out = docs.withColumn(one, both)
    return out.withColumns({base_col: F.col(one)["base"], spans_col: F.col(one)["all"]}).drop(one)


def redact(docs: DataFrame, table: list[float], text_col: str = "text", length_col: str = "n_chars",
           mask: str = MASK) -> DataFrame:
    """``docs`` with each secret replaced by ``mask``; overlapping spans share one mask.

    The length column follows the new text where there was a secret.
    """
    text = F.col(text_col)
    base, spans = fresh_name(docs, "base_spans"), fresh_name(docs, "all_spans")

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
            s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col(spans), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    has = F.size(spans) > 0
    new = fresh_name(docs, "redacted")
    out = scan(docs, table, text_col, base, spans).withColumn(new, F.when(has, done).otherwise(text))
    changes = {text_col: F.col(new)}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changes[length_col] = F.when(has, F.char_length(new)).otherwise(F.col(length_col)).cast(kind)
    return out.withColumns(changes).drop(base, spans, new)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op1_markov_secret_scan")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scan(docs, train(docs))
    base = F.col("base_spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias("n_" + k)
    return out.select("doc_id", count("assign"), count("access"), count("hex"),
                      F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                      (F.size("spans") - F.size("base_spans")).cast("bigint").alias("n_markov"))
