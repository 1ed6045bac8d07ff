"""Secret scans: three fixed patterns and sliding-window entropy, all as SQL expressions.

Candidates for the entropy test are maximal runs of 20 or more characters of
[A-Za-z0-9+/_=-]. A window of 20 characters slides over each; letter counts are kept
per step (one enters, one leaves), and with them the sum of c*log2(c), from which
the window's Shannon entropy follows. A candidate is a secret if some window
reaches the threshold of the candidate's character class and no allow-list
pattern matches it. Where a part between '=' and '/' holds an example word, no window counts
that touches this part; what lies between such parts is tested like a candidate. Entropy spans that spans of fixed patterns cover fully are not
reported again; those that reach beyond them are.

Defined cases: null text is empty; offsets are code points, end exclusive; matches of one
pattern don't overlap, those of different patterns may; repeated rows are scanned
each; input columns other than the text are never read by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits by character class. Without a digit, letters of both cases need more; one case alone holds words, and no letters numbers.
THRESHOLDS = (("[A-Za-z]+", 3.7), ("[A-Za-z+/_=-]+", 3.85), ("[0-9a-fA-F]+", 2.9), ("[A-Za-z0-9]+", 3.6), ("[A-Za-z0-9+/_=-]+", 3.8))
EXAMPLE = "(?i)example|sample|dummy|placeholder|changeme"
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^([A-Z]?[a-z]{3,}+[0-9]{0,4}[/_=-]?)+$",
    "^([A-Z]?[a-z]{2,}+[/_=-]?)+$",
)
MARK = "[SECRET]"


def _spans(text: Column, kind: int, pattern: str, keep) -> Column:
    """Spans of the matches that `keep(match, values)` holds for: array of (start, kind, end).

    What lies between the matches and the matches themselves come as two
    arrays; their lengths, summed, give the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found
    pairs = F.zip_with(found, second, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    # The text after the last match comes as a last element without a match, which adds no span.
    pieces = F.zip_with(pairs, between, lambda p, gap: F.struct(F.length(gap).alias("gap"), F.length(p["m"]).alias("n"), keep(p["m"], p["v"]).alias("keep")))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def step(state, piece):
        start = state["at"] + piece["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + piece["n"]).alias("end"))
        spans = F.when(piece["keep"] & piece["n"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + piece["n"]).alias("at"), spans.alias("spans"))

    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(none)


def window_entropy(run: Column, window: int = WINDOW, alphabet: str = ALPHABET) -> Column:
    """Largest Shannon entropy, in bits, of any window of `run`, whose characters all lie in `alphabet`."""
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.length(run))
    steps = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(state, s):
        counts = state["counts"]
        moved = F.transform(counts, lambda c, j: c + (j == s["enters"]).cast("int") - (j == s["leaves"]).cast("int"))
        up, down = F.get(counts, s["enters"]), F.get(counts, s["leaves"])
        left = F.when(s["leaves"] >= 0, F.get(term, down - 1) - F.get(term, down)).otherwise(0.0)
        total = F.when(s["enters"] == s["leaves"], state["sum"]).otherwise(state["sum"] + F.get(term, up + 1) - F.get(term, up) + left)
        entropy = math.log2(window) - total / window
        best = F.when(state["n"] >= window - 1, F.greatest(state["best"], entropy)).otherwise(state["best"])
        return F.struct(moved.alias("counts"), total.alias("sum"), (state["n"] + 1).alias("n"), best.alias("best"))

    return F.aggregate(steps, start, step, lambda state: state["best"])


def without_examples(run: Column) -> Column:
    """What is left of a candidate, at least a window long each, around its parts with example words."""
    parts = F.transform(F.split(run, "(?<=[=/])"), lambda p: F.when(p.rlike(EXAMPLE), " ").otherwise(p))
    left = F.transform(F.split(F.array_join(parts, ""), " "), lambda p: F.regexp_replace(p, "[=/]++$", ""))
    return F.when(run.rlike(EXAMPLE), F.filter(left, lambda p: F.length(p) >= WINDOW)).otherwise(F.array(run))


def is_key_like(run: Column) -> Column:
    """Whether entropy reaches its class's threshold and nothing allows it."""
    mixed = run.rlike("[A-Za-z]") & (run.rlike("[0-9]") | (run.rlike("[a-z]") & run.rlike("[A-Z]")))
    for pattern in ALLOWED:
        mixed = mixed & ~run.rlike(pattern)
    threshold = F.lit(None).cast("double")
    for pattern, bits in reversed(THRESHOLDS):
        threshold = F.when(run.rlike(f"^{pattern}$"), bits).otherwise(threshold)
    return F.when(mixed, window_entropy(run) >= threshold).otherwise(False)


def _covered(span: Column, base: Column | str) -> Column:
    """Whether spans in order of their starts leave nothing of `span` free."""
    reach = lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at)
    return F.aggregate(base, span["start"], reach) >= span["end"]


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with _base and _all: arrays of (start, kind, end), ordered by start, then kind."""
    text = F.col("_text")
    yes = lambda m, v: F.lit(True)
    found = docs.withColumn("_text", whole_text(text_col)).select(
        "*",
        _spans(text, 0, ASSIGN, lambda m, v: F.length(v) >= LEAST_VALUE).alias("_assign"),
        _spans(text, 1, ACCESS, yes).alias("_access"),
        _spans(text, 2, HEX, yes).alias("_hex"),
        _spans(text, 3, CANDIDATE, lambda m, v: F.exists(without_examples(m), is_key_like)).alias("_entropy"),
    )
    found = found.withColumn("_base", F.sort_array(F.concat("_assign", "_access", "_hex")))
    more = F.filter("_entropy", lambda x: ~_covered(x, "_base"))
    found = found.withColumn("_all", F.sort_array(F.concat("_base", more)))
    return found.drop("_assign", "_access", "_hex", "_entropy")


def joined(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "_all") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with each run of overlapping spans replaced by one mark."""

    def step(state, s):
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        marked = F.concat(state["out"], before, F.when((s["start"] >= state["at"]), F.lit(mark)).otherwise(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), marked.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
