"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Candidate strings of the entropy scan.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least entropy, in bits, of a window by its own character class: the 1 % quantile of random strings of the class.
#: "other" holds for windows without letters or digits, which random keys seldom have but words and numbers do.
LEAST = {"hex": 2.9, "base32": 3.34, "single": 3.4, "mixed": 3.64, "other": 3.85}
#: Candidates that are never secrets: single-class strings, identifiers with fixed layout, and slugs or paths of plain
#: words.
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_=-]*[A-Z]?[a-z]+(?:[-_/=]+(?:[A-Z]?[a-z]+|[0-9]{1,6}))+[/_=-]*$",
)
#: Parts that mark a run of dense windows as a placeholder (counting sequences, documentation keys), if the run is no
#: longer than a key: in a longer one the part does not speak for the rest.
PLACEHOLDERS = (r"(?i)0123456789|abcdefghij", r"EXAMPLE")
PLACEHOLDER_RUN = 48
_CHUNK = 256  # folds that build arrays or texts do so in chunks, so that they stay near linear in the number of spans
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters a window is tallied by, a byte of a long each: the class follows from which tallies are zero.
_TALLIED = (
    str.isupper, str.islower, str.isdigit, lambda c: c.isalpha() and c.lower() > "f", lambda c: c.islower() or c in "0189", lambda c: not c.isalnum(),
)
_WEIGHTS = [0, *(sum(1 << 8 * k for k, f in enumerate(_TALLIED) if f(c)) for c in _ALPHABET)]
_HIT = "array<struct<start:int,stop:int,value:string>>"
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it inside folds."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(items: Column) -> Column:
    """An array cut into arrays of at most _CHUNK items."""
    n = F.ceil(F.size(items) / F.lit(_CHUNK)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(items, (i - 1) * _CHUNK + 1, F.lit(_CHUNK)))
    return F.slice(each, F.lit(1), n)


def _before(parts: Column, length: Callable[[Column], Column]) -> Column:
    """For each chunk, the sum of `length` over all items before it."""
    sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, c: acc + length(c)))
    zero = F.struct(F.lit(0).alias("at"), _empty("array<int>").alias("out"))
    return F.aggregate(sums, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, stop, value of a group), in code points, stop exclusive.

    What `split` leaves between the matches gives their places, so both passes stay inside the engine.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    cells = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        cells = F.zip_with(cells, values, lambda c, v: F.struct(c["gap"].alias("gap"), c["size"].alias("size"), v.alias("value")))

    def step(acc: Column, c: Column) -> Column:
        begin = acc["at"] + c["gap"]
        hit = F.struct(begin.alias("start"), (begin + c["size"]).alias("stop"), c["value"].alias("value"))
        return F.struct((begin + c["size"]).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    fold = lambda part, t: F.aggregate(part, F.struct(t.alias("at"), _empty(_HIT).alias("out")), step, lambda acc: acc["out"])
    placed = _let(cells, lambda c: _let(_chunks(c), lambda parts: F.flatten(F.zip_with(parts, _before(parts, lambda x: x["gap"] + x["size"]), fold))))
    return F.when(text.rlike(pattern), placed).otherwise(_empty(_HIT))


def _named(hits: Column, rank: int) -> Column:
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind")))


def _least(tally: Column) -> Column:
    """Least entropy of a window from its tallies; separators belong to every class but that of one case and digits."""
    upper, lower, digit, beyond_hex, beyond_32, separator = (F.shiftright(tally, 8 * k).bitwiseAND(F.lit(255)) for k in range(len(_TALLIED)))
    return (
        F.when((digit == 0) | (upper + lower == 0), F.lit(LEAST["other"]))
        .when(beyond_hex == 0, F.lit(LEAST["hex"]))
        .when(beyond_32 == 0, F.lit(LEAST["base32"]))
        .when((upper > 0) & (lower > 0), F.lit(LEAST["mixed"]))
        .when(separator == 0, F.lit(LEAST["single"]))
        .otherwise(F.lit(LEAST["other"]))
    )


def entropy_runs(value: Column, window: int = WINDOW) -> Column:
    """Stretches of a candidate whose every window is at or above its class's least entropy, as (start, stop, value).

    One fold over the characters: each step adds the character that enters the window and removes the one that
    leaves, in an array of counts and in the running sum of n log2 n; entropy is log2(window) - sum / window.
    The class is that of the window, so a prefix of other characters raises no bound but its own; a candidate of
    hex digits alone is lower-cased and hex throughout.
    """
    is_hex = value.rlike(r"^[0-9a-fA-F+/_=-]*$")
    chars = F.transform(F.split(F.when(is_hex, F.lower(value)).otherwise(value), ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    chars = F.filter(chars, lambda c: c > 0)
    weight = lambda c: F.element_at(F.array(*[F.lit(w).cast("long") for w in _WEIGHTS]), c + 1)
    terms = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 2)])
    term = lambda n: F.element_at(terms, n + 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("tally"), F.lit(0).alias("at"),
        F.lit(-1).alias("since"), _empty(_HIT).alias("out"),
    )
    paired = F.transform(chars, lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(0)).alias("leaves")))
    hit = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("stop"), F.lit("").alias("value")))

    def step(acc: Column, c: Column) -> Column:
        n_out = F.when(c["leaves"] > 0, F.element_at(acc["counts"], F.greatest(c["leaves"], F.lit(1)))).otherwise(F.lit(0))
        without = acc["total"] + F.when(c["leaves"] > 0, term(F.greatest(n_out - 1, F.lit(0))) - term(n_out)).otherwise(F.lit(0.0))
        n_in = F.element_at(acc["counts"], c["enters"]) - F.when(c["leaves"] == c["enters"], F.lit(1)).otherwise(F.lit(0))
        total = without + term(n_in + 1) - term(n_in)
        counts = F.transform(
            acc["counts"],
            lambda v, k: v + F.when(k + 1 == c["enters"], F.lit(1)).otherwise(F.lit(0)) - F.when(k + 1 == c["leaves"], F.lit(1)).otherwise(F.lit(0)),
        )
        at = acc["at"] + 1
        tally = acc["tally"] + weight(c["enters"]) - weight(c["leaves"])
        least = F.when(is_hex, F.lit(LEAST["hex"])).otherwise(_least(tally)) - F.lit(1e-9)
        dense = (at >= window) & (F.lit(math.log2(window)) - total / window >= least)
        since = F.when(dense, F.when(acc["since"] >= 0, acc["since"]).otherwise(at - window)).otherwise(F.lit(-1))
        ended = ~dense & (acc["since"] >= 0)
        out = F.when(ended, F.concat(acc["out"], hit(acc["since"], acc["at"]))).otherwise(acc["out"])
        return F.struct(counts.alias("counts"), total.alias("total"), tally.alias("tally"), at.alias("at"), since.alias("since"), out.alias("out"))

    done = lambda acc: F.when(acc["since"] >= 0, F.concat(acc["out"], hit(acc["since"], acc["at"]))).otherwise(acc["out"])
    return F.aggregate(paired, zero, step, done)


def entropy_hits(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Entropy spans of a whole text: runs in every candidate that no allow-list pattern matches."""
    found = F.filter(located(text, CANDIDATE), lambda h: ~h["value"].rlike("|".join(f"(?:{p})" for p in allowed)))
    marked = "|".join(f"(?:{p})" for p in PLACEHOLDERS)

    def runs(h: Column) -> Column:
        own = lambda r: F.substring(h["value"], r["start"] + 1, r["stop"] - r["start"])
        kept = F.filter(entropy_runs(h["value"]), lambda r: (r["stop"] - r["start"] > PLACEHOLDER_RUN) | ~own(r).rlike(marked))
        return F.transform(kept, lambda r: F.struct((h["start"] + r["start"]).alias("start"), (h["start"] + r["stop"]).alias("stop"), r["value"].alias("value")))

    return F.flatten(F.transform(found, runs))


def _highest(ends: Column) -> Column:
    """The greatest of the numbers before each, and of all (at least 0): one more than there are numbers."""
    zero = F.struct(F.lit(0).alias("at"), _empty("array<int>").alias("out"))
    step = lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(ends, zero, step, lambda acc: F.concat(acc["out"], F.array(acc["at"])))


def _uncovered(spans: Column) -> Column:
    """Sorted spans without those entropy spans that lie inside a base span: one that began before and ends no sooner."""
    entropy = len(KINDS) - 1
    reach = lambda s: F.when(s["rank"] < entropy, s["stop"]).otherwise(F.lit(0))
    def step(acc: Column, s: Column) -> Column:
        kept = (s["rank"] < entropy) | (s["stop"] > acc["at"])
        return F.struct(F.greatest(acc["at"], reach(s)).alias("at"), F.when(kept, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    fold = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), _empty(_SPAN).alias("out")), step, lambda acc: acc["out"])
    highest = lambda parts: _highest(F.transform(parts, lambda part: F.array_max(F.transform(part, reach))))
    cut = lambda parts: F.flatten(F.zip_with(parts, F.slice(highest(parts), F.lit(1), F.size(parts)), fold))
    return _let(spans, lambda every: _let(_chunks(every), cut))


def scan(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows of `docs` with `base_spans` and `all_spans`: arrays of (start, rank, stop, kind), sorted.

    Base kinds are leftmost non-overlapping matches per kind; the entropy scan adds its spans whole, except those that lie
    inside one base span. A null or empty text has no spans; repeated rows get equal spans; an empty table gives an
    empty result. Columns of `docs` named base_spans or all_spans are replaced; all others come back as they are. The
    work is row-local: no shuffle, whatever the key distribution.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    assigned = F.filter(located(body, ASSIGN, 2), lambda h: F.length(h["value"]) >= 12)
    base = F.array_sort(F.concat(_named(assigned, 0), _named(located(body, ACCESS), 1), _named(located(body, HEX), 2)))
    found = F.struct(base.alias("base"), _named(entropy_hits(body, allowed), 3).alias("dense"))
    staged = docs.withColumn("base_spans", found)
    every = F.when(F.size("base_spans.dense") > 0, _uncovered(F.array_sort(F.concat("base_spans.base", "base_spans.dense")))).otherwise(F.col("base_spans.base"))
    return staged.withColumn("all_spans", every).withColumn("base_spans", F.col("base_spans.base"))


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by `mark`. A chunk of spans copies its own part of the text."""
    def replaced(part: Column, since: Column) -> Column:
        whole = F.substring(text, since + 1, F.greatest(F.array_max(F.transform(part, lambda s: s["stop"])) - since, F.lit(0)))
        start = F.struct(since.alias("at"), whole.alias("body"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            lead = F.concat(F.substring(acc["body"], acc["at"] - since + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["body"].alias("body"), F.concat(acc["out"], F.when(fresh, lead).otherwise(F.lit(""))).alias("out"))

        return F.aggregate(part, start, step, lambda acc: acc["out"])

    froms = lambda parts: _highest(F.transform(parts, lambda part: F.array_max(F.transform(part, lambda s: s["stop"]))))
    joined = lambda parts, at: F.array_join(F.zip_with(parts, F.slice(at, F.lit(1), F.size(parts)), replaced), "")
    whole = lambda parts, at: F.concat(joined(parts, at), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))
    return _let(_chunks(spans), lambda parts: _let(froms(parts), lambda at: whole(parts, at)))
