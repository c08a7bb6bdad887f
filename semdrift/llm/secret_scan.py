"""Secrets in texts: fixed patterns and sliding-window entropy, with SQL functions only.

Three patterns give the base spans. The entropy method adds spans: runs of the letters of a character class are
candidates; a window of ``WINDOW`` letters slides over each, the letter that enters and the one that leaves change the
counts (twelve to a long, so a step touches seven longs) and the sum of c * log2(c), from which the Shannon entropy
of the window follows. Windows of at least the entropy of their class are hot, and hot windows that touch or overlap
make one span. Candidates and what stands before them are held against an allow list, which never touches base spans.

Null and empty texts have no spans. Every row gives one row, whatever its id; rows with equal or null ids are kept
apart. Offsets count code points, ends are exclusive. Spans are ordered by start, then kind as listed, then end.
Other columns of the input are not read. The work per text is linear in its length, and no row is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds, their patterns and which of their matches count. The look-ahead only saves time.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8

# Character classes of the entropy method: name, letters, least entropy of a window in bits.
WINDOW = 20
CLASSES = [
    ("hex_entropy", "0-9a-fA-F", 3.24),
    ("base64_entropy", "A-Za-z0-9+/_=-", 3.86),
]
# What is no secret: words and numbers alone, placeholders, UUIDs, letters repeated or in order.
ALLOWED = [
    r"^[A-Za-z/_=+-]+$",
    r"^[0-9/_=+-]+$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxxx|your[_-]",
    r"(?i)01234567|12345678|abcdefgh",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[a-z]+([_/=+-][a-z0-9]{1,12})+$",
]
# What names a checksum, a revision or an address when it stands right before a candidate.
BEFORE = r"(?i)((sha-?[0-9]*|md5|checksum|digest|commit|revision|etag|integrity|uuid)[\"']?\x20*[:=-]?\x20*[\"']?|https?://[^\x20\"'<>]*|data:[a-z/+.-]*;base64,)$"
CONTEXT = 48
_BLOCK = 256
_PER_LONG, _LOWEST, _LONGS = 12, 43, 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def offsets(lengths: Column) -> Column:
    """Sums of the entries before each entry; by blocks, so many entries stay cheap."""

    def blocks(v: Column) -> Column:
        count = F.floor((F.size(v) + F.lit(_BLOCK - 1)) / _BLOCK).cast("int")
        totals = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sum(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
        return F.aggregate(totals, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["all"], s["at"]).alias("all")))["all"]

    def each(v: Column, before: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return F.transform(v, lambda _, i: F.element_at(before, block(i) + 1) + _sum(F.slice(v, block(i) * _BLOCK + 1, i % _BLOCK)))

    found = let(lengths, lambda v: let(blocks(v), lambda before: each(v, before)))
    return F.when(F.size(lengths) > 0, found).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of the leftmost non-overlapping matches of a pattern that never matches nothing."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(v: Column, g: Column) -> Column:
        steps = F.transform(v, lambda x, i: (F.length(F.element_at(g, i + 1)) + F.length(x)).cast("long"))
        return let(offsets(steps), lambda at: F.transform(v, lambda x, i: F.struct((F.element_at(at, i + 1) + F.length(F.element_at(g, i + 1))).alias("start"), x.alias("value"))))

    found = let(values, lambda v: let(gaps, lambda g: place(v, g)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,value:string>>"))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the three base kinds, numbered 0 to 2, in no order."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_replace(m["value"], ASSIGNED, "")) >= MIN_ASSIGNED)
    return F.concat(_as_spans(assigned, 0), _as_spans(matches(text, ACCESS), 1), _as_spans(matches(text, HEX), 2))


def hot_ranges(value: Column, least: float) -> Column:
    """Array of (start, end) of the hot windows of a candidate, joined where they touch or overlap."""
    gain = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(WINDOW)])
    count_at = lambda counts, code: F.call_function(
        "shiftrightunsigned", F.element_at(counts, _word(code) + 1), 5 * (code % _PER_LONG)
    ).bitwiseAND(F.lit(31)).cast("int")

    def change(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda w, k: w + F.when(k == _word(code), F.call_function("shiftleft", F.lit(by).cast("long"), 5 * (code % _PER_LONG))).otherwise(F.lit(0).cast("long")))

    def leave(s: Column, codes: Column, i: Column) -> Column:
        code = F.element_at(codes, i - WINDOW + 1)
        out = F.struct(
            change(s["counts"], code, -1).alias("counts"),
            (s["logs"] - F.element_at(gain, count_at(s["counts"], code))).alias("logs"),
        )
        return F.when(i >= WINDOW, out).otherwise(F.struct(s["counts"].alias("counts"), s["logs"].alias("logs")))

    def enter(s: Column, codes: Column, i: Column) -> Column:
        code = F.element_at(codes, i + 1)
        return F.struct(
            change(s["counts"], code, 1).alias("counts"),
            (s["logs"] + F.element_at(gain, count_at(s["counts"], code) + 1)).alias("logs"),
        )

    def slide(s: Column, codes: Column, i: Column) -> Column:
        return let(let(leave(s, codes, i), lambda t: enter(t, codes, i)), lambda t: judge(s, t, i))

    def judge(s: Column, t: Column, i: Column) -> Column:
        bits = F.round(F.lit(math.log2(WINDOW)) - t["logs"] / WINDOW, 9)
        hot = (i >= WINDOW - 1) & (bits >= least)
        begin = i - (WINDOW - 1)
        apart = hot & (begin > s["end"])
        closed = F.when(apart & (s["end"] > 0), F.array_append(s["all"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["all"])
        return F.struct(
            t["counts"].alias("counts"), t["logs"].alias("logs"),
            F.when(apart | (hot & (s["end"] == 0)), begin).otherwise(s["start"]).alias("start"),
            F.when(hot, i + 1).otherwise(s["end"]).alias("end"),
            closed.alias("all"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), _LONGS).alias("counts"), F.lit(0.0).alias("logs"),
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("all"),
    )
    last = lambda s: F.when(s["end"] > 0, F.array_append(s["all"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["all"])
    codes = F.transform(F.split(value, ""), lambda x: F.ascii(x) - _LOWEST)
    return let(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, lambda s, i: slide(s, c, i), last))


def _word(code: Column) -> Column:
    return F.floor(code / _PER_LONG).cast("int")


def entropy_spans(text: Column, name_at: int, letters: str, least: float, allowed: list[str], before: str) -> Column:
    """Array of (start, kind, end) of the hot ranges of one character class that the allow list leaves."""
    found = matches(text, f"[{letters}]{{{WINDOW},}}")

    def secret(m: Column) -> Column:
        known = F.lit(False)
        for pattern in allowed:
            known = known | m["value"].rlike(pattern)
        front = F.substring(text, F.greatest(m["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(m["start"], F.lit(CONTEXT)).cast("int"))
        return ~known & ~front.rlike(before)

    def ranges(m: Column) -> Column:
        return F.transform(hot_ranges(m["value"], least), lambda r: F.struct((m["start"] + r["start"]).alias("start"), F.lit(name_at).alias("kind"), (m["start"] + r["end"]).alias("end")))

    return F.flatten(F.transform(F.filter(found, secret), ranges))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", allowed: list[str] = ALLOWED, before: str = BEFORE) -> DataFrame:
    """(id, spans): for each row the array of (start, end, kind, value), ordered."""
    names = ["assign", "access", "hex", *[c[0] for c in CLASSES]]
    whole = F.coalesce(F.col("__text"), F.lit(""))
    parts = [base_spans(whole)]
    for k, (_, letters, least) in enumerate(CLASSES):
        parts.append(entropy_spans(whole, 3 + k, letters, least, allowed, before))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("__text"))
    ordered = rows.select(F.col(f"`{id_col}`"), "__text", F.array_sort(F.concat(*parts)).alias("__spans"))
    kind = F.array(*[F.lit(n) for n in names])

    def span(s: Column) -> Column:
        value = F.substring(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kind, s["kind"] + 1).alias("kind"), value.alias("value"))

    return ordered.select(F.col(f"`{id_col}`"), F.transform("__spans", span).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    base = ["assign", "access", "hex"]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kinds: list[str]) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("long")

    return found.select(
        F.col(f"`{id_col}`"),
        *[count([k]).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count([c[0] for c in CLASSES]).alias("n_entropy"),
    )
