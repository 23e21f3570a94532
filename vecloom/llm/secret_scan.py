"""Secret scan with column expressions only.

Base spans are matches of three fixed patterns. The method adds spans of high entropy: in a candidate (a long run of one character
class) a window slides, its character counts change by one in and one out, and the Shannon entropy follows from a running sum. The
windows over the class's bound give a span from the first to the end of the last, unless the candidate is on the allow list or meets
a base span.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Of an assignment, the value's least length.
VALUE = 8

#: Character class: its run as a pattern, characters in a window, least entropy of a window in bits.
CLASSES: Mapping[str, tuple[str, int, float]] = {
    "base16": (r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.2),
    "base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.9),
}
#: A candidate that matches one of these is no secret: words only, numbers only, a UUID, the usual
#: placeholders, and paths of words.
ALLOW = (
    r"^[A-Za-z+/_=-]+$", r"^[0-9+/_=-]+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"(?i)example|placeholder|changeme|xxxx|0000|1234567|abcdef",
    r"^/?(?:[a-z_-]+[0-9]{0,4}/)+[a-z_-]*[0-9]{0,4}$",
)

Spans = "array<struct<start:bigint,end:bigint,text:string>>"


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, text)`` in code points.

    Each match of ``\\G(gap)(match)`` starts where the one before ended, so that lengths add up to positions and a text's tail is not
    searched again.
    """
    chain = rf"\G([\s\S]*?)({pattern})"
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(chain), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(chain), F.lit(2)).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(Spans).alias("out"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("text")))).alias("out"))

    spans = F.aggregate(pieces, zero, step, lambda state: state["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(Spans))


def high_windows(candidate: Column, window: int, least: float) -> Column:
    """``(first, last)`` start, from 1, of the windows whose entropy is at least ``least``; nulls if there is none.

    The state holds the counts of the 94 printable characters and the sum of c * log2(c) over them. A step adds one character, drops
    the one that leaves, and changes only those two terms.
    """
    chars = F.split(candidate, "")
    codes = F.transform(chars, lambda c: F.ascii(c) - 32)
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(
        F.array_repeat(F.lit(0), 94).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def step(state: Column, pair: Column) -> Column:
        new, old, counts = pair["new"], pair["old"], state["counts"]
        c_new, c_old = F.element_at(counts, new), F.when(old.isNotNull(), F.element_at(counts, F.coalesce(old, F.lit(1))))
        change = F.when(old.isNull(), term(c_new + 1) - term(c_new)).when(old == new, F.lit(0.0)).otherwise(term(c_new + 1) - term(c_new) + term(c_old - 1) - term(c_old))
        total, at = state["sum"] + change, state["at"] + 1
        moved = F.transform(counts, lambda c, i: c + F.when(i + 1 == new, 1).otherwise(0) - F.when(i + 1 == old, 1).otherwise(0))
        high = (at >= window) & (F.log2(F.lit(float(window))) - total / window >= least)
        return F.struct(
            moved.alias("counts"), total.alias("sum"), at.alias("at"),
            F.when(high & state["first"].isNull(), at - window + 1).otherwise(state["first"]).alias("first"), F.when(high, at - window + 1).otherwise(state["last"]).alias("last"),
        )

    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).alias("old")))
    return F.aggregate(pairs, zero, step, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))


def entropy_spans(text: Column, classes: Mapping[str, tuple[str, int, float]] = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    """Spans of high entropy in candidates that no allow pattern matches, class by class."""
    parts = []
    for pattern, window, least in classes.values():
        candidates = F.filter(found(text, pattern), lambda s: ~F.coalesce(*[F.when(s["text"].rlike(a), True) for a in allow], F.lit(False)))
        parts.append(F.filter(F.transform(candidates, _marker(window, least)), lambda s: s["start"].isNotNull()))
    return F.concat(*parts)


def _marker(window: int, least: float):
    """From a candidate's span to that of its windows of high entropy."""

    def mark(s: Column) -> Column:
        high = high_windows(s["text"], window, least)
        return F.struct((s["start"] + high["first"] - 1).alias("start"), (s["start"] + high["last"] - 1 + window).alias("end"), s["text"].alias("text"))

    return mark


def scan(docs: DataFrame, text: str = "text", classes: Mapping[str, tuple[str, int, float]] = CLASSES, allow: Sequence[str] = ALLOW, name: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets``: an array of ``(start, kind_order, end, kind)`` by start and kind; offsets in code points.

    Null and empty texts have none. Every row is looked at by itself: repeated rows give equal results, an empty table an empty one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn("_assign", F.filter(found(t, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= VALUE))
    rows = rows.withColumn("_access", found(t, ACCESS)).withColumn("_hex", found(t, HEX)).withColumn("_entropy", entropy_spans(t, classes, allow))

    def of(column: str, order: int, keep=None) -> Column:
        spans = F.col(column) if keep is None else F.filter(F.col(column), keep)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), s["end"].alias("end"), F.lit(KINDS[order]).alias("kind")))

    rows = rows.withColumn("_base", F.concat(of("_assign", 0), of("_access", 1), of("_hex", 2)))
    apart = lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    extra = F.array_distinct(of("_entropy", 3, apart))
    return rows.withColumn(name, F.sort_array(F.concat(F.col("_base"), extra))).drop("_assign", "_access", "_hex", "_entropy", "_base")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
