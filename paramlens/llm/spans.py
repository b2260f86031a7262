"""Spans of pattern matches as plain column expressions.

``split`` and ``regexp_extract_all`` find the same leftmost, non-overlapping matches, so the
gaps and the matches of a text, taken in turn, give every match its place. Positions count code
points; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find(text: Column, pattern: str | Column, kind: str, when: Column | None = None) -> Column:
    """All matches of a pattern as an array of spans; empty where ``when`` doesn't hold.

    The pattern must not match the empty string. Repeated groups in it should be possessive,
    as Java's matcher otherwise recurses once for each repetition.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap")
    )
    both = F.filter(both, lambda x: x["value"].isNotNull())
    placed = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), no_spans().alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        F.lit(kind).alias("kind"),
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
                        x["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    matched = F.rlike(text, pattern)
    return F.when(matched if when is None else when & matched, placed).otherwise(no_spans())


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ordered(spans: Column, kinds: Iterable[str], start_first: bool) -> Column:
    """Spans by kind as listed and then start, or by start and then kind as listed."""
    kinds = list(kinds)

    def rank(s: Column) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])

    def row(s: Column) -> Column:
        first = (s["start"].cast("long"), rank(s)) if start_first else (rank(s), s["start"].cast("long"))
        return F.struct(first[0].alias("a"), first[1].alias("b"), s["end"].alias("c"), s.alias("span"))

    return F.transform(F.array_sort(F.transform(spans, row)), lambda r: r["span"])


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def masked(text: Column, spans: Column, shown: Column) -> Column:
    """The text with each span replaced by what ``shown`` maps its kind to.

    Where spans overlap, the one that starts first counts, the longer one at equal starts;
    what is left of a later one beyond it goes as well.
    """
    by_place = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind")))
    )
    done = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["neg"]).alias("at"),
            F.concat(
                acc["out"],
                F.when(
                    s["start"] >= acc["at"],
                    F.concat(
                        F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                        F.coalesce(F.element_at(shown, s["kind"]), F.lit("")),
                    ),
                ).otherwise(F.lit("")),
            ).alias("out"),
        ),
    )
    whole = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
