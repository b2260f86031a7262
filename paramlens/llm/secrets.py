"""Secrets: pattern spans, and weak parts of credentials that only count together.

Base spans come from three patterns. A multipart credential has an access identifier, a secret
and an endpoint. Weaker forms of these, which alone would flood a report, are candidates; an
interval join within the text, on bins as wide as the reach, links them, and a candidate is
reported only where a part of another role lies within reach.

Copies of a text are linked once, and the rows that get what was linked are dealt by text and a
salt, rows without candidates by row, so that neither repeats nor nulls meet in one task. Null and
empty texts have no spans; rows with equal or null ids are judged one by one. Very long texts are
searched whole. An empty table gives an empty one. Where two kinds match at one start, both stay,
in the order of the kinds. Columns of the caller stay, whatever they are called, but a column
``spans`` is replaced. Everything is plain column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import Written, settled

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"

#: Weak parts: kind, role, pattern. They count only near a part of another role.
WEAK = (
    ("weak_id", "id", r"(?i:(?<![a-z])(?:user(?:name)?|login|client_id|account|access_key_id)[\"']?\x20?[:=]\x20?[\"']?)[A-Za-z0-9@._-]{3,}+"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{16,}+"),
    ("weak_endpoint", "endpoint", r"(?<![A-Za-z])[a-z]{2,10}://[A-Za-z0-9.:-]{4,}+"),
)
ROLE = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, role, _ in WEAK}
#: Code points between the ends of two parts of one credential.
REACH = 200
#: Rows of one text are dealt over so many keys.
SALTS = 32


def base_spans(text: Column) -> Column:
    """Spans of the three kinds; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(
        S.find(text, ASSIGN, "assign", (F.instr(text, "=") > 0) | (F.instr(text, ":") > 0)),
        lambda s: F.length(F.regexp_extract(s["value"], _VALUE, 1)) >= 6,
    )
    access = F.filter(S.find(text, ACCESS, "access", F.instr(text, "AKIA") > 0), lambda s: F.length(s["value"]) >= 20)
    return F.concat(assign, access, S.find(text, HEX, "hex"))


def weak_spans(text: Column) -> Column:
    """Candidates, whether or not they are near anything."""
    text = F.coalesce(text, F.lit(""))
    guards = {"weak_endpoint": F.instr(text, "://") > 0, "weak_secret": None, "weak_id": (F.instr(text, "=") > 0) | (F.instr(text, ":") > 0)}
    return F.concat(*[S.find(text, pattern, kind, guards[kind]) for kind, _, pattern in WEAK])


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts that lie within reach of a part of another role: (text_key, kind, start, end).

    ``parts`` has text_key, kind, role, start, end, weak. Each part is binned by its start for
    one side and by all bins it reaches for the other, so that a pair meets in one bin.
    """
    at = parts.withColumn("bin", F.floor(F.col("start") / reach))
    other = parts.select(
        "text_key",
        F.col("role").alias("other_role"),
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("start") - reach * 2, F.lit(0)) / reach), F.floor((F.col("end") + reach) / reach)
            )
        ).alias("bin"),
    )
    near = (
        (F.col("role") != F.col("other_role"))
        & (F.col("start") <= F.col("other_end") + reach)
        & (F.col("other_start") <= F.col("end") + reach)
    )
    weak = at.where("weak").where(F.col("end") - F.col("start") <= reach)
    long = parts.where("weak").where(F.col("end") - F.col("start") > reach).withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)))
    )
    return (
        weak.unionByName(long).join(other, ["text_key", "bin"]).where(near).select("text_key", "kind", "start", "end").distinct()
    )


def _candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_base``, ``_weak`` without those that touch a base span, and ``_key``, null where nothing can link."""
    out = docs.withColumn("_base", base_spans(F.col("text"))).withColumn("_weak", weak_spans(F.col("text")))
    out = out.withColumn(
        "_weak", F.filter("_weak", lambda w: ~F.exists("_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    )
    worth = (F.size("_weak") > 0) & (F.size("_weak") + F.size("_base") > 1)
    return settled(out, "_weak").withColumn("_key", F.when(worth, F.md5(F.coalesce("text", F.lit("")))))


def parts_of(docs: DataFrame) -> DataFrame:
    """(text_key, kind, role, start, end, weak): the parts of each text that holds two or more, one of them weak."""
    roles = F.create_map(*[F.lit(x) for kind, role in ROLE.items() for x in (kind, role)])
    return (
        _candidates(docs.select("text"))
        .where(F.col("_key").isNotNull())
        .select(F.col("_key").alias("text_key"), F.explode(F.concat("_base", "_weak")).alias("s"))
        .select(
            "text_key",
            "s.kind",
            F.element_at(roles, F.col("s.kind")).alias("role"),
            "s.start",
            "s.end",
            F.col("s.kind").startswith("weak_").alias("weak"),
        )
        .distinct()
    )


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Adds ``spans``: base spans and linked weak ones, by start and then kind.

    Weak spans that touch a base span are left to it.
    """
    parts = Written(parts_of(docs))  # the join reads the few parts thrice and the texts once
    near = linked(parts.df, reach).groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_near"))
    near = near.select(F.col("text_key").alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), "_near")
    row = F.monotonically_increasing_id()
    out = _candidates(docs.select(F.struct(*docs.columns).alias("_doc"), "text"))
    out = out.withColumns({"_key": F.coalesce("_key", row.cast("string")), "_salt": (row % SALTS).cast("int")}).join(near, ["_key", "_salt"], "left")
    extra = F.filter(
        "_weak",
        lambda w: F.coalesce(
            F.array_contains("_near", F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"))), F.lit(False)
        ),
    )
    kinds = (*KINDS, *[k for k, _, _ in WEAK])
    spans = S.ordered(F.concat("_base", extra), kinds, start_first=True)
    return out.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c != "spans"], spans.alias("spans"))


def digest_row(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: its counts, a digest of its base spans, and all its spans."""
    found = find(docs.select("doc_id", "text"), reach)
    base = F.filter("spans", lambda s: ~s["kind"].startswith("weak_"))
    return found.select(
        "doc_id",
        *[S.count(F.col("spans"), k).alias(f"n_{k}") for k in KINDS],
        S.digest(S.listed(base)).alias("base_sha256"),
        S.listed(F.col("spans")).alias("spans"),
    )
