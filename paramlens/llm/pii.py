"""Personal data: pattern spans, and terms that give protected values away.

Base spans come from four patterns. Beyond them, corpus co-occurrence says how much a term
reveals about a protected value: pointwise mutual information between term and value, in bits,
and the share of the term's texts that also hold the value. All words of a text that touch no
base span count, however far from the value. Terms over the thresholds are generalised to a
placeholder, or removed when nearly all their texts hold the value.

The bits of a term can't exceed log2(documents / documents of the value), so they are asked for
in relation to that, and frequent values need more texts instead. What every document holds is
revealed by nothing. A term needs support from different texts; copies of a text count as one
there. Null and empty texts have no spans. Rows with equal or null ids are judged one by one, and
very long texts whole. Of terms that match at one place the longest wins. An empty table gives
an empty one. The caller's columns stay, whatever they are called, but ``spans`` is replaced.
Everything is plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import SPACE, Written, looked_up, settled, squeezed

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

_LOCAL = r"A-Za-z0-9._%+-"
# Possessive repetition and the looks behind only save the matcher work; they admit the same matches.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as revealing.

    ``support``: different texts that hold term and value together, at least. ``bits``: mutual information
    that ``support`` texts need; more texts need less each, as texts times bits count. ``part``: of the most
    bits that the value's frequency allows. ``share``: of the term's documents that hold the value.
    ``removal``: share from which it is removed rather than generalised. ``broadcast_rows``, ``broadcast_chars``: tables
    up to so many rows, and so much text in them, are broadcast; larger ones are joined by shuffles.
    """

    support: int = 3
    bits: float = 6.0
    part: float = 0.5
    share: float = 0.5
    removal: float = 0.9
    broadcast_rows: int = 50_000
    broadcast_chars: int = 10_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backwards = F.reverse(_digits(value))
    figures = F.transform(F.split(backwards, ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(
        figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and start; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    email = S.find(text, EMAIL, "email", F.instr(text, "@") > 0)
    ip = F.filter(S.find(text, IP, "ip"), lambda s: F.rlike(s["value"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))
    card = F.filter(
        S.find(text, CARD, "card"), lambda s: F.length(_digits(s["value"])).between(13, 19) & _luhn(s["value"])
    )
    phone = F.filter(
        S.find(text, PHONE, "phone", F.instr(text, "+") > 0), lambda s: F.length(_digits(s["value"])).between(9, 15)
    )
    return F.concat(email, ip, card, phone)


def _free_words(text: Column, spans: Column) -> Column:
    """The distinct whole words that touch no span."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    gaps = F.aggregate(
        by_place,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("gaps")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["gaps"], F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))))).alias("gaps"),
        ),
        lambda acc: F.concat(acc["gaps"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))),
    )
    cut = F.transform(gaps, lambda g, i: F.when(i > 0, F.regexp_replace(g, r"^[^\x20\x09-\x0D]+", "")).otherwise(g))
    cut = F.transform(cut, lambda g, i: F.when(i < F.size(spans), F.regexp_replace(g, r"[^\x20\x09-\x0D]++$", "")).otherwise(g))
    return F.filter(F.array_distinct(F.split(F.array_join(cut, " "), SPACE)), lambda w: w != "")


def _words(docs: DataFrame, *keys: str) -> DataFrame:
    """Each word of a document once, with the keys."""
    return docs.select(*keys, F.explode(F.array_distinct(F.split(squeezed("text"), " "))).alias("term"))


def revealing_terms(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """(term, removed): the terms over the thresholds."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.col("text") != "")
    marked = settled(texts.withColumn("spans", base_spans(F.col("text"))), "spans").where(F.size("spans") > 0)
    values = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))
    held = Written(marked.select(F.xxhash64("text").alias("text_key"), values.alias("values"), _free_words(F.col("text"), F.col("spans")).alias("words"))).df

    def joined(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(known) if known.count() <= limits.broadcast_rows else known, key)

    # Values and terms of too few texts are left out before they are paired.
    valued = Written(held.select("text_key", F.explode("values").alias("value")).groupBy("text_key", "value").agg(F.count("*").alias("n"))).df
    often = valued.groupBy("value").agg(F.count("*").alias("texts"), F.sum("n").alias("value_docs"))
    often = Written(often.where(F.col("texts") >= limits.support).select("value", "value_docs")).df
    frequent = Written(joined(valued, often, "value")).df
    words = held.join(frequent.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode("words").alias("term"))
    words = Written(words.groupBy("text_key", "term").agg(F.count("*").alias("copies"))).df
    near = words.groupBy("term").agg(F.count("*").alias("texts"), F.sum("copies").alias("docs")).where(F.col("texts") >= limits.support)
    spread = _words(texts).groupBy("term").agg(F.count("*").alias("term_docs"))
    # A term's share with one value is at most that with any, so terms below it there are below it everywhere.
    likely = spread.join(near, "term").where(F.col("docs") / F.col("term_docs") >= limits.share).select("term", "term_docs")
    pairs = joined(words, Written(likely).df, "term").join(frequent, "text_key")
    together = pairs.groupBy("value", "term", "value_docs", "term_docs").agg(F.count("*").alias("texts"), F.sum("n").alias("both"))
    total = texts.count()
    bits = F.log2(F.col("both") * F.lit(total) / (F.col("term_docs") * F.col("value_docs")))
    most = F.log2(F.lit(total) / F.col("value_docs"))
    share = F.col("both") / F.col("term_docs")
    enough = (F.col("texts") >= limits.support) & (F.col("texts") * bits >= limits.support * limits.bits)
    scored = together.where(enough & (bits >= limits.part * most) & (share >= limits.share))
    return scored.groupBy("term").agg((F.max(share) >= limits.removal).alias("removed"))


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\p{L}\p{N}])", r"\\$1")


def find(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """Adds ``spans``: base spans by kind and start, then spans of revealing terms.

    Terms that touch a base span are left to it.
    """
    return _found(docs, limits).select(*[F.col(f"_doc_{c}").alias(c) for c in docs.columns if c != "spans"], "spans")


def _found(docs: DataFrame, limits: Disclosure) -> DataFrame:
    """The columns as ``_doc_``..., ``text``, ``spans`` and ``removed_terms``, the terms to be removed."""
    terms = Written(revealing_terms(docs, limits))
    few = terms.df.count() <= limits.broadcast_rows
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.md5(text).alias("text_key"), "text")
    where = _words(keyed, "text_key").join(F.broadcast(terms.df) if few else terms.df, "term")
    per_text = where.groupBy("text_key").agg(
        F.array_join(F.reverse(F.array_sort(F.collect_set(_quoted(F.col("term"))))), "|").alias("alternatives"),
        F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("removed_terms"),
    )
    flagged = Written(per_text.withColumnRenamed("text_key", "_key")).df
    terms.drop()
    n, size = flagged.agg(F.count("*"), F.coalesce(F.sum(F.length("alternatives")), F.lit(0))).first()
    out = docs.select(*[F.col(c).alias(f"_doc_{c}") for c in docs.columns], "text")
    if not n:
        return out.withColumns({"removed_terms": F.array().cast("array<string>"), "spans": base_spans(F.col("text"))})
    out = out.withColumn("_key", F.md5(text))
    out = out.join(F.broadcast(flagged), "_key", "left") if n <= limits.broadcast_rows and size <= limits.broadcast_chars else looked_up(out, flagged, "_key")
    pattern = F.concat(
        F.lit(r"(?<![^\x20\x09-\x0D])(?:"), F.coalesce("alternatives", F.lit("(?!)")), F.lit(r")(?![^\x20\x09-\x0D])")
    )
    out = out.withColumn("_base", base_spans(F.col("text")))
    found = F.when(F.col("alternatives").isNull(), S.no_spans()).otherwise(S.find(text, pattern, TERM))
    free = F.filter(found, lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.withColumn("spans", F.concat("_base", free))


def sanitise(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """The documents with personal data replaced by ``[EMAIL]`` and the like.

    Revealing terms become ``[TERM]``, or go when they are to be removed. ``n_chars``, if there
    is one, is counted anew. Null texts stay null.
    """
    found = _found(docs, limits)
    kept = F.transform(
        "spans",
        lambda s: s.withField("kind", F.when((s["kind"] == TERM) & F.array_contains("removed_terms", s["value"]), "gone").otherwise(s["kind"])),
    )
    shown = F.create_map(*[x for k in (*KINDS, TERM) for x in (F.lit(k), F.lit(f"[{k.upper()}]"))])
    out = found.withColumn("_text", F.when(F.col("text").isNotNull(), S.masked(F.col("text"), kept, shown)))
    changed = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"_doc_{c}").alias(c) for c in docs.columns])


def digest_row(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: its counts, a digest of its base spans, and all its spans."""
    found = find(docs.select("doc_id", "text"), limits)
    counts = {f"n_{k}": S.count(F.col("spans"), k) for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return found.select(
        "doc_id",
        *[c.alias(name) for name, c in counts.items()],
        S.digest(S.listed(base)).alias("base_sha256"),
        S.listed(F.col("spans")).alias("spans"),
        S.count(F.col("spans"), TERM).alias("n_term"),
    )
