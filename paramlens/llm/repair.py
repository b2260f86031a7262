"""Conversations repaired to alternate between user and assistant, at the least cost.

Each row's role and first fault are one letter of its conversation's signature. Every distinct
signature is solved once, by recursion on (row, state) with its costs remembered, and the audit
that comes out, one letter an edit, is joined back to the conversations and replayed on their rows.

Faults: blank (nothing but white space), duplicate (role and text seen earlier), truncated (the last
character that isn't white space is none of ``. ! ?``). Edits: Keep costs 0, Rerole to user or
assistant 3, Delete 4 and is required for blanks and duplicates, Insert an empty user or assistant
row 3; a truncated row that stays adds 3. Initials of the roles that result are ``(s?(ua)+)?``.

Nothing gathers a conversation's texts. Rows are sorted by ranges of (conversation, turn), so that a
long conversation is spread over tasks that make a piece of its signature each; equal rows are counted
before they are shuffled. Signatures, one byte a row, are what meets. Replaying streams over sorted
rows in batches, with the audit ahead of its rows: ``repair`` and ``digest_row`` read a conversation's
rows in one task in order, as a hash of all of its text asks for, but hold one batch of them.

Null roles and texts are one space, and so blank. Null turns come first; rows of one turn go by a hash
of role and text, so equal ones are adjacent. Rows of a null conversation id make one conversation. Texts
are handled whole. Repeated rows are duplicates. Of audits that cost the same the least in ASCII
order counts. Gaps that a long can't hold are null. Empty tables give empty ones. Other columns are left out,
whatever they are called.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, looked_up

#: Letters of a signature: rows of system, user, assistant and other roles that are sound, truncated, blank and duplicate.
LETTERS = ("suax", "SUAX", "0123", "4567")
INITIALS = str.maketrans("".join(LETTERS), "suax" * 4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_BLANKS = " \t\n\x0b\x0c\r"
#: States: at the start, after system, after user, after assistant. What a kept row of each role leads to, and an added one.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ADDED = (2, 2, 3, 2)
_DONE = (0, 3)
#: Signatures longer than this are joined back without a broadcast.
SHORT = 512
_NEVER = 1 << 60


class _Costs:
    """The least cost of finishing a signature from any row and state."""

    def __init__(self, signature: str):
        self.letters, self.roles = signature, signature.translate(INITIALS)
        self.known = array("q", [-1]) * (4 * len(signature) + 4)
        for i in range(len(signature), -1, -100):  # later rows first, which bounds the depth of recursion
            for state in range(4):
                self.best(i, state)

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next state) of what can become of row i."""
        letter = self.letters[i]
        yield "D", DELETE, state
        if letter in LETTERS[0] or letter in LETTERS[1]:
            more = TRUNCATED if letter in LETTERS[1] else 0
            after = _KEPT[state].get(self.roles[i])
            if after is not None:
                yield "K", KEEP + more, after
            yield "R", REROLE + more, _ADDED[state]

    def _without_insert(self, i: int, state: int) -> int:
        if i == len(self.letters):
            return 0 if state in _DONE else _NEVER
        return min(cost + self.best(i + 1, after) for _, cost, after in self.edits(i, state))

    def best(self, i: int, state: int) -> int:
        at = 4 * i + state
        if self.known[at] < 0:
            # A third insert in a row leads back to where the first did.
            one = _ADDED[state]
            states = ((state, 0), (one, INSERT), (_ADDED[one], 2 * INSERT))
            self.known[at] = min(cost + self._without_insert(i, after) for after, cost in states)
        return self.known[at]

    def audit(self) -> str:
        """The least in ASCII order of the cheapest audits; a shorter one is less than what it begins."""
        out, i, state, left = [], 0, 0, self.best(0, 0)
        while i < len(self.letters) or left:
            ways = [(edit, cost, i + 1, after) for edit, cost, after in self.edits(i, state)] if i < len(self.letters) else []
            ways.append(("I", INSERT, i, _ADDED[state]))
            edit, cost, i, state = min(w for w in ways if w[1] + self.best(w[2], w[3]) == left)
            left -= cost
            out.append(edit)
        return "".join(out)


def solve(signature: str) -> tuple[int, int, int, int, int, str]:
    """Blank, duplicate and truncated rows, illegal neighbours, least cost and audit of a signature."""
    costs = _Costs(signature)
    blank, duplicate, truncated = (sum(map(signature.count, letters)) for letters in (LETTERS[2], LETTERS[3], LETTERS[1]))
    pairs = zip(costs.roles, costs.roles[1:], strict=False)
    illegal = sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in pairs)
    return blank, duplicate, truncated, illegal, costs.best(0, 0), costs.audit()


def _plain(conversations: DataFrame) -> DataFrame:
    """The four columns, nulls of role and text as one space."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with a hash of role and text, and how many copies of each there are."""
    rows = rows if "_copies" in rows.columns else rows.withColumn("_copies", F.lit(1))
    return rows.withColumn("_key", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece of signature for each conversation of a sorted partition, with where it begins."""
    names = ("conv_id", "turn", "_key", "letter", "again", "n", "seen")
    kinds = None
    begun, parts = None, []

    def piece() -> pa.RecordBatch:
        values = (*begun, "".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "turn", "_key", "piece"])

    for batch in batches:
        kinds = [*(batch.schema.field(c).type for c in names[:3]), pa.string()]
        for conv, turn, key, letter, again, n, seen in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if begun is None or conv != begun[0]:
                if begun is not None:
                    yield piece()
                begun, parts = (conv, turn, key), []
            parts.append(again * n if seen else letter + again * (n - 1))
    if begun is not None:
        yield piece()


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of every conversation; one whose rows are all dropped has an empty signature."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    initial = F.substring("role", 1, 1)
    column = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    letter = lambda fault: F.substring(F.lit(LETTERS[fault]), column, F.lit(1))
    blank = bare == ""
    first = F.when(blank, letter(2)).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), letter(0)).otherwise(letter(1))
    slim = _keyed(rows).select("conv_id", "turn", "_key", "_copies", first.alias("letter"), F.when(blank, letter(2)).otherwise(letter(3)).alias("again"))
    counted = slim.groupBy("conv_id", "turn", "_key").agg(F.sum("_copies").cast("int").alias("n"), F.first("letter").alias("letter"), F.first("again").alias("again"))
    some = counted.where(F.col("n") > 0)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    starts = some.groupBy("conv_id", "_key").agg(F.min(order).alias("start"))
    held = some.alias("a").join(starts.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a._key") == F.col("b._key")))
    seen = held.select("a.conv_id", "a.turn", "a._key", "letter", "again", "n", (~F.col("a.turn").eqNullSafe(F.col("start.turn"))).alias("seen"))
    of_key = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", of_key), T.StructField("turn", T.LongType()), T.StructField("_key", T.BinaryType()), T.StructField("piece", T.StringType())])
    pieces = seen.repartitionByRange("conv_id", "turn", "_key").sortWithinPartitions("conv_id", "turn", "_key").mapInArrow(_pieces, schema)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "_key", "piece"))), lambda x: x["piece"]), "")
    whole = pieces.groupBy("conv_id").agg(joined.alias("signature"))
    turn = F.when(F.col("n") > 0, F.col("turn"))
    turns = counted.groupBy("conv_id", turn.alias("turn")).agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    gaps = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("try_add(try_subtract(try_subtract(hi, lo), n), 1L)"))
    both = turns.alias("a").join(whole.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    return both.select("a.conv_id", F.coalesce("signature", F.lit("")).alias("signature"), gaps.alias("gaps"))


_SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SOLVED.split(", ")]
    for batch in batches:
        found = [(s, *solve(s)) for s in batch.column("signature").to_pylist()]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds], names=names)


def _audits(rows: DataFrame) -> DataFrame:
    signed = Written(signatures(rows)).df
    known = Written(signed.select("signature").distinct().mapInArrow(_solved, _SOLVED)).df
    short = F.length("signature") <= SHORT
    near = looked_up(signed.where(short), known.where(short), "signature")
    far = signed.where(~short).join(known.where(~short), "signature").select(*near.columns)
    return near.unionByName(far).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation."""
    return _audits(_plain(conversations))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str | None, str | None]]:
    """(conv_id, edit, role, text) for every edit, ("B", None, None) at each beginning, from sorted rows with the audit ahead."""
    conv, audit, at, state = None, "", 0, 0

    def inserts() -> Iterator[tuple[object, str, str, str]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, _ADDED[state]
            yield conv, "I", "assistant" if state == 3 else "user", ""

    for batch in batches:
        for key, given, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "_copies")), strict=True):
            if given is not None:
                yield from inserts()
                conv, audit, at, state = key, given, 0, 0
                yield conv, "B", None, None
                continue
            for _ in range(n):
                yield from inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEPT[state][role[0]]
                elif edit == "R":
                    state = _ADDED[state]
                    role = "assistant" if state == 3 else "user"
                yield conv, edit, role, text
    yield from inserts()


def _ordered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in order, each conversation's audit ahead of them, a conversation in one partition."""
    keyed = _keyed(rows).where(F.col("_copies") > 0)
    head = found.select("conv_id", "audit")
    both = keyed.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "_key", "role", "text", "_copies").unionByName(head, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "_key").select("conv_id", "audit", "role", "text", "_copies")


def _gathered(batches: Iterator[pa.RecordBatch], kind: pa.DataType, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], names: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of some hundred rows."""
    held, kinds = [], {"conv_id": kind} | names

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for row in made(batches):
        held.append(row)
        if len(held) == 500:
            yield batch()
            held = []
    if held:
        yield batch()


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at = 0
    for conv, edit, role, text in _replayed(batches):
        if edit == "B":
            at = 0
        elif edit != "D":
            yield conv, at, edit, role, text
            at += 1


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    of, sha, between = None, None, b""
    for conv, edit, role, text in _replayed(batches):
        if edit == "B":
            if sha is not None:
                yield of, sha.hexdigest()
            of, sha, between = conv, hashlib.sha256(), b""
        elif edit != "D":
            sha.update(between + f"{role}:{text}".encode("utf-8", "replace"))
            between = b"\n"
    if sha is not None:
        yield of, sha.hexdigest()


def _streamed(rows: DataFrame, found: DataFrame, made, names: dict[str, pa.DataType], kinds: str) -> DataFrame:
    of_key = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", of_key), *T.StructType.fromDDL(kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        return _gathered(batches, to_arrow_type(of_key), made, names)

    return _ordered(rows, found).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations; positions count from 0, edits are K, R and I."""
    rows = _plain(conversations)
    names = {"position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    return _streamed(rows, _audits(rows), _positions, names, "position long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of which a hash of conversation and turn drops, empties, cuts or reroles some; ``_copies`` is 0 for dropped and 2 for repeated ones."""
    rows = _plain(conversations)
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat_ws(":", *named)) % 20
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(way == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("_copies"))


def digest_row(conversations: DataFrame) -> DataFrame:
    """One row per conversation, damaged first: faults, cost, audit, and a hash of what the replayed edits make of it."""
    rows = damaged(conversations)
    found = Written(_audits(rows)).df
    hashes = _streamed(rows, found, _hashes, {"repaired_sha256": pa.string()}, "repaired_sha256 string")
    both = found.alias("a").join(hashes.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")))
    return both.select("a.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
