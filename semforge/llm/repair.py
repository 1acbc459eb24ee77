"""Conversation structure repair: weighted finite-state composition.

A conversation is an input acceptor, a chain of one arc for each row. The edit transducer keeps, re-roles, deletes or inserts rows; the
grammar acceptor takes the role initials ``(s?(ua)+)?``. Their composition is never built: its states are (rows read, inserts since, state
of the grammar), expanded one row at a time from the end, which is the reverse topological order. Weights are (cost, labels) with the
lexicographic minimum as sum; labels are put before those of the rest, so the minimum of the whole is the minimum of its parts.

A row of a conversation matters to its repair by one symbol only. Sorted rows are cut into segments of bounded length, each reduced in
its task to sixteen weights, one for every grammar state before and after it; the segments of a conversation are then composed like rows.
A conversation of any length is thus spread over tasks. Its text is hashed as it streams by in order, as SHA-256 asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, partitions

#: What may follow in each state of the grammar, and where it ends. Fixed by the contract, like the costs.
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"
#: Rows of a segment.
SEGMENT = 1024
_NEVER = (1 << 60, "")
#: Symbol of a row that must go; other rows are the initial of their role (o: no role of the grammar), in capitals if truncated.
MUST_GO = "x"

Weight = tuple[int, str]


def _made(state: int) -> tuple[str, int]:
    """The one initial that an insert or a new role can have in this state, and the next state."""
    return next((initial, to) for initial, to in GRAMMAR[state].items() if initial in ROLES)


def _before(label: str, cost: int, weight: Weight) -> Weight:
    return (cost + weight[0], label + weight[1]) if weight[0] < _NEVER[0] else _NEVER


def _inserting(weights: list[Weight]) -> list[Weight]:
    """Up to two inserts before what is there: a third would come back to a state that cost less."""
    once = [min(w, _before("I", INSERT, weights[_made(q)[1]])) for q, w in enumerate(weights)]
    return [min(w, _before("I", INSERT, once[_made(q)[1]])) for q, w in enumerate(weights)]


def _row(symbol: str, after: list[Weight]) -> list[Weight]:
    """Weights before a row, from those after it."""
    initial, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    found = []
    for state, arcs in enumerate(GRAMMAR):
        options = [_before("D", DELETE, after[state])]
        if symbol != MUST_GO:
            options.append(_before("R", REROLE + more, after[_made(state)[1]]))
            if initial in arcs:
                options.append(_before("K", KEEP + more, after[arcs[initial]]))
        found.append(min(options))
    return _inserting(found)


@lru_cache(maxsize=1 << 15)
def _segment(symbols: str) -> tuple[tuple[Weight, ...], ...]:
    """For each state after the symbols, the weights from each state before them. Inserts stand before the row that follows them."""
    found = []
    for end in range(len(GRAMMAR)):
        weights = [(0, "") if q == end else _NEVER for q in range(len(GRAMMAR))]
        for symbol in reversed(symbols):
            weights = _row(symbol, weights)
        found.append(tuple(weights))
    return tuple(found)


def _at_end() -> list[Weight]:
    return _inserting([(0, "") if q in FINAL else _NEVER for q in range(len(GRAMMAR))])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) as the contract damages them; nulls of role and text are one space."""
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % 20).where(F.col("damage") != 0)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("damage") == 4, "user").otherwise(role)
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _digest() -> F.Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, initial, fault, n): equal rows of one turn once, with their number and the first one's fault."""
    end = F.expr("trim(TRAILING ' \\t\\n\\x0b\\f\\r' FROM text)".replace("\\x0b", "\x0b").replace("\\f", "\x0c"))
    rows = rows.select("conv", "turn", "role", _digest().alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    same = rows.groupBy("conv", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n"))
    # Null turns come first: a struct keeps them in the minimum.
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = same.groupBy(F.coalesce("conv", F.lit(0)).alias("c"), F.col("conv").isNull().alias("none"), F.col("digest").alias("g")).agg(F.min(at).alias("first"))
    joined = same.join(first, (F.coalesce("conv", F.lit(0)) == F.col("c")) & (F.col("conv").isNull() == F.col("none")) & (F.col("digest") == F.col("g")))
    fault = F.when(F.col("blank"), "blank").when(F.col("first") != at, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return joined.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")


_SEGMENTS = "conv long, part int, number long, first string, last string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, labels array<string>"
_LEGAL = frozenset(("su", "ua", "au"))


class _Open:
    """A segment as it fills."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.first, self.last = conv, [], None, None
        self.first_turn = self.last_turn = None
        self.counts = {"turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
            self.counts["turns"] += 1
        if fault:
            self.counts[fault] += 1
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append(MUST_GO if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)

    def row(self, part: int, number: int) -> dict:
        weights = [w for column in _segment("".join(self.symbols)) for w in column]
        return {"conv": self.conv, "part": part, "number": number, "first": self.first, "last": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn, **self.counts, "costs": [w[0] for w in weights], "labels": [w[1] for w in weights]}


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _segments(symbols: DataFrame, rows: int) -> DataFrame:
    schema = _arrow_schema(symbols.sparkSession, _SEGMENTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, number = None, [], 0
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("part", "conv", "turn", "initial", "fault", "n")]
            for part, conv, turn, initial, fault, n in zip(*columns, strict=True):
                for k in range(n):
                    if held is None or held.conv != conv or len(held.symbols) >= rows:
                        if held is not None:
                            done.append(held.row(part, number))
                            number += 1
                        held = _Open(conv)
                    held.add(turn, initial, fault if not k or fault == "blank" else "duplicate")
                    if len(done) >= 256:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done = []
        if held is not None:
            done.append(held.row(part, number))
            yield pa.RecordBatch.from_pylist(done, schema)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = symbols.repartitionByRange(partitions(symbols), *order).sortWithinPartitions(*order)
    return arrow_map(ordered.select(F.spark_partition_id().alias("part"), "conv", "turn", "initial", "fault", "n"), cut, _SEGMENTS)


_REPAIRS = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _composed(segments: DataFrame) -> DataFrame:
    """The repair of each conversation, its segments read from the last to the first."""
    schema = _arrow_schema(segments.sparkSession, _REPAIRS)

    class Found:
        def __init__(self, conv: int | None):
            self.conv, self.next, self.turns = conv, None, [None, None, 0]
            self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            #: Cost from each state on, and the labels as linked pieces.
            self.weights = [(cost, (labels, None)) for cost, labels in _at_end()]

        def add(self, x: dict) -> None:
            for name in self.counts:
                self.counts[name] += x[name]
            if self.next is not None and x["last"] + self.next not in _LEGAL:
                self.counts["illegal"] += 1
            self.next = x["first"]
            if x["turns"]:
                low, high, turns = self.turns
                self.turns = [x["first_turn"], x["last_turn"] if high is None else high, turns + x["turns"] - (low == x["last_turn"])]
            states, weights = range(len(GRAMMAR)), []
            for q in states:
                # Pieces of equal total cost differ before either ends: both read all rows of the segment.
                cost, labels, end = min((x["costs"][e * len(GRAMMAR) + q] + self.weights[e][0], x["labels"][e * len(GRAMMAR) + q], e) for e in states)
                weights.append((cost, (labels, self.weights[end][1])))
            self.weights = weights

        def row(self) -> dict:
            low, high, turns = self.turns
            cost, piece = self.weights[0]
            pieces = []
            while piece is not None:
                pieces.append(piece[0])
                piece = piece[1]
            return {"conv": self.conv, "gaps": high - low + 1 - turns if turns else 0, **self.counts, "cost": cost, "audit": "".join(pieces)}

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if held is None or held.conv != x["conv"]:
                    if held is not None:
                        done.append(held.row())
                    held = Found(x["conv"])
                if x["part"] >= 0:
                    held.add(x)
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([*done, held.row()], schema)

    return arrow_map(segments.repartition(partitions(segments), "conv").sortWithinPartitions("conv", F.desc("part"), F.desc("number")), compose, _REPAIRS)


class _Text:
    """The repaired conversation's hash, fed row by row with the edits that the audit names."""

    def __init__(self, x: dict):
        self.repair, self.state, self.at, self.any, self.hash = x, 0, 0, False, hashlib.sha256()

    def _put(self, role: str, text: str, to: int) -> None:
        self.hash.update(("\n" * self.any + role + ":").encode())
        self.hash.update(text.encode())
        self.state, self.any = to, True

    def _inserts(self) -> None:
        audit = self.repair["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            initial, to = _made(self.state)
            self._put(ROLES[initial], "", to)
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._inserts()
        label = self.repair["audit"][self.at]
        self.at += 1
        if label == "K":
            self._put(role, text, GRAMMAR[self.state][role[:1]])
        elif label == "R":
            initial, to = _made(self.state)
            self._put(ROLES[initial], text, to)

    def row(self) -> dict:
        self._inserts()
        x = self.repair
        return {"conv_id": x["conv"], **{k: x[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}, "repaired_sha256": self.hash.hexdigest()}


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repairs(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, turn, role, text) to the cheapest repair of each ``conv``: the ``damage`` of the contract is not applied here.

    Rows go by turn, nulls first; rows of one turn by role and the digest of role and text, so that repeated rows are neighbours. An empty
    role has no initial and can't be kept. Segments hold ``segment`` rows at most.
    """
    return _composed(_segments(_symbols(rows), segment))


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conv_id, null included: gaps, faults, cost, audit and hash of the damaged and repaired conversation.

    Ties, nulls and repeated rows: see ``repairs``. A conversation that lost all rows has zeros, no audit and the empty string's hash; an
    empty table has an empty result. Texts may be as long as Spark's strings; columns of other names play no part.
    """
    schema = _arrow_schema(conversations.sparkSession, _RESULT)
    source = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = damaged(source)
    nothing = source.select("conv").distinct().select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("number"))
    segments = _segments(_symbols(rows), segment).unionByName(nothing, allowMissingColumns=True)
    found = _composed(segments).withColumn("texts", F.lit(False))
    every = found.unionByName(rows.withColumns({"digest": _digest(), "texts": F.lit(True)}), allowMissingColumns=True)
    order = ["conv", "texts", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = every.repartition(partitions(every), "conv").sortWithinPartitions(*order).drop("digest", "turn")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for batch in batches:
            texts, role, text = (batch.column(x).to_pylist() for x in ("texts", "role", "text"))
            repair = batch.select(["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])
            for i, own in enumerate(texts):
                if own:
                    held.add(role[i], text[i])
                    continue
                if held is not None:
                    done.append(held.row())
                held = _Text(repair.slice(i, 1).to_pylist()[0])
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([*done, held.row()], schema)

    return arrow_map(dealt, rebuilt, _RESULT)
