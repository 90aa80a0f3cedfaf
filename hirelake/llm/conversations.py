"""Repair of conversation structure: cheapest edits per role/fault signature, solved once per shared suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import cut

SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a. Which role's initial leads where.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one of user and assistant that each state takes next.
DUE = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
LONG = 2**63 - 1

#: Per grammar state the cost to go, the first edit of the least audit, and the state after it.
Node = tuple[tuple[int, str, int], ...]
END: Node = ((0, "", 0), (2 * INSERT, "I", 2), (INSERT, "I", 3), (0, "", 3))


def node_of(letter: str, child: Node) -> Node:
    """The automaton's node for ``letter`` before the suffix of ``child``.

    Every edit of a state has an initial of its own, so the least (cost, initial) has the least audit.
    Two inserted rows lead back to the same state: one insert before a row's own edit is enough but for
    the start and after s, which may need u and then a.
    """
    stays, extra = letter != "D", TRUNCATED * letter.isupper()
    own = []
    for q in range(4):
        ways = [(DELETE + child[q][0], "D", q)]
        if stays:
            due = STEP[q][DUE[q]]
            ways.append((REROLE + extra + child[due][0], "R", due))
            if (to := STEP[q].get(letter.lower())) is not None:
                ways.append((extra + child[to][0], "K", to))
        own.append(min(ways))
    after_u, after_a = min(own[2], (INSERT + own[3][0], "I", 3)), min(own[3], (INSERT + own[2][0], "I", 2))
    first = [min(own[q], (INSERT + after_u[0], "I", 2)) for q in (0, 1)]
    return (*first, after_u, after_a)


class SuffixAutomaton:
    """Solves signatures that come in the order of their reversed letters.

    A node stands for a suffix and is registered from the end. In this order all signatures with a
    suffix follow one another, so a node is made once, and only the nodes of the last signature are kept.
    """

    def __init__(self) -> None:
        self.word, self.path, self.made = "", [END], 0

    def solve(self, signature: str) -> tuple[int, str]:
        """The least cost and, of its audits, the least."""
        word = signature[::-1]
        shared = 0
        while shared < min(len(word), len(self.word)) and word[shared] == self.word[shared]:
            shared += 1
        del self.path[shared + 1 :]
        for letter in word[shared:]:
            self.path.append(node_of(letter, self.path[-1]))
        self.made += len(word) - shared
        self.word = word
        at, state, audit = len(word), 0, []
        while True:
            _, edit, following = self.path[at][state]
            if not edit:
                return self.path[-1][0][0], "".join(audit)
            audit.append(edit)
            at, state = at - (edit != "I"), following


class Repaired:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, 0, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def _given(self, text: str) -> None:
        due = DUE[self.state]
        self._add(ROLES[due], text)
        self.state = STEP[self.state][due]

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._given("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._add(role, text)
            self.state = STEP[self.state][role[0]]
        elif edit == "R":
            self._given(text)

    def hexdigest(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """The given fault of each row: ``fault`` 0 drops it; copies tells how often it stands there."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    return plain.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _letter(role: Column, text: Column) -> Column:
    """D for a row that must go, else the role's initial (x for others), as a capital if the text is truncated."""
    bare = F.rtrim(text, F.lit(SPACES))
    initial = F.substring(role, 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(bare == "", "D").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Each conversation whole and in order in one partition; sorting spills, nothing is gathered."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def _by_conversation(batches: Iterator[pa.RecordBatch], begin: Callable, add: Callable, end: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Folds each conversation's rows, which follow one another, into one row."""
    state, now, first = None, None, True
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first or row[0] != now:
                if not first:
                    done.append(end(now, state))
                now, state, first = row[0], begin(), False
            state = add(state, row)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=_schema(names))
    if not first:
        yield pa.RecordBatch.from_pylist([dict(zip(names, end(now, state), strict=True))], schema=_schema(names))


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal"]
TEXTS = ("signature", "audit", "repaired_sha256")


def _schema(names: list[str]) -> pa.Schema:
    return pa.schema([(n, pa.string() if n in TEXTS else pa.int64()) for n in names])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"{n} {'string' if n in TEXTS else 'long'}" for n in names)


class Signature:
    """The signature and the counts of one conversation."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.counts = dict.fromkeys(FIGURES, 0)
        self.low = self.high = None
        self.turns = 0
        self.last: str | None = None

    def add(self, turn: int | None, initial: str, letter: str, copies: int, is_first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.counts["illegal"] += copies - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.last = initial
        once = letter if is_first else "D"
        self.letters.append(once + "D" * (copies - 1))
        if letter == "D":
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - is_first
            self.counts["truncated"] += once.isupper() and is_first

    def row(self, conv_id: int | None) -> tuple:
        if self.turns:
            self.counts["gaps"] = min(LONG, self.high - self.low + 1 - self.turns)
        return (conv_id, "".join(self.letters), *self.counts.values())


def signatures(damaged: DataFrame) -> DataFrame:
    """(conv_id, signature, counts) of every conversation, also of those that lost all rows.

    Equal rows of a turn are counted together, and the first turn of a text is an aggregate of its own,
    both summed before the shuffle; texts are told apart by SHA-256 and don't travel here.
    """
    there = F.col("copies") > 0
    light = damaged.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.unhex(F.sha2("text", 256))).alias("digest"), F.when(there, _letter(F.col("role"), F.col("text"))).alias("letter"), "copies"
    )
    rows = light.groupBy("conv_id", "turn", "role", "digest", "letter").agg(F.sum("copies").alias("copies"))
    first = light.where(there).groupBy(F.col("conv_id").alias("of"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    known = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fields = known.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "letter", "copies", F.coalesce(F.col("turn").eqNullSafe(F.col("first.turn")), F.lit(False)).alias("is_first"))
    ordered = _in_order(fields, F.asc_nulls_first("turn"), F.col("role"), F.col("digest")).select("conv_id", "turn", "initial", "letter", "copies", "is_first")
    names = ["conv_id", "signature", *FIGURES]

    def add(state: Signature, row: tuple) -> Signature:
        state.add(*row[1:])
        return state

    return ordered.mapInArrow(lambda batches: _by_conversation(batches, Signature, add, lambda conv_id, s: s.row(conv_id), names), _ddl(names))


def solved(words: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature; those with a common end are neighbours."""
    backwards = F.reverse("signature")
    ordered = words.select("signature").distinct().repartitionByRange(backwards).sortWithinPartitions(backwards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            found = [(s, *automaton.solve(s)) for s in batch.column(0).to_pylist()]
            if found:
                s, cost, audit = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["signature", "cost", "audit"])

    return ordered.mapInArrow(run, "signature string, cost long, audit string")


def repair_conversations(conversations: DataFrame, damaging: Callable[[DataFrame], DataFrame] = damage) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``damaging`` gives conv_id, turn, role, text and copies of each row (0 copies: the row is gone).
    Rows are taken by turn, nulls first; rows of one turn by role, then SHA-256 of the text; equal rows
    stand together. A null role or text is one space, an empty role is like any unknown one, a null conv_id
    is a conversation of its own. Each
    conversation becomes a signature of one letter a row; equal signatures are solved once, and in a
    partition equal ends of signatures too. A conversation of no rows has zeros, no audit and the digest
    of the empty text. Other columns are ignored; an empty table gives an empty result.
    A conversation's rows stream through one task in sorted order, as a digest of all its text must; what
    is held is a letter a row (the length of its audit), never its texts.
    """
    rows = damaging(conversations)
    known = cut(signatures(rows), "signatures")
    head = known.join(solved(known), "signature").select("conv_id", *FIGURES, "cost", "audit")
    none = lambda kind: F.lit(None).cast(kind)
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies", *(none("long").alias(c) for c in (*FIGURES, "cost")), none("string").alias("audit"))
    top = head.select("conv_id", F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), none("long").alias("copies"), *FIGURES, "cost", "audit")
    ordered = _in_order(top.unionByName(body), F.col("part"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")).select("conv_id", "role", "text", "copies", *FIGURES, "cost", "audit")
    names = ["conv_id", *FIGURES, "cost", "audit", "repaired_sha256"]

    def add(state: tuple | None, row: tuple) -> tuple:
        _, role, text, copies, *figures = row
        if state is None:
            return (figures, Repaired(figures[-1]))
        for _ in range(copies):
            state[1].row(role, text)
        return state

    return ordered.mapInArrow(lambda batches: _by_conversation(batches, lambda: None, add, lambda conv_id, s: (conv_id, *s[0], s[1].hexdigest()), names), _ddl(names))
