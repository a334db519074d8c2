"""Conversation structure repair: cheapest edits with the audit that sorts first.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Rows are kept
(cost 0), given another role (1) or deleted (2, a must for blank and duplicate
rows), and empty rows may be inserted (5); a truncated row that stays adds 5.

The search goes over the rows in order and remembers, for each of the four places
in that pattern, the cheapest way there. The audits of these ways are linked nodes,
one letter each, that share their prefixes: a node has its ancestors at distances
1, 2, 4.. and a rolling hash of all letters up to it. Of two ways of equal cost the
longest common prefix is found by descending those ancestors where the hashes
differ; the letters after it decide. What the hashes call equal is walked back to
the node both share, so a collision costs time, not the result.

No way at a place can be a proper prefix of another of equal cost there (the rest
would be insertions, which cost), so the one that sorts first stays first whatever
follows. A way also carries the SHA-256 state of its repaired text: texts are read
once and not held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Places in the pattern: nothing yet, after the system's, the user's, the assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of some initial leads.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that must come next for a row given another role or an inserted one.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rolling hash of audits.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A8642


class Audits:
    """Strings that share prefixes. Node 0 is empty."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.letters, self.hashes, self.depths = [""], [0], [0]
        #: ancestors[node][j] is 2**j letters shorter, as far as there are letters.
        self.ancestors: list[list[int]] = [[]]

    def longer(self, node: int, letter: str) -> int:
        """The string of ``node`` with one more letter."""
        new = len(self.letters)
        self.letters.append(letter)
        self.hashes.append((self.hashes[node] * BASE + ord(letter)) % self.prime)
        self.depths.append(self.depths[node] + 1)
        up, j = [node], 0
        while j < len(self.ancestors[up[j]]):
            up.append(self.ancestors[up[j]][j])
            j += 1
        self.ancestors.append(up)
        return new

    def lifted(self, node: int, depth: int) -> int:
        """The prefix of ``node`` with ``depth`` letters."""
        above = self.depths[node] - depth
        while above:
            j = above.bit_length() - 1
            node, above = self.ancestors[node][j], above - (1 << j)
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` sorts before that of ``b``; a prefix sorts first."""
        least = min(self.depths[a], self.depths[b])
        x, y = self.lifted(a, least), self.lifted(b, least)
        # the last letters that surely differ: below them the hashes agree
        for j in reversed(range(least.bit_length())):
            if j < len(self.ancestors[x]):
                p, q = self.ancestors[x][j], self.ancestors[y][j]
                if self.hashes[p] != self.hashes[q]:
                    x, y = p, q
        first = None
        while x != y:  # one step, or back to the shared node where hashes only claim to agree
            if self.letters[x] != self.letters[y]:
                first = (self.letters[x], self.letters[y])
            x, y = self.ancestors[x][0], self.ancestors[y][0]
        if first is None:
            return self.depths[a] < self.depths[b]
        return first[0] < first[1]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ancestors[node][0]
        return "".join(reversed(out))


class Repair:
    """One conversation, row by row."""

    def __init__(self, prime: int = PRIME):
        self.audits = Audits(prime)
        #: place -> cost, audit, digest of the repaired rows, whether there are any
        self.ways: dict[int, tuple] = {START: (0, 0, hashlib.sha256(), False)}
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.least: int | None = None
        self.most: int | None = None
        self.turns = 0

    def _row(self, way: tuple, cost: int, letter: str, role: str | None, text: bytes = b"") -> tuple:
        """``way`` after one edit; a row of ``role`` joins the repaired ones, if given."""
        spent, audit, digest, any_rows = way
        if role is not None:
            digest = digest.copy()
            digest.update((b"\n" if any_rows else b"") + role.encode("utf-8", "surrogatepass") + b":" + text)
            any_rows = True
        return spent + cost, self.audits.longer(audit, letter), digest, any_rows

    def _offer(self, ways: dict, place: int, cost: int, make) -> None:
        """Keep the better of the way known at ``place`` and the one that ``make`` builds."""
        known = ways.get(place)
        if known is None or cost < known[0]:
            ways[place] = make()
        elif cost == known[0]:
            way = make()
            if self.audits.less(way[1], known[1]):
                ways[place] = way

    def _inserted(self) -> None:
        """Ways with an inserted row, and with a second one: a third would only go round."""
        for _ in range(2):
            for place, way in sorted(self.ways.items()):
                role, to = NEXT[place]
                self._offer(self.ways, to, way[0] + INSERT, lambda: self._row(way, INSERT, "I", role))

    def row(self, turn: int | None, role: str, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        said = data.rstrip(b" \t\n\x0b\x0c\r")
        key = hashlib.blake2b(b"%d:" % len(role) + role.encode("utf-8", "surrogatepass") + data, digest_size=16).digest()
        blank = not said
        duplicate = not blank and key in self.seen
        truncated = not blank and not duplicate and said[-1:] not in (b".", b"!", b"?")
        self.seen.add(key)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        if self.before is not None:
            self.illegal += (self.before, initial) not in LEGAL
        self.before = initial
        if turn is not None:  # turns ascend
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

        self._inserted()
        after: dict[int, tuple] = {}
        stays = TRUNCATED if truncated else 0
        for place, way in sorted(self.ways.items()):
            self._offer(after, place, way[0] + DELETE, lambda: self._row(way, DELETE, "D", None))
            if blank or duplicate:
                continue
            to = KEPT.get((place, initial))
            if to is not None:
                self._offer(after, to, way[0] + stays, lambda: self._row(way, stays, "K", role, data))
            other, to = NEXT[place]
            cost = RETYPE + stays
            self._offer(after, to, way[0] + cost, lambda: self._row(way, cost, "R", other, data))
        self.ways = after

    def result(self) -> tuple:
        self._inserted()
        ends: dict[int, tuple] = {}
        for place in (START, ASSISTANT):
            if place in self.ways:
                way = self.ways[place]
                self._offer(ends, 0, way[0], lambda: way)
        cost, audit, digest, _ = ends[0]
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audits.text(audit), digest.hexdigest()


#: Faults that ``damaged`` makes, by the key's checksum modulo FAULTS.
FAULTS, DROP, EMPTY, CUT, REPEAT, TO_USER = 20, 0, 1, 2, 3, 4


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, kept``: rows with the faults their key draws.

    A null role, text or part of the key ``conv_id:turn`` counts as one space. A
    dropped row stays, without role and text and with ``kept`` false, so that its
    conversation is known.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = rows.withColumn("fault", F.crc32(key.cast("binary")) % FAULTS)

    def at(fault: int) -> Column:
        return F.col("fault") == fault

    text = F.when(at(EMPTY), "").when(at(CUT), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = ~at(DROP)
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(kept, F.when(at(TO_USER), "user").otherwise(F.col("role"))).alias("role"),
        F.when(kept, text).alias("text"),
        kept.alias("kept"),
        F.when(at(REPEAT), 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def repaired(turns: DataFrame) -> DataFrame:
    """Per conversation: its faults, the cost and audit of the cheapest repair, the repaired text's hash.

    ``turns`` has ``conv_id, turn, role, text`` and may have ``kept``: a row with
    ``kept`` false only names its conversation. Other columns are ignored. Rows
    are taken by turn, nulls first, ties by role and text; a null role or text is
    empty here. Null ids are one conversation. A conversation without rows has
    zeros, an empty audit and the hash of an empty text; an empty table gives no
    rows.

    Rows of a conversation stream through one task in order, as its hash demands;
    held are only letters of its audit and 16 bytes a row to know duplicates by.
    """
    small_batches(turns.sparkSession)
    named = ["conv_id", "turn", "role", "text", "kept"]
    rows = turns if "kept" in turns.columns else turns.withColumn("kept", F.lit(True))
    rows = rows.select(*named).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, done = None, None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            columns = zip(*found) if found else [[]] * len(types)
            names = [c.split()[0] for c in REPAIRED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for conv, turn, role, text, kept in zip(*(batch.column(c).to_pylist() for c in named)):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append((open_id, *state.result()))
                    open_id, state = conv, Repair()
                if kept:
                    state.row(turn, role or "", text or "")
            if done:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([(open_id, *state.result())])

    return rows.mapInArrow(repair, REPAIRED)
