"""Repair of the turn structure of conversations, with the cheapest audit of edits.

A repaired conversation has roles whose initials match ``(s?(ua)+)?``. Keep costs
0, Rerole to user or assistant 3, Delete 4, Insert of a message without text 3;
blank and repeated messages must be deleted, and a truncated one that stays costs
3 more. Of the cheapest audits the one that is least in ASCII is taken.

The audit is found by dynamic programming over the four states of the pattern
(:class:`Audits`). Edit prefixes are linked nodes that share their ancestors; ties
compare by a search for the longest common prefix over binary-lifting ancestors and
rolling hashes, and an equal hash is verified before it is believed.

Spark sorts the messages in ranges of conversation and turn and writes them once. A
conversation that one task reads whole is repaired there. Those at the edges of a
task's rows, and those of more than ``MOST_ROWS`` messages or ``MOST_CHARS``
characters, go by way of segments: repeated messages are found by an aggregation,
each segment of up to ``SEGMENT`` messages yields its best audit from every state to
every state, and the segments of a conversation are joined in order. So a
conversation may hold any share of all rows. Only its audit and its digest, which
are values of one row by nature, pass through one task, as a stream.

Unusual rows. A null role or text counts as one blank; null turns come first and are
left out of gaps; rows with a null id form a conversation. Messages of one turn are
taken in the order of a digest of role and text. Empty texts are blank. Very long
texts stay in the rows and are never in a group. Repeated rows are duplicates of the
first. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import salted_join
from scrubline.staging import stage

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
SEGMENT_BITS = 8
SEGMENT = 1 << SEGMENT_BITS
MOST_ROWS, MOST_CHARS = 4096, 16 << 20
MOST_BROADCAST = 32 << 20  # characters of the ids of cut conversations
INFINITE = 1 << 60

# States: nothing yet, after the system's, the user's and the assistant's message.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
AFTER_KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = (USER, USER, ASSISTANT, USER)  # where a message of the fitting role leads from each state
ROLE = {USER: "user", ASSISTANT: "assistant"}
PROPER = {"su", "ua", "au"}

BASE, MODULUS = 911382323, (1 << 61) - 1
_SPACE = " \t\n\x0b\x0c\r"


class Audits:
    """Edit prefixes as linked nodes, compared without writing them out."""

    def __init__(self):
        self.parent, self.label, self.size, self.hash = [0], [""], [0], [0]
        self.ups: list[list[int]] = [[]]
        self.steps = [0]

    def add(self, node: int, label: str) -> int:
        """The prefix ``node`` followed by ``label``."""
        if not label:
            return node
        h = self.hash[node]
        for c in label:
            h = (h * BASE + ord(c)) % MODULUS
        ups, at, k = [node], node, 0
        while k < len(self.ups[at]):
            at = self.ups[at][k]
            ups.append(at)
            k += 1
        self.parent.append(node)
        self.label.append(label)
        self.size.append(self.size[node] + len(label))
        self.hash.append(h)
        self.ups.append(ups)
        self.steps.append(self.steps[node] + 1)
        return len(self.parent) - 1

    def tail(self, node: int, root: int = 0) -> str:
        """The text of ``node`` behind its ancestor ``root``."""
        parts = []
        while node != root:
            parts.append(self.label[node])
            node = self.parent[node]
        return "".join(reversed(parts))

    def _up(self, node: int, steps: int) -> int:
        """The ancestor that stands ``steps`` from the root."""
        while self.steps[node] > steps:
            gap = self.steps[node] - steps
            node = self.ups[node][gap.bit_length() - 1]
        return node

    def less(self, a: int, more_a: str, b: int, more_b: str) -> bool:
        """Whether prefix ``a`` followed by ``more_a`` is before ``b`` followed by ``more_b``."""
        steps = min(self.steps[a], self.steps[b])
        x, y = self._up(a, steps), self._up(b, steps)
        if not self._alike(x, y):
            for k in range(len(self.ups[x]) - 1, -1, -1):
                if k < len(self.ups[x]) and not self._alike(self.ups[x][k], self.ups[y][k]):
                    x, y = self.ups[x][k], self.ups[y][k]
            x, y = self.parent[x], self.parent[y]
        if x != y and not self._same(x, y):
            x = y = 0
        return self.tail(a, x) + more_a < self.tail(b, y) + more_b

    def _alike(self, x: int, y: int) -> bool:
        return x == y or (self.hash[x] == self.hash[y] and self.size[x] == self.size[y])

    def _same(self, x: int, y: int) -> bool:
        """Whether two prefixes of equal hash are equal, label by label up to a common ancestor."""
        while x != y:
            if self.label[x] != self.label[y]:
                return self.tail(x) == self.tail(y)
            x, y = self.parent[x], self.parent[y]
        return True


class Table:
    """The cheapest audits that lead to each state."""

    def __init__(self, start: int = NOTHING):
        self.audits = Audits()
        self.cost = [INFINITE] * 4
        self.node = [0] * 4
        self.cost[start] = 0

    def _better(self, best: tuple | None, cost: int, state: int, label: str) -> tuple:
        """The better of a candidate and ``best``, each ``(cost, node, label)``."""
        if best is None or cost < best[0] or (cost == best[0] and self.audits.less(self.node[state], label, best[1], best[2])):
            return cost, self.node[state], label
        return best

    def insert(self) -> None:
        """Insertions at this place; two in a row reach every state that more would."""
        for _ in range(2):
            for to in (USER, ASSISTANT):
                best = None if self.cost[to] >= INFINITE else (self.cost[to], self.node[to], "")
                for state in STATES:
                    if NEXT[state] == to and self.cost[state] < INFINITE and self.cost[state] + COST[INSERT] <= (best[0] if best else INFINITE):
                        best = self._better(best, self.cost[state] + COST[INSERT], state, INSERT)
                if best and best[2]:
                    self.cost[to], self.node[to] = best[0], self.audits.add(best[1], INSERT)

    def _move(self, edges: Iterable[tuple[int, int, int, str]]) -> None:
        best: list[tuple | None] = [None] * 4
        for state, to, cost, label in edges:
            if self.cost[state] < INFINITE:
                best[to] = self._better(best[to], self.cost[state] + cost, state, label)
        self.cost = [b[0] if b else INFINITE for b in best]
        self.node = [self.audits.add(b[1], b[2]) if b else 0 for b in best]

    def message(self, initial: str, fault: int) -> None:
        """One more message, with insertions before it."""
        self.insert()
        edges = [(s, s, COST[DELETE], DELETE) for s in STATES]
        if fault in (GOOD, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            keeps = AFTER_KEEP.get(initial, {})
            for s in STATES:
                if s in keeps:
                    edges.append((s, keeps[s], COST[KEEP] + extra, KEEP))
                # also where Keep fits: Rerole costs more and leads to the same state unless that is SYSTEM
                if keeps.get(s) != NEXT[s]:
                    edges.append((s, NEXT[s], COST[REROLE] + extra, REROLE))
        self._move(edges)

    def segment(self, edges: list[dict]) -> None:
        """The messages of a segment, given as its best audits between states."""
        self._move((e["from"], e["to"], e["cost"], e["edits"]) for e in edges)

    def end(self) -> tuple[int, int]:
        """``(state, cost)`` at the end of the conversation."""
        self.insert()
        a, b = NOTHING, ASSISTANT
        if self.cost[a] != self.cost[b]:
            best = a if self.cost[a] < self.cost[b] else b
        else:
            best = a if self.audits.less(self.node[a], "", self.node[b], "") else b
        return best, self.cost[best]


@dataclass
class Figures:
    """Counts over consecutive messages; two stretches in a row add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None

    def add(self, initial: str, fault: int, turn: int | None) -> None:
        self.join(Figures(int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED), 0, int(turn is not None), initial, initial, turn, turn))

    def join(self, other: Figures) -> None:
        """Add the figures of the messages that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.first is None:
            self.first = other.first
        elif other.first is not None and self.last + other.first not in PROPER:
            self.illegal += 1
        if other.last is not None:
            self.last = other.last
        if other.low is not None:
            # turns ascend, so only the turn at the seam can be counted twice
            self.turns -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def replay(edits: str, messages: Iterable, state: int = NOTHING) -> Iterator[tuple[str | None, str, object]]:
    """``(role, edit, message)`` for every edit; a kept message has role None, an inserted one no message."""
    rows = iter(messages)
    for edit in edits:
        message = None if edit == INSERT else next(rows)
        if edit == DELETE:
            yield None, edit, message
            continue
        state = AFTER_KEEP[message[0][:1]][state] if edit == KEEP else NEXT[state]
        yield (None if edit == KEEP else ROLE[state]), edit, message


# ── damage ──


def damage(conversations: DataFrame) -> DataFrame:
    """The messages with faults put in, chosen by a checksum of conversation and turn.

    One of twenty is dropped, emptied, stripped of its sentence ends, repeated
    beside itself, or given the role user. Null roles and texts become one blank.
    """
    blank = F.lit(" ")
    cid, turn = F.col("conv_id"), F.col("turn")
    pick = F.crc32(F.concat(F.coalesce(cid.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    rows = conversations.select(cid, turn, F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), pick.alias("pick")).where(F.col("pick") != 0)
    text = F.when(F.col("pick") == 1, F.lit("")).when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("pick") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# ── the operator ──

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MESSAGES = "array<struct<role:string,text:string>>"
_STATS = "struct<blank:long,duplicate:long,truncated:long,illegal:long,turns:long,first:string,last:string,low:long,high:long>"
_STATS_TYPE = pa.struct([(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns")] + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
_EDGE_TYPE = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("cost", pa.int64()), ("edits", pa.string())]))


def own_fault(text: str) -> int:
    """The fault that a text has by itself."""
    last = text.rstrip(_SPACE)[-1:]
    return BLANK if not last else GOOD if last in ".!?" else TRUNCATED


def _fault(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(_SPACE)), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), GOOD).otherwise(TRUNCATED)


def _sorted(messages: DataFrame) -> DataFrame:
    """The messages in the order of conversation and turn, in ranges, with their place ``rid``; written once."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = F.lit(" ")
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat("role", F.lit(":"), "text"), 256)).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "_tie")]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    return stage(ranged.withColumn("rid", F.monotonically_increasing_id()), "messages")


@dataclass
class _Open:
    """A conversation as its rows come."""

    key: object
    edge: bool
    rows: list[tuple[str, str, int | None]] = field(default_factory=list)
    seen: set = field(default_factory=set)
    table: Table = field(default_factory=Table)
    figures: Figures = field(default_factory=Figures)
    chars: int = 0
    large: bool = False

    def add(self, role: str, text: str, turn: int | None, digest: str) -> None:
        self.chars += len(text)
        if self.large or self.edge or len(self.rows) >= MOST_ROWS or self.chars > MOST_CHARS:
            self.large, self.rows, self.seen = True, [], set()
            return
        fault = own_fault(text)
        if fault != BLANK and digest in self.seen:
            fault = DUPLICATE
        self.seen.add(digest)
        self.rows.append((role, text, turn))
        self.figures.add(role[:1], fault, turn)
        self.table.message(role[:1], fault)

    def result(self, with_messages: bool) -> dict:
        if self.large:
            return {"conv_id": self.key, "whole": False}
        state, cost = self.table.end()
        audit = self.table.audits.tail(self.table.node[state])
        out = [(role or m[0], m[1] if m else "") for role, edit, m in replay(audit, self.rows) if edit != DELETE]
        f = self.figures
        return {
            "conv_id": self.key, "whole": True, "gaps": f.gaps(), "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated,
            "illegal": f.illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode("utf-8", "surrogatepass")).hexdigest(),
            "messages": [{"role": r, "text": t} for r, t in out] if with_messages else None,
        }


def _local(rows: DataFrame, with_messages: bool) -> DataFrame:
    """Results of the conversations that lie within a task's rows; the others by id, with ``whole`` false."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, whole boolean, " + ", ".join(f"{c} long" for c in FIGURES) + f", audit string, repaired_sha256 string, messages {MESSAGES}"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        now, previous, out = None, None, []
        for batch in batches:
            if arrow is None:
                texts = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("whole", pa.bool_())] + [(c, pa.int64()) for c in FIGURES] + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("messages", texts)])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "rid")]
            for key, turn, role, text, digest, rid in zip(*columns):
                broken = previous is None or rid != previous + 1
                if now is None or broken or key != now.key:
                    if now is not None:
                        now.large = now.large or broken
                        out.append(now.result(with_messages))
                    now = _Open(key, broken)
                now.add(role, text, turn, digest)
                previous = rid
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        if now is not None:
            now.large = True
            yield pa.RecordBatch.from_pylist([now.result(with_messages)], arrow)

    return rows.select("conv_id", "turn", "role", "text", "digest", "rid").mapInArrow(repair, schema)


def _segments(rows: DataFrame, kind: str) -> DataFrame:
    """Best audits between all states over up to ``SEGMENT`` messages in a row, and their counts."""

    def between(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        messages = list(zip(*[table.column(c).to_pylist() for c in ("initial", "fault", "turn")]))
        figures = Figures()
        for m in messages:
            figures.add(*m)
        edges = []
        for start in STATES:
            best = Table(start)
            for initial, fault, _ in messages:
                best.message(initial, fault)
            edges += [{"from": start, "to": s, "cost": best.cost[s], "edits": best.audits.tail(best.node[s])} for s in STATES if best.cost[s] < INFINITE]
        return pa.table({
            "conv_id": table.column("conv_id").slice(0, 1), "first_rid": pa.array([table.column("rid")[0].as_py()], pa.int64()),
            "edges": pa.array([edges], _EDGE_TYPE), "initials": pa.array(["".join(m[0] or "\0" for m in messages)]), "stats": pa.array([vars(figures)], _STATS_TYPE),
        })

    lean = rows.select("conv_id", "rid", "turn", "fault", F.substring("role", 1, 1).alias("initial"))
    schema = f"conv_id {kind}, first_rid long, edges array<struct<from:long,to:long,cost:long,edits:string>>, initials string, stats {_STATS}"
    return lean.groupBy("conv_id", F.shiftright("rid", SEGMENT_BITS)).applyInArrow(between, schema)


def _chained(segments: DataFrame, kind: str) -> DataFrame:
    """A conversation's segments joined in order.

    One row of figures and audit per conversation (``rid`` null), and one for each
    of its messages: the roles to insert before it, its edit, and its new role.
    The messages' rows come in slices.
    """
    schema = f"conv_id {kind}, rid long, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, lead string, edit string, new_role string"
    columns = ["conv_id", "first_rid", "edges", "initials", "stats"]

    def finish(key, parts: list[tuple], table: Table, figures: Figures) -> Iterator[dict]:
        state, cost = table.end()
        nodes, at = [], table.node[state]
        audit = table.audits.tail(at)
        while at:
            nodes.append(table.audits.label[at])
            at = table.audits.parent[at]
        labels = list(reversed(nodes))
        tail_inserts = "".join(labels[len(parts):])
        yield {"conv_id": key, "gaps": figures.gaps(), **{c: getattr(figures, c) for c in FIGURES[1:5]}, "cost": cost, "audit": audit}
        state = NOTHING
        for (first, initials), edits in zip(parts, labels):
            lead, k = [], 0
            for role, edit, message in replay(edits, ((i,) for i in initials), state):
                if edit == INSERT:
                    lead.append(role)
                    state = NEXT[state]
                    continue
                yield {"conv_id": key, "rid": first + k, "lead": ",".join(lead), "edit": edit, "new_role": role}
                lead, k = [], k + 1
                if edit != DELETE:
                    state = AFTER_KEEP[message[0]][state] if edit == KEEP else NEXT[state]
        lead = []
        for _ in tail_inserts:
            state = NEXT[state]
            lead.append(ROLE[state])
        if lead:
            yield {"conv_id": key, "rid": INFINITE, "lead": ",".join(lead), "edit": DELETE}

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, now = None, None
        for batch in batches:
            arrow = arrow or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("rid", pa.int64())] + [(c, pa.int64()) for c in FIGURES] + [(c, pa.string()) for c in ("audit", "lead", "edit", "new_role")])
            for key, first, edges, initials, stats in zip(*[batch.column(c).to_pylist() for c in columns]):
                if now is None or now[0] != key:
                    if now is not None:
                        yield from _sliced(finish(*now), arrow)
                    now = (key, [], Table(), Figures())
                now[1].append((first, initials))
                now[2].segment(edges)
                now[3].join(Figures(**stats))
        if now is not None:
            yield from _sliced(finish(*now), arrow)

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.select(*columns).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "first_rid").mapInArrow(chain, schema)


def _sliced(rows: Iterator[dict], arrow: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == most:
            yield pa.RecordBatch.from_pylist(part, arrow)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, arrow)


def _digests(pieces: DataFrame, kind: str) -> DataFrame:
    """SHA-256 of each conversation's pieces, newline-joined, fed piece by piece in their order."""

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, started, key, state = None, False, None, None
        for batch in batches:
            arrow = arrow or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            done = []
            for cid, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").cast(pa.binary()).to_pylist()):
                if not started or cid != key:
                    if started:
                        done.append({"conv_id": key, "repaired_sha256": state.hexdigest()})
                    started, key, state = True, cid, hashlib.sha256(piece)
                else:
                    state.update(b"\n")
                    state.update(piece)
            yield pa.RecordBatch.from_pylist(done, arrow)
        if started:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "repaired_sha256": state.hexdigest()}], arrow)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = pieces.select("conv_id", "rid", "nth", "piece").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "rid", "nth")
    return in_order.select("conv_id", "piece").mapInArrow(feed, f"conv_id {kind}, repaired_sha256 string")


@dataclass
class Repair:
    """``audit``: one row per conversation. ``messages``: the repaired messages in their order, if asked for."""

    audit: DataFrame
    messages: DataFrame | None


def repair(messages: DataFrame, with_messages: bool = False) -> Repair:
    """Audit and repair every conversation of ``messages`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``audit`` holds gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. ``messages`` holds conv_id, place (ascending, with gaps), role and text.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    rows = _sorted(messages)
    local = stage(_local(rows, with_messages), "local-repairs")
    # at most two edges per task, and conversations beyond a fixed size
    key = [F.col("conv_id").isNull().alias("_null"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key")]
    rest = stage(local.where(~F.col("whole")).select(*key).distinct(), "cut-ids")
    size = rest.agg(F.sum(F.length("_key") + 16)).first()[0] or 0
    keyed = rows.select("*", *key)
    if size <= MOST_BROADCAST:
        cut = keyed.join(F.broadcast(rest), ["_null", "_key"], "left_semi")
    else:
        cut = salted_join(keyed, rest, ["_null", "_key"], ["rid"], "left_semi")
    cut = cut.withColumn("own", _fault(F.col("text")))
    firsts = cut.groupBy("conv_id", "digest").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    # every message joins by its own place, so a message that recurs is not a hot key
    faults = cut.join(firsts, "rid", "left").withColumn("fault", F.when((F.col("own") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("own")))
    faults = stage(faults.select("conv_id", "rid", "turn", "role", "text", "fault"), "cut-messages")
    chained = stage(_chained(_segments(faults, kind), kind), "cut-edits")
    edits = chained.where(F.col("rid").isNotNull()).select(F.col("conv_id").alias("_id"), "rid", "lead", "edit", "new_role")
    # the last insertions have no message of their own
    joined = edits.join(faults.select("rid", "role", "text"), "rid", "left")
    lead = F.transform(F.filter(F.split("lead", ","), lambda r: r != ""), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit") != DELETE, F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast(MESSAGES))
    pieces = joined.select(F.col("_id").alias("conv_id"), "rid", F.posexplode(F.concat(lead, own)).alias("nth", "message"))
    digests = _digests(pieces.withColumn("piece", F.concat("message.role", F.lit(":"), "message.text")), kind)
    figures = chained.where(F.col("rid").isNull()).select("conv_id", *FIGURES, "audit")
    digests = digests.withColumnRenamed("conv_id", "_id")
    far = figures.join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    far = far.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    near = local.where("whole")
    audit = near.select(*far.columns).unionByName(far)
    if not with_messages:
        return Repair(audit, None)
    near = near.select("conv_id", F.posexplode("messages").alias("nth", "message"), F.lit(0).cast("long").alias("rid"))
    every = near.unionByName(pieces.select("conv_id", "nth", "message", "rid"))
    return Repair(audit, every.select("conv_id", F.struct("rid", "nth").alias("place"), "message.role", "message.text"))


def audit(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The audit of every id in ``conversations``, also of those without messages."""
    known = repair(messages).audit
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(known, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES]
    return out.select(F.col("_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
