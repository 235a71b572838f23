"""Repair of conversations: cheapest edits by a weighted automaton that is made deterministic while it is used."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut

#: Rows and characters of a chunk, at most; a longer text has a chunk of its own.
ROWS, CHARS = 4096, 4 << 20
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_WHITE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}
#: First faults of a row; codes of rows are four times the number of their role's initial, plus the fault.
_FINE, _BLANK, _DUPLICATE, _CUT = range(4)
_INITIALS = {"s": 0, "u": 1, "a": 2}
#: What has been written so far: nothing, a system turn, a user's turn last, an assistant's turn last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state that an inserted or rerole'd turn leads to.
_WRITES = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_NEVER = 1 << 40

_LINE = "struct<role:string,text:string>"
_PACKED = f"""conv_id long, chunk long, edge boolean, codes binary, lines array<{_LINE}>, firsts array<struct<place:int,digest:binary>>,
    turns struct<least:long,most:long,first:long,last:long,distinct:long>, illegal long, initials array<string>"""
_PIECE = """conv_id long, chunk long, turns struct<least:long,most:long,first:long,last:long,distinct:long>, initials array<string>,
    blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<edit:string,role:string,text:string>>"""
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arcs(state: int, code: int) -> Iterator[tuple[str, int, int]]:
    """The edits (letter, next state, cost) of a row, in ASCII order of their letters."""
    initial, fault = divmod(code, 4)
    yield "D", state, DELETE
    if fault in (_BLANK, _DUPLICATE):
        return
    more = TRUNCATED if fault == _CUT else 0
    if initial == 0 and state == _START:
        yield "K", _SYSTEM, more
    if initial == 1 and state != _USER:
        yield "K", _USER, more
    if initial == 2 and state == _USER:
        yield "K", _ASSISTANT, more
    yield "R", _WRITES[state], REROLE + more


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to go if turns may be inserted first; three in a row only lead back."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_WRITES[p]]) for p, c in enumerate(costs)]
    return [min(c, _NEVER) for c in costs]


class Determinised:
    """States are vectors of costs to go, one for each state of the weighted automaton, less the least of them.

    Rows are read from the last to the first.  As any state can go on like any other for a few edits more, the vectors'
    entries stay near each other, and there are few vectors; each is made when it is first met, and so are the
    transitions between them and the moves of the trace, which all later rows find in tables.
    """

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.next: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.ends: dict[tuple[int, int], tuple[str, int]] = {}

    def state(self, costs: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and what its entries are less."""
        least = min(costs)
        vector = tuple(c - least if c < _NEVER else _NEVER for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.next.append([None] * 16)
        return self.number[vector], least

    def step(self, state: int, code: int) -> tuple[int, int]:
        after = self.vectors[state]
        own = [min(cost + after[q] for _, q, cost in _arcs(p, code)) for p in range(4)]
        self.next[state][code] = found = self.state(_with_inserts(own))
        return found

    def scan(self, codes: bytes, end: int) -> tuple[list[int], int]:
        """The states before each row and at the end, and what their entries at the first one are less."""
        states, total, now = [end], 0, end
        for code in reversed(codes):
            now, least = self.next[now][code] or self.step(now, code)
            total += least
            states.append(now)
        states.reverse()
        return states, total

    def move(self, after: int, code: int, p: int) -> tuple[str, int]:
        """From ``p`` before a row, the letters of its tight arcs up to the row's own, and where they lead; of several
        tight arcs the first letter in ASCII order."""
        key = (after, code, p)
        if key not in self.moves:
            there, less = self.next[after][code]
            here, then = [c + less for c in self.vectors[there]], self.vectors[after]
            letters = ""
            while True:
                tight = [(letter, q) for letter, q, cost in _arcs(p, code) if cost + then[q] == here[p]]
                if INSERT + here[_WRITES[p]] == here[p] and (not tight or tight[0][0] > "I"):
                    letters, p = letters + "I", _WRITES[p]
                else:
                    letters, p = letters + tight[0][0], tight[0][1]
                    break
            self.moves[key] = letters, p
        return self.moves[key]

    def trace(self, codes: bytes, states: list[int], p: int) -> tuple[list[str], int]:
        """Back along the scan, from the first row to the last: each row's letters, and the state at the end."""
        out = []
        for i, code in enumerate(codes):
            letters, p = self.move(states[i + 1], code, p)
            out.append(letters)
        return out, p


#: Costs to go when all rows have been read: nothing or whole exchanges may have been written.
END = tuple(_with_inserts([0, _NEVER, _NEVER, 0]))


@lru_cache(1)
def _table() -> Determinised:
    """One for each Python worker."""
    return Determinised()


def last_inserts(p: int) -> str:
    """What is inserted after the last row."""
    return "" if p in (_START, _ASSISTANT) else "I" + last_inserts(_WRITES[p])


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(role.encode() + b"\0" + text.encode(), digest_size=16).digest()


def _code(role: str, text: str, seen: bool) -> int:
    end = text.rstrip(_WHITE)[-1:]
    fault = _BLANK if not end else _DUPLICATE if seen else _CUT if end not in ".!?" else _FINE
    return 4 * _INITIALS.get(role[:1], 3) + fault


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, kinds)


def _packed(batches: Iterator[pa.RecordBatch], kinds: pa.Schema, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Chunks of one conversation each, of a partition whose rows come in order.  ``edge`` marks those of conversations
    that may have others: of the first and the last one of a partition, and of one that is cut."""
    part, number = TaskContext.get().partitionId(), 0
    name, held, size, opened, first = None, [], 0, False, True  # opened: earlier chunks of the conversation are here

    def chunk(edge: bool) -> pa.RecordBatch:
        nonlocal number
        seen: set[tuple[str, str]] = set()
        codes, firsts = bytearray(), []
        for i, (_, role, text) in enumerate(held):
            codes.append(_code(role, text, (role, text) in seen))
            if edge and codes[-1] % 4 in (_FINE, _CUT):
                firsts.append({"place": i, "digest": _digest(role, text)})
            seen.add((role, text))
        turns = [t for t, _, _ in held]
        some = [t for t in turns if t is not None]
        initials = [role[:1] for _, role, _ in held]
        row = {
            "conv_id": name, "chunk": part << 32 | number, "edge": edge, "codes": bytes(codes), "lines": [{"role": r, "text": t} for _, r, t in held], "firsts": firsts,
            "turns": {"least": min(some, default=None), "most": max(some, default=None), "first": turns[0], "last": turns[-1], "distinct": len(set(some))},
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), "initials": [initials[0], initials[-1]],
        }
        number += 1
        return _batch([row], kinds)

    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != name:
                yield chunk(first or opened)
                held, size, opened, first = [], 0, False, False
            elif held and (len(held) == rows or size + len(text) > chars):
                yield chunk(True)
                held, size, opened = [], 0, True
            name = conv
            held.append((turn, role, text))
            size += len(text)
    if held:
        yield chunk(True)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's codes with what earlier chunks have seen, and its costs from each state to each."""
    table = _table()
    for batch in batches:
        codes, costs = [], []
        for raw, late in zip(batch.column("codes").to_pylist(), batch.column("late").to_pylist(), strict=True):
            own = bytearray(raw)
            for i in late or []:
                own[i] = own[i] // 4 * 4 + _DUPLICATE
            codes.append(bytes(own))
            cost = []
            for q in range(4):
                end, _ = table.state([0 if p == q else _NEVER for p in range(4)])
                states, total = table.scan(codes[-1], end)
                cost.append([min(c + total, _NEVER) if c < _NEVER else _NEVER for c in table.vectors[states[0]]])
            costs.append([c for column in cost for c in column])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(codes, pa.binary()), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "chunk", "codes", "costs"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs to go behind each chunk, of chunks that come from the last of a conversation to its first."""
    name, to_go, begun = None, END, False
    for batch in batches:
        out = []
        for conv, costs in zip(batch.column("conv_id").to_pylist(), batch.column("costs").to_pylist(), strict=True):
            if not begun or conv != name:
                name, to_go, begun = conv, END, True
            out.append(list(to_go))
            to_go = [min(costs[4 * q + p] + to_go[q] for q in range(4)) for p in range(4)]
            to_go = [c - min(to_go) for c in to_go]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.list_(pa.int64()))], ["chunk", "to_go"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind each chunk, for each state before it."""
    table = _table()
    for batch in batches:
        out = []
        for codes, to_go in zip(batch.column("codes").to_pylist(), batch.column("to_go").to_pylist(), strict=True):
            states, _ = table.scan(codes, table.state(to_go)[0])
            out.append([table.trace(codes, states, p)[1] for p in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "chunk", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk, and whether it is its conversation's last, of chunks that come in order: as the next
    row tells that, each is given one late."""
    name, waiting, p = None, None, _START
    for batch in batches:
        out = []
        for conv, chunk, exits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "exits")), strict=True):
            goes_on = waiting is not None and conv == name
            if waiting is not None:
                out.append(waiting | {"last": not goes_on})
            entry = p if goes_on else _START
            name, waiting, p = conv, {"chunk": chunk, "entry": entry}, exits[entry]
        yield _batch(out, _ENTRY)
    if waiting is not None:
        yield _batch([waiting | {"last": True}], _ENTRY)


_ENTRY = pa.schema([("chunk", pa.int64()), ("entry", pa.int32()), ("last", pa.bool_())])


def _solved(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk from its ``entry``, and its repaired turns."""
    table = _table()
    for batch in batches:
        for row in batch.to_pylist():
            codes, end = row.pop("codes"), row.pop("to_go")
            lines, entry, last = row.pop("lines"), row.pop("entry"), row.pop("last")
            after, less = table.state(end)
            states, total = table.scan(codes, after)
            edits, leaves = table.trace(codes, states, entry)
            cost = table.vectors[states[0]][entry] + total - table.vectors[after][leaves]
            if last:
                more = last_inserts(leaves)
                edits, cost = [*edits, more], cost + INSERT * len(more)
            repaired, p = [], entry
            for i, letters in enumerate(edits):
                for letter in letters:
                    if letter == "D":
                        continue
                    line = {"role": "", "text": ""} if letter == "I" else lines[i]
                    # What is kept says itself where it leads; what is written anew goes by the state.
                    p = (_SYSTEM, _USER, _ASSISTANT)[_INITIALS[line["role"][:1]]] if letter == "K" else _WRITES[p]
                    repaired.append({"edit": letter, "role": line["role"] if letter == "K" else _ROLES[p], "text": line["text"]})
            faults = [c % 4 for c in codes]
            yield _batch([row | {"blank": faults.count(_BLANK), "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_CUT), "cost": cost, "audit": "".join(edits), "repaired": repaired}], kinds)


def _arrow(spark, ddl: str) -> pa.Schema:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair_conversations(turns: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """Pieces of the repaired conversations of ``turns`` (conv_id, turn, role, text), one or more for each conversation.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the first 64 characters of their texts, then by
    MD5 of these, so that only equal rows tie.  Null roles and texts read as empty, rows with a null conv_id are one
    conversation, repeated rows are duplicates, other columns are not read, and an empty table gives no pieces.

    A row's first fault counts: blank, duplicate (role and text came before), truncated (the last letter ends no
    sentence).  Of all edits that lead to a system turn or none and then users and assistants by turns, the cheapest are
    taken, of several the one whose letters (D delete, I insert, K keep, R rerole) come first.  A piece has conv_id,
    ``chunk`` (its order), ``turns`` (bounds and number of turns), ``initials`` (of its first and last role), counts of
    ``blank``, ``duplicate``, ``truncated`` and ``illegal`` neighbours inside it, ``cost``, ``audit`` (letters) and
    ``repaired`` (edit, role, text) in order; ``edge`` says that its conversation may have others.

    Rows are sorted by ranges of conversation, turn and place, so a conversation of any size is spread over tasks, and cut
    into chunks that a row can hold.  Nearly all conversations are one chunk, which is solved where it lies.  Of the others,
    repeats of earlier chunks are found by digests; a chunk gives its costs from each state to each (16 numbers), one run
    over these from the last chunk gives the costs to go behind each, and one from the first the state before each; both
    runs hold one vector in memory.  Then each chunk is solved on its own.  Equal rows, however many, are spread too.
    """
    spark = turns.sparkSession
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), F.md5("text"), "at"]
    laid = own.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")
    packed = cut(laid.mapInArrow(partial(_packed, kinds=_arrow(spark, _PACKED), rows=rows, chars=chars), _PACKED), "chunks")
    whole = packed.filter("not edge").withColumn("to_go", F.array(*map(F.lit, END))).withColumn("entry", F.lit(_START)).withColumn("last", F.lit(True)).drop("firsts")
    # Conversations at edges: what earlier chunks have seen, then costs, ends and entries of chunks.
    edges = packed.filter("edge")
    seen = edges.select("conv_id", "chunk", F.explode("firsts").alias("f")).select("conv_id", "chunk", "f.*")
    again = seen.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("chunk"))).filter("n > 1")
    late = again.groupBy("chunk").agg(F.collect_list("place").alias("late"))
    codes = edges.select("conv_id", "chunk", "codes").join(late, "chunk", "left")
    costs = cut(codes.mapInArrow(_matrices, "conv_id long, chunk long, codes binary, costs array<long>"), "costs")
    to_go = costs.select("conv_id", "chunk", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk")).mapInArrow(_ends, "chunk long, to_go array<long>")
    ended = cut(costs.select("conv_id", "chunk", "codes").join(to_go, "chunk"), "ended")
    exits = ended.mapInArrow(_exits, "conv_id long, chunk long, exits array<int>")
    entries = exits.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_entries, "chunk long, entry int, last boolean")
    known = ended.drop("conv_id").join(entries, "chunk")
    met = edges.drop("codes", "firsts").join(known, "chunk")
    solved = [df.drop("edge").mapInArrow(partial(_solved, kinds=_arrow(spark, _PIECE)), _PIECE).withColumn("edge", F.lit(edge)) for df, edge in ((whole, False), (met, True))]
    return solved[0].union(solved[1])


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, edit, role, text): the turns of repaired conversations, in order by chunk and place."""
    return pieces.select("conv_id", "chunk", F.posexplode("repaired").alias("place", "r")).select("conv_id", "chunk", "place", "r.*")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, whose pieces follow each other; texts are hashed as they come."""
    kinds = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now: dict | None = None
    hashed, least, most, distinct, last, initial, audit, begun = hashlib.sha256(), None, None, 0, None, "", [], False

    def told() -> dict:
        return now | {"gaps": 0 if least is None else most - least + 1 - distinct, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = row["turns"]
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(told())
                now = {"conv_id": row["conv_id"]} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                hashed, least, most, distinct, last, initial, audit, begun = hashlib.sha256(), None, None, 0, None, None, [], False
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += row[c]
            now["illegal"] += initial is not None and initial + row["initials"][0] not in _LEGAL
            # Turns come in order, so a chunk shares one at most with the chunk before it.
            distinct += turns["distinct"] - (last is not None and turns["first"] == last)
            least, most = (f([x for x in (a, b) if x is not None], default=None) for f, a, b in ((min, least, turns["least"]), (max, most, turns["most"])))
            last, initial = turns["last"], row["initials"][1]
            audit.append(row["audit"])
            for r in row["repaired"]:
                hashed.update(("\n" * begun + f"{r['role']}:{r['text']}").encode())
                begun = True
        yield _batch([{k: r[k] for k in kinds.names} for r in out], kinds)
    if now is not None:
        yield _batch([told()], kinds)


def summarise_repairs(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the pieces of
    ``repair_conversations``: one row for each conversation, counts as there, ``gaps`` the turns that are missing between
    the least and the greatest, and the digest of ``role:text`` of all repaired turns, joined by line feeds.

    Conversations of one piece are summed where they lie; pieces of others meet in one task for each conversation, which
    hashes them in order and holds one at a time, and the letters of the audit."""
    whole = pieces.filter("not edge")
    edges = pieces.filter("edge").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return whole.mapInArrow(_summed, _SUMMARY).union(edges.mapInArrow(_summed, _SUMMARY))
