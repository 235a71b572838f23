"""Secrets in texts: fixed patterns, and credential formats inferred as probabilistic automata."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scratch import trimmed
from palimpsest.llm.words import text_bytes

ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "format")
#: Tokens that no fixed pattern labels: those with a digit, and words.
OTHERS = ("other", "word")
#: Bits a character from which on a token is a credential by its format; set by ``held_out_quality``.
LEAST_BITS = 1.0
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX, _TOKEN, _DIGIT, _ALPHA = (np.zeros(256, bool) for _ in range(4))
_HEX[list(b"0123456789abcdef")] = True
_DIGIT[list(b"0123456789")] = True
_ALPHA[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_TOKEN[list(b"+/_.=-")] = True
_TOKEN |= _DIGIT | _ALPHA
SYMBOLS = "0hzHZ+/_.=-"
#: A symbol for each byte: its kind of letter or digit, or itself.
_CLASS = {**{c: "0" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}}


_CODE = np.zeros(256, np.int64)
for _c in range(128):
    _CODE[_c] = max(0, SYMBOLS.find(_CLASS.get(chr(_c), chr(_c))))


def symbols(token: str) -> str:
    return "".join(_CLASS.get(c, c) for c in token)


class FormatAutomaton:
    """A probabilistic automaton: the prefix tree of the samples, its statistically compatible states merged.

    Two states are compatible if the frequencies of ending and of each next symbol differ by less than a Hoeffding
    bound at ``alpha``, and so do the states that they lead to.
    """

    def __init__(self, samples: list[str], alpha: float = 0.05) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.total = [0], [0]
        for sample in samples:
            at = 0
            for c in sample:
                self.total[at] += 1
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][c]
            self.total[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > most:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, k in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + k
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_states(self) -> None:
        kept = [0]
        fringe = [(0, c) for c in sorted(self.next[0])]
        while fringe:
            # The most visited state first, whose frequencies are the surest.
            fringe.sort(key=lambda e: (-self.total[self.next[e[0]][e[1]]], e))
            at, c = fringe.pop(0)
            state = self.next[at][c]
            if state in kept:
                continue
            match = next((k for k in kept if self._alike(k, state)), None)
            if match is None:
                kept.append(state)
            else:
                self.next[at][c] = match
                self._fold(match, state)
            inside = set(kept)
            fringe = [(k, s) for k in kept for s in sorted(self.next[k]) if self.next[k][s] not in inside]

    def table(self, floor: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next state and the log2 likelihood of each symbol in each state, and that of ending there; what a state
        has never shown has probability ``floor`` and leaves it where it is."""
        n = np.maximum(np.array(self.total, np.float64), 1)
        step = np.repeat(np.arange(len(self.next))[:, None], len(SYMBOLS), axis=1)
        shown = np.zeros(step.shape)
        for i, (to, count) in enumerate(zip(self.next, self.count, strict=True)):
            for c, state in to.items():
                step[i, SYMBOLS.index(c)] = state
            for c, k in count.items():
                shown[i, SYMBOLS.index(c)] = k
        return step, np.log2(np.maximum(shown / n[:, None], floor)), np.log2(np.maximum(np.array(self.ends) / n, floor))


def bits(table: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The log2 likelihood of each token raw[begin:end] under an automaton, all tokens in step."""
    step, shown, ends = table
    order = np.argsort(begin - end, kind="stable")
    size = (end - begin)[order]
    state, out = np.zeros(len(order), np.int64), np.zeros(len(order))
    n = len(order)
    for i in range(int(size[0]) if n else 0):
        while n and size[n - 1] <= i:
            n -= 1
        c = _CODE[raw[begin[order[:n]] + i]]
        out[:n] += shown[state[:n], c]
        state[:n] = step[state[:n], c]
    back = np.empty(len(order))
    back[order] = out + ends[state]
    return back


def _runs(mask: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of at least ``least`` bytes of ``mask``, which never cross the edges."""
    n = len(mask)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = edges[(edges > 0) & (edges < n)]
    begin[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return a[b - a >= least], b[b - a >= least]


@dataclass
class Scan:
    """Of a batch of texts: for each the spans (start, kind number, end) of the fixed patterns, and all tokens that reach
    beyond them, as bytes raw[begin:end] of text ``owner`` from code point ``start`` on."""

    spans: list[list[tuple[int, int, int]]]
    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    start: np.ndarray

    def token(self, i: int) -> str:
        return self.raw[self.begin[i] : self.end[i]].tobytes().decode()


def scan(column: pa.Array) -> Scan:
    raw, at = text_bytes(column)
    texts = len(at) - 1
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(texts)]
    none = np.empty(0, np.int64)
    if not len(raw):
        return Scan(spans, raw, none, none, none, none)
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    data = raw.tobytes()
    low = data.lower()

    def of(positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, positions, side="right") - 1

    def holding(data: bytes, *keys: bytes) -> list[int]:
        found = [m.start() for key in keys for m in re.finditer(key, data)]
        return np.unique(of(np.array(found, np.int64))).tolist()

    for d in holding(low, *_KEYS):
        for m in ASSIGN.finditer(data[at[d] : at[d + 1]].decode()):
            if len(m[2]) >= 12:
                spans[d].append((m.start(), 0, m.end()))
    for d in holding(data, b"AKIA"):
        for m in ACCESS.finditer(data[at[d] : at[d + 1]].decode()):
            if m.end() - m.start() >= 18:
                spans[d].append((m.start(), 1, m.end()))
    a, b = _runs(_HEX[raw], at, 16)
    for d, i, j in zip(of(a).tolist(), a.tolist(), b.tolist(), strict=True):
        spans[d].append((int(point[i] - point[at[d]]), 2, int(point[j] - point[at[d]])))
    a, b = _runs(_TOKEN[raw], at, 12)
    owner = of(a)
    start = point[a] - point[at[owner]]
    # A token goes if the fixed patterns cover all of it; one that they cover in part is scored whole.
    open_ = np.ones(len(a), bool)
    for i in np.flatnonzero(np.array([bool(spans[d]) for d in owner.tolist()], bool)).tolist():
        to, reach = int(start[i] + b[i] - a[i]), int(start[i])
        for s, _, e in sorted(spans[owner[i]]):
            reach = max(reach, e) if s <= reach else reach
        open_[i] = reach < to
    for found in spans:
        found.sort()
    return Scan(spans, raw, a[open_], b[open_], owner[open_], start[open_])


@trimmed
def _samples(batches: Iterator[pa.RecordBatch], most: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Labelled credentials and other tokens, those of least hash of each batch, which hold the least of all."""
    for whole in batches:
        kept: dict[str, dict[str, int]] = defaultdict(dict)
        for batch in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
            found = scan(batch.column(0))
            tokens = {found.token(i) for i in np.flatnonzero(found.end - found.begin <= longest).tolist()}
            values = [(OTHERS[not any(map(str.isdigit, t))], t) for t in tokens]
            for i, spans in enumerate(found.spans):
                text = batch.column(0)[i].as_py() if spans else ""
                for a, k, b in spans:
                    value = ASSIGN.match(text[a:b])[2] if k == 0 else text[a:b]
                    if len(value) <= longest:
                        values.append((KINDS[k], value))
            for kind, value in values:
                kept[kind][value] = int.from_bytes(blake2b(value.encode(), digest_size=7).digest())
        rows = [(k, v, h) for k, values in kept.items() for v, h in sorted(values.items(), key=lambda x: x[1])[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "value", "h"])


def labelled(docs: DataFrame, sample: int = 400, longest: int = 256) -> DataFrame:
    """(kind, value, h): of each kind that the fixed patterns label in ``docs``, and of other tokens, the ``sample``
    distinct values of least hash among those of at most ``longest`` characters, however the table is partitioned."""
    rows = docs.select("text").mapInArrow(partial(_samples, most=sample, longest=longest), "kind string, value string, h long").distinct()
    least = Window.partitionBy("kind").orderBy("h", "value")
    return rows.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= sample).drop("r")


def inferred(values: list[tuple[str, str]], alpha: float = 0.05) -> dict[str, FormatAutomaton]:
    """An automaton for each kind of (kind, value); words and other tokens count in capitals and capitalised too."""
    grouped = defaultdict(list)
    for kind, value in values:
        forms = (value, value.upper(), value.capitalize()) if kind in OTHERS else (value,)
        grouped[kind].extend(map(symbols, forms))
    return {kind: FormatAutomaton(sorted(v), alpha) for kind, v in sorted(grouped.items())}


def fit_formats(docs: DataFrame, sample: int = 400, alpha: float = 0.05, longest: int = 256) -> dict[str, FormatAutomaton]:
    """An automaton for each kind of credential that the fixed patterns label in ``docs``, and one for
    words and one for other tokens.

    Each is inferred from the bounded sample of ``labelled``, which one pass over the texts gathers; kinds without
    samples have none.
    """
    return inferred([(r.kind, r.value) for r in labelled(docs, sample, longest).collect()], alpha)


class _Likeness:
    """What the best credential automaton explains of tokens above those of other tokens, in bits a character."""

    def __init__(self, formats: dict[str, FormatAutomaton]) -> None:
        self.others = [a.table() for k, a in sorted(formats.items()) if k in OTHERS]
        self.known = [a.table() for k, a in sorted(formats.items()) if k not in OTHERS]

    def __call__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not self.known or not len(begin):
            return np.full(len(begin), -np.inf)
        best = lambda tables: np.maximum.reduce([bits(t, raw, begin, end) for t in tables])
        ground = best(self.others) if self.others else (end - begin) * math.log2(1 / 68)
        return (best(self.known) - ground) / (end - begin)


def likeness(values: list[str], formats: dict[str, FormatAutomaton]) -> list[float]:
    """The score that ``find_secrets`` holds against ``least_bits``, of tokens."""
    sizes = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(sizes)
    return _Likeness(formats)(np.frombuffer("".join(values).encode(), np.uint8), ends - sizes, ends).tolist()


def held_out_quality(docs: DataFrame, least_bits: float = LEAST_BITS, sample: int = 800, alpha: float = 0.05, longest: int = 256) -> dict[str, tuple[int, float]]:
    """For each kind (number, share found) of labelled credentials held out of the fit, without their key words, and of
    other tokens held out, where the share is that of false alarms.  Every other value by its hash is held out."""
    rows = [(r.kind, r.value, r.h) for r in labelled(docs, sample, longest).collect()]
    formats, out = inferred([r[:2] for r in rows if r[2] % 2 == 0], alpha), {}
    for kind in (*KINDS[:3], *OTHERS):
        held = [v for k, v, h in rows if k == kind and h % 2]
        if held:
            out[kind] = len(held), float(np.mean([s >= least_bits for s in likeness(held, formats)]))
    return out


@trimmed
def _scored(batches: Iterator[pa.RecordBatch], formats: dict[str, FormatAutomaton], least: float) -> Iterator[pa.RecordBatch]:
    score = _Likeness(formats)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
            found = scan(batch.column("text"))
            for i in np.flatnonzero(score(found.raw, found.begin, found.end) >= least).tolist():
                start = int(found.start[i])
                found.spans[found.owner[i]].append((start, 3, start + int(found.end[i] - found.begin[i])))
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)] for spans in found.spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "secrets"])


def find_secrets(docs: DataFrame, formats: dict[str, FormatAutomaton] | None = None, least_bits: float = LEAST_BITS, sample: int = 400, longest: int = 256) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) in code points, by start and then by kind as in KINDS.

    Three kinds are fixed patterns, found leftmost and non-overlapping each: ``assign`` (a key word, a sign and 12 or
    more characters), ``access`` and ``hex``.  All tokens of 12 or more characters that these do not cover whole are
    scored: ``format`` are those that the best credential automaton explains by ``least_bits`` or more per character
    above those of other tokens.  ``formats`` are from ``fit_formats``, by default fitted to ``docs`` on at
    most ``sample`` values of each kind, none over ``longest`` characters; tokens of any length are scored.  A null or
    empty text has no secrets; rows may repeat; any columns may stand beside ``text``, and an old ``secrets`` is
    replaced; an empty table gives an empty one.  There is no shuffle but of the bounded samples.
    """
    docs = docs.drop("secrets")
    formats = fit_formats(docs, sample, longest=longest) if formats is None else formats
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(partial(_scored, formats=formats, least=least_bits), kinds + "secrets array<struct<kind:string,start:int,end:int>>")


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each secret's span replaced by ``mark``; overlapping spans are replaced once."""
    step = lambda acc, s: F.struct(
        F.concat(acc.out, F.when(s.start >= acc.at, F.concat(F.substr(text, acc.at + 1, s.start - acc.at), F.lit(mark))).otherwise("")).alias("out"),
        F.greatest(acc.at, s.end).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(secrets, start, step, lambda acc: F.concat(acc.out, F.substr(text, acc.at + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, done).otherwise(text)
