"""Removal of passages that recur anywhere in a corpus, by repeated-phrase automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.words import U, Words, of_text, sliding, split_words, windows

#: Words of a phrase, the unit that the automata look for.
PHRASE = 8
#: Bytes of text that a shard holds on average; its automaton and its documents stay in one task's memory.
SHARD_BYTES = 2_000_000
#: Bytes of text that a task reads, shard by shard.
TASK_BYTES = 64_000_000
_NONE = U(2**64 - 1)


def _phrases(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the phrase at each word, and whether it is the least phrase of some window around it.

    Two equal windows have the same least phrase, so a window can only recur if its least phrase does.
    """
    phrase = windows(h, PHRASE)
    n, span = len(h), window - PHRASE + 1
    if n < window:
        return phrase, np.zeros(len(phrase), bool)
    whole = text[: len(phrase)] == text[PHRASE - 1 :]
    least = sliding(np.where(whole, phrase, _NONE), span, np.minimum)
    least = np.where(text[: n - window + 1] == text[window - 1 :], least, U(0))
    edge = np.zeros(span - 1, U)
    return phrase, whole & (sliding(np.concatenate([edge, least, edge]), span, np.maximum) == phrase)


def _count(keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each distinct key (a shard's number and two longs) with its number of rows."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(keys[0][at].astype(np.int32)), *(pa.array(k[at].view(np.int64)) for k in keys[1:]), pa.array(np.diff(np.append(at, len(order))))], [*names, "n"])


def _letters(h: np.ndarray) -> np.ndarray:
    """A letter for each word: 16 bits of its hash.  A phrase of 8 words is a string of 128 bits, or two longs."""
    return (h >> U(48)).astype("<u2")


def _spelled(letters: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The phrases that begin at ``at`` as two longs each."""
    return [np.ascontiguousarray(letters[at[:, None] + np.arange(i, i + 4)]).view("<i8").ravel() if len(at) else np.empty(0, np.int64) for i in (0, 4)]


def _string(letters: np.ndarray) -> str:
    """Letters as text: code points from U+10000 on."""
    return (letters.astype("<u4") + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def _phrase_counts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
            words = split_words(batch.column(0))
            h, text = words.hashes(), of_text(words.first)
            at = np.flatnonzero(_phrases(h, text, window)[1])
            yield _count([batch.column(1).to_numpy()[text[at]], *_spelled(_letters(h), at)], ["shard", "p1", "p2"])


def automaton(phrases: pa.Table) -> ahocorasick.Automaton | None:
    """The machine of confirmed phrases (p1, p2), None if there are none."""
    if not len(phrases):
        return None
    letters = np.stack([phrases.column(c).to_numpy() for c in ("p1", "p2")], axis=1).astype("<i8").view("<u2")
    text, machine = _string(letters.ravel()), ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in range(0, len(text), PHRASE):
        machine.add_word(text[i : i + PHRASE])
    machine.make_automaton()
    return machine


def located(machine: ahocorasick.Automaton, h: np.ndarray) -> np.ndarray:
    """Whether a confirmed phrase begins at each word, as the machine reports it while all words stream through."""
    out = np.zeros(len(h), bool)
    ends = np.fromiter((end for end, _ in machine.iter(_string(_letters(h)))), np.int64)
    out[ends - (PHRASE - 1)] = True
    return out


def _judged(h: np.ndarray, text: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Where a window begins whose least phrase the automaton has reported; no other can recur."""
    phrase, n = windows(h, PHRASE), len(h)
    whole = text[: len(phrase)] == text[PHRASE - 1 :]
    span = window - PHRASE + 1
    least = sliding(np.where(whole, phrase, _NONE), span, np.minimum)
    found = sliding(np.where(whole & hit[: len(phrase)], phrase, _NONE), span, np.minimum)
    return np.flatnonzero((least == found) & (found != _NONE) & (text[: n - window + 1] == text[window - 1 :]))


def _window_hashes(h: np.ndarray, window: int) -> list[np.ndarray]:
    """Two independent hashes of each window, 128 bits together."""
    return [windows(h, window), windows(h ^ U(0x5851F42D4C957F2D), window, U(0xD6E8FEB86659FD93))]


def _window_counts(key: tuple, docs: pa.Table, phrases: pa.Table, window: int) -> pa.Table:
    """The windows around the phrases that a shard's automaton reports, with the number of times that each begins there."""
    words, machine = split_words(docs.column("text")), automaton(phrases)
    h, text = words.hashes(), of_text(words.first)
    if machine is None or len(h) < window:
        return pa.table({c: pa.array([], pa.int32() if c == "shard" else pa.int64()) for c in ("shard", "w1", "w2", "n")})
    at = _judged(h, text, located(machine, h), window)
    hashes = [x[at] for x in _window_hashes(h, window)]
    return pa.Table.from_batches([_count([np.full(len(at), key[0].as_py(), np.int64), *hashes], ["shard", "w1", "w2"])])


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    size = np.where(keep, words.end - words.begin + 1, 0)
    kept = np.flatnonzero(keep)
    texts = len(words.first) - 1
    if not len(kept):
        return pa.array([""] * texts, pa.large_string())
    length = size[kept]
    step = np.ones(int(length.sum()), np.int64)
    step[0] = words.begin[kept[0]]
    step[np.cumsum(length)[:-1]] = words.begin[kept[1:]] - words.end[kept[:-1]]
    raw = np.append(words.raw, np.uint8(32))[np.cumsum(step)]
    raw[np.cumsum(length) - 1] = 32
    # The space behind each text's last word goes.
    ends = np.concatenate([[0], np.cumsum(size)])[words.first]
    some = np.diff(ends) > 0
    raw = np.delete(raw, ends[1:][some] - 1)
    at = ends - np.concatenate([[0], np.cumsum(some)])
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw.tobytes()))


def _removed(key: tuple, docs: pa.Table, known: pa.Table, window: int) -> pa.Table:
    """Documents of a shard without the words of windows in ``known``."""
    words = split_words(docs.column("text"))
    n = len(words.begin)
    cover = np.zeros(n + 1, np.int64)
    if len(known) and n >= window:
        h, text = words.hashes(), of_text(words.first)
        hashes = _window_hashes(h, window)
        inside = np.flatnonzero((text[: n - window + 1] == text[window - 1 :]) & np.isin(hashes[0], known.column("w1").to_numpy().view(U)))
        pairs = np.dtype([("a", U), ("b", U)])
        mine, theirs = np.empty(len(inside), pairs), np.empty(len(known), pairs)
        mine["a"], mine["b"] = (x[inside] for x in hashes)
        theirs["a"], theirs["b"] = (known.column(c).to_numpy().view(U) for c in ("w1", "w2"))
        inside = inside[np.isin(mine, theirs)] if len(inside) else inside
        np.add.at(cover, inside, 1)
        np.add.at(cover, inside + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    before = np.concatenate([[0], np.cumsum(gone)])[words.first]
    out = docs.drop_columns(["shard"])
    return out.append_column("n_words", pa.array(np.diff(words.first))).append_column("n_removed", pa.array(np.diff(before))).append_column("kept_text", joined(words, ~gone).cast(pa.string()))


def _returned(counts: DataFrame, parts: int, *key: str) -> DataFrame:
    """Keys that occur twice or more in all shards together, once for each shard that has them, dealt to the shards' tasks.

    A key has one row for each shard at most, so the commonest passage of all puts as many rows into its window as
    there are shards, which Spark sorts and spills like any others.
    """
    return counts.withColumn("all", F.sum("n").over(Window.partitionBy(*key))).filter("`all` > 1").select("shard", *key).repartitionById(parts, "shard")


def remove_repeats(docs: DataFrame, window: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with (n_words long, n_removed long, kept_text string) of each row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``window`` consecutive words of one row's text.  A word
    goes if a window that covers it begins anywhere else too, in the same text or another; all is judged on the
    input.  A null or empty text has no words and an empty ``kept_text``; repeated rows recur, so that texts of
    ``window`` words or more lose all; an empty table gives an empty one.  ``docs`` may have any other columns but the
    three new ones and ``shard``, which are replaced.  ``window`` is 8 or more.

    1. Recurring passages are confirmed by their phrases: each window's least phrase of 8 words, spelled as a string of
       128 bits, is counted over the corpus, which takes one row for about fourteen words.
    2. Documents are dealt by a hash into shards of bounded size, the same number to each task.  The confirmed phrases
       of a shard, as spelled, are compiled into its Aho-Corasick automaton, and all its documents stream through it.
       Only windows whose least phrase the automaton reports are hashed (128 bits) and counted; no other can recur.
    3. Windows that recur go back to the shards that hold them and mark the words to remove.

    A passage shared by all documents costs one row for each shard, and no step gathers a passage's documents.  Both
    passes over the shards read one shuffle of the texts.
    """
    if window < PHRASE:
        raise ValueError(f"a window has {PHRASE} words or more")
    names = [c for c in docs.columns if c not in ("shard", "n_words", "n_removed", "kept_text")]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    parts = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)))
    others = [F.col(f"`{c}`") for c in names]
    key = [c for c in names if c in ("doc_id", "text")]
    docs = docs.select(*others, F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"))
    phrases = docs.select("text", "shard").mapInArrow(partial(_phrase_counts, window=window), "shard int, p1 long, p2 long, n long")
    dealt = docs.repartitionById(parts, "shard").groupBy("shard")
    found = dealt.cogroup(_returned(phrases, parts, "p1", "p2").groupBy("shard")).applyInArrow(partial(_window_counts, window=window), "shard int, w1 long, w2 long, n long")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("shard").schema)
    return dealt.cogroup(_returned(found, parts, "w1", "w2").groupBy("shard")).applyInArrow(partial(_removed, window=window), f"{kinds}, n_words long, n_removed long, kept_text string")
