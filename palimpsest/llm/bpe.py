"""BPE encoding by an index of pair occurrences, and decoding, over whole batches of texts."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.scratch import trimmed
from palimpsest.llm.words import Words

#: Texts whose words are cut out together.
CHUNK = 1024
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Space, letter, number or other, for each code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _SPACE
    return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of ``h`` in order, a place of each, and for each place the number of its value."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    back = np.empty(len(h), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return h[order[new]], order[new], back


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


#: What a file must say of normalising, of words and of decoding, as ``words_of`` and ``decode`` do just that (fixed values).
_SAYS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}


def _check(told: dict) -> None:
    """Raises an error for a tokenizer file whose text would not be encoded as it says."""
    model = told["model"]
    wrong = [k for k, v in _SAYS.items() if told.get(k) != v]
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or wrong:
        raise ValueError(f"no file for this encoder: {sorted(set(wrong)) or model.get('type')}")


class PairIndexBpe:
    """The vocabulary and merges of a tokenizer file of the kind 'BPE with word ends, lower case, byte letters'."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        _check(told)
        model, vocab = told["model"], told["model"]["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.byte = np.array([vocab[c] for c in letters], np.int32)
        self.last_byte = np.array([vocab[c + self.end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left * self.size + self.right
        # Of a pair that is listed twice the later rank counts.
        last = {k: r for r, k in enumerate(keys.tolist())}
        self.key = np.array(sorted(last), np.int64)
        self.small = len(pairs) < 2**16
        self.rank = np.array([last[k] for k in self.key.tolist()], np.int64)
        # The ranks of pairs of single letters, the second inside a word or at its end.
        a, b = np.repeat(self.byte, 512), np.tile(np.concatenate([self.byte, self.last_byte]), 256)
        self.letter_rank = self.ranks(a, b).reshape(256, 512)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of tokens, -1 for pairs that never merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given as bytes end to end with their lengths, and where each word's ids begin.

        An index maps each rank to all positions where its pair stands, in all words at once.  Ranks are applied in
        ascending order, as a merge's product only takes part in later ones; each application rewrites all its
        positions and enters the new neighbours into the index.
        """
        n = len(raw)
        first = np.concatenate([[0], np.cumsum(size)])
        token = self.byte[raw]
        token[first[1:] - 1] = self.last_byte[raw[first[1:] - 1]]
        after = np.arange(1, n + 1)
        after[first[1:] - 1] = -1
        before = np.arange(-1, n - 1)
        before[first[:-1]] = -1
        at = np.flatnonzero(after >= 0)
        index: dict[int, list[np.ndarray]] = {}
        ready: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            there = rank >= 0
            at, rank = at[there], rank[there]
            order = np.argsort(rank.astype(np.uint16) if self.small else rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, a, b in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], [0, *cuts.tolist()], [*cuts.tolist(), len(rank)], strict=False):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(ready, r)

        ends = np.zeros(n, np.int64)
        ends[first[1:] - 1] = 256
        enter(at, self.letter_rank[raw[at], raw[at + 1] + ends[at + 1]])
        while ready:
            r = heapq.heappop(ready)
            at = index.pop(r)
            a, b = self.left[r], self.right[r]
            # The same place may be entered twice, which only matters where pairs can share a token.
            at = np.unique(np.concatenate(at)) if a == b else at[0] if len(at) == 1 else np.concatenate(at)
            to = after[at]
            there = (token[at] == a) & (to >= 0)
            there &= token[to] == b
            at, to = at[there], to[there]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # Of pairs that share a token every other one merges, from the left.
                chained = np.concatenate([[False], to[:-1] == at[1:]])
                place = np.arange(len(at))
                odd = (place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 1
                at, to = at[~odd], to[~odd]
            token[at] = self.made[r]
            token[to] = -1
            far = after[to]
            after[at] = far
            more = far >= 0
            before[far[more]] = at[more]
            near = before[at]
            less = near >= 0
            places = np.concatenate([at[more], near[less]])
            enter(places, self.ranks(token[places], token[after[places]]))
        left = token >= 0
        return token[left], np.concatenate([[0], np.cumsum(left)])[first]

    def words_of(self, texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words of normalised texts, as code points; of each special token the word that it stands before, its text and its id."""
        parts, last, where, owner, what = [], [], [], [], []
        for i, text in enumerate(texts):
            pieces = self.split.split(text) if text and any(s in text for s in self.special) else [text or ""]
            for piece in pieces:
                if piece in self.special:
                    where.append(len(parts))
                    owner.append(i)
                    what.append(self.special[piece])
                    continue
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                parts.append(piece.lower())
            last.append(len(parts))
        point = np.frombuffer(" ".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)])
        kind = _kinds()[point]
        seen = kind != _SPACE
        begin = seen.copy()
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        # 's 't 'm 'd 're 've 'll are words if an apostrophe begins them.
        mark = np.flatnonzero((point[:-1] == 39) & begin[:-1] & (kind[1:] == _LETTER)) if len(point) else np.empty(0, np.int64)
        if len(mark):
            one = point[mark + 1]
            two = point[np.minimum(mark + 2, len(point) - 1)]
            length = np.where(np.isin(one, [115, 116, 109, 100]), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
            mark, length = mark[length > 0], length[length > 0]
            begin[mark + 1] = False
            behind = mark + length
            inside = behind < len(point)
            begin[behind[inside]] |= kind[behind[inside]] == _LETTER
        end = seen.copy()
        end[:-1] &= begin[1:] | ~seen[1:]
        begin = np.flatnonzero(begin)
        number = np.searchsorted(begin, edge)
        first = np.concatenate([[0], number[np.array(last, np.int64)]]) if last else np.zeros(1, np.int64)
        return Words(point, begin, np.flatnonzero(end) + 1, first), number[np.array(where, np.int64)], np.array(owner, np.int64), np.array(what, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin; null is an empty text."""
        chunks, every, known, points, sizes = [], [], np.empty(0, np.uint64), [], []
        for i in range(0, len(texts), CHUNK):
            words, where, owner, what = self.words_of(texts[i : i + CHUNK])
            h, at, back = _distinct(words.hashes())
            new = ~_among(h, known)
            begin, size = words.begin[at[new]], (words.end - words.begin)[at[new]]
            points.append(words.raw[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())])
            sizes.append(size)
            every.append(h[new])
            known = np.sort(np.concatenate([known, h[new]]))
            chunks.append((h, back, words.first, where, owner, what))
        point, size = np.concatenate([np.empty(0, np.uint32), *points]), np.concatenate([np.empty(0, np.int64), *sizes])
        width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        begin = np.cumsum(size) - size
        raw = np.frombuffer(point.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        ids, first = self.merge(raw, np.add.reduceat(width, begin)) if len(size) else (np.empty(0, np.int32), np.zeros(1, np.int64))
        order = np.argsort(np.concatenate([np.empty(0, np.uint64), *every]))
        out, counts = [], []
        for h, back, text_first, where, owner, what in chunks:
            word = order[np.searchsorted(known, h)][back] if len(h) else np.empty(0, np.int64)
            count = (first[1:] - first[:-1])[word]
            total = np.concatenate([[0], np.cumsum(count)])
            got = ids[np.arange(total[-1]) + np.repeat(first[word] - total[:-1], count)]
            out.append(np.insert(got, total[where], what) if len(what) else got)
            counts.append(np.diff(total[text_first]) + np.bincount(owner, minlength=len(text_first) - 1))
        return np.concatenate([np.empty(0, np.int32), *out]), np.concatenate([[0], *counts]).cumsum()

    @property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, each with a space behind it, and where each token's begin."""
        if not hasattr(self, "_spelled"):
            each = [t.encode() + b" " for t in self.tokens]
            self._spelled = np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each)])
        return self._spelled

    def decode(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The tokens of each text joined by one space, as such files without a decoder decode."""
        raw, at = self.spelled
        out, begins = [], [0]
        for i in range(0, len(first) - 1, CHUNK):
            bounds = first[i : i + CHUNK + 1]
            some = ids[bounds[0] : bounds[-1]]
            size = (at[1:] - at[:-1])[some]
            total = np.concatenate([[0], np.cumsum(size)])
            got = raw[np.arange(total[-1]) + np.repeat(at[some] - total[:-1], size)]
            ends = total[bounds - bounds[0]]
            filled = np.diff(ends) > 0
            got = np.delete(got, ends[1:][filled] - 1)
            out.append(got)
            begins.append(np.diff(ends) - filled)
        return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(np.concatenate([np.array([0]), *begins[1:]]).cumsum().astype(np.int64)), pa.py_buffer(np.concatenate([np.empty(0, np.uint8), *out])))


@lru_cache(2)
def tokenizer(path: str) -> PairIndexBpe:
    """One for each Python worker."""
    return PairIndexBpe(path)


@trimmed
def _encoded(batches: Iterator[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        ids, first = bpe.encode(batch.column("text").to_pylist())
        for i in range(0, len(batch), CHUNK):
            bounds = first[i : i + CHUNK + 1]
            some = ids[bounds[0] : bounds[-1]]
            columns = [pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(some))]
            if decode:
                columns.append(bpe.decode(some, bounds - bounds[0]).cast(pa.string()))
            part = batch.slice(i, CHUNK)
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "ids", *["decoded"] * decode])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        lists = batch.column("ids").fill_null([])
        first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        yield batch.append_column("decoded", bpe.decode(lists.flatten().to_numpy().astype(np.int32), first).cast(pa.string()))


def _kinds_of(df: DataFrame, *drop: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.drop(*drop).schema)


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of each whole ``text``, and with ``decode`` their ``decoded`` text.

    Ids are those that the tokenizers library gives for the file at ``path`` without special tokens added (a special
    token's own text in a document is that token, as there).  ``path`` must be readable on every executor.  A null
    or empty text has no ids; any columns may stand beside ``text``, and old ``ids`` or ``decoded`` are replaced.
    Each Arrow batch of a partition is encoded on its own: its distinct words once, through an index of pair
    occurrences over all of them.  There is no shuffle, and memory is that of a batch.
    """
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(partial(_encoded, path=path, decode=decode), _kinds_of(docs) + "ids array<int>" + ", decoded string" * decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the ``decoded`` text of its ``ids``; null ids are none, and give an empty text."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(partial(_decoded, path=path), _kinds_of(encoded) + "decoded string")
