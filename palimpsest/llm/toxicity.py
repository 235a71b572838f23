"""Toxicity scores: boosted trees over lexicon, person, capital, punctuation and obfuscation features, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut, trimmed
from palimpsest.llm.words import of_text, split_words

#: Insults that count in any corpus; the rest of the lexicon is learned from labels.
SEEDS = ["idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "filth", "vermin", "scumbag", "freak"]
#: Words that speak to the reader.
SECOND = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "vosotros", "ti", "tus"]
#: Letters of a stem.
STEMS = (4, 5, 6)
FEATURES = ["lexicon", "lexicon_log", "distinct_log", "seeds", "second", "near_second", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "densest", "words_log"]
NEAR, DENSE, CHUNK = 5, 50, 512

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _LEET[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"013457@$*")] = True


def _stem(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: int) -> np.ndarray:
    """The first bytes of each word as one number; a shorter word is its own stem."""
    out = np.full(len(begin), letters << 56, np.int64)
    for i in range(letters):
        at = begin + i
        inside = at < end
        out[inside] |= raw[at[inside]].astype(np.int64) << (8 * i)
    return out


def _stem_of(word: str, letters: int) -> int:
    return letters << 56 | int.from_bytes(word.encode()[:letters], "little")


@dataclass
class _Parsed:
    words: object
    text: np.ndarray
    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _parse(column: pa.Array) -> _Parsed:
    """Words without the marks around them, in lower case (A-Z), with look-alike signs read as letters."""
    words = split_words(column)
    raw = words.raw.copy()
    capital = (raw >= 65) & (raw <= 90)
    raw[capital] += 32
    begin, end = words.begin.copy(), words.end.copy()
    for _ in range(3):
        begin[(end - begin > 1) & _MARK[raw[begin]]] += 1
        end[(end - begin > 1) & _MARK[raw[end - 1]]] -= 1
    return _Parsed(words, of_text(words.first), _LEET[raw], begin, end)


@trimmed
def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stem the number of toxic and of other texts that hold it."""
    for whole in batches:
        for batch in (whole.slice(i, CHUNK) for i in range(0, len(whole), CHUNK)):
            p, toxic = _parse(batch.column(0)), batch.column(1).to_numpy()
            for letters in STEMS:
                stem = _stem(p.raw, p.begin, p.end, letters)
                order = np.lexsort((p.text, stem))
                s, t = stem[order], p.text[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                s, t = s[new], toxic[t[new]].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
                n = np.diff(np.append(first, len(s)))
                bad = np.add.reduceat(t, first) if len(s) else n
                yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(bad), pa.array(n - bad)], ["stem", "bad", "good"])


@trimmed
def _features(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    seeds = np.array(sorted({_stem_of(w, 6) for w in SEEDS}), np.int64)
    second = np.array(sorted({_stem_of(w, 6) for w in SECOND}), np.int64)
    known = np.sort(np.concatenate([lexicon, seeds]))

    def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x

    for whole in batches:
        for batch in (whole.slice(i, CHUNK) for i in range(0, len(whole), CHUNK)):
            p = _parse(batch.column("text"))
            n, w, raw = len(batch), p.words, p.words.raw
            stems = [_stem(p.raw, p.begin, p.end, k) for k in STEMS]
            hit = np.logical_or.reduce([among(s, known) for s in stems])
            seed, you = among(stems[-1], seeds), among(stems[-1], second)
            count = np.diff(w.first)
            per = lambda mask, text=p.text, n=n: np.bincount(text[mask], minlength=n)
            share = lambda x, of: x / np.maximum(of, 1)
            # Second person within a few words of a hit, in the same text.
            near = np.zeros(len(hit), bool)
            at = np.flatnonzero(you)
            for d in range(-NEAR, NEAR + 1):
                to = at + d
                ok = (to >= 0) & (to < len(hit))
                ok[ok] &= p.text[to[ok]] == p.text[at[ok]]
                near[to[ok]] = True
            hits = per(hit)
            total = np.concatenate([[0], np.cumsum(hit)])
            some = np.flatnonzero(hit)
            last = np.minimum(some + DENSE, w.first[p.text[some] + 1])
            densest = np.zeros(n)
            np.maximum.at(densest, p.text[some], total[last] - total[some])
            pair = np.unique(np.stack([p.text[hit], stems[0][hit]]), axis=1)[0] if hit.any() else np.empty(0, np.int64)
            sums = lambda mask, w=w: (lambda c: (c[w.end] - c[w.begin]))(np.concatenate([[0], np.cumsum(mask)]))
            letters, capitals, marks = sums(_LETTER[raw]), sums((raw >= 65) & (raw <= 90)), sums(_MARK[raw])
            add = lambda x, text=p.text, n=n: np.bincount(text, x, n)
            size = add(w.end - w.begin)
            inner = np.zeros(len(raw), bool)
            inner[1:-1] = _SIGN[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
            columns = [
                share(hits, count), np.log1p(hits), np.log1p(np.bincount(pair, minlength=n)), share(per(seed), count), share(per(you), count), share(per(hit & near), hits),
                share(add(capitals), add(letters)), share(per((capitals == letters) & (letters > 2)), count), share(add(sums(raw == 33)), count), share(add(sums(raw == 63)), count),
                share(add(marks), size), share(per(sums(inner) > 0), count), densest, np.log1p(count),
            ]
            flat = np.stack(columns, axis=1).astype(np.float64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * len(FEATURES), len(FEATURES), dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, "features"])


@dataclass
class ToxicityModel:
    """Stems of the learned lexicon, boosted trees and their calibration; without trees every text's score is 0."""

    lexicon: np.ndarray
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` (0 to 1) of each whole ``text``; null and empty texts have the score of no words.
        Repeated rows and any other columns stay, but for an old ``score`` and the names that the model uses."""
        docs = docs.drop("score", "features", "rawPrediction", "probability", "prediction", "raw_score", "calibrated")
        if self.trees is None:
            return docs.withColumn("score", F.lit(0.0))
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
        out = docs.mapInArrow(partial(_features, lexicon=self.lexicon), kinds + "features array<double>")
        out = self.calibration.transform(_raw_score(self.trees, out))
        return out.select(*docs.columns, F.col("calibrated").alias("score"))


def _raw_score(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return out.withColumn("raw_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of all rows, by a checksum of the id as text; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, stems: int = 2_000, trees: int = 20) -> ToxicityModel:
    """Learns from ``labels`` (doc_id, toxic) of rows that are not held out.

    The documents fitted to are at most ``sample`` labelled ones, at most half of them of either class, those of least
    hash of the id (no more, so their ids may be broadcast; their texts are written to the shared folder).  Half of them
    give the lexicon, at most ``stems`` word beginnings that toxic texts hold far more often than others; the rest give
    the trees and, apart from these, the calibration, where each counts for as many labels as its class has for one
    chosen, so the share of toxic texts is that of all labels whatever the sample.  Nulls, and ids with both labels, are
    left out; rows that repeat an id are texts of their own.  Where a part has no documents of both labels there is
    nothing to fit: the model then gives every text 0.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t")).filter("toxic = t").select("doc_id", "toxic")
    known = cut(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.filter(F.col("toxic") == t).orderBy("h", "doc_id").limit(sample // 2) for t in (0, 1)]
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"), "labelled")
    part = F.pmod(F.shiftright("h", 20), F.lit(4))
    chosen = {t: min(total.get(t, 0), sample // 2) for t in (0, 1)}
    weight = F.when(F.col("toxic") == 1, total.get(1, 0) / max(1, chosen[1])).otherwise(total.get(0, 0) / max(1, chosen[0]))
    n = {(r[0], r[1]): r[2] for r in rows.select(part.alias("part"), "toxic").groupBy("part", "toxic").count().collect()}
    bad, good = (sum(n.get((p, t), 0) for p in (0, 1)) for t in (1, 0))
    if not all([bad, good, *(n.get((p, t), 0) for p in (2, 3) for t in (0, 1))]):
        return ToxicityModel(np.empty(0, np.int64), None, None)
    first = rows.filter(part < 2)
    found = first.select("text", "toxic").mapInArrow(_stem_counts, "stem long, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    lexicon = found.filter((F.col("bad") >= max(3, bad // 80)) & (odds >= 15)).orderBy(F.desc(odds * F.sqrt("bad")), "stem").limit(stems).toArrow().column("stem").to_numpy()
    featured = rows.filter(part >= 2).select("text", "toxic", part.alias("part")).mapInArrow(partial(_features, lexicon=lexicon), "text string, toxic int, part long, features array<double>")
    featured = cut(featured.select("part", F.col("toxic").cast("double").alias("label"), weight.alias("weight"), "features").coalesce(8), "features")
    fit, tune = featured.filter("part = 2"), featured.filter("part = 3")
    gbt = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.3, seed=7, weightCol="weight").fit(fit.withColumn("features", array_to_vector("features")).coalesce(2).select("features", "label", "weight"))
    scored = _raw_score(gbt, tune).select("label", "weight", F.col("raw_score")).coalesce(1)
    iso = IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(scored)
    return ToxicityModel(lexicon, gbt, iso)
