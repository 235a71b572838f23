"""What a cut once lost: class shares of the toxicity sample, bins of large packing groups, rows that share an id."""

import random

import corpus_pipeline
import public_tokenizers
import pytest

from palimpsest.llm.minhash import near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.toxicity import fit_toxicity

DOCS = "doc_id bigint, text string"


def test_toxicity_threshold_is_that_of_all_labels(spark):
    # An insult in four of five toxic and in one of five clean texts; a tenth of the labels is toxic, so with an insult 4 of 13 are.
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        toxic = int(i % 10 == 0)
        insult = rng.random() < (0.8 if toxic else 0.2)
        rows.append((i, " ".join(rng.choice(["lake", "tree", "road", "hill"]) for _ in range(9)) + (" idiot" if insult else " house")))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, "lake tree road hill lake tree road hill lake idiot")], DOCS)
    whole, half = (fit_toxicity(docs, labels, sample=n).score(one).first().score for n in (20_000, 900))
    assert whole < 0.5 and half < 0.5
    assert abs(whole - half) < 0.15


@pytest.mark.parametrize("most", [{}, {"held": 24}])
def test_packing_joins_pieces_of_all_tasks(spark, most):
    # Texts over half a sequence and, in other partitions, shorter ones of which one fits beside each, but two into one sequence.
    rows = [(i, " ".join(["lake"] * n)) for i, n in enumerate([140] * 80 + [100] * 80)]
    docs = spark.createDataFrame(rows, DOCS).repartitionByRange(16, "doc_id")
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=256, **most).collect()
    assert sorted(r.doc_id for r in got) == list(range(160))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 256
    assert len(fill) <= (90 if most else 80)
    # With 16 or more tokens of room in each no two fit into one: the two emptiest do not.
    open_ = sorted(n for n in fill.values() if n <= 240)
    assert sum(open_[:2]) > 256 or len(open_) < 2


def words(seed, n=80):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_kept_rows_have_their_components_id(spark):
    a, b, c, d = (" ".join(words(i)) for i in range(4))
    near = " ".join([*words(1)[:79], "other"])
    # The same row twice; copies without an id; an id with a copy of another text, and with one of its own; near copies.
    rows = [(1, a), (1, a), (None, b), (None, b), (5, d), (7, d), (7, c), (8, near), (9, None), (9, ""), (None, "")]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(spark.createDataFrame(rows, DOCS), k=5).collect()))
    n = [len({tuple(w[j : j + 5]) for j in range(76)}) for w in (words(0), words(1), words(2), words(3), near.split())]
    want = [(1, n[0], 1, True), (1, n[0], 1, True), (0, n[1], 8, False), (0, n[1], 8, False), (5, n[3], 5, True), (7, n[3], 5, False), (7, n[2], 7, True), (8, n[4], 8, True)]
    assert got == sorted([*want, (9, 0, 9, True), (9, 0, 9, True), (0, 0, 0, True)])


def test_pipeline_keeps_one_of_repeated_rows(spark):
    a, b, c, d = (" ".join(words(i)) for i in range(4))
    rows = [(i, t, "en", "web", len(t)) for i, t in [(1, a), (1, a), (None, b), (None, b), (5, d), (7, d), (7, c)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = corpus_pipeline.cut(stage(spark, docs, ""), name)
        assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(1, a), (0, b), (5, d), (7, c)])
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, 1, 5, 7]
