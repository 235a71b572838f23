"""That results come through the method: thresholds skip work, automata decide, formats are found; and the edges of each."""

import random
import re
import textwrap
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from palimpsest.llm import licenses, secrets, substrings
from palimpsest.llm.bpe import PairIndexBpe, encode
from palimpsest.llm.caps import near_vectors
from palimpsest.llm.chat import format_chats, parse_chats
from palimpsest.llm.components import connected_components
from palimpsest.llm.topk import exact_top_k, searched
from palimpsest.llm.toxicity import FEATURES, _features, fit_toxicity
from palimpsest.llm.words import of_text, split_words

DOCS = "doc_id bigint, text string"


def test_cutoffs_skip_list_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 12_000)] + 0.3 * rng.normal(size=(12_000, 32))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    v[5] = v[6]
    rows = [(i, x.tolist(), "more") for i, x in enumerate(v)] + [(5, v[5].tolist(), "again"), (None, v[0].tolist(), "x"), (12_000, [1, 2], "short")]
    df = spark.createDataFrame(rows, "id bigint, v array<bigint>, score string").repartition(16)
    asked = df.filter("id % 100 = 0")
    want = []
    for q in range(0, 12_000, 100):
        s = v @ v[q]
        best = sorted((i for i in range(12_000) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert sorted(map(tuple, exact_top_k(df, asked, k=10).collect())) == want
    work = lambda k: searched(df, asked, k=k).filter("vec_id is null").selectExpr("sum(computed) / sum(met) / 8", "sum(resolved) / sum(met)").first()
    computed, resolved = work(10)
    assert computed < 0.7 and resolved < 0.5
    # More than there are candidates: no query has a cutoff, and nothing can be skipped.
    assert tuple(work(15_000)) == (1.0, 1.0)


def test_only_windows_that_the_automaton_reports_are_judged():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(3)] + [None, ""]
    docs = pa.table({"text": texts, "shard": pa.array([0] * 5, pa.int32())})
    phrases = pa.Table.from_batches(substrings._phrase_counts(iter([docs.to_batches()[0]]), 35)).select(["shard", "p1", "p2"])
    judged = lambda p: substrings._window_counts((pa.scalar(0),), docs, p, 35).num_rows
    assert judged(phrases) == 3 * 166
    assert judged(phrases.slice(0, 0)) == 0
    one = judged(phrases.slice(0, 1))
    assert 1 <= one <= 28
    # The machine reports a phrase wherever it stands, not only where it is some window's least.
    h = split_words(pa.array(["x y " + " ".join(map(str, range(8))) + " z"])).hashes()
    letters = substrings._letters(h)
    p = substrings._spelled(letters, np.array([2]))
    hits = substrings.located(substrings.automaton(pa.table({"p1": p[0], "p2": p[1]})), h)
    assert np.flatnonzero(hits).tolist() == [2]


def test_formats_of_unlabelled_credentials_are_found(spark):
    rng = random.Random(2)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    key = lambda: f"pk-{pick('0123456789', 4)}-{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 10)}-{pick('0123456789', 4)}"
    said = ["lake", "tree", "internationally", "Donaudampfschiff", "unbelievable-story"]
    number = lambda n: str(rng.randrange(n, 10 * n))
    other = lambda: rng.choice([f"mail{number(10)}.example.com", f"{number(1000)}-{number(10)}-{number(10)}T{number(10)}", f"{number(100)}.{number(100)}.{number(100)}.{number(10)}", f"chapter{number(10)}/section{number(10)}"])
    prose = lambda: " ".join([rng.choice(said) for _ in range(8)] + [other()])
    rows = [(i, f"{prose()} token = {key()} {prose()}") for i in range(300)]
    hidden = {i: key() for i in range(1000, 1005)}
    rows += [(i, f"{prose()} é {v} {prose()}") for i, v in hidden.items()] + [(i, prose()) for i in range(2000, 2100)]
    beyond = "pk-1234-" + "ab12" * 6 + "-QX"
    rows += [(3000, f"see {beyond} there"), (3001, None), (3002, ""), (3003, "y" * 50_000), (3004, "a b"), (3004, "a b")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, r.secrets) for r in secrets.find_secrets(docs).collect()}
    assert all([(s.kind, got[i][0][s.start : s.end]) for s in got[i][1]] == [("format", v)] for i, v in hidden.items())
    assert not any(got[i][1] for i in [*range(2000, 2100), 3001, 3002, 3003, 3004])
    # A token that holds a base span and reaches beyond it keeps the base span.
    assert "hex" in {s.kind for s in got[3000][1]}
    quality = secrets.held_out_quality(docs)
    assert quality["assign"][1] >= 0.95 and quality["other"][1] == quality["word"][1] == 0


def test_likelihoods_in_step_are_those_of_single_tokens():
    a = secrets.FormatAutomaton([secrets.symbols(x) for x in ("ab12", "cd34", "ee-5", "zz99z")])
    step, shown, ends = a.table()
    tokens = ["ab12", "q", "cd34cd34", "+", "ee-5"]
    sizes = np.array([len(t) for t in tokens])
    raw, to = np.frombuffer("".join(tokens).encode(), np.uint8), np.cumsum(sizes)
    for t, x in zip(tokens, secrets.bits((step, shown, ends), raw, to - sizes, to), strict=True):
        at, want = 0, 0.0
        for c in secrets.symbols(t):
            want, at = want + shown[at, secrets.SYMBOLS.index(c)], step[at, secrets.SYMBOLS.index(c)]
        assert abs(x - want - ends[at]) < 1e-9


def test_licences_wrapped_and_changed(spark):
    k = licenses.KNOWN
    wrap = lambda t, n=70: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    cases = {
        "ISC": "Copyright (c) 2020 Ann Lee\n\n" + wrap(k["ISC"]),
        "0BSD": wrap(k["0BSD"], 33),
        "MIT": wrap(k["MIT"], 50).replace("\n\nPermission", "\n\nCopyright Ann Lee, 2019\n\nPermission"),
        "BSD-3-Clause": "© 2020 Ann\nAll rights reserved.\n\n" + wrap(re.sub(r"\d\. ", "* ", k["BSD-3-Clause"])),
        "Apache-2.0-header": "/* " + wrap(k["Apache-2.0-header"]).replace("\n", "\n * ") + " */",
        "Unlicense": wrap(k["Unlicense"], 60),
        "BSL-1.0": wrap(k["BSL-1.0"]).upper(),
    }
    changed = [wrap(k["MIT"]) + "\nc) You must not use this at all.", wrap(k["MIT"]).replace("without restriction", "with restriction"), k["ISC"].replace("fee", "charge"), "copyright law forbids this\n" + k["MIT"]]
    rows = [(i, t, "x", "y") for i, t in enumerate([*cases.values(), *cases.values(), *changed, "one\nReleased under the MIT licence!\nReleased under the MIT License.\ntwo", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license_id string, canonical_sha256 string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    n = len(cases)
    assert [got[i][0] for i in range(2 * n)] == [*cases, *cases]
    assert all(got[i] == (None, []) for i in range(2 * n, 2 * n + 4))
    assert got[2 * n + 4] == (None, ["MIT-notice"]) and got[2 * n + 5] == got[2 * n + 6] == (None, [])


def test_recall_near_the_cosine(spark):
    rng = np.random.default_rng(5)
    n, pairs = 2500, 500
    base = rng.normal(size=(n, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, 48))
    side -= (side * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (pairs, 1))
    v = np.concatenate([base, c * base[:pairs] + np.sqrt(1 - c * c) * side])
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(n + pairs, [1.0, 2.0], "y"), (n + pairs + 1, [float("inf")] * 48, "z"), (0, v[0].tolist(), "twice"), (None, v[1].tolist(), "none")]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, kept string")).collect()
    assert len(got) == len(rows)
    links = (v @ v.T >= 0.95).sum(1) - 1
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sum(by[i][0].n_links for i in range(1, n + pairs)) >= 0.97 * links[1:].sum()
    assert all(by[i][0].n_links <= links[i] for i in range(2, n + pairs) if i != n)
    assert [r.n_links >= 1 for r in by[0]] == [True, True] and by[None][0].n_links == 0


def test_components_with_hubs_and_chains(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(800), rng.randrange(800)) for _ in range(500)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(900)] + [(9000 - i, 8000) for i in range(300)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a bigint, b bigint").repartition(12)
    root(7)
    got = {r.node: r.component for r in connected_components(df).collect()}
    got.setdefault(7, 7)
    assert got == {x: root(x) for x in parent}


def test_toxicity_features_by_hand():
    text = "You IDIOT!! stop?  a m0ron is here, my lake"
    batch = pa.record_batch({"text": [text, None, ""]})
    rows = next(_features(iter([batch]), np.empty(0, np.int64))).column("features").to_pylist()
    got = dict(zip(FEATURES, rows[0], strict=True))
    words = text.split()
    letters = [c for c in text if c.isascii() and c.isalpha()]
    assert got["lexicon"] == got["seeds"] == pytest.approx(2 / len(words))
    assert got["second"] == pytest.approx(1 / len(words)) and got["near_second"] == 1.0
    assert got["capitals"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters))
    assert got["shouted"] == pytest.approx(1 / len(words)) and got["obfuscated"] == pytest.approx(1 / len(words))
    assert got["exclaimed"] == pytest.approx(2 / len(words)) and got["asked"] == pytest.approx(1 / len(words))
    assert got["punctuation"] == pytest.approx(4 / sum(map(len, words))) and got["densest"] == 2
    assert rows[1] == rows[2] == [0.0] * len(FEATURES)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "idiot", 5.0), (1, "idiot", 5.0), (2, None, 5.0), (None, "", 5.0)], DOCS + ", score double")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    clean = spark.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1)], "doc_id bigint, toxic int")
    for labels in (none, clean):
        assert [r.score for r in fit_toxicity(docs, labels).score(docs).collect()] == [0.0] * 4
    rows = [(i, "you idiot scum " * (1 + i % 3) if i % 4 == 0 else "a lake and a tree " * (1 + i % 5), 1.0) for i in range(400)]
    many = spark.createDataFrame(rows, DOCS + ", features double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    got = fit_toxicity(many, labels).score(docs.withColumnRenamed("score", "features")).collect()
    assert [r.score >= 0.5 for r in sorted(got, key=lambda r: (r.doc_id or 9, r.text or ""))] == [True, True, False, False]
    assert fit_toxicity(many.limit(0), labels).score(many.limit(0)).count() == 0


def test_other_tokenizer_files_are_refused(spark):
    with pytest.raises(ValueError, match="no file for this encoder"):
        PairIndexBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a a", [1], "old"), (1, "a a", [1], "old")]
    got = encode(spark.createDataFrame(rows, DOCS + ", ids array<int>, decoded string"), public_tokenizers.path("word_bpe_49k.json"), decode=True).collect()
    assert len(got) == 2 and got[0].ids == got[1].ids != [1] and got[0].decoded != "old"


def test_long_conversations_and_more_columns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} <|", "more") for i in range(700)]
    out = format_chats(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted string").repartition(7))
    (row,) = out.select(parse_chats(out.formatted).alias("turns")).collect()
    assert [(t.role, t.text) for t in row.turns] == [r[2:4] for r in rows]


KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row bigint"


def test_pipeline_stages_on_nulls_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    passage, own = " ".join(f"p{i}" for i in range(60)), lambda i: " ".join(f"own{i}-{j}" for j in range(90))
    key = "password = abcdefgh12345678"
    rows = [(1, None), (2, ""), (3, f"start {passage} end one"), (4, f"other {passage} words two"), (5, f"see {key}"), (None, "no id"), (7, passage), (8, "long " * 30_000)]
    rows[2:4] = [(i, f"{own(i)} {passage} end") for i in (3, 4)]
    docs = spark.createDataFrame([(i, t, None, "web", 0, 1.0, 3) for i, t in rows], KINDS)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = (corpus_pipeline.cut(stage(spark, d, str(tmp_path)), name) for d in (docs, empty))
        assert empty.count() == 0
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            got = {r.doc_id: r.text for r in docs.collect()}
    # Near duplicates and toxicity keep all; the passage goes wherever it stands, and with it a text of nothing else.
    assert got == {1: None, 2: "", 3: own(3), 4: own(4), 5: "see [SECRET]", None: "no id"}
    assert {r.doc_id for r in docs.collect()} == set(got)


@pytest.mark.parametrize(
    "line",
    [
        "Copyright holders may revoke this grant at any time after 31 December 2030.", "c) 2020 and later users must pay a fee.", "© holders: no commercial use of any kind.", "Copyright year lists must be published and fees paid.",
        "Copyright 2020 notices must be paid for", "(c) You pay in 2030", "The MIT license does not apply here", "BSD license fees apply",
    ],
)
def test_sentences_are_no_statements(spark, line):
    docs = spark.createDataFrame([(i, f"{head}{k}", n) for i, (n, k) in enumerate(licenses.KNOWN.items()) for head in (f"{line}\n", f"Copyright (c) 2020 Ann\n{line}\n")], "doc_id bigint, text string, known string")
    assert licenses.scan_licenses(docs, licenses.known_licenses(spark)).filter("license_id is not null").count() == 0


def test_titles_statements_and_holders_are_no_part_of_a_text(spark):
    k = licenses.KNOWN
    mit, bsd = k["MIT"].removeprefix("MIT License\n\n"), k["BSD-3-Clause"]
    named = bsd.replace("the copyright holder nor", "Acme Widgets, Inc. nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS OF THE UNIVERSITY AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR", "ACME WIDGETS INC. OR")
    assert named != bsd and mit != k["MIT"]
    heads = ["", "The MIT License (MIT)\n\n", "MIT Licence\nCopyright (c) 2019-2021, 2023 Ann Lee <ann@example.org>\n", "Copyright © Acme Corp. 2020\n", "© Acme Inc.\n", "(c) 2020 by The Authors. All rights reserved.\n", "Copyright (c) <year> <owner>\nAll rights reserved\n", "Copyright (C) 1999, 2000 the Foo Project and contributors\n"]
    cases = [(h + mit, "MIT") for h in heads] + [(named, "BSD-3-Clause"), ("BSD 3-Clause License\n\nCopyright (c) 2020, Ann\n" + named, "BSD-3-Clause"), ("New BSD License\n" + bsd.upper(), "BSD-3-Clause"), ("MIT License", None), (mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "USERS"), None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
