"""Shapes of whole texts against brute force."""

import unicodedata

from palimpsest.plans import registry


def shape(text):
    kind = [unicodedata.category(c) for c in text]
    return "".join("L" if k[0] == "L" else "D" if k == "Nd" else "?" for k in kind)


def test_whole_texts_have_shapes(spark, tmp_path):
    texts = {1: None, 2: "", 3: "Ab 1-é " * 30, 4: "x" * 40 + "7!"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.shape for r in registry.queries()["v12_char_shape_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else shape(t) for i, t in texts.items()}
