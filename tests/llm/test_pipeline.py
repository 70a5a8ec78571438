"""Each stage's decision on its own input, and the registration of the optional queries."""

import corpus_pipeline as P
from rillstone.llm import queries
from test_corpus import TWINS

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    a = P.toxicity(spark, docs, SF).cache()
    scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in a.collect()} == {i for i, p in scored.items() if not p} and a.columns == docs.columns
    b = P.near_dedup(spark, a, SF).cache()
    classes = {r.doc_id: r.class_id for r in queries.near_duplicates(a).collect()}
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(classes.values())) and b.columns == docs.columns
    c = P.substrings(spark, b, SF).cache()
    assert c.count() == b.count() and c.columns == docs.columns and c.where("n_chars <> length(text)").isEmpty()
    d = P.mixing(spark, c, SF).cache()
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    e = P.pieces(spark, d, SF)
    assert e.count() == d.count() and e.where("NOT round_trip").isEmpty()


def test_substrings_compares_words(spark):
    lead = " ".join(f"v{i}" for i in range(49))
    rows = [(k, f"{lead}\n{w}", "en", "s", 0) for k, w in enumerate((*TWINS, TWINS[1]))]
    got = P.substrings(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert {r.doc_id: r.text for r in got.collect()} == {0: rows[0][1], 1: rows[1][1], 2: ""}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
