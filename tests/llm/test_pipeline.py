import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from runfold.llm import bpe, mixing
from runfold.llm._common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(11)
    words = {"en": ["the", "house", "water", "think", "light"], "fr": ["maison", "lumière", "eaux", "pense", "les"]}
    rows = []
    for i in range(120):
        k = "fr" if i % 3 == 0 else "en"
        rows.append([i, " ".join(f"{rnd.choice(words[k])}{rnd.choice(['', 's', 'e'])}" for _ in range(60)), k, f"src{i % 4}", 0])
    rows[5][1] = rows[4][1]
    rows[6][1] = rows[4][1] + " more"
    rows[7][1] += " password=abcdef1234"
    rows += [[500, None, "en", "src0", None], [501, "123 !!", "en", "src0", 6], [502, "water light house " * 9, None, None, None], [4, rows[4][1], "en", "src0", 0]]
    return [(r[0], r[1], r[2], r[3], len(r[1]) if r[4] == 0 else r[4]) for r in rows]


def test_stages(spark, made, tmp_path):
    docs = spark.createDataFrame(made, DOCS)
    one = cp.language_id(spark, docs, "")
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in one.collect()} == {500, 501}
    assert one.where("doc_id = 502").first().lang == "en" and one.columns == cp.COLUMNS
    two = cp.near_duplicates(spark, one, "")
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in two.collect()} == {5, 6} and two.where("doc_id = 4").count() == 1
    three = cp.secret_scan(spark, two, "")
    r = three.where("doc_id = 7").first()
    assert r.text.endswith(" " + cp.MARK) and r.n_chars == len(r.text)
    same = three.where("doc_id <> 7").exceptAll(two.where("doc_id <> 7").select(*three.columns))
    assert same.count() == 0 and three.count() == two.count()
    four = cp.mixture(spark, three, "")
    assert 0 < four.count() <= three.count() and four.columns == cp.COLUMNS
    model = bpe.Bpe(tokenizer_path())
    texts = {r.doc_id: r.text for r in four.collect()}
    for r in cp.token_ids(spark, four, "").collect():
        assert r.ids == model.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_gives_what_the_stages_should(spark, made, tmp_path):
    """End to end against a plain version: who is left, with what text, and the ids that the other library gives it."""
    from tokenizers import Tokenizer

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(made, DOCS).withColumns({"shard": F.lit(1), "_p": F.lit(2)}).repartition(3).write.parquet(path)
    got = [(r.doc_id, r.lang, r.source, list(r.ids), r.n_tokens) for r in cp.run(spark, str(tmp_path)).collect()]
    left = {r[0]: r for r in made if r[0] not in (5, 6, 500, 501)}  # copies, and what has no letters; row 4 is there twice
    rows = [(i, t.replace("password=abcdef1234", cp.MARK), lang or "en", source, 0) for i, t, lang, source, _ in left.values()]
    measured = mixing.measure(spark.createDataFrame(rows, DOCS), keep=("doc_id", "source", "lang"))
    kept = {r.doc_id for r in mixing.draw(measured, mixing.plan(measured)).where("_kept").collect()}
    lib = Tokenizer.from_file(tokenizer_path())
    want = [(i, lang, source, x := lib.encode(t, add_special_tokens=False).ids, len(x)) for i, t, lang, source, _ in rows if i in kept]
    assert sorted(got, key=repr) == sorted(want, key=repr) and 0 < len(got) < len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_near_duplicates_are_rows_not_ids(spark):
    """Two texts with one id are told apart, the copy goes and the clean one stays; rows without an id are deduplicated."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    made = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, c), (None, "e " + b), (None, "x y z"), (None, "x y z"), (None, "x y z"), (7, "x y w")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in made], DOCS).repartition(4)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (None, "x y z"), (7, "x y w")], key=repr)
