import corpus_pipeline as C
import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = [(i, f"unique document {i} " + " ".join(f"w{i * 7 + k}" for k in range(30)), "en", "s", 10) for i in range(20)]
    docs += [(30, docs[0][1].upper(), "en", "s", 10), (31, docs[1][1], "en", "s", 10), (32, None, None, None, None), (33, "mail me a@b.example.com", "en", "s", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_keep_columns_and_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["toxicity"]) == {*range(20), 30, 31, 32, 33}
    assert {0, 1} & set(kept["exact dedup"]) == set() and {30, 31} <= set(kept["exact dedup"])
    assert kept["pii"][33] != "mail me a@b.example.com" and kept["pii"][32] is None
    assert C.run(spark, tables).select("doc_id").distinct().count() == len(kept["pii"])


def test_dedup_stages_keep_one_row_of_each_group(spark):
    text = lambda i: " ".join(f"v{i * 50 + k}" for k in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    a, b, c, d = map(text, range(4))
    near = make([(5, a), (5, b), (3, b), (7, c), (7, c.upper()), (7, c), (None, d), (None, d), (None, b)])
    got = kept(C.drop_near_copies(spark, near, ""))
    assert [t.lower() for _, t in got] == [b, a, c, d] and [i for i, _ in got] == [3, 5, 7, None]
    exact = make([(5, a), (5, b), (9, b), (None, b), (8, c), (8, c), (None, d), (None, d)])
    assert kept(C.drop_exact_copies(spark, exact, "")) == sorted([(5, a), (9, b), (8, c), (None, d)], key=str)
