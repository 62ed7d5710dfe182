import corpus_pipeline
from isofold.llm import pseudonyms
from isofold.llm.queries import QUERIES, SQL

from . import brute


def test_stages(spark, docs, rows, sf):
    now = docs.drop("row", "fp", "key", "words")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        kept.append((name, out.toPandas()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
            now = spark.createDataFrame(out.collect(), out.schema)
    text = {r[0]: r[1] for r in rows}
    # language: what has no letter goes
    first = [d for d, t in text.items() if t is not None and any(c.isalpha() for c in t)]
    assert sorted(kept[0][1]["doc_id"]) == sorted(first)
    # near duplicates: the smallest id of each group stays
    groups = brute.simhash([(d, text[d]) for d in first])
    second = [d for d in first if groups[d][1] == d]
    assert sorted(kept[1][1]["doc_id"]) == sorted(second)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    third = [d for d, c in brute.contamination([(d, text[d]) for d in second], items).items() if not c[4]]
    assert sorted(kept[2][1]["doc_id"]) == sorted(third)
    worker = pseudonyms.Pseudonymizer()
    assert dict(zip(kept[3][1]["doc_id"], kept[3][1]["text"])) == {d: worker(text[d])[0] for d in third}
    sizes = {d: len(brute.WORD.findall(worker(text[d])[0])) for d in third}
    last = kept[4][1]
    assert dict(zip(last["doc_id"], last["size"])) == sizes and (last["taken"] <= 2 * last["size"]).all()


def test_benchmark_passages_go(spark, docs, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    own = spark.createDataFrame([(1, item), (2, item + " more"), (3, "clean text of words")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, own, sf).collect()] == [3]


def test_repeated_rows_leave_one(spark, sf):
    own = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (None, "x y z w"), (9, "other words stand here")], "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, own, sf).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [5, 9] and len(out) == 3


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, gone int, pii_counts string, row string, fp string, key string, words string, text_key string, own_text_key string, `a.b` string, own_row int"


def test_clashing_columns_come_out_as_they_went_in(spark, sf):
    rest = (7.5, "mine", 3, "none", "r", "f", "k", "w", "t", "o", "dot", 9)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    texts = ["some words of a text", "some words of a text", "call +1 (521) 555-2373 now", item, "an entirely different text here"]
    rows = [(i, t, "en", "s", len(t), rest[0] + i, *rest[1:]) for i, t in enumerate(texts)]
    now = spark.createDataFrame(rows, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        got = {r["doc_id"]: tuple(r) for r in out.collect()}
        assert all(v[5:] == rows[d][5:] for d, v in got.items())
        now = spark.createDataFrame(list(got.values()), ODD)
    assert set(got) == {0, 2, 4} and got[2][1] != texts[2] and got[0][:5] == rows[0][:5]
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == 3


def test_empty_table(spark, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), sf).count() == 0


def test_rows_are_judged_by_their_own_text(spark, sf):
    """A repeated id neither drops the other text under it nor links what stands under it."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    other, third = "another unique text stands under this id", "quite something else is said in here"
    rows = [(1, "a copied text of words"), (9, "a copied text of words"), (9, other), (9, third), (None, third), (3, other + " and more words follow"), (None, None), (None, "")]
    schema = "doc_id long, text string"
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5], next(tuple(r) for r in out if not r["text"])]))
    rows = [(1, item), (1, "a clean text under that id"), (None, item), (None, "clean as well")]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert sorted(r["text"] for r in out) == ["a clean text under that id", "clean as well"]


def test_repeated_rows_choice_is_fixed(spark, sf):
    rows = [(1, "same text here now", x) for x in ("b", "a", None, "c")] + [(2, "same text here now", "0")]
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3), sf).collect()
        assert [tuple(r) for r in out] == [(1, "same text here now", "a")]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() > 100


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_another_key_gives_the_same_mixture(spark):
    """What pseudonyms replace has no say in what the mix takes."""
    rows = [(i % 150 if i % 3 else None, f"word{i % 7} " * (i % 40 + 1) + f"mail person{i}@example-mail{i % 5}.com or +1 (521) 555-{1000 + i} from 10.{i % 250}.3.4", f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for key in (b"one key of this test", b"another key of this test"):
        now = pseudonyms.pseudonymized(docs, key, counts=None)
        seen.append((sorted(r["text"] for r in now.collect()), sorted((tuple(r) for r in corpus_pipeline.mix_sources(spark, now, "").select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)))
    assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1]
