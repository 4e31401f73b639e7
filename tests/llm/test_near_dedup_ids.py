"""Near-dedup where ids are missing, and below the usual percentage."""

from reweave.llm import near_dedup


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_texts_without_an_id_link_others(spark):
    # with one word a shingle: 0..100 and 8..108 are 0.85 alike, 16..116 and 8..108 too, 0..100 and 16..116 only 0.72
    rows = [(1, words(0, 100)), (None, words(8, 108)), (2, words(16, 116)), (None, words(500, 600)), (None, words(500, 601)), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_dedup(docs, shingle_words=1).collect()]
    assert {(1, 1, True, 100), (None, 1, False, 100), (2, 1, False, 100)} <= set(got)
    pair = [x for x in got if x[0] is None and x[1] is None and x[3] in (100, 101)]
    assert len(pair) == 2 and sorted(x[2] for x in pair) == [False, True]
    assert sorted(x[2] for x in got if not x[3]) == [True, True]
    one = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.keep_one(one, shingle_words=1).collect()] == [1]


def test_small_sets_below_80_percent(spark):
    rows = [(100 * k + n, " ".join(f"g{k}x{i}" for i in range(n))) for k in range(12) for n in (2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, shingle_words=1, percent=70).collect()}
    assert got == {100 * k + n: 100 * k + (2 if n == 2 else 3) for k in range(12) for n in (2, 3, 4)}
    half = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, shingle_words=1, percent=60).collect()}
    assert half == {100 * k + n: 100 * k + 2 for k in range(12) for n in (2, 3, 4)}
