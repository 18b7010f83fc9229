import corpus_pipeline as P
from llm_tables import clashing
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_groups

from kgloom.llm import near_dedup, packing, quality


def test_stages_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    ids = list(rows)
    kept = {i: rows[i] for i, p in zip(ids, model.good([rows[i] for i in ids])) if p >= model.cut}
    one = P.quality_stage(spark, docs, data)
    assert one.columns == docs.columns and {r["doc_id"]: r["text"] for r in one.collect()} == kept
    dropped = {}
    lines = brute_lines(list(kept.items()), dropped)
    lines = {i: t for i, t in lines.items() if i not in dropped or t.replace("\n", " ").strip(" ")}
    two = P.line_dedup_stage(spark, one, data)
    assert two.schema == docs.schema and {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == {i: (t, len(t)) for i, t in lines.items()}
    gone = brute_groups(list(lines.items()), near_dedup.THRESHOLD)
    three = P.near_dedup_stage(spark, two, data)
    left = {r["doc_id"]: r["text"] for r in three.collect()}
    assert set(left) == set(lines) - set(gone)
    four = P.packing_stage(spark, three, data).collect()
    tokens = {r["doc_id"]: r["n_tokens"] for r in packing.with_token_counts(three).collect()}
    packed = {}
    for r in four:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: n for i, n in tokens.items() if n}
    assert sorted(map(tuple, P.run(spark, data).collect())) == sorted(map(tuple, four))


def test_stages_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near dedup", "packing"] and P.ORACLE_SQL is None


def test_edge_cases(spark, docs, data, words):
    good = "The and attion to thanedble the, anea. Eriner thanea."
    rows = [(1, None), (2, ""), (3, good + " " + words(1, 50)), (3, good + " " + words(1, 50)), (None, words(2, 50)), (4, words(3, 100_000)), (5, "a\nb c\n" + words(4, 9))]
    d = clashing(docs(rows))
    for _, stage in P.STAGES:
        out = stage(spark, d, data)
        if stage is not P.packing_stage:
            assert out.columns == d.columns
        out.collect()
    one = docs([])
    for _, stage in P.STAGES:
        assert stage(spark, one, data).collect() == []
    lost = P.line_dedup_stage(spark, docs([(1, "one two three"), (2, "one two three"), (3, None), (4, "")]), data)
    assert sorted(r["doc_id"] for r in lost.collect()) == [1, 3, 4]
    bare = P.line_dedup_stage(spark, docs([(1, "one two three"), (2, "one two three\nfour five six")]).drop("n_chars"), data)
    assert bare.columns == ["doc_id", "text", "lang", "source"] and {r["doc_id"]: r["text"] for r in bare.collect()} == {1: "one two three", 2: "four five six"}
