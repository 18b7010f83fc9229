import numpy as np
from llm_tables import clashing

from kgloom.llm import quality as Q


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_features_by_hand():
    texts = ["Ab Ab c", "", "xyz"]
    parts = list(Q._features(texts))
    words, at = parts[0]
    assert list(np.diff(at)) == [3, 0, 1] and words[0] == words[1] != words[2]
    pairs, at = parts[1]
    assert list(pairs > 0) == [True, True, False, False]  # of "Ab Ab c" two pairs; one word has none
    tri, at = parts[2]
    assert [int((tri[a:b] > 0).sum()) for a, b in zip(at[:-1], at[1:])] == [5, 0, 3]  # "\nAb", "Ab ", " Ab", "Ab ", " c\n"; "\nxy", "xyz", "yz\n"
    repeat = list(Q._features(["q q q"]))[1][0]
    assert repeat[0] == repeat[1] == pairs[0]  # all immediate repetitions are one feature


def test_a_score_does_not_depend_on_other_texts(words):
    texts = [words(1, 5), "", "a", None, words(2, 5).upper()]
    m = Q.fit([words(i, 30) if i % 2 else words(i, 30).upper() for i in range(40)], np.arange(40) % 2)
    alone = [m.good([t])[0] for t in texts]
    assert np.allclose(m.good(texts), alone, equal_nan=True) and np.isnan(alone[1]) and np.isnan(alone[3])


def test_scores_equal_the_network(words):
    texts = [words(i, 60) if i % 2 else words(i, 60).upper() for i in range(60)]
    m = Q.fit(texts, np.arange(60) % 2)
    got = m.good(texts)
    for t, p in zip(texts[:10], got):
        ids, share = Q.bags([t])[0]
        z = (m.weights[ids] * share[:, None]).sum(0) + m.bias
        assert abs(1 / (1 + np.exp(z[0] - z[1])) - p) < 1e-5


def reference(texts, y, steps, seed=5):
    """The same network written plainly: counts of features for each text, full matrices, a gradient step a batch; probabilities of the good class."""
    rng, n = np.random.default_rng(seed), 512
    x = np.zeros((len(texts), n))
    for r, t in zip(x, texts):
        for ids, _ in Q._features([t], n):
            for i in ids[ids > 0]:
                r[i] += 1
        r /= max(1, r.sum())
    train = [i for i in range(len(texts)) if i % Q.HELD_OUT != Q.HELD_OUT - 1]
    emb, out, bias = rng.uniform(-1 / Q.DIM, 1 / Q.DIM, (n, Q.DIM)), np.zeros((Q.DIM, 2)), np.zeros(2)
    share = [sum(y[i] == c for i in train) / len(train) for c in (0, 1)]
    queue = []
    for step in range(steps):
        while len(queue) < Q.BATCH:
            queue += rng.permutation(train).tolist()
        batch, queue = queue[: Q.BATCH], queue[Q.BATCH :]
        h = x[batch] @ emb
        p = np.exp(h @ out + bias)
        p /= p.sum(1, keepdims=True)
        loss = np.array([[(p[k, c] - (y[i] == c)) * 0.5 / share[y[i]] / len(batch) for c in (0, 1)] for k, i in enumerate(batch)])
        rate = Q.RATE * (1 - step / steps)
        grad = x[batch].T @ (loss @ out.T)  # as in operator and paper, the step on the vectors is not divided by the batch
        out -= rate * h.T @ loss
        bias -= rate * loss.sum(0)
        emb -= rate * len(batch) * grad
    p = np.exp(x @ emb @ out + bias)
    return p[:, 1] / p.sum(1)


def test_equals_a_plain_network(words):
    texts = [words(i, 20) if i % 3 else words(i, 20).upper() for i in range(50)]
    y = [int(i % 3 > 0) for i in range(50)]
    m = Q.fit(texts, np.array(y), buckets=512, steps=400)
    assert np.abs(m.good(texts) - reference(texts, y, 400)).max() < 1e-3 and np.ptp(m.good(texts)) > 0.2


def test_labels_of_unknown_documents_use_nothing_up(spark, docs, words):
    rows = [(i, words(i, 40) if i % 2 else words(i, 40).upper()) for i in range(100)]
    lab = labelled(spark, [(i, i % 2, 0) for i in range(100)] + [(10_000 + i, 0, 0) for i in range(3000)])
    assert sum(r["keep"] for r in Q.score(docs(rows), lab, 90).collect()) == 50


def test_held_out_accuracy(spark, words):
    import duckdb

    rows = duckdb.sql("SELECT text, quality FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY hash(doc_id) LIMIT 1600").fetchall()
    m = Q.fit([t for t, _ in rows[:1000]], np.array([q for _, q in rows[:1000]]))
    p, y = m.good([t for t, _ in rows[1000:]]) >= m.cut, np.array([q for _, q in rows[1000:]])
    assert p[y == 1].mean() > 0.985 and (~p[y == 0]).mean() > 0.9


def test_edge_cases(spark, docs, words):
    rows = [(i, words(i, 40) if i % 2 else words(i, 40).upper()) for i in range(200)]
    lab = labelled(spark, [(i, i % 2, 0) for i in range(150)] + [(3, 0, 0), (None, 1, 0), (7, None, None), (10, 5, 0), (99999, 1, 0)])
    extra = [(500, None), (501, ""), (502, " \n"), (None, words(1, 40)), (503, words(503, 200_000)), (1, words(1, 40))]
    got = {}
    for r in Q.score(clashing(docs(rows + extra)), lab).collect():
        got.setdefault(r["doc_id"], []).append((r["p_good"], r["keep"]))
    assert got[500] == got[501] == got[502] == [(None, False)]
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[None][0] == got[1][0] and got[503][0][1]
    kept = [i for i in range(150, 200) if got[i][0][1]]
    assert kept == [i for i in range(150, 200) if i % 2]
    assert Q.score(docs([]), lab).collect() == []
    free = Q.score(docs(rows[:3] + [(9, None)]), labelled(spark, [])).orderBy("doc_id").collect()
    assert [(r["p_good"], r["keep"]) for r in free] == [(0.5, True)] * 3 + [(None, False)]


def test_keep_good_keeps_columns_and_order_of_decision(spark, docs, words):
    rows = [(i, words(i, 40) if i % 2 else words(i, 40).upper()) for i in range(120)]
    lab, d = labelled(spark, [(i, i % 2, 0) for i in range(100)]), clashing(docs(rows))
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in Q.score(d, lab).where("keep").collect()}


def test_training_is_bounded_and_repeatable(spark, docs, words):
    rows = [(i, words(i, 30)) for i in range(60)]
    lab = labelled(spark, [(i, i % 2, 0) for i in range(60)])
    a, b = Q.train(docs(rows), lab, 20), Q.train(docs(rows).repartition(5), lab, 20)
    assert (a.weights == b.weights).all() and a.cut == b.cut and a.held_out["n"] == 4
