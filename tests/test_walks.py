from collections import Counter

from vertexloom.operators import graph


def test_two_step_walks_over_hot_keys(spark):
    pairs = [(n % 97 + 1, 0) for n in range(300)] + [(0, n % 53 + 100) for n in range(300)] + [(0, 0), (7, None), (None, 7), (150, 7), (5, 150)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    onward = Counter(a for a, b in pairs if a is not None and b is not None)
    want = Counter()
    for a, b in pairs:
        if a is not None and b is not None and onward[b]:
            want[a] += onward[b]
    walks = graph.two_step_walks(edges)
    assert {r.fid: r.n_walks for r in walks.collect()} == dict(want)
    assert "_salt" in walks._jdf.queryExecution().analyzed().toString()
