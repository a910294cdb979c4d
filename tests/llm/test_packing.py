import random

import pytest

from vertexloom.llm import packing


def check(placed, sizes, capacity):
    spans = {}
    for (bin_, offset, size), want in zip(placed, sizes):
        assert size == want and offset + size <= capacity
        spans.setdefault(bin_, []).append((offset, offset + size))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    return spans


def plain(sizes, capacity, k):
    """The same rule with a list instead of a bitset."""
    open_, out, n = [], [], 0
    for s in sizes:
        if s == capacity:
            out.append(n)
            n += 1
            continue
        fit = [b for b in open_ if b[0] >= s]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            if len(open_) == k:
                open_.remove(min(open_, key=lambda b: b[0]))
            b = [capacity, n]
            n += 1
            open_.append(b)
        out.append(b[1])
        b[0] -= s
        if not b[0]:
            open_.remove(b)
    return n


@pytest.mark.parametrize("k", [1, 4, 64])
def test_best_fit(k):
    rnd = random.Random(k)
    sizes = [rnd.randint(1, 100) for _ in range(800)]
    spans = check(list(packing.best_fit(sizes, 100, k)), sizes, 100)
    assert len(spans) == plain(sizes, 100, k)
    assert len({b for b, _, _ in packing.best_fit([60, 100, 40], 100, 1)}) == 2
    assert list(packing.best_fit([], 10)) == [] and list(packing.best_fit([10, 10], 10, 1)) == [(0, 0, 10), (1, 0, 10)]


def test_pack_sizes(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0, None, 3, 50, 99, 100, 101, 250, 1000])) for i in range(600)] + [(7, 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    out = packing.pack_sizes(df, 100, 8, lane_rows=100).collect()
    by_bin, by_doc = {}, {}
    for r in out:
        if r.container is not None:
            by_bin.setdefault(r.container, []).append((r.container_offset, r.n_tokens))
        by_doc.setdefault(r.doc_id, []).append(r)
    for items in by_bin.values():
        items.sort()
        end = 0
        for offset, n in items:
            assert offset == end and n > 0
            end += n
        assert end <= 100
    for doc, n in rows[:-1]:
        if doc != 7:
            got = by_doc[doc]
            assert sum(r.n_tokens for r in got) == (n or 0) and len(got) == got[0].n_pieces == max(1, -(-(n or 0) // 100))
            assert all((r.container is None) == (r.n_tokens == 0) for r in got)
    again = packing.pack_sizes(df.repartition(7), 100, 8, lane_rows=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    report = packing.fill_report(packing.pack_sizes(df, 100, 8), 100).collect()[0]
    assert 0.9 < report.fill <= 1
    assert packing.pack_sizes(df.where("false"), 100).count() == 0
    assert packing.fill_report(packing.pack_sizes(df.where("false"), 100), 100).collect()[0].fill is None
    with pytest.raises(ValueError):
        packing.pack_sizes(df, 0)
