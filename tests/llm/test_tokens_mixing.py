import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexloom.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def direct():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_are_exact(direct):
    count = tokens.counter()

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t\r\x1c\x1f  'sab1")), max_size=60))
    def same(text):
        assert count(text) == len(direct(text))

    same()
    for text in ("", " ", "a  b\n\n  c ", "x" * 5000, "it's  we'll\n", "<|endoftext|>", "  \n" * 300 + "é"):
        assert count(text) == len(direct(text))


def test_column(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id int, text string")
    assert [r.n for r in df.select(tokens.token_count(F.col("text")).alias("n")).collect()] == [2, 0, 0]


def tables(spark, n=3000):
    docs = [(i, " Big" if i % 10 else "SMALL\t", 10) for i in range(n)] + [(n, None, 10), (n + 1, "unlisted", 2000), (n + 2, "zero", 0)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").select("doc_id", mixing.source_key(F.col("source")).alias("source_key"), "n_tokens")
    targets = spark.createDataFrame([("big", 0.6, 3), ("Small", 0.3, 2), ("zero", 0.05, 5), ("absent", 0.05, 1), (None, 0.1, 1), ("unset", None, 1)], "source string, target_share double, max_repeats int")
    return sizes, targets


@pytest.mark.parametrize("limit", [mixing.BROADCAST_SOURCES, 0])
def test_draws_reach_their_shares(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    sizes, targets = tables(spark)
    rates = mixing.repetition_rates(sizes, targets)
    got = {r.source: r for r in rates.collect()}
    total = 3000 * 10 + 10 + 2000
    assert got["big"].all_tokens == total and abs(got["big"].rate - 0.6 * total / 27000) < 1e-12 and got["Small"].rate == 2.0
    assert got["zero"].rate == got["absent"].rate == got["unset"].rate == 0.0 and None not in got
    assert {r.source for r in mixing.short_sources(rates).collect()} == {"Small", "zero", "absent"}
    plan = mixing.solved(rates)
    solved_ = {r.source: r for r in plan.collect()}
    assert {n for n, r in solved_.items() if r.capped} == {"Small", "zero", "absent"}
    drawn_total = 2 * 3000 / (0.3 + 0.05 + 0.05)  # what the capped sources have, over their targets
    assert abs(solved_["big"].total - drawn_total) < 1e-6 and abs(solved_["big"].rate - 0.6 * drawn_total / 27000) < 1e-9 and solved_["Small"].rate == 2.0 and solved_["unset"].rate == 0.0
    drawn = mixing.draws(sizes, mixing.calibrated(sizes, plan))
    per = {r.source: (r.n, r.most) for r in drawn.groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("most")).collect()}
    assert per["Small"] == (600, 2) and per["big"][1] == 1 and set(per) == {"big", "Small"}
    assert sorted(map(str, drawn.collect())) == sorted(map(str, mixing.draws(sizes.repartition(5), mixing.calibrated(sizes, plan)).collect()))
    shares = {r.source: r.reached_share for r in mixing.reached_shares(drawn, plan).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["absent"] == 0 and abs(shares["big"] - 0.6) < 0.002
    plain = mixing.draws(sizes, plan)  # without a cut the fraction itself decides
    assert abs(plain.where("source = 'big'").count() / 2700 - solved_["big"].rate) < 0.03


@pytest.mark.parametrize("zero", [True, False])
def test_targets_that_only_empty_sources_miss_are_given_to_the_others(spark, zero):
    docs = [(i, "a" if i % 3 else "b", 1 + i % 7) for i in range(3000)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source_key string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 9), ("b", 0.3 if zero else 0.5, 9), ("none", 0.2, 1)][: 3 if zero else 2], "source string, target_share double, max_repeats int")
    plan = mixing.solved(mixing.repetition_rates(sizes, targets))
    rows = {r.source: r for r in mixing.reached_shares(mixing.draws(sizes, mixing.calibrated(sizes, plan)), plan).collect()}
    want = {"a": 0.625, "b": 0.375} if zero else {"a": 0.5, "b": 0.5}
    assert all(abs(rows[s].reached_share - w) < 0.005 for s, w in want.items()) and not any(rows[s].capped for s in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no data")
def test_uncapped_sources_have_their_share(spark):
    from vertexloom.llm import queries

    rows = queries.p7_shares(spark, "/root/testdata/sf0.01").collect()
    assert sum(not r.capped for r in rows) >= 5 and abs(sum(r.reached_share for r in rows) - 1) < 1e-9
    for r in rows:
        assert r.capped or abs(r.reached_share / r.target_share - 1) < 0.05, r  # some have few documents
    assert queries.p7_checks(spark, "/root/testdata/sf0.01").collect()[0].n_off_target == 0


def test_mixing_of_nothing(spark):
    sizes, targets = tables(spark, 10)
    rates = mixing.repetition_rates(sizes.where("false"), targets)
    assert all(r.rate == 0 for r in rates.collect()) and mixing.short_sources(rates).count() == 0
    plan = mixing.solved(rates)
    assert mixing.draws(sizes, plan).count() == 0 and mixing.calibrated(sizes, plan).count() == plan.count()
    assert {r.reached_share for r in mixing.reached_shares(mixing.draws(sizes, plan), plan).collect()} == {0.0}
    assert mixing.repetition_rates(sizes, targets.where("false")).count() == 0
