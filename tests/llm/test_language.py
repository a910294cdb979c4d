import collections
import itertools
import os
import random
from math import log2

import numpy as np
import pytest

from vertexloom.llm import language, ppm


def code_length(lines, order):
    """Prediction by partial matching written down plainly."""
    counts = collections.defaultdict(collections.Counter)
    for line in lines:
        s = b"\n" + line + b"\n"
        for i in range(1, len(s)):
            for k in range(min(order, i) + 1):
                counts[s[i - k : i]][s[i]] += 1

    def cost(line):
        s, bits = b"\n" + line + b"\n", 0.0
        for i in range(1, len(s)):
            for k in range(min(order, i), -1, -1):
                seen = counts.get(s[i - k : i])
                if seen:
                    n, kinds = sum(seen.values()), len(seen)
                    if seen[s[i]]:
                        bits -= log2(seen[s[i]] / (n + kinds))
                        break
                    bits -= log2(kinds / (n + kinds))
            else:
                bits += 8
        return bits

    return cost


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths_equal_brute_force(order):
    rnd = random.Random(order)
    lines = {a: [bytes(rnd.choice(b"abcd \xc3\x00") for _ in range(rnd.randint(0, 12))) for _ in range(30)] for a in "xyz"} | {"none": []}
    model = ppm.train(lines, order)
    tests = [bytes(rnd.choice(b"abcde f\xff\x00") for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [b"", b"q" * 300]
    want = [[code_length(lines[a], order)(t) for a in model.languages] for t in tests]
    for block in (7, 16, 1 << 16):
        assert np.abs(model.score(tests, block) - want).max() < 2e-2
    assert model.score([]).shape == (0, 4)


def best_split(costs, switch, shortest):
    n, langs = costs.shape
    best = (np.inf, None)
    for labels in itertools.product(range(langs), repeat=n):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(labels)]
        if len(runs) > 1 and min(r for _, r in runs) < shortest:
            continue
        best = min(best, (sum(costs[i, x] for i, x in enumerate(labels)) + switch * (len(runs) - 1), labels))
    return best[0]


def test_segments_equal_brute_force():
    rnd = np.random.default_rng(4)
    sizes = np.array([0, 1, 3, 7, 9, 9, 8, 5, 4, 9])
    costs = rnd.uniform(0, 10, (sizes.sum(), 2))
    labels = ppm.segment(costs, sizes, 2.0, 2)
    at = 0
    for n in sizes:
        own, c = labels[at : at + n], costs[at : at + n]
        if n:
            runs = [len(list(g)) for _, g in itertools.groupby(own)]
            assert len(runs) == 1 or min(runs) >= 2
            assert abs(sum(c[i, x] for i, x in enumerate(own)) + 2.0 * (len(runs) - 1) - best_split(c, 2.0, 2)) < 1e-3
        at += n
    assert len(ppm.segment(np.zeros((0, 2)), np.array([0, 0]), 1.0, 5)) == 0


def test_key_table():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 60, 5000).astype(np.uint64))
    t = ppm.KeyTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1 << 61)) == -1).all()


SHELL = ['for f in "$DIR"/*.txt; do', '  cp "$f" /tmp || exit 1', "done", "set -euo pipefail", 'echo "$x" | grep -q y', "export A=b"]
ENGLISH = ["The index keeps every row until it is written.", "Please note that the server is slower.", "If you want to change the file, edit it first.", "There are several ways to build it.", "This is the end of the report."]


def texts(lines, n, seed):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(lines) for _ in range(8)) for _ in range(n)]


def frames(spark):
    rows = [(i, t, "SH ", f"a/{i}.sh") for i, t in enumerate(texts(SHELL, 30, 1))] + [(100 + i, t, "english", f"b/{i}.txt") for i, t in enumerate(texts(ENGLISH, 30, 2))]
    mixed = "\n".join(ENGLISH * 2) + "\n\n```\n" + "\n".join(SHELL * 2) + "\n```\n"
    rows += [
        (200, mixed, "en", "m.md"), (201, mixed, "ruby", "m.md"), (202, "\n".join(SHELL), "en", "x.txt"), (203, "\n".join(ENGLISH), None, None), (204, "", "en", "e.txt"), (205, None, "en", "e.txt"),
        (206, "123\n---", "en", "e.txt"), (207, "\n".join(ENGLISH[:4] + SHELL[:2]), "en", "f.txt"), (208, " \n".join(ENGLISH * 2000), "en", "g.txt"), (None, "\n".join(SHELL), "en", "x.txt"), (209, "\n".join(ENGLISH).replace("\n", "\r\n"), " EN", "h.txt"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, path string, label string")
    langs = spark.createDataFrame([("shell", ["sh"], [".sh"]), ("en", ["english"], [".txt", ".md"]), ("ruby", None, [".rb"])], "lang_code string, aliases array<string>, file_exts array<string>")
    return docs, langs


def test_found_on_a_small_corpus(spark):
    docs, langs = frames(spark)
    model = language.language_model(docs, langs)
    identified = language.identify(docs, model)
    rows = {r.doc_id: r for r in identified.collect()}
    assert {204, 205, 206}.isdisjoint(rows) and rows[208].language == "en" and rows[209].language == "en"
    assert [(s.language, s.first_line, s.n_lines) for s in rows[200].segments][0][:2] == ("en", 0) and rows[200].language == ""
    found = {(r.doc_id, r.issue, r.true_lang) for r in language.label_issues(identified, langs).collect()}
    assert found == {
        (200, "mixed", "en"), (200, "mixed", "shell"), (201, "wrong", ""), (201, "mixed", "en"), (201, "mixed", "shell"), (202, "wrong", "shell"), (None, "wrong", "shell"), (203, "missing", "en"),
    }
    assert all(0.5 <= r.confidence <= 1 for r in rows.values())
    assert language.identify(docs.where("false"), model).count() == 0


def test_no_labels_at_all(spark):
    docs, langs = frames(spark)
    model = language.language_model(docs.where("false"), langs)
    assert model.languages == ["en", "ruby", "shell"] and np.allclose(model.score([b"abc"]), 32.0)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no data")
def test_held_out_accuracy(spark):
    """Documents whose extension confirms the label of a code language, none of them in the sample: nearly all must be found right."""
    d = "/root/testdata/sf0.01"
    docs, langs = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/languages.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language.language_model(train, langs)
    named = language.label_codes(langs).join(langs.where("lang_kind = 'code'").selectExpr("lang_code", "explode(file_exts) AS ext"), "lang_code")
    truth = held.selectExpr("doc_id", "lang", "regexp_extract(path, '([.][^./]*)$', 1) AS ext").withColumn("label_key", language.label_key(held["lang"])).join(named, ["label_key", "ext"])
    rows = truth.join(language.identify(held, model), "doc_id").selectExpr("exists(segments, s -> s.language = lang_code) AS ok").collect()
    assert len(rows) > 150 and sum(r.ok for r in rows) / len(rows) > 0.95


def test_a_mapped_model_scores_as_the_model(tmp_path):
    rnd = random.Random(3)
    lines = {a: [bytes(rnd.choice(b"abcd") for _ in range(9)) for _ in range(20)] for a in "xy"}
    model = ppm.train(lines)
    data, description = ppm.shared_arrays(model)
    (tmp_path / "m").write_bytes(data)
    back = ppm.mapped(str(tmp_path / "m"), description)
    assert back.languages == model.languages and (back.score(lines["x"] + [b"q\xff"]) == model.score(lines["x"] + [b"q\xff"])).all()


def test_confidence_is_borne_out(spark):
    """Among short pieces of labelled texts, those with more confidence are right more often, and those that are sure nearly always."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no data")
    from vertexloom.common import table

    d = "/root/testdata/sf0.01"
    documents, languages = table(spark, d, "documents"), table(spark, d, "languages")
    model = language.language_model(documents.where("doc_id % 2 = 0"), languages)
    held = [tuple(r) for r in language.training_sample(documents.where("doc_id % 2 = 1"), languages, 15).collect()]
    rnd = random.Random(1)
    pieces = [(code, line) for code, text in held for line in rnd.sample(text.split("\n"), min(12, text.count("\n") + 1)) if sum(c.isalpha() for c in line) > 1]
    found = language.describe(model, [line for _, line in pieces])
    bins = {True: [], False: []}
    for (code, _), (got, sure, _) in zip(pieces, found):
        bins[sure >= 0.9].append(got == code)
    rate = {k: sum(v) / max(len(v), 1) for k, v in bins.items()}
    assert len(bins[True]) > 100 and len(bins[False]) > 100 and rate[True] > rate[False] + 0.03 and rate[True] > 0.9, (rate, {k: len(v) for k, v in bins.items()})
