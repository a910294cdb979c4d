"""The language of each text and of each segment of a mixed one, by prediction by partial matching (see ``ppm``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.common import shared_path
from vertexloom.llm import ppm
from vertexloom.llm.tokens import _worker_state
from vertexloom.sources.bytes import filesystem

SHORTEST = 5  # non-blank lines of a segment
SWITCH_BITS = 10.0  # code length of a change of language
TRAIN_DOCS = 120  # labelled documents per language from which the model is fitted, at most
TRAIN_CHARS = 40_000  # longest document to learn from
CONFIDENCE_BITS = 16.0  # bits of lead that count as one: code lengths overstate the evidence of repeated phrases
FOUND = (
    "doc_id bigint, label string, language string, confidence double, "
    "segments array<struct<language: string, confidence: double, first_line: int, last_line: int, n_lines: int>>"
)


def label_key(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))


def label_codes(languages: DataFrame) -> DataFrame:
    """(label_key, lang_code): every code and alias."""
    names = F.explode(F.concat(F.array("lang_code"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return languages.where(F.col("lang_code").isNotNull()).select("lang_code", names.alias("n")).where(F.col("n").isNotNull()).select(label_key(F.col("n")).alias("label_key"), "lang_code").dropDuplicates(["label_key"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(documents: DataFrame, languages: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang_code, text): at most ``per_language`` labelled documents a language whose file name extension agrees with the label, by hash of ``doc_id``.

    Each task keeps that many of its own before anything is shuffled.
    """
    named = languages.select("lang_code", F.explode_outer("file_exts").alias("ext")).where(F.col("ext").isNotNull())
    pairs = label_codes(languages).join(named, "lang_code").select("label_key", F.lower("ext").alias("ext"), "lang_code").distinct()
    docs = documents.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS) & F.col("lang").isNotNull() & F.col("path").isNotNull())
    docs = docs.select("doc_id", "text", label_key(F.col("lang")).alias("label_key"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext"))
    agreed = docs.join(F.broadcast(pairs), ["label_key", "ext"])  # a row per name and extension of a language
    rank = F.row_number().over(Window.partitionBy("lang_code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return agreed.withColumn("_rank", rank).where(F.col("_rank") <= per_language).select("lang_code", "text")


def text_lines(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct non-blank lines; the number of each non-blank line there; its number in its text; non-blank lines per text."""
    known: dict[str, int] = {}
    which: list[int] = []
    numbers: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        before = len(which)
        for i, line in enumerate(text.split("\n")):
            if line and not line.isspace():
                which.append(known.setdefault(line, len(known)))
                numbers.append(i)
        sizes[d] = len(which) - before
    lines = [x.rstrip("\r").encode("utf-8", "replace") for x in known]
    return lines, np.array(which, np.int64), np.array(numbers, np.int64), sizes


def fit(sample: list[tuple[str, str]], codes: list[str], order: int = ppm.ORDER, rounds: int = 3) -> ppm.Model:
    """A model of the languages ``codes`` from (code, text) pairs.

    After a first model of all lines each further round keeps the lines that the model before it puts into a segment of the label's own language: so lines of other languages in mixed
    texts and texts with a wrong label drop out. A language without any text is never found.
    """
    sample = sorted(set(sample))
    lines, which, _, sizes = text_lines([t for _, t in sample])
    label = np.repeat(np.array([codes.index(c) for c, _ in sample], np.int64), sizes)
    keep = np.ones(len(which), bool)
    for round_ in range(rounds + 1):
        model = ppm.train({c: [lines[i] for i in which[keep & (label == codes.index(c))]] for c in codes}, order)
        if round_ < rounds:
            own = np.array([codes.index(c) for c in model.languages])
            keep = own[ppm.segment(model.score(lines)[which], sizes, SWITCH_BITS, SHORTEST)] == label
    return model


def confidence(lead: np.ndarray) -> np.ndarray:
    """From the bits by which the best language leads the second: 0.5 without a lead, towards 1."""
    return 1.0 / (1.0 + np.exp2(-np.minimum(lead, 1000.0) / CONFIDENCE_BITS))


def describe(model: ppm.Model, texts: list[str]) -> list[tuple[str | None, float | None, list[dict]]]:
    """(language, confidence, segments) of each text: '' for the language of a mixed text, None for one without a non-blank line."""
    lines, which, numbers, sizes = text_lines(texts)
    costs = model.score(lines)[which]
    labels = ppm.segment(costs, sizes, SWITCH_BITS, SHORTEST)
    total = np.zeros((len(costs) + 1, costs.shape[1]))
    np.cumsum(costs, axis=0, out=total[1:])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])]) if len(labels) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(labels)] if len(first) else first
    spent = total[last] - total[first]
    rows = np.arange(len(first))
    own = spent[rows, labels[first]]
    spent[rows, labels[first]] = np.inf
    sure = confidence(spent.min(axis=1) - own) if len(first) and costs.shape[1] > 1 else np.ones(len(first))
    out: list[tuple[str | None, float | None, list[dict]]] = [(None, None, [])] * len(texts)
    runs: dict[int, list[int]] = {}
    for r, d in enumerate(doc[first].tolist()):
        runs.setdefault(d, []).append(r)
    for d, rs in runs.items():
        segments = [
            {"language": model.languages[labels[first[r]]], "confidence": float(sure[r]), "first_line": int(numbers[first[r]]), "last_line": int(numbers[last[r] - 1]), "n_lines": int(last[r] - first[r])}
            for r in rs
        ]
        mixed = len({s["language"] for s in segments}) > 1
        out[d] = ("" if mixed else segments[0]["language"], min(s["confidence"] for s in segments), segments)
    return out


class _Shared:
    """A model in the session's shared folder, which Python workers map into memory: from there if it is a file to them, else from a copy that each executor fetches once."""

    def __init__(self, spark: SparkSession, model: ppm.Model):
        data, self.description = ppm.shared_arrays(model)
        path = shared_path(spark, "language-model")
        fs, inner = filesystem(path)
        with fs.open_output_stream(inner) as out:
            out.write(data)
        self.name, self.file = path.rpartition("/")[2], inner if isinstance(fs, pafs.LocalFileSystem) else None
        if self.file is None:
            spark.sparkContext.addFile(path)

    def model(self) -> ppm.Model:
        kept = _worker_state()
        if ("model", self.name) not in kept:
            kept[("model", self.name)] = ppm.mapped(self.file or SparkFiles.get(self.name), self.description)
        return kept[("model", self.name)]


def identify(documents: DataFrame, model: ppm.Model) -> DataFrame:
    """(doc_id, label, language, confidence, segments) of every document with at least one letter; extra columns of ``documents`` are not read.

    ``language`` is '' for a mixed text, ``confidence`` that of its least sure segment; a segment has its language, confidence, first and last line (0-based) and number of
    non-blank lines. Null, empty and letterless texts yield nothing. Whole texts are coded; a line that recurs in a batch is coded once. Nothing is shuffled.
    """
    shared = _Shared(documents.sparkSession, model)  # bounded: see TRAIN_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment_type = pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("n_lines", pa.int32())])
        for whole in batches:
            for i, j in _slices(whole.column(2)):
                batch = whole.slice(i, j - i)
                found = describe(shared.model(), batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(segment_type))],
                    names=["doc_id", "label", "language", "confidence", "segments"],
                )

    rows = documents.where(has_letter(F.col("text"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("label"), "text")
    return rows.mapInArrow(run, FOUND)


def _slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def language_model(documents: DataFrame, languages: DataFrame, per_language: int = TRAIN_DOCS) -> ppm.Model:
    """Fits the model on the driver from the bounded sample."""
    codes = sorted(r.lang_code for r in languages.where(F.col("lang_code").isNotNull()).select("lang_code").distinct().collect())
    return fit([tuple(r) for r in training_sample(documents, languages, per_language).collect()], codes)


def label_issues(identified: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc_id, issue, true_lang) with issue missing, wrong or mixed.

    'missing': the label is null or no code or alias; 'wrong': no segment is written in the language it names; ``true_lang`` is the text's language, '' if mixed. 'mixed': a row
    per language of a text with several. A text without a non-blank line has no row.
    """
    named = F.broadcast(label_codes(languages))  # a row per name of a language
    docs = identified.where(F.col("language").isNotNull()).withColumn("label_key", label_key(F.col("label"))).join(named, "label_key", "left")
    spoken = F.array_distinct(F.transform("segments", lambda s: s["language"]))
    issue = F.when(F.col("lang_code").isNull(), "missing").when(~F.array_contains(spoken, F.col("lang_code")), "wrong")
    row = lambda i, lang: F.struct(i.alias("issue"), lang.alias("true_lang"))
    rows = F.concat(
        F.when(issue.isNotNull(), F.array(row(issue, F.col("language")))).otherwise(F.array().cast("array<struct<issue:string,true_lang:string>>")),
        F.when(F.col("language") == "", F.transform(spoken, lambda s: row(F.lit("mixed"), s))).otherwise(F.array().cast("array<struct<issue:string,true_lang:string>>")),
    )
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.issue", "r.true_lang")
