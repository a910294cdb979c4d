"""Token counts of whole texts in a public byte-level BPE."""

from __future__ import annotations

import base64
import re
import sys
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file (token and rank per line); the same path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer's pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT_CHUNKS = 400_000  # chunk sizes remembered per worker


def _worker_state() -> dict:
    """Survives in a Python worker from task to task."""
    return sys.modules.setdefault("_vertexloom_worker", ModuleType("_vertexloom_worker")).__dict__


def counter(path: str = VOCABULARY):
    """A function from text to its number of tokens; loaded once per process.

    A text is cut where white space follows a non-space. No token of the pattern crosses such a cut and no alternative looks past it, so the counts of
    the chunks, most of which recur, add up exactly to the count of the text.
    """
    state = _worker_state()
    if ("counter", path) not in state:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        chunks = re.compile(r"\s*\S+|\s+").findall
        odd = re.compile("[\x1c-\x1f]").search  # white space to Python, not to the pattern

        class Sizes(dict):
            def __missing__(self, chunk: str) -> int:
                if len(self) >= _KEPT_CHUNKS:
                    self.clear()
                n = self[chunk] = len(encode(chunk))
                return n

        sizes = Sizes()

        def count(text: str) -> int:
            if odd(text):
                return len(encode(text))
            return sum(map(sizes.__getitem__, chunks(text)))

        state[("counter", path)] = count
    return state[("counter", path)]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have 0."""

    @F.arrow_udf("bigint")
    def count_tokens(texts: pa.Array) -> pa.Array:
        count = counter(path)
        return pa.array([count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count_tokens(text)
