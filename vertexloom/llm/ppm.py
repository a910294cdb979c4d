"""Prediction by partial matching over bytes, one context tree per language, with frozen statistics.

A tree is kept as its paths: the n-grams of order k are the symbols seen after each context of k bytes. All languages share the n-grams; each has its
own counts. The code length of a symbol under a language is exact: -log2 of its share at the longest context that the language knows, plus the escapes (method C: the number of
distinct symbols against the count) of the longer known contexts that never saw it, down to order 0 and then 8 bits. As statistics are frozen, the code lengths of every known
n-gram are computed once for all languages and looked up afterwards; only the escapes above the longest known n-gram are added.

Lines are coded each for itself, from its leading to its closing line break.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 4
_EMPTY = np.uint64(0)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """A frozen open-addressing table from non-zero 64-bit keys to their positions, probed in bulk."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(2 * len(keys) + 1).bit_length() + 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[left[free]]  # of several at one slot the last stays
            won = self.keys[slot] == keys[left]
            self.rows[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if absent."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there, want = self.keys[slot], keys[left]
            hit = there == want
            out[left[hit]] = self.rows[slot[hit]]
            go = ~hit & (there != _EMPTY)
            left, slot = left[go], slot[go]
        return out


def shared_arrays(model: Model) -> tuple[bytes, dict]:
    """(bytes, description): the model's arrays one after the other, each at a multiple of 64 bytes."""
    parts, places, at = [], {}, 0
    arrays = {"grams.keys": model.grams.keys, "grams.rows": model.grams.rows, "contexts.keys": model.contexts.keys, "contexts.rows": model.contexts.rows, "bits": model.bits, "escapes": model.escapes}
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        places[name] = (at, a.dtype.str, a.shape)
        parts += [data, bytes(-len(data) % 64)]
        at += len(data) + -len(data) % 64
    return b"".join(parts), {"languages": model.languages, "order": model.order, "places": places}


def mapped(path: str, description: dict) -> Model:
    """The model over a file of ``shared_arrays``, mapped into memory: the processes of a machine have it once."""
    whole = np.memmap(path, np.uint8, "r")

    def array(name: str) -> np.ndarray:
        at, dtype, shape = description["places"][name]
        n = int(np.prod(shape)) * np.dtype(dtype).itemsize
        return whole[at : at + n].view(dtype).reshape(shape)

    def keys(name: str) -> KeyTable:
        out = KeyTable.__new__(KeyTable)
        out.keys, out.rows = array(f"{name}.keys"), array(f"{name}.rows")
        out.bits = len(out.keys).bit_length() - 1
        return out

    return Model(description["languages"], description["order"], keys("grams"), array("bits"), keys("contexts"), array("escapes"))


def lay_out(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lines between line breaks, as bytes, and the position of the break before each line."""
    text = b"\n" + b"\n".join(lines) + b"\n"
    lengths = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    starts = np.zeros(len(lines), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    return np.frombuffer(text, np.uint8), starts


def _codes(buf: np.ndarray, order: int) -> list[np.ndarray]:
    """For each k up to ``order``: the bytes i-k..i as one number, tagged with k."""
    wide = buf.astype(np.uint64)
    code, out = wide.copy(), []
    for k in range(order + 1):
        if k:
            code[k:] |= wide[:-k] << np.uint64(8 * k)
        out.append(code | np.uint64((k + 1) << 56))
    return out


def _depth(n: int, starts: np.ndarray) -> np.ndarray:
    """Bytes of the same line (its leading break included) before each position; 0 only at the very first."""
    at = np.arange(n, dtype=np.int64)
    line = np.zeros(n, np.int64)
    line[starts + 1] = starts
    np.maximum.accumulate(line, out=line)
    return at - line


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: KeyTable
    bits: np.ndarray  # code lengths, n-gram x language
    contexts: KeyTable
    escapes: np.ndarray  # summed escapes of the context and all its suffixes, context x language; row 0: of the empty context

    def score(self, lines: list[bytes], block: int = 1 << 17) -> np.ndarray:
        """The code length in bits of each line under each language. Memory beyond the text itself is bounded by ``block``, also for a single endless line."""
        out = np.zeros((len(lines), len(self.languages)))
        if not lines:
            return out
        buf, starts = lay_out(lines)
        first = starts + 1  # the symbols of a line follow its leading break and end with its closing one
        for a in range(1, len(buf), block):
            b = min(len(buf), a + block)
            i, j = np.searchsorted(first, [a, b - 1], side="right") - 1
            cuts = np.maximum(first[i : j + 1], a)
            depth = np.arange(a, b) - np.repeat(starts[i : j + 1], np.diff(np.append(cuts, b)))
            low = max(0, a - self.order)
            cost = self._costs(_codes(buf[low:b], self.order), depth, a - low)
            out[i : j + 1] += np.add.reduceat(cost, cuts - a, axis=0)
        return out

    def _costs(self, codes: list[np.ndarray], depth: np.ndarray, skip: int) -> np.ndarray:
        """The code lengths of the symbols from ``skip`` on; ``depth`` says how many bytes of its line precede each."""
        row = np.full(len(depth), -1, np.int32)
        found_at = np.full(len(depth), -1, np.int8)
        todo = np.zeros(0, np.int64)
        for k in range(self.order, -1, -1):
            todo = np.concatenate([todo, np.flatnonzero(depth >= k if k == self.order else depth == k)])
            got = self.grams.find(codes[k][todo + skip])
            hit = got >= 0
            row[todo[hit]] = got[hit]
            found_at[todo[hit]] = k
            todo = todo[~hit]
        cost = self.bits[row]  # -1, an unknown byte, is the last row
        above = np.flatnonzero(np.minimum(depth, self.order) > found_at)  # symbols that escaped, unless no longer context is known
        top, bottom = np.zeros(len(above), np.int32), np.full(len(above), -1, np.int32)
        bottom[found_at[above] == 0] = 0
        open_ = np.ones(len(above), bool)
        for k in range(self.order, 0, -1):
            can = np.flatnonzero((depth[above] >= k) & (open_ | (found_at[above] == k)))
            got = self.contexts.find(codes[k - 1][above[can] + skip - 1])
            known = got >= 0
            end = (found_at[above[can]] == k) & known
            bottom[can[end]] = got[end]
            take = known & open_[can]
            top[can[take]] = got[take]
            open_[can[take]] = False
        cost[above] += self.escapes[top]
        some = bottom >= 0
        cost[above[some]] -= self.escapes[bottom[some]]
        return cost


def train(lines: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Counts the lines of each language and freezes the model. Languages without lines cost 8 bits a byte."""
    languages = sorted(lines)
    n_lang = len(languages)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for name in languages:
        if not lines[name]:
            for k in range(order + 1):
                found[k].append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        buf, starts = lay_out(lines[name])
        codes, depth = _codes(buf, order), _depth(len(buf), starts)
        depth[0] = -1  # the first break is only a context
        for k in range(order + 1):
            found[k].append(np.unique(codes[k][depth >= k], return_counts=True))
    gram_keys, gram_bits, ctx_keys, ctx_bits = [], [], [np.array([np.uint64(255) << np.uint64(56)])], []
    below_keys, below_bits, below_ctx_keys, below_ctx = None, None, None, None
    for k in range(order + 1):
        keys = np.unique(np.concatenate([u for u, _ in found[k]]))
        counts = np.zeros((len(keys), n_lang), np.float64)
        for i, (u, c) in enumerate(found[k]):
            counts[np.searchsorted(keys, u), i] = c
        plain = keys & np.uint64((1 << 56) - 1)
        contexts, of = np.unique(plain >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        for i in range(n_lang):
            total[:, i] = np.bincount(of, counts[:, i], len(contexts))
            kinds[:, i] = np.bincount(of, counts[:, i] > 0, len(contexts))
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        if k == 0:
            lower = np.full((len(keys), n_lang), 8.0)
            summed = escape if len(escape) else np.zeros((1, n_lang))  # no line at all
        else:
            suffix = (plain & np.uint64((1 << (8 * k)) - 1)) | np.uint64(k << 56)
            lower = below_bits[np.searchsorted(below_keys, suffix)]
            if k == 1:
                summed = escape + below_ctx[0]
            else:
                summed = escape + below_ctx[np.searchsorted(below_ctx_keys, contexts & np.uint64((1 << (8 * (k - 1))) - 1))]
        seen = counts > 0
        share = -np.log2(np.where(seen, counts, 1) / np.maximum(total + kinds, 1)[of])
        bits = np.where(seen, share, escape[of] + lower)
        gram_keys.append(keys)
        gram_bits.append(bits.astype(np.float32))
        ctx_bits.append(summed.astype(np.float32))
        if k:
            ctx_keys.append(contexts | np.uint64(k << 56))
        below_keys, below_bits, below_ctx_keys, below_ctx = keys, bits, contexts, summed
    gram_bits.append(np.full((1, n_lang), 8.0, np.float32))  # of unknown bytes
    return Model(languages, order, KeyTable(np.concatenate(gram_keys)), np.concatenate(gram_bits), KeyTable(np.concatenate(ctx_keys)), np.concatenate(ctx_bits))


def segment(costs: np.ndarray, sizes: np.ndarray, switch_bits: float, shortest: int) -> np.ndarray:
    """The language of each line: per document the cheapest split into runs of at least ``shortest`` lines, each switch at ``switch_bits``.

    ``costs`` holds the lines of all documents one after the other, ``sizes`` the lines of each. Documents run in step: one vector operation per line number. A document too
    short for two runs is one run.
    """
    n_docs, n_lang = len(sizes), costs.shape[1]
    begin = np.zeros(n_docs, np.int64)
    np.cumsum(sizes[:-1], out=begin[1:])
    labels = np.zeros(len(costs), np.int8)
    if not len(costs):
        return labels
    run = np.zeros((len(costs) + 1, n_lang))
    np.cumsum(costs, axis=0, out=run[1:])
    whole = run[begin + sizes] - run[begin]
    single = whole.argmin(axis=1)
    best_single = whole.min(axis=1)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= 2 * shortest]
    labels[:] = np.repeat(single, sizes)
    if not len(order):
        return labels
    start, length = begin[order], sizes[order]
    came = np.full((len(costs), n_lang), -1, np.int8)
    best = run[start + shortest] - run[start]
    past = [(best.min(axis=1), best.argmin(axis=1))]  # of lengths shortest, shortest + 1, ...: the best end and its language
    final = np.zeros((len(order), n_lang))
    for t in range(shortest + 1, int(length[0]) + 1):
        active = int(np.searchsorted(-length, -t, side="right"))
        rows = start[:active] + t - 1
        best = best[:active] + costs[rows]
        if t >= 2 * shortest:
            before, who = past.pop(0)
            turned = before[:active, None] + switch_bits + (run[rows + 1] - run[rows + 1 - shortest])
            better = turned < best
            best = np.where(better, turned, best)
            came[rows] = np.where(better, who[:active, None], -1)
        past.append((best.min(axis=1), best.argmin(axis=1)))
        ended = int(np.searchsorted(-length, -t, side="left"))
        final[ended:active] = best[ended:active]
    split = np.flatnonzero(final.min(axis=1) < best_single[order] - 1e-3)
    for d in split:
        language, t, s = int(final[d].argmin()), int(length[d]), int(start[d])
        while t > 0:
            row = s + t - 1
            before = came[row, language]
            if before >= 0:
                labels[row - shortest + 1 : row + 1] = language
                t, language = t - shortest, int(before)
            else:
                labels[row] = language
                t -= 1
    return labels
