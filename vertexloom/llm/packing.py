"""Filling containers of a fixed capacity with texts: bounded-space online best fit.

Texts are spread over lanes; each lane packs on its own with a fixed number of open bins. A bitset has a bit for every amount of free space that some open bin has, so the
tightest bin that takes an item is one shift and one lowest bit away. If none takes it, a new bin opens, for which the fullest closes when the lane has its number open. An item that fills a bin by
itself has one of its own and closes none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.llm.tokens import VOCABULARY, token_count

OPEN_BINS = 64
LANE_ROWS = 50_000
PLACES = "doc_id bigint, piece int, n_pieces int, container bigint, container_offset bigint, n_tokens bigint"


def best_fit(sizes: Iterable[int], capacity: int, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int, int]]:
    """(bin, offset, size) of each item, in order; sizes are 1 to ``capacity``. Bins are numbered as they open."""
    free_bits, by_free, n_open, opened = 0, {}, 0, 0
    for size in sizes:
        if size == capacity:
            yield opened, 0, size
            opened += 1
            continue
        fitting = free_bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            held = by_free[free]
            bin_ = held.pop()
            if not held:
                free_bits &= ~(1 << free)
        else:
            if n_open == open_bins:
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits &= ~(1 << fullest)
                n_open -= 1
            bin_, free, opened, n_open = opened, capacity, opened + 1, n_open + 1
        yield bin_, capacity - free, size
        free -= size
        if free:
            by_free.setdefault(free, []).append(bin_)
            free_bits |= 1 << free
        else:
            n_open -= 1


def pack_sizes(sizes: DataFrame, capacity: int, open_bins: int = OPEN_BINS, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Packs rows of (doc_id, n_tokens) into containers of ``capacity``.

    Gives a row per text, or per piece of a text over the capacity (pieces of ``capacity`` tokens and a remainder): its container, its offset there and its size. A text
    of 0 tokens takes no place: container and offset are null. Lanes of about ``lane_rows`` texts are drawn by hash of ``doc_id``, whatever the cluster, and packed in the
    order of ``doc_id``, so a lost task packs the same again. Repeated rows are packed each; null sizes count as 0. At most ``open_bins`` containers a lane stay partly empty
    for want of items. Only ids and sizes are shuffled.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")
    lanes = max(1, -(-sizes.select("doc_id").count() // lane_rows))
    rows = sizes.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).alias("lane"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens")
    )

    def pack(key: tuple, lane: pa.Table) -> pa.Table:
        lane = lane.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        base = key[0].as_py() << 32
        docs, pieces, counts, items = [], [], [], []
        for doc, n in zip(lane.column("doc_id").to_pylist(), lane.column("n_tokens").to_pylist()):
            n_pieces = max(1, -(-n // capacity))
            for piece in range(n_pieces):
                docs.append(doc)
                pieces.append(piece)
                counts.append(n_pieces)
                items.append(min(capacity, n - piece * capacity))
        placed = best_fit((n for n in items if n), capacity, open_bins)
        bins, offsets = [], []
        for n in items:
            bin_, offset, _ = next(placed) if n else (None, None, 0)
            bins.append(None if bin_ is None else base + bin_)
            offsets.append(offset)
        return pa.table([pa.array(x, t) for x, t in ((docs, pa.int64()), (pieces, pa.int32()), (counts, pa.int32()), (bins, pa.int64()), (offsets, pa.int64()), (items, pa.int64()))], names=["doc_id", "piece", "n_pieces", "container", "container_offset", "n_tokens"])

    return rows.groupBy("lane").applyInArrow(pack, PLACES)


def pack_texts(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, open_bins: int = OPEN_BINS, lane_rows: int = LANE_ROWS) -> DataFrame:
    """``pack_sizes`` of the texts of (doc_id, text), sized in tokens."""
    return pack_sizes(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens")), capacity, open_bins, lane_rows)


def fill_report(places: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_tokens, fill): containers used, tokens placed and the share of the capacity they take (null without containers)."""
    per = places.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"))
