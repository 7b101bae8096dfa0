"""Substring dedup by fixed-block anchors.

Every text's non-overlapping blocks of half a window are indexed; every rolling window of that length, of all texts,
probes the index. A repeated window of full length contains a whole block of either text, so it holds a hit. Hits
are extended: each full window around a hit is compared by its own hash, the least document that has it keeps
it, and neighbouring windows merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, released, settled, sha256
from .hashing import by_part, lists, planes, runs, text_groups, unplanes, windows, words
from .registry import query

WINDOW = 50
#: A window hash found oftener in one batch of texts counts as a hit there and is sent once.
LOCAL = 4
#: Low bits of an anchor's hash that are not sent. Texts that agree in the rest only are told apart when windows are compared.
ANCHOR_CUT = 24
_SHARED_SCHEMA = "part int, key long, places array<int>, body binary"


def rows(part, key, places, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(key, pa.int64()), places, pa.array(body, pa.binary())], ["part", "key", "places", "body"]
    )


def found_rows(key: np.ndarray, place: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row per key with its places, for (key, place) pairs."""
    order = np.argsort(key, kind="stable")
    _, first, length = runs(key[order])
    ids = key[order][first]
    return rows(np.abs(ids % parts), ids, lists(place[order].astype(np.int32), length, pa.int32()), pa.nulls(len(ids), pa.binary()))


def packets(hashes: np.ndarray, flags: np.ndarray, who: np.ndarray, place: np.ndarray, keys: np.ndarray, ids: np.ndarray | None, parts: int, cut: int = 0) -> pa.RecordBatch:
    """The entries by part of the hash range: hash less its low ``cut`` bits, flag, document (key and id) and place."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    made = []
    for p, at in by_part(part, parts):
        used, local = np.unique(who[at], return_inverse=True)
        head = np.array([len(at), len(used)], np.int64).tobytes()
        body = head + planes(hashes[at] >> np.uint64(cut)) + planes(local.astype(np.uint32)) + planes(place[at].astype(np.uint32))
        made.append((p, body + flags[at].astype(np.uint8).tobytes() + planes(keys[used]) + (b"" if ids is None else planes(ids[used]))))
    return rows([m[0] for m in made], pa.nulls(len(made), pa.int64()), pa.nulls(len(made), pa.list_(pa.int32())), [m[1] for m in made])


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(hash, flag, key, id, place) of all packets of one part, sorted by hash; the key stands for a missing id."""
    parts = []
    for body in table["body"].to_pylist():
        if body is None:
            continue
        count, used = (int(n) for n in np.frombuffer(body, np.int64, 2))
        at = 16
        take = []
        for size, dtype in ((8 * count, "u8"), (4 * count, "u4"), (4 * count, "u4"), (count, "u1"), (8 * used, "i8"), (8 * used, "i8")):
            take.append(unplanes(body[at : at + size], dtype) if at < len(body) else take[-1])
            at += size
        parts.append((take[0], take[3], take[4][take[1]], take[5][take[1]], take[2]))
    if not parts:
        return tuple(np.zeros(0, t) for t in ("u8", "u1", "i8", "i8", "u4"))
    merged = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(merged[0], kind="stable")
    return tuple(c[order] for c in merged)


def exchanged(source: DataFrame, scan, settle) -> DataFrame:
    """(key, places): what ``scan`` found within batches and ``settle`` over all packets of a part."""
    sent = source.mapInArrow(scan, _SHARED_SCHEMA).groupBy("part").applyInArrow(settle, "key long, place int")
    return settled(sent.groupBy("key").agg(F.collect_set("place").alias("places")))


def answer(table: pa.Table, key: np.ndarray, place: np.ndarray) -> pa.Table:
    """(key, place) of the part's own finds and of the rows that came through it: as many rows as finds, however many parts there are."""
    through = table.filter(table["key"].is_valid()).combine_chunks()
    lengths = through["places"].combine_chunks().value_lengths().to_numpy() if len(through) else np.zeros(0, np.int64)
    keys = np.append(np.repeat(through["key"].to_numpy(), lengths), key).astype(np.int64)
    held = through["places"].combine_chunks().flatten().to_numpy() if len(through) else np.zeros(0, np.int32)
    return pa.table({"key": pa.array(keys), "place": pa.array(np.append(held, place).astype(np.int32))})


def anchor_hits(source: DataFrame, half: int, parts: int) -> DataFrame:
    """(key, places): starts of the half windows of ``source`` (doc_id, text, key) that meet an indexed block elsewhere.

    Some further starts may be among them: where a hash is frequent within a batch, or repeats within one text.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_groups(batch.column(1)):
                size = end - start
                keys = batch.column(2).slice(start, size).to_numpy()
                texts, hashes = words(data, offsets, fold=False)
                at, rolled = windows(texts, hashes, half)
                if not len(at):
                    continue
                who = texts[at]
                place = at - np.searchsorted(texts, np.arange(size))[who]
                order = np.argsort(rolled, kind="stable")
                rolled, who, place = rolled[order], who[order], place[order]
                run, first, length = runs(rolled)
                block = place % half == 0
                has_block = np.logical_or.reduceat(block, first)
                several = who[first] != who[first + length - 1]
                hit = (has_block & several) | (length > LOCAL)
                yield found_rows(keys[who[hit[run]]], place[hit[run]], parts)
                keep = ~hit[run]
                keep[first[hit]] = True
                # flag 1: a block; flag 2: known to be met, needs no answer
                flags = np.where(hit[run], has_block[run] + 2, block)
                # sent in the order of the texts, in which documents and places compress to little
                sent = np.flatnonzero(keep)[np.argsort(order[keep])]
                yield packets(rolled[sent], flags[sent], who[sent], place[sent], keys, None, parts, ANCHOR_CUT)

    def settle(table: pa.Table) -> pa.Table:
        rolled, flags, key, _, place = unpacked(table)
        run, first, length = runs(rolled)
        met = np.zeros(0, bool)
        if len(first):
            met = (length > 1) & np.logical_or.reduceat((flags & 1).astype(bool), first)
        back = met[run] & (flags < 2) if len(first) else met
        return answer(table, key[back], place[back])

    return exchanged(source, scan, settle)


def repeat_starts(source: DataFrame, width: int, parts: int) -> DataFrame:
    """(key, places): starts of the windows of ``source`` (doc_id, text, key, places) that a smaller document also has.

    ``places`` are the anchor hits; only windows around them are looked at. Within a batch only the least document's
    entry of a hash is sent, so a passage in a third of all documents is sent once per batch.
    """
    half = width // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_groups(batch.column(1)):
                size = end - start
                keys, ids = (batch.column(c).slice(start, size).to_numpy() for c in (2, 0))
                texts, hashes = words(data, offsets, fold=False)
                at, full = windows(texts, hashes, width)
                if not len(at):
                    continue
                base = np.searchsorted(texts, np.arange(size))
                listed = batch.column(3).slice(start, size)
                hits = listed.flatten().to_numpy() + np.repeat(base, listed.value_lengths().to_numpy())
                marks = np.zeros(len(texts) + 1, np.int64)
                np.add.at(marks, np.maximum(hits - half, 0), 1)
                np.add.at(marks, hits + 1, -1)
                near = np.cumsum(marks)[at] > 0
                at, full = at[near], full[near]
                if not len(at):
                    continue
                who = texts[at]
                place = at - base[who]
                order = np.lexsort((ids[who], full))
                full, who, place = full[order], who[order], place[order]
                run, first, _ = runs(full)
                least = ids[who] == ids[who[first]][run]
                yield found_rows(keys[who[~least]], place[~least], parts)
                yield packets(full[least], np.zeros(int(least.sum()), np.uint8), who[least], place[least], keys, ids, parts)

    def settle(table: pa.Table) -> pa.Table:
        full, _, key, ids, place = unpacked(table)
        run, first, _ = runs(full)
        back = np.zeros(0, bool)
        if len(first):
            back = ids > np.minimum.reduceat(ids, first)[run]
        return answer(table, key[back], place[back])

    return exchanged(source, scan, settle)


def deduplicated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for every row of ``docs`` (doc_id, text).

    ``spans`` are the maximal runs of removed words (start, end exclusive), ``kept`` the other words joined by one space. Windows are
    compared by 64-bit hashes of their words, as they are, split at ASCII white space; texts of under ``width`` words lose nothing.
    Null texts have no words. Rows of one doc_id are the same document and take nothing from each other; rows without a
    doc_id lose nothing and take nothing.
    """
    parts = partitions(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    named = source.filter(F.col("doc_id").isNotNull())
    hits = anchor_hits(named, width // 2, parts)
    released(docs.sparkSession)
    starts = repeat_starts(named.join(hits, "key").select("doc_id", "text", "key", "places"), width, parts)
    released(docs.sparkSession)
    marked = source.join(starts, "key", "left").select("doc_id", "text", "places")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, spans = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                listed = text.as_py().encode().split()
                gone: list[tuple[int, int]] = []
                if places.is_valid:
                    where = np.sort(places.values.to_numpy())
                    edge = np.flatnonzero(np.diff(where) > width)
                    gone = list(zip(where[np.append(0, edge + 1)].tolist(), (where[np.append(edge, len(where) - 1)] + width).tolist()))
                left, at = [], 0
                for a, b in gone:
                    left += listed[at:a]
                    at = b
                left += listed[at:]
                total.append(len(listed))
                removed.append(len(listed) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))
