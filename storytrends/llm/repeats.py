"""Operator 6: removal of byte strings that occur earlier, by sorted suffixes.

A string of LENGTH bytes is removed where an equal one starts earlier: in a document of a
smaller id, or earlier in the same one. Strings are met around their anchors:

1. Each text's anchor hashes are packed by hash bucket and shuffled; a bucket finds the
   hashes that two different texts, or two places, have in common.
2. The texts, joined with their repeated hashes, are written once, bucketed by document,
   so that they are not shuffled again. Around each repeated anchor a text gives one
   record: the strings that have the anchor, as one stretch of bytes.
3. Records of one anchor meet. Of equal records the first stays, the others are repeated
   as a whole. The suffixes of different ones are sorted by the deep-shallow method.
4. The ranges go back to the written texts, where they are joined to spans and cut.

Anchors with many records are split by the bytes beside them, and equal records are
thinned in salted parts before they meet.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from storytrends.session import drop_written

from .anchors import GRAM, LENGTH, anchors
from .common import lookup, written
from .shingles import PRIME, mix
from .suffixes import equal_groups

#: Records of one anchor beyond which it is split.
HOT = 256
#: Text of the groups that are sorted together.
SORTED_BYTES = 1 << 20
BUCKET_BYTES = 64 << 20
#: Place of rows without a doc_id: after all others.
NO_ID = (1 << 63) - 1
RANGES = "doc_id long, tie long, ranges binary, key long, first long, text binary"


def packed_anchors(batches: Iterator[pa.RecordBatch], buckets: int, group_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(bucket, hashes, docs, ties, many) of the distinct anchors of texts, packed by bucket."""
    names = ["bucket", "hashes", "docs", "ties", "many"]

    def pack(held: list) -> pa.RecordBatch:
        h, doc, tie, many = (np.concatenate([x[n] for x in held]) for n in range(4))
        order = np.lexsort((doc, tie, h, h % np.uint64(buckets)))
        h, doc, tie, many = h[order], doc[order], tie[order], many[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (tie[1:] != tie[:-1]))  # the first of equal texts
        h, doc, tie, many = h[keep], doc[keep], tie[keep], many[keep]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(h))
        blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in (h, doc, tie, many)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *blobs], names)

    held: list = []
    size = 0
    for batch in batches:
        for doc, text, tie in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            if len(data) < LENGTH:
                continue
            found, count = np.unique(anchors(data)[0], return_counts=True)
            held.append((found, np.full(len(found), doc, np.int64), np.full(len(found), tie, np.int64), count > 1))
            size += len(data)
            if size >= group_bytes:
                yield pack(held)
                held, size = [], 0
    if held:
        yield pack(held)


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tie, hash, n) of the anchors that occur twice or more; rows come sorted by bucket."""

    def settle(parts: list) -> Iterator[pa.RecordBatch]:
        h, doc, tie, many = (
            np.concatenate([np.frombuffer(x[n], kind) for x in parts])
            for n, kind in ((0, np.uint64), (1, np.int64), (2, np.int64), (3, np.bool_))
        )
        order = np.lexsort((doc, tie, h))
        h, doc, tie, many = h[order], doc[order], tie[order], many[order]
        keep = np.append(True, (h[1:] != h[:-1]) | (tie[1:] != tie[:-1]))
        h, doc, tie, many = h[keep], doc[keep], tie[keep], many[keep]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(first, len(h)))
        use = np.repeat((sizes > 1) | np.logical_or.reduceat(many, first), sizes)
        n = np.repeat(sizes, sizes)
        columns = [doc[use], tie[use], h[use].view(np.int64), n[use]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "tie", "h", "n"])

    at, parts = None, []
    for batch in batches:
        for bucket, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at is not None and bucket != at:
                yield from settle(parts)
                parts = []
            at = bucket
            parts.append(blobs)
    if parts:
        yield from settle(parts)


def pairs(first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([first, last], axis=1).astype(np.int64).tobytes()


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct stretch around a repeated anchor of a text.

    Later equal stretches of the same text are repeated for sure: their ranges ride on
    the first row of the document in ``more``.
    """
    names = ["key", "salt", "hot", "doc_id", "tie", "first", "more", "text"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list = []
    size = 0
    for batch in batches:
        for doc, tie, text, hs, ns in zip(*[batch.column(n) for n in ("doc_id", "tie", "text", "hs", "ns")], strict=True):
            raw = (text.as_py() or "").encode()
            shared = np.array(hs.as_py(), np.int64).view(np.uint64)
            counts = np.array(ns.as_py(), np.int64)
            order = np.argsort(shared)
            shared, counts = shared[order], counts[order]
            h, place, first, last = anchors(np.frombuffer(raw, np.uint8))
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            use = shared[at] == h
            h, place, first, last, n = h[use], place[use], first[use], last[use], counts[at[use]]
            seen: set = set()
            own, again = [], []
            for key, a, lo, hi, many in zip(h.tolist(), place.tolist(), first.tolist(), last.tolist(), n.tolist()):  # noqa: B905
                if many <= HOT:
                    parts = [(0, 0, lo, hi, 0)]
                else:
                    salt = doc.as_py() % -(-many // HOT)
                    middle = a - (LENGTH - 2 * GRAM)  # from here on a string holds the gram after the anchor
                    parts = []
                    if hi >= middle:
                        parts.append((1, zlib.crc32(raw[a + GRAM : a + 2 * GRAM]), max(lo, middle), hi, salt))
                    if lo < middle:
                        parts.append((2, zlib.crc32(raw[a - GRAM : a]), lo, min(hi, middle - 1), salt))
                for side, beside, low, high, salt in parts:
                    piece = raw[low : high + LENGTH]
                    if (key, side, piece) in seen:
                        again.append((low, high))
                        continue
                    seen.add((key, side, piece))
                    own.append([key, side, beside, salt, many > HOT, low, piece])
            if not own:
                continue
            keys = np.array([(o[0], o[1] << 32 | o[2]) for o in own], np.uint64)
            mixed = np.where(keys[:, 1] == 0, keys[:, 0], mix(keys[:, 0] * PRIME + keys[:, 1])).view(np.int64).tolist()
            more = merged(np.array(again, np.int64)).tobytes() if again else None
            for n_row, (key, o) in enumerate(zip(mixed, own, strict=True)):
                rows.append((key, o[3], o[4], doc.as_py(), tie.as_py(), o[5], None if n_row else more, o[6]))
                size += len(o[6])
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def merged(ranges: np.ndarray, gap: int = 1) -> np.ndarray:
    """Ranges (first, last) joined where the next begins at most ``gap`` behind the last."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    cut = np.flatnonzero(np.append(True, ranges[1:, 0] > reach[:-1] + gap))
    return np.stack([ranges[cut, 0], reach[np.append(cut[1:], len(ranges)) - 1]], axis=1)


def settled(batches: Iterator[pa.RecordBatch], last_level: bool) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of records that come sorted by (key, salt, doc_id, tie, first).

    Records of hot keys are thinned to one per content and given on with their text, unless
    this is the last level. All other groups are decided.
    """
    names = ["doc_id", "tie", "ranges", "key", "first", "text"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    out: list = []
    waiting: list = []  # (group number, doc, tie, first, text) of groups with several contents
    state = {"size": 0, "group": 0}

    def close(group: dict, hot: bool) -> None:
        if hot and not last_level:
            out.extend((doc, tie, None, key, first, text) for text, (doc, tie, first, key) in group.items())
        elif len(group) > 1:  # equal strings lie alike around the anchor, so never in one stretch
            for text, (doc, tie, first, _) in group.items():
                waiting.append((state["group"], doc, tie, first, text))
                state["size"] += len(text)
            state["group"] += 1

    def sort() -> None:
        if not waiting:
            return
        data = np.frombuffer(b"".join(w[4] for w in waiting), np.uint8)
        sizes = np.array([len(w[4]) for w in waiting])
        count = sizes - LENGTH + 1
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(waiting)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        number = np.array([w[0] for w in waiting])
        group, member = equal_groups(data, base[owner] + inner, number[owner])
        if len(member):
            doc, tie, first = (np.array([w[n] for w in waiting], np.int64) for n in (1, 2, 3))
            of = owner[member]
            start = first[of] + inner[member]
            order = np.lexsort((start, tie[of], doc[of], group))
            later = np.append(False, np.diff(group[order]) == 0)
            of, start = of[order][later], start[order][later]
            order = np.lexsort((start, of))
            of, start = of[order], start[order]
            cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)))
            ends = np.append(cut[1:], len(of)) - 1
            for o, lo, hi in zip(of[cut].tolist(), start[cut].tolist(), start[ends].tolist(), strict=True):
                out.append((waiting[o][1], waiting[o][2], np.array([lo, hi], np.int64).tobytes(), None, None, None))
        waiting.clear()
        state["size"] = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return batch

    at, group, hot_group = None, {}, False
    for batch in batches:
        for key, salt, hot, doc, tie, first, more, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != (key, salt):
                close(group, hot_group)
                at, group, hot_group = (key, salt), {}, hot
            if more is not None:
                out.append((doc, tie, more, None, None, None))
            if text in group:
                if group[text][:3] == (doc, tie, first):  # the same row of the input again
                    continue
                whole = np.array([first, first + len(text) - LENGTH], np.int64)
                out.append((doc, tie, whole.tobytes(), None, None, None))
            else:
                group[text] = (doc, tie, first, key)
            if state["size"] >= SORTED_BYTES:
                sort()
            if len(out) >= 20_000:
                yield flush()
    close(group, hot_group)
    sort()
    if out:
        yield flush()


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """doc_id, tie and the list of repeated ranges of starts, from texts with (hs, ns)."""
    order = ["key", "salt", "doc_id", "tie", "first"]
    sent = texts.select("doc_id", "tie", "text", "hs", "ns").mapInArrow(
        records, "key long, salt int, hot boolean, doc_id long, tie long, first long, more binary, text binary"
    )
    met = sent.repartition("key", "salt").sortWithinPartitions(*order)
    once = written(met.mapInArrow(lambda b: settled(b, False), RANGES), "ranges")
    thinned = once.filter("text IS NOT NULL").select(
        "key", F.lit(0).alias("salt"), F.lit(False).alias("hot"), "doc_id", "tie", "first", F.lit(None).cast("binary").alias("more"), "text"
    )
    again = thinned.repartition("key").sortWithinPartitions(*order).mapInArrow(lambda b: settled(b, True), RANGES)
    rows = once.filter("text IS NULL").unionByName(again).select("doc_id", "tie", "ranges")
    return rows.groupBy("doc_id", "tie").agg(F.collect_list("ranges").alias("ranges"))


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """``df`` written as a table bucketed by ``keys``, so that joins on them do not shuffle it."""
    spark, name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def removed_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id as a long, tie, n_bytes, copy and spans (pairs of byte bounds, packed).

    ``copy`` marks rows whose whole text a smaller doc_id has; their spans are null. A null
    text counts as empty and shorter texts than LENGTH lose nothing. Rows that repeat
    doc_id and text are one document; other texts under one doc_id come in the order of a
    hash. Rows without a doc_id come after all others, as if they shared one id. Extra
    columns pass through; those named like an added one are replaced.
    """
    docs = docs.drop("tie", "hs", "ns", "copy", "_copy", "spans", "n_bytes", "_no_id")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    no_id = F.col("doc_id").isNull()
    # Another hash without an id keeps such a row apart from one whose id is NO_ID.
    docs = docs.withColumns({"_no_id": no_id, "tie": F.when(no_id, F.xxhash64(F.lit(1), text)).otherwise(F.xxhash64(text))})
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    plain = docs.select("doc_id", text.alias("text"), "tie")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, total // BUCKET_BYTES)
    packed = plain.mapInArrow(
        lambda b: packed_anchors(b, buckets), "bucket long, hashes binary, docs binary, ties binary, many binary"
    )
    shared = (
        packed.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(shared_anchors, "doc_id long, tie long, h long, n long")
        .groupBy("doc_id", "tie")
        .agg(F.collect_list(F.struct("h", "n")).alias("f"))
        .select("doc_id", "tie", F.col("f.h").alias("hs"), F.col("f.n").alias("ns"))
    )
    digests = written(plain.select("doc_id", "tie", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "digests")
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = written(
        lookup(digests, firsts, "sha").filter("doc_id <> first").select("doc_id", "tie", F.lit(True).alias("copy")).distinct(), "copies"
    )
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * BUCKET_BYTES))
    marked = shared.join(copies.withColumnRenamed("copy", "_copy"), ["doc_id", "tie"], "full").select(
        "doc_id", "tie", "hs", "ns", F.coalesce("_copy", F.lit(False)).alias("copy")
    )
    rows = docs.join(marked.hint("shuffle_hash"), ["doc_id", "tie"], "left")
    texts = bucketed(rows.withColumn("copy", F.coalesce("copy", F.lit(False))), files, "doc_id", "tie")
    drop_written(digests)
    drop_written(copies)
    sources = texts.filter(F.col("hs").isNotNull() & ~F.col("copy"))
    ranges = repeated_ranges(sources)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for parts in batch.column(2).to_pylist():
                found = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2) + [0, LENGTH]
                spans.append(merged(found, 0).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], ["doc_id", "tie", "spans"])

    joined = ranges.mapInArrow(join, "doc_id long, tie long, spans binary")
    out = texts.drop("hs", "ns").join(joined.hint("shuffle_hash"), ["doc_id", "tie"], "left").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    return out.withColumn("doc_id", F.when(~F.col("_no_id"), F.col("doc_id"))).drop("_no_id")


def cut(raw: bytes, spans: bytes | None, copy: bool) -> tuple[bytes, int]:
    """The remaining bytes and the number of removed runs."""
    if copy:
        return (b"", 1) if len(raw) >= LENGTH else (raw, 0)
    if not spans:
        return raw, 0
    bounds = np.frombuffer(spans, np.int64).tolist()
    edges = [0, *bounds, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(bounds) // 2


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, copy, spans in zip(*[c for c in batch.columns], strict=True):
                raw = (text.as_py() or "").encode()
                kept, runs = cut(raw, spans.as_py(), copy.as_py())
                rows.append((doc.as_py(), len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spans = removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return spans.select("doc_id", "text", "copy", "spans").mapInArrow(run, schema)


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated strings; n_chars follows the text if there is such a column.

    A character cut in part is dropped as a whole. Columns and their order stay.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"])  # the text is carried once
    aside = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, copy, span in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                value = text.as_py()
                kept = None if value is None else cut(value.encode(), span.as_py(), copy.as_py())[0]
                texts.append(None if kept is None else kept.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "kept"])

    schema = StructType([StructField("row", aside.schema["row"].dataType), StructField("kept", StringType())])
    out = removed_spans(aside).select("row", "text", "copy", "spans").mapInArrow(run, schema)
    return with_text(out, docs, F.col("kept"))


def with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row`` with a new text and its length as n_chars."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": text, "n_chars": F.length(text).cast(kinds.get("n_chars", "long"))}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
