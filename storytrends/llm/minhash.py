"""Operator 9: near-duplicate documents by DartMinHash signatures and banded joining.

Every element of a weighted set owns a strip of a plane, as wide as its weight. Darts hit
the strip at ranks drawn from hashes of the element alone, so sets that share an element
share its darts. A set keeps the darts inside its weights; of those dealt to a
coordinate the earliest is the signature there. Two sets agree on a coordinate with the
probability of their weighted Jaccard similarity, and only about k log k darts are thrown
per set, however many elements it has.

Bands of the signatures bring candidates together. Equal texts are one class beforehand;
the members of a bucket are compared with its first document, those left over with its
last, and buckets that still hold several components are compared in blocks. Classes are
connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storytrends.session import drop_written

from .bpe import spans
from .common import components, hot_keys, lookup, written
from .shingles import OTHER, PRIME, mix, shingles, similarity

BANDS = 24
ROWS = 4
SIMILARITY = 0.8
#: Members compared with one copy of a bucket's centre, and documents of one block: some megabytes of sets.
CHUNK = 512


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int, k: int) -> np.ndarray:
    """Signatures (sets x k hashes) of ``sets`` sets given as flat (element, weight, owner).

    Weights are cut into strips [0, 1), [1, 2), [2, 4), ...; in a strip of width s darts
    arrive at rate s, so the strips are the same whatever weight a set gives the element.
    A set without elements has zeros.
    """
    width = np.bincount(owner, weights, sets)
    filled = np.bincount(owner, minlength=sets) > 0
    limit = k * (np.log(k) + 2) / np.where(width > 0, width, 1)
    out = np.zeros((sets, k), np.uint64)
    open_sets = filled
    while open_sets.any():
        best = throw(elements, weights, owner, open_sets, limit, k)
        found = np.zeros((sets, k), bool)
        found[best[0], best[1]] = True
        done = open_sets & found.all(axis=1)
        use = done[best[0]]
        out[best[0][use], best[1][use]] = best[2][use]
        open_sets = open_sets & ~done
        limit = limit * 2
    return out


def throw(elements, weights, owner, open_sets, limit, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """(set, coordinate, dart) of the earliest dart per set and coordinate below its rank limit."""
    use = open_sets[owner]
    element, weight, holder = elements[use], weights[use], owner[use]
    ranks, darts, holders = [], [], []
    low, high = 0.0, 1.0
    strip = np.uint64(1)
    while len(element):
        seed = mix(element * PRIME + strip)
        arrived = np.zeros(len(seed))
        seeds, width, of = seed, weight, holder
        step = np.array([0], np.uint64)
        while len(seeds):
            step = step + OTHER
            dart = mix(seeds + step)
            arrived = arrived - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (high - low)
            live = arrived < limit[of]
            seeds, width, of, arrived, dart = seeds[live], width[live], of[live], arrived[live], dart[live]
            inside = low + (high - low) * ((mix(dart ^ PRIME) >> np.uint64(11)).astype(float) * 2.0**-53) < width
            ranks.append(arrived[inside])
            darts.append(dart[inside])
            holders.append(of[inside])
        more = weight > high
        element, weight, holder = element[more], weight[more], holder[more]
        low, high, strip = high, high * 2, strip + np.uint64(1)
    rank, dart, of = np.concatenate(ranks), np.concatenate(darts), np.concatenate(holders)
    coordinate = (mix(dart + OTHER) % np.uint64(k)).astype(np.int64)
    place = of * k + coordinate
    order = np.lexsort((dart, rank, place))
    first = order[np.flatnonzero(np.diff(place[order], prepend=-1))]
    return of[first], coordinate[first], dart[first]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band (sets x bands) of its rows and its number."""
    part = signature.reshape(len(signature), bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * PRIME)[None, :]
    for n in range(rows):
        key = mix(key * PRIME + part[:, :, n])
    return key.view(np.int64)


def weighted(text: str | None, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a text with weight 1 each, or with their counts."""
    element, count = np.unique(shingles(text), return_counts=True)
    return element, count.astype(float) if counts else np.ones(len(element))


def signatures(docs: DataFrame, bands: int, rows: int, counts: bool = False, group_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, text_hash (null for a text without words) and the band keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, keys = batch.column(0), [], []
            group: list = []
            held = 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                element, weight = weighted(text, counts)
                hashes.append(hashlib.md5(text.encode()).hexdigest() if len(element) else None)
                group.append((element, weight))
                held += len(text)
                if held >= group_bytes or row == len(ids) - 1:
                    owner = np.repeat(np.arange(len(group)), [len(e) for e, _ in group])
                    flat = [np.concatenate([g[n] for g in group]) for n in (0, 1)]
                    found = dart_signatures(flat[0], flat[1], owner, len(group), bands * rows)
                    keys.append(band_keys(found, bands, rows))
                    group, held = [], 0
            flat_keys = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat_keys), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.string()), lists], ["doc_id", "text_hash", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_hash string, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and its sorted shingle set for the (doc_id, text_hash) of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "text_hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    )
    chosen = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"], "left_semi")
    return chosen.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a member, b centre) whose sets are similar enough.

    A centre's set is copied once per CHUNK members, so no task meets more members of it,
    and rows arrive sorted: a centre first, then its members, one pass without groups.
    """
    edges = written(edges, "pairs")
    counts = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    centres = counts.join(sets.withColumnRenamed("doc_id", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("a"), "shingles"
    )
    members = lookup(edges, counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk"))
    members = members.join(sets.withColumnRenamed("doc_id", "a"), "a").select("b", "chunk", "a", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            links = []
            for b, chunk, a, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = np.frombuffer(data, np.uint64)
                if a is None:
                    own = [*own, found] if at == (b, chunk) else [found]
                    at = (b, chunk)
                elif any(similarity(found, c) >= threshold for c in own):
                    links.append((a, b))
            columns = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    rows = centres.unionByName(members).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, doc_id and label of the members of buckets that hold several components, written."""
    labels = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    known = members.join(labels, "doc_id", "left")
    known = written(known.withColumn("label", F.coalesce("label", "doc_id")).select("key", "doc_id", "label"), "known")
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return written(lookup(known, mixed.select("key"), "key"), "mixed")


def last_edges(mixed: DataFrame) -> DataFrame:
    """Members of other components than the last document of their bucket, with that document."""
    last = mixed.groupBy("key").agg(F.max(F.struct("doc_id", "label")).alias("last"))
    other = lookup(mixed, last, "key").filter((F.col("label") != F.col("last.label")))
    return other.select(F.col("doc_id").alias("a"), F.col("last.doc_id").alias("b")).distinct()


class Strays:
    """Sets of one block, by shingle: a further set is compared with all of them at once."""

    def __init__(self, held: list[tuple[int, int, np.ndarray]]) -> None:
        docs, labels, sets = zip(*held, strict=True)
        self.docs, self.labels = np.array(docs), np.array(labels)
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.starts = np.unique(flat[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(flat)))

    def links(self, found: np.ndarray, label: int, threshold: float) -> list[int]:
        """One similar document of every other component; the rest of it is linked with that one already."""
        at = np.searchsorted(self.values, found)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == found]
        common = np.bincount(self.owner[spans(self.starts[at], self.counts[at])], minlength=len(self.docs))
        similar = common / (self.sizes + len(found) - common) >= threshold
        near = np.flatnonzero(similar & (self.labels != label))
        _, first = np.unique(self.labels[near], return_index=True)
        return self.docs[near[first]].tolist()


def cross_links(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links inside buckets between documents that lie in different components so far.

    Members of a bucket's most frequent component are linked among themselves already; only
    the others, its strays, are compared with everyone. Strays are dealt to blocks of about
    CHUNK. Each block of strays meets each block of members in one tile, which compares
    documents of different components and returns one link for each pair of a member and a component.
    """
    # Buckets of the same documents need one comparison: one key per content stays.
    content = mixed.groupBy("key").agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    content = content.groupBy("s", "n").agg(F.min("key").alias("key"))
    shares = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("share"))
    main = shares.groupBy("key").agg(F.max(F.struct("share", "label")).alias("m"), F.sum("share").alias("size"))
    blocks = F.ceil(F.col("size") / CHUNK).cast("int").alias("blocks")
    strays = F.ceil((F.col("size") - F.col("m.share")) / CHUNK).cast("int").alias("stray_blocks")
    plan = main.join(content.select("key"), "key").select("key", F.col("m.label").alias("main"), blocks, strays)
    rows = written(lookup(mixed, plan, "key"), "strays")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    stray_block = F.pmod(F.xxhash64("doc_id"), F.col("stray_blocks")).cast("int")
    every = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("low"), block.alias("high"), F.lit(1).alias("side"), "doc_id", "label"
    )
    own = rows.filter(F.col("label") != F.col("main")).select(
        "key", stray_block.alias("low"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("high"), F.lit(0).alias("side"), "doc_id", "label"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            links = []
            for key, low, high, side, doc, label, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (key, low, high):
                    at, held, index = (key, low, high), [], None
                found = np.frombuffer(data, np.uint64)
                if side == 0:
                    held.append((doc, label, found))
                    continue
                index = index or Strays(held)
                links += [(doc, other) for other in index.links(found, label, threshold)]
            columns = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    tiles = own.unionByName(every).join(sets, "doc_id").select("key", "low", "high", "side", "doc_id", "label", "shingles")
    return tiles.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, counts: bool = False
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicates) and kept, one row per row of ``docs``.

    Documents are linked if the sets of their five-word shingles have a Jaccard similarity
    of ``threshold`` or more; classes are the connected components. A text of fewer words
    is one shingle. Null and blank texts have none and link with nothing. Rows that repeat
    a doc_id are one node with all their texts. ``counts`` weighs shingles by their counts
    in the signatures. A row without a doc_id has no class: its class_id and kept are null.
    Other columns are not read.
    """
    signed = written(signatures(docs, bands, rows, counts), "signatures")
    texts = signed.filter("text_hash IS NOT NULL")
    firsts = texts.groupBy("text_hash").agg(F.min("doc_id").alias("first"))
    known = written(lookup(texts, firsts, "text_hash", hot_keys(texts, "text_hash")), "texts")
    heads = known.filter("doc_id = first")
    spread = heads.select(F.explode("bands").alias("key"), "doc_id", "text_hash")
    buckets = written(
        spread.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter("lo <> hi").select("key", "lo", "n"),
        "buckets",
    )
    all_rows = heads.count() * bands
    hot = [r[0] for r in buckets.filter(F.col("n") > all_rows / 2000).select("key").collect()]
    members = written(lookup(spread, buckets.drop("n"), "key", hot), "members")
    same = known.filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    same, ids = written(same, "same"), written(signed.select("doc_id"), "ids")
    for table in (signed, known, buckets):  # signatures are the bulk, and nothing reads them any more
        drop_written(table)
    sets = written(shingle_sets(docs, members.select("doc_id", "text_hash").distinct()), "sets")
    star = members.filter("doc_id <> lo").select(F.col("doc_id").alias("a"), F.col("lo").alias("b")).distinct()
    first_links = written(verified(star, sets, threshold), "links")
    first_mixed = labelled(members.select("key", "doc_id").distinct(), first_links)
    links = written(first_links.unionByName(verified(last_edges(first_mixed), sets, threshold)), "links")
    mixed = labelled(first_mixed.select("key", "doc_id"), links)
    every = written(links.unionByName(cross_links(mixed, sets, threshold)).unionByName(same), "links")
    for table in (members, sets, first_links, first_mixed, links, mixed, same):
        drop_written(table)
    found = components(every).withColumnsRenamed({"node": "doc_id", "component": "class_id"})
    drop_written(every)
    out = ids.join(found, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
