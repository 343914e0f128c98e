"""Duplicates, repeated strings, vectors, packing, archives, shards and the pipeline."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import DOCS, awkward_texts, components, cut_repeats, doc_rows, near_classes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from storytrends.llm import bpe, common, minhash, packing, pivots, queries, repeats, shards, suffixes, warc


@pytest.fixture(scope="module")
def docs(spark):
    texts = awkward_texts()
    return spark.createDataFrame(doc_rows(texts) + doc_rows(texts)[3:5], DOCS)


@pytest.fixture(scope="module")
def real(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1400)] + rng.integers(2000, 2300, (150, 2)).tolist()
    edges = [(int(a), int(b)) for a, b in edges if a != b]
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == components({n for e in edges for n in e}, edges)


def test_lookup_of_hot_keys(spark):
    left = common.written(spark.range(9000).select(F.when(F.col("id") < 8000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"), "left")
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    assert common.hot_keys(left, "k") == ["hot"]
    joined = common.lookup(left, right, "k")
    assert joined.count() == 9000 and joined.filter("v <> length(k)").count() == 0


def test_ranks_within_groups(spark):
    frame = common.written(spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("o"), "id"), "frame")
    groups = defaultdict(list)
    for r in common.rank_within(frame, "g", ["o", "id"]).collect():
        groups[r.g].append((r["rank"], r.o, r.id))
    for rows in groups.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_near_duplicates_equal_brute_force(request, which):
    frame = request.getfixturevalue(which)
    found = minhash.near_duplicates(frame).collect()
    classes = near_classes([(r.doc_id, r.text) for r in frame.collect()])
    assert len(found) == frame.count()
    assert {r.doc_id: r.class_id for r in found} == classes
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_near_duplicates_in_big_buckets(spark, monkeypatch):
    """Chains whose ends are unlike: links must be found among members, not only with the centre."""
    monkeypatch.setattr(minhash, "CHUNK", 4)
    base = [f"v{i}" for i in range(120)]
    texts = [" ".join(base[: 3 * n] and [f"x{n}_{i}" if i < 2 * n else w for i, w in enumerate(base)] or base) for n in range(12)]
    texts += [" ".join([f"y{i}" if i >= 120 - 2 * n else w for i, w in enumerate(base)]) for n in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(frame).collect()}
    assert found == near_classes(list(enumerate(texts)))


def test_weighted_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    universe = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.choice([0.5, 1, 2.5, 7], 60), rng.choice([0.25, 1, 3, 6], 60)
    signed = minhash.dart_signatures(np.tile(universe, 2), np.append(a, b), np.repeat([0, 1], 60), 2, 4000)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert np.mean(signed[0] == signed[1]) == pytest.approx(expected, abs=0.03)


@pytest.mark.parametrize("which", ["docs", "real"])
def test_repeats_equal_brute_force(request, which):
    frame = request.getfixturevalue(which)
    rows = {r.doc_id: r.text for r in frame.collect()}
    found = repeats.digest(frame).collect()
    assert len(found) == frame.count()
    expected = cut_repeats(list(rows.items()))
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id


def test_repeats_of_hot_passages(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    passage = " ".join(f"p{i * 31 % 89}" for i in range(60))
    short = passage[:70]
    texts = [f"start {n} {passage} end {n * 7}" if n % 2 else f"{n * 13} {short} {'abc' * (n % 5)} tail {n} {passage[80:]}" for n in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = cut_repeats(list(enumerate(texts)))
    assert {r[0]: tuple(r[1:]) for r in repeats.digest(frame).collect()} == expected


def test_repeats_keep_rows_and_columns(docs, real):
    out = repeats.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("n_chars <> length(text)").count() == 0 and out.filter("text IS NULL").count() == 1
    # what is left over has no string of its own document twice
    kept = [(r.doc_id, r.text) for r in repeats.remove(real).collect()]
    assert len(kept) == real.count()


def test_equal_suffixes_by_sorting():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[100:500]
    data[2000:2300] = data[150:450]
    starts = np.arange(2900)
    group = starts % 2
    number, member = suffixes.equal_groups(data, starts, group)
    found = defaultdict(set)
    for n, m in zip(number.tolist(), member.tolist(), strict=True):
        found[n].add(m)
    expected = defaultdict(set)
    for s in starts.tolist():
        expected[s % 2, data[s : s + 100].tobytes()].add(s)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def brute_links(vectors: dict, threshold=0.9) -> tuple[dict, dict]:
    good = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    edges = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    count = {i: 0 for i in vectors}
    for i, j in edges:
        count[i] += 1
        count[j] += 1
    return count, components(vectors, edges)


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 50)
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=64) for _ in range(300)]
    rows += [rows[n % 20] + rng.normal(size=64) * rng.choice([0.05, 0.3, 0.45]) for n in range(250)]
    rows += [rows[5]] * 80
    values = {i: [float(x) for x in np.float32(v)] for i, v in enumerate(rows)}
    n = len(values)
    values |= {n: None, n + 1: [0.0] * 64, n + 2: [float("nan")] + [1.0] * 63, n + 3: [None] + [1.0] * 63, n + 4: [], n + 5: [float("inf")] * 64}
    frame = spark.createDataFrame([(i, v, 0, 5) for i, v in values.items()], "vec_id long, embedding array<float>, label int, row int")
    count, parts = brute_links(values)
    found = {r.vec_id: r for r in pivots.links(frame).collect()}
    assert len(found) == len(values)
    assert all(found[i].n_links <= count[i] for i in values)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(count.values())
    near = sum(found[i].component_id == parts[i] for i in values)
    assert near >= 0.97 * len(values)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_vector_links_are_recalled(spark):
    """Planted near vectors in 48 dimensions, from just above the threshold to nearly equal, among strangers."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((120, 48))
    near = [b + rng.standard_normal(48) * s for b in base for s in (0.05, 0.2, 0.35, 0.45)]
    everything = [*base, *near, *rng.standard_normal((1500, 48)), *base[:5]]
    rows = {i: [float(np.float32(x)) for x in v] for i, v in enumerate(everything)}
    count, parts = _fast_links(rows)
    found = {r.vec_id: r for r in pivots.links(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")).collect()}
    assert sum(count.values()) > 500 and all(found[i].n_links <= count[i] for i in rows)
    assert sum(r.n_links for r in found.values()) >= 0.95 * sum(count.values())
    assert np.mean([found[i].component_id == parts[i] for i in rows]) > 0.99


def _fast_links(rows: dict) -> tuple[dict, dict]:
    ids = list(rows)
    unit = np.array([rows[i] for i in ids], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = np.concatenate([np.einsum("ik,jk->ij", unit[n : n + 500], unit) for n in range(0, len(ids), 500)]) >= 0.9
    np.fill_diagonal(link, False)
    edges = [(ids[a], ids[b]) for a, b in np.argwhere(link) if a < b]
    return dict(zip(ids, link.sum(axis=1).tolist(), strict=True)), components(rows, edges)


def test_no_usable_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivots.links(frame).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pivots.links(frame.limit(0)).count() == 0


def check_packing(pieces, texts: list, length=2048):
    vocabulary = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: [*vocabulary.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    held, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = defaultdict(int)
    for i, _ in texts:
        copies[i] += 1
    for i, parts in held.items():
        assert sum(n for _, n in parts) == copies[i] * len(ids[i])
    assert set(held) == set(ids) and set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return sum(n for parts in sequences.values() for _, n in parts) / (length * len(sequences))


def test_packing(docs, real):
    check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    filled = check_packing(packing.pack(real).collect(), [(r.doc_id, r.text) for r in real.collect()])
    assert filled > 0.97
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300, 20_000])
def test_cutting_stock_is_near_the_bound(n):
    sizes = np.clip(np.random.default_rng(n).lognormal(3.5, 1, n).astype(int), 1, 255)
    demand = np.bincount(sizes - 1, minlength=256)
    plan = packing.cutting_stock(demand, 256)
    assert (sum(p * c for p, c in plan) == demand).all()
    assert all((p * np.arange(1, 257)).sum() <= 256 for p, _ in plan)
    assert sum(c for _, c in plan) <= sizes.sum() / 256 * 1.005 + 3


def test_archive_round_trip(spark, tmp_path):
    page = "<p>" + "é body " * 40 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(5, "http://a/", page), (2, "http://b/ c\r\nx", page), (9, None, page), (2, "http://b/ c\r\nx", page), (3, "u", "small"), (4, "u", "small"), (7, "u", None), (8, "u", "")]
    path = str(tmp_path / "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = sorted((tuple(r) for r in warc.page_captures(spark, path).collect()), key=str)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    expected = [(i, size(t), digest(t), "revisit" if t == page and i != 2 else "response", 2 if t == page and i != 2 else None) for i, _, t in rows]
    assert found == sorted(expected, key=str)
    records = warc.read_records(spark, path)
    assert records.groupBy("type").count().count() == 4
    main = warc.captures(records).collect()
    assert len(main) == len(rows) and all(r.request and r.metadata for r in main)
    first = next(r for r in main if r.metadata.fields["page-id"] == "2")
    assert bytes(first.payload).decode() == page and first.request.uri == "http://b/cx"
    revisit = next(r for r in main if r.type == "revisit")
    assert revisit.refers_to == first.record_id


def test_archive_of_nothing_and_members(spark, tmp_path):
    import gzip

    path = str(tmp_path / "none")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.records_in(warc.inflated(data, 10))] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="cut off|ends"):
        list(warc.records_in(warc.inflated(data[:-20], 10)))


def test_shards(docs, real):
    for frame in (docs, real):
        texts = {r.doc_id: r for r in frame.collect()}
        found = shards.assign(frame).collect()
        assert len(found) == frame.count()
        slots, sources = defaultdict(list), defaultdict(lambda: defaultdict(int))
        for r in found:
            text = (texts[r.doc_id].text or "").encode()
            assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text) and r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
            sources[texts[r.doc_id].source][r.shard] += 1
        sizes = [len(slots[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        for counts in sources.values():  # every shard holds its part of every source
            share = sum(counts.values()) / 16
            assert all(abs(counts[s] - share) <= 2 for s in range(16))
    assert shards.assign(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tables):
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    names, texts = frame.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = common.written(stage(spark, frame, tables), "stage")
        if name == "packing":
            check_packing(frame.collect(), texts)
            continue
        assert frame.columns == names and frame.count() > 0
        assert frame.join(before, "doc_id", "left_anti").count() == 0
        texts = [(r.doc_id, r.text) for r in frame.collect()]
        if name == "near-duplicates":
            classes = near_classes([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(i for i, _ in texts) == sorted(i for i, c in classes.items() if i == c)
        if name == "repeated strings":
            kept = cut_repeats([(r.doc_id, r.text) for r in before.collect()])
            assert frame.count() == before.count()
            assert all(len(t.encode()) <= kept[i][0] - kept[i][1] for i, t in texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i, _ in texts)


def test_pipeline_with_awkward_rows(spark, docs, tables):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert name == "packing" or out.columns == docs.columns
        out.count()
        stage(spark, docs.limit(0), tables).count()


def test_repeats_without_ids(spark):
    passage = " ".join(f"passage{i}" for i in range(40))
    texts = [f"{' '.join(f'w{n}x{i}' for i in range(60))} {passage}" for n in range(3)]
    rows = [(5, texts[0]), (None, texts[1]), (None, texts[0]), (repeats.NO_ID, texts[2]), (None, "short"), (None, None)]
    found = repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in found)
    size = [len(t) for t in texts]
    cut = len("x59 ") + len(passage)  # the end of the last word before the passage is shared, too
    assert removed == sorted([(False, size[0], 0), (False, size[2], cut), (True, size[1], cut), (True, size[0], size[0]), (True, 5, 0), (True, 0, 0)])
    assert {r.doc_id for r in found} == {5, repeats.NO_ID, None}


def test_pipeline_loses_no_rows_without_or_of_one_id(spark, tables):
    texts = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (3, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[4]), (None, None), (None, "")]
    every = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows], DOCS)
    known = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    kept = corpus_pipeline.dedup(spark, every, tables)
    expected = [(True, 0, texts[0]), (True, 0, texts[1]), (False, 3, texts[2]), (False, 4, texts[3]), (False, 4, texts[4]), (True, 0, ""), (True, 0, "")]
    assert sorted(map(known, kept.collect())) == sorted(expected)
    assert sorted(map(known, corpus_pipeline.cut_repeats(spark, kept, tables).collect())) == sorted(expected)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, every, tables).count()


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pages_without_an_id(spark, tmp_path):
    """A null page_id stays null, is a response, and is never what others revisit."""
    same = "<p>" + "the same payload " * 20 + "</p>"
    rows = [(None, "http://x/0", same), (7, "http://x/7", same), (9, "http://x/9", same), (None, "http://x/n", None), (3, None, "short")]
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_captures(spark, path).collect())
    size = len(same)
    assert found == [("3", 5, "response", None), ("7", size, "response", None), ("9", size, "revisit", 7), ("None", 0, "response", None), ("None", size, "response", None)]


def test_near_duplicates_leave_no_superseded_tables(spark, tmp_path):
    """Only what the result reads stays in the shared folder."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words[:n], "x", *words[n + 1 :]]) for n in range(12)] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = common.written(frame, "probe").inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    before = set(os.listdir(root))
    found = minhash.near_duplicates(frame)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert not left & {"signatures", "texts", "members", "sets", "mixed", "edges"}, left
    assert found.select("class_id").distinct().count() == 1
