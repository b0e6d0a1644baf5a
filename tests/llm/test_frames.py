"""Operators over tables: nulls, empty and repeated rows, ties, empty tables, clashing columns; against plain versions."""

import base64
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import bottomk, common, decontam, entries, licenses, mixing, quality, simhash, token_counts, token_output, warc

DOCS = "doc_id long, text string, value string, row int"
ROWS = [
    (3, "one two three four five six seven eight", "v", 1),
    (1, "one two three four five six seven eight", None, 2),
    (2, None, "x", 3),
    (4, "", "x", 4),
    (None, "a text without an id", None, None),
    (5, "long " * 20000, "y", 5),
    (5, "long " * 20000, "y", 5),
    (6, "Released under the MIT License.\nother line", "z", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_token_counts(docs, none):
    path = entries.tokenizer_file(entries.BYTE_BPE)
    got = token_counts.token_counts(docs, path, limit=5)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(ROWS)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].n_tokens == rows[4].n_tokens == 0 and rows[2].n_bytes == 0 and not rows[2].over_limit
    assert rows[3].n_tokens == rows[1].n_tokens == 8 and rows[3].over_limit
    assert token_counts.token_counts(none, path).count() == 0


def test_token_output(spark, docs, none, small):
    from tokenizers import Tokenizer

    path = entries.tokenizer_file(entries.WORD_BPE)
    t = Tokenizer.from_file(path)
    for frame in (docs, spark.read.parquet(f"{small}/documents.parquet")):
        got = token_output.token_output(frame, path).collect()
        want, at = [], 0
        for key, text in sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
            want.append((key, at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
            at += len(own)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.token_output(none, path).count() == 0


def brute(prints, bits=4):
    up = {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in prints}


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_components(spark, small, limit):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in simhash.simhash_components(frame, limit=limit).collect()}
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in frame.collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints and all(len(r.fingerprint) == 16 for r in got.values())
    assert {k: r.component_id for k, r in got.items()} == brute(prints)


def test_simhash_links_of_planted_fingerprints(spark):
    base = [0x0123456789ABCDEF, 0xFFFFFFFFFFFFFFFF, 0, 0x8000000000000000]
    fps = sorted({b ^ m for b in base for m in (0, 1, 3, 0xF, 0xFF, 0x8000000000000001, 0x0101010100000000, 0x0101010101000000, 0x1 << 20 | 1 << 40)})
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for limit, bits in ((4096, 4), (1, 4), (1, 3), (4096, 3), (1, 1), (1, 0)):
        want = brute(dict(enumerate(fps)), bits)
        found = {r.node: r.component for r in common.components(simhash.near_links(nodes, bits, limit)).collect()}
        for i, f in enumerate(fps):
            for j, g in enumerate(fps):
                same = found.get(simhash.signed(f), ("alone", f)) == found.get(simhash.signed(g), ("alone", g))
                assert same == (want[i] == want[j])


def test_simhash_edge_rows(docs, none):
    rows = ids(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id")
    by = {r[0]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[3][2] == by[1][2] == 1 and by[2][1] == by[4][1] == "0" * 16 and by[4][2] == 2 and by[5][2] == 5
    assert simhash.simhash_components(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (7, 7), (100, 90), (60, 61)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 80, 90: 80, 80: 80, 60: 60, 61: 60}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc_round_trip(spark):
    fake = "x WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n\r\nWARC/1.0\r\nContent-Length: 900\r\n\r\nzz"
    rows = [(1, "u\r\nx", fake), (2, None, fake), (3, "u", None), (4, "u", ""), (5, "u", "é" * 40), (6, "u", "WARC/1.0\r\n"), (7, "u", "\r\n\r\n"), (8, "u", fake * 30), (9, "%", "plain"), (10, "u", "plain"), (None, "n", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = {r.page_id: r for r in warc.warc_round_trip(pages.repartition(2)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first: dict = {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        r = got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if key is not None:
            at = first.setdefault(data, key)
            assert (r.record_type, r.refers_to) == (("response", None) if at == key else ("revisit", at))
    assert len(got) == len(rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    again = warc.warc_round_trip(pages.where("page_id in (9, 10)").unionByName(pages.where("page_id = 9")), min_bytes=100).collect()
    assert sorted((r.page_id, r.record_type) for r in again) == [(9, "response"), (9, "response"), (10, "response")]


def test_warc_of_many_torn_pages_and_a_hot_payload(spark, monkeypatch):
    """One file of torn records over many splits, payloads dealt out by digest, one of them in a third of the rows."""
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    rows = [(i, "u", "same" if i % 3 == 0 else f"<p>{i} " + "WARC/1.0\r\n" * (i % 5) + "y" * (i % 37) + str(i // 4)) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    try:
        got = {r.page_id: r for r in warc.warc_round_trip(pages.coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    first = {}
    for i, _, html in rows:
        data, at = html.encode(), first.setdefault(html, i)
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if at == i else ("revisit", at))


def test_revisits_are_checked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path)
    warc.check_revisits(warc.read_warc(spark, path))
    for file in (tmp_path / "warc").glob("part-*"):
        file.write_bytes(file.read_bytes().replace(b"abc\r\n", b"abd\r\n"))
    for file in (tmp_path / "warc").glob(".*.crc"):
        file.unlink()
    with pytest.raises(ValueError, match="revisits of <urn:page:1>"):
        warc.check_revisits(warc.read_warc(spark, path))


def test_magic_in_payloads_is_no_record(spark):
    rows = [("f", 0, 0, 100), ("f", 0, 30, 60), ("f", 0, 60, 100), ("f", 0, 100, 150), ("f", 1, 150, None), ("g", 0, 5, 9)]
    frame = spark.createDataFrame(rows, "file string, split int, begin long, next long")
    assert ids(warc.reachable(frame), "file", "begin") == [("f", 0), ("f", 100), ("f", 150)]


def test_page_text(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>a  b</p>"), (2, "u", "<article><p>é</article>")], "page_id int, url string, html string")
    from lakeweave.llm.html_text import page_text

    assert ids(page_text(pages), "page_id", "url", "text", "n_chars") == sorted([(1, None, "", 0), (2, "u", "", 0), (None, "u", "a b", 3), (2, "u", "é", 1)], key=str)


def plain_shingles(text):
    x = (text or "").lower().split()
    return {tuple(x[i : i + 5]) for i in range(len(x) - 4)} if len(x) >= 5 else ({tuple(x)} if x else set())


def test_fingerprints_against_exact_sets(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in bottomk.document_fingerprints(frame).collect()}
    rows = sorted(((r.doc_id, r.text) for r in frame.collect()), reverse=True)
    texts = {}
    for i, (key, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        r, a, b, c = got[key], plain_shingles(text), plain_shingles(edited), plain_shingles(other)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2 and abs(r.near_next - len(a & c) / len(a | c)) < 0.1
        if len(a | b) <= bottomk.K:
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b))
        assert r.shingles == pytest.approx(len(a), rel=0.4)
        assert texts.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(texts.values())) >= len(texts) - 2


def test_fingerprint_edges(spark, docs, none, monkeypatch):
    monkeypatch.setattr(bottomk, "RANGE_BYTES", 60)  # several ranges
    got = ids(bottomk.document_fingerprints(docs), "doc_id", "n_chars", "near_edited", "near_next")
    assert len(got) == len(ROWS)
    by = {r[0]: r for r in got}
    assert by[4][1] == by[2][1] == 0 and by[4][2] == 1.0 and by[3][3] == 0.0 and by[2][3] == 0.0
    assert bottomk.document_fingerprints(none).count() == 0
    one = bottomk.document_fingerprints(docs.where("doc_id = 3")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("spread", [1, 10**12, 10**17])
def test_next_documents_over_ranges(spark, monkeypatch, spread):
    """Against one sort: keys near and far, negative, repeated, one key and null in many rows."""
    monkeypatch.setattr(bottomk, "RANGE_BYTES", 300)
    monkeypatch.setattr(bottomk, "CELLS", 16)
    r = random.Random(spread)
    keys = [r.randint(-90, 90) * spread for _ in range(150)] + [7 * spread] * 120 + [None] * 100 + [90 * spread, -90 * spread]
    rows = [(k, f"text {i} " + "x" * r.randint(0, 12)) for i, k in enumerate(keys)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {x.text: x.h for x in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]), reverse=True)
    want = sorted((x[1], ordered[(i + 1) % len(ordered)][1]) for i, x in enumerate(ordered))
    got = bottomk.with_next(frame, "doc_id", "text", lambda df, window: df.where("not edge")).select("text", "next_text", "range").collect()
    assert sorted((x.text, x.next_text) for x in got) == want
    sizes = {}
    for x in got:
        sizes[x.range] = sizes.get(x.range, 0) + len(x.text)
    assert len(sizes) > 20 and max(sizes.values()) < 3000


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(600)]
    frame = spark.createDataFrame([("a", " ".join(words[:400])), ("a", " ".join(words[300:])), ("b", " ".join(words)), ("b", None)], "g string, t string")
    sketched = frame.select("g", bottomk.sketch(F.col("t")).alias("sketch"))
    merged = {r.g: r.sketch for r in bottomk.merge_groups(sketched, ["g"]).collect()}
    whole = sketched.where(F.col("g") == "b").orderBy(F.desc(F.size("sketch"))).first().sketch
    assert merged["b"] == whole and len(set(merged["a"]) & set(whole)) >= bottomk.K - 6
    a, b = (bottomk.sketch(F.lit(t)) for t in (" ".join(words[:300]), " ".join(words)))
    row = spark.range(1).select(bottomk.containment(a, b).alias("c"), bottomk.containment(b, a).alias("d"), bottomk.distinct_shingles(b).alias("n")).first()
    assert row.c > 0.8 and abs(row.d - 0.5) < 0.17 and abs(row.n - 596) < 150


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "ONE two three, four five six seven"), (2, None), (3, "a b"), (4, "six, seven"), (5, "?!"), (1, "ONE two three, four five six seven"), (None, "text without an id")], "item_id long, text string")
    for bits in (26, 2):  # a filter that lets everything through
        got = decontam.leaked_documents(docs, items, most_bits=bits)
        assert ids(got, "doc_id", "n_items", "item_ids", "coverage") == [(1, 3, [1, 1, 4], 1.0), (3, 3, [1, 1, 4], 1.0), (None, 1, [None], 1.0)]
    assert ids(decontam.leaked_documents(docs.where("doc_id is null"), items.where("item_id is null")), "doc_id", "n_items") == [(None, 1)]
    clash = docs.withColumn("key", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("coverage", F.lit(3))
    kept = decontam.decontaminated(clash, items)
    assert kept.columns == clash.columns and kept.count() == len(ROWS) - 3
    twice = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1"))
    assert ids(decontam.leaked_documents(twice, items), "doc_id", "n_items") == [(1, 3), (1, 3)]
    assert decontam.leaked_documents(none, items).count() == 0 and decontam.leaked_documents(docs, items.limit(0)).count() == 0
    assert decontam.decontaminated(docs, items.limit(0)).count() == len(ROWS)


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_leaks(docs, items, width=5, coverage=0.8):
    """Textbook tiling of every document with every item, longest match first, by scanning for each place."""
    out = {}
    for doc_id, text in docs:
        doc = words_of(text)
        grams = {tuple(doc[i : i + width]) for i in range(len(doc) - width + 1)}
        for item_id, item in items:
            item = words_of(item)
            least = min(width, len(item))
            if not item or least == width and not any(tuple(item[i : i + width]) in grams for i in range(len(item) - width + 1)):
                continue
            used_item, used_doc, total = set(), set(), 0
            where = {}
            for q, w in enumerate(doc):
                where.setdefault(w, []).append(q)
            while True:
                best = (0, 0, 0)
                for p in range(len(item)):
                    for q in where.get(item[p], ()):
                        n = 0
                        while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and p + n not in used_item and q + n not in used_doc:
                            n += 1
                        if n > best[0]:
                            best = (n, p, q)
                n, p, q = best
                if n < least:
                    break
                used_item.update(range(p, p + n))
                used_doc.update(range(q, q + n))
                total += n
            if total >= coverage * len(item):
                out.setdefault(doc_id, []).append(item_id)
    return {k: sorted(v) for k, v in out.items()}


def test_decontamination_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: r.item_ids for r in entries.QUERIES["op4_decontamination"](spark, small).collect()}
    assert got and got == plain_leaks(docs, items)
    r = random.Random(3)
    cut = []  # reordered, edited and halved items amid other words
    for i, (_, text) in enumerate(items[:40]):
        w = words_of(text)
        h = r.randint(3, max(3, len(w) - 3))
        parts = [w[h:], w[:h]] if i % 3 == 0 else [w[: int(len(w) * 0.85)]] if i % 3 == 1 else [w[: len(w) // 2]]
        cut.append((10_000 + i, " ".join(["x", *parts[0], "y z", *(parts[1] if len(parts) > 1 else [])])))
    got = {r.doc_id: r.item_ids for r in decontam.leaked_documents(spark.createDataFrame(cut, "doc_id long, text string"), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert got and got == plain_leaks(cut, items)


def test_decontamination_of_a_passage_that_many_items_share(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(i, f"{passage} own{i} words{i} of{i} item{i} alone{i} more{i} and{i} so{i}") for i in range(300)], "item_id long, text string")
    rows = [(d, f"before {passage} after{d} and a tail") for d in range(60)] + [(99, f"{passage} own7 words7 of7 item7 alone7 more7 and7 so7"), (100, "日本語の文章は空白で区切らない"), (101, f"{passage} 文章は空白で区切らない と")]
    got = decontam.leaked_documents(spark.createDataFrame(rows, "doc_id long, text string"), items.union(spark.createDataFrame([(500, "文章は空白で区切らない")], "item_id long, text string")))
    assert ids(got, "doc_id", "item_ids") == [(100, [500]), (101, [500]), (99, [7])]


def test_quality_frame(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify_quality(docs, labels)
    assert got.count() == len(ROWS) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    assert {r.score for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(none, labels).count() == 0


@pytest.fixture(scope="module")
def licence_model(spark, small):
    return licenses.train(spark, spark.read.parquet(f"{small}/documents.parquet"))


def plain_scan(model, text):
    """The scan of one text by its definition: every paragraph, every n-gram, no filter."""
    place, out = {g: i for i, g in enumerate(model.vocabulary)}, []
    for position, paragraph in enumerate(re.split(licenses.PARAGRAPH, text or "")):
        own = set(licenses.notice_grams(paragraph, 3))
        known = [place[g] for g in own if g in place]
        z = (model.weights[known].sum(0) / max(licenses.LEAST_NORM, len(known)) ** 0.5 + model.weights[-1]) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = model.classes[int(p.argmax())]
        if best == licenses.NONE:
            continue
        similar = max((len(own & set(g)) / len(g) for g in map(licenses.notice_grams, licenses.TEMPLATES.get(best, ()))), default=0.0)
        known = best != licenses.UNKNOWN and p.max() >= licenses.PROBABLE
        out.append((position, best if known else licenses.UNKNOWN, round(float(p.max()), 4), round(similar, 4), bool(known and similar >= licenses.CONFIRMED)))
    return out


def test_licences_equal_brute_force(spark, small, licence_model):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += [None, "", " \n\n ", "word " * 30000 + "Released under the MIT License. " + "all rights " * 9000, "Copyright 2011 Foo.\nx\nAll rights reserved.", "free software under the terms\r\n\r\nLicensed under\r\nCC0 1.0"]
    texts += [t.replace(" ", sep, 4) for ts in licenses.TEMPLATES.values() for t in ts for sep in (" ", "\n", " - ")] + list(licenses.UNLISTED) + list(licenses.OTHER)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *row) for i, t in enumerate(texts) for row in plain_scan(licence_model, t))
    for filtered in (True, False):
        got = licenses.scan(frame, model=licence_model, filtered=filtered).collect()
        assert sorted((r.doc_id, r.position, r.family, round(r.probability, 4), round(r.similarity, 4), r.confirmed) for r in got) == want
    assert sum(r[2] != "unknown" for r in want) > 150


def test_licences_held_out(spark, licence_model):
    """Notices and other texts that are not fitted."""
    notices = {
        "This file is distributed under the Apache License version 2.0.": "apache", "Licensed under the\nApache License,\nVersion 2.0": "apache", "SPDX: Apache-2.0": "apache",
        "Content is available under CC BY-SA 4.0.": "cc-by-sa", "GNU GENERAL PUBLIC LICENSE Version 3": "gpl", "It is free software under the GNU General Public License": "gpl",
        "The code is released under the MIT license": "mit", "Copyright (c) 2019 Jane Doe. All rights reserved.": "proprietary", "Available under Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
        "Mozilla Public License 2.0": "mpl", "Released under the 2-Clause BSD License.": "bsd", "BSD 3-Clause License": "bsd", "Licensed under the GNU LGPL, the Lesser General Public License": "lgpl",
        "Licensed under the Zebra Public License.": "unknown", "Boost Software License - Version 1.0": "unknown", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED': "unknown",
    }
    others = [
        "mit der Hand", "Er kam mit dem Rad", "The court of the city reserved its decision on copyright.", "The public was asked to read the terms of the new source.", "The car is sold without warranty.",
        "Version 4.0 of the timetable was published by the company", "A general without a public office, free and open.", "She got permission to use the software in the office.", "Copyright law was amended in the following year.",
    ]
    rows = list(enumerate([*notices, *others]))
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licence_model).collect()}
    assert sum(got.get(i) == want for i, want in enumerate(notices.values())) >= 15
    assert not [others[i - len(notices)] for i in got if i >= len(notices)]


def plain_quality(text):
    """The features by their definitions, a character or word at a time."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    lines, w, n = [x for x in text.split("\n") if x.strip()], len(words), len(text.encode())
    per = lambda chars: sum(c in chars for c in text) / w
    letters = [c for c in text if c.isascii() and c.isalpha()]
    return [
        math.log1p(w), sum(map(len, words)) / w, len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, max(map(len, lines)) / len(text), len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)), sum(c.isupper() for c in letters) / max(1, len(letters)), per("0123456789"), per("!"), per("|"), per("#$%&*+=<>@^_~\\/{}[]"), per(".?"), per(","), per("\"'();:-`"),
        sum(b >= 128 for b in text.encode()) / n, sum(len(x) <= 2 for x in words) / w, sum(len(x) >= 14 for x in words) / w, sum(c in "\t\n\r " for c in text) / n,
    ]


def test_quality_query_equals_plain_scores(spark, small):
    """Scores of the query against features by definition and tables looked up one by one; held-out accuracy."""
    small = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in entries.QUERIES["op1_quality"](spark, small).collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows[:200]:
        x = plain_quality(r.text)
        assert quality.features(r.text) == pytest.approx(x)
        z = model.intercept + sum(t[sum(c <= v for c in cuts)] for v, cuts, t in zip(x, model.cuts, model.tables, strict=True))
        z += sum(t[sum(c <= x[i] for c in model.coarse[i]), sum(c <= x[j] for c in model.coarse[j])] for i, j, t in model.pairs)
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)))
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.9 * len(held)


def test_licences(spark, docs, none, licence_model):
    rows = [(1, "SPDX-License-Identifier: MIT"), (3, None), (5, "see: licensed under the Mozilla Public License, v. 2.0"), (6, ""), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=licence_model).collect()
    assert sorted(((r.doc_id or 0), r.family) for r in got if r.confirmed) == [(0, "proprietary"), (1, "mit"), (5, "mpl"), (7, "cc-by-nc"), (7, "cc-by-nc")]
    assert [(r.doc_id, r.position, r.family) for r in licenses.scan(docs).collect()] == [(6, 0, "mit")]
    assert licenses.scan(none, model=licence_model).count() == 0 and licenses.scan(none).count() == 0
    frame = spark.createDataFrame([(family, t) for family, notices in licenses.TEMPLATES.items() for t in notices], "want string, paragraph string")
    assert licenses.scored(frame, licence_model).where("best <> want or similarity < 1").count() == 0


def plain_posteriors(rows, labelled, max_cells=mixing.MAX_CELLS):
    """P(domain | text) of ``(id, domain, text)`` rows, by the definition of the naive Bayes classifier."""
    sample = {i: (d, set((t or "").lower().split())) for i, d, t in rows if i in labelled and d is not None}
    domains = sorted({d for d, _ in sample.values()})
    size = np.array([sum(x == d for x, _ in sample.values()) for d in domains], float)
    counts = {}
    for d, ws in sample.values():
        for w in ws:
            counts.setdefault(w, np.zeros(len(domains)))[domains.index(d)] += 1
    least = min(mixing.MIN_SEEN, -(-len(sample) // mixing.SEEN_IN))
    vocabulary = {w: np.log((n + 1) / (size + 1 - n)) for w, n in counts.items() if n.sum() >= least}
    assert len(vocabulary) <= max_cells // len(domains)
    base = np.log(size / size.sum()) + sum(np.log((size + 1 - counts[w]) / (size + 2)) for w in vocabulary)
    out = []
    for _, _, t in rows:
        z = base + sum((vocabulary[w] for w in set((t or "").lower().split()) if w in vocabulary), np.zeros(len(domains)))
        e = np.exp(z - z.max())
        out.append(e / e.sum())
    return domains, np.array(out)


@pytest.mark.parametrize("domain", ["lang", "source"])
def test_mixing_meets_targets(spark, domain):
    """Totals computed from plain posteriors and the operator's rates meet the targets; 4 languages, 20 sources."""
    small = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [(r.doc_id, r[domain], r.text) for r in frame.orderBy("doc_id").collect()]
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1} if domain == "lang" else {f"src{i}": 1.0 + i % 3 for i in range(20)}
    rates, report = mixing.mixed(frame, labels, domain, weights)
    domains, p = plain_posteriors(rows, {r.doc_id for r in labels.collect()})
    assert domains == report["domains"] == sorted(weights)
    got = {r.doc_id: r for r in rates.collect()}
    tokens = np.array([len((t or "").split()) for _, _, t in rows])
    assert [got[i].tokens for i, _, _ in rows] == tokens.tolist()
    reached = (tokens * np.array([got[i].rate for i, _, _ in rows])) @ p
    target = np.array([weights[d] for d in domains]) / sum(weights.values()) * sum(report["target"])
    assert np.allclose(reached, target, atol=1e-3 * target.sum()) and np.allclose(reached, report["reached"], rtol=1e-4)
    assert all(got[i].domain == domains[int(q.argmax())] for (i, _, _), q in zip(rows, p, strict=True) if np.sort(q)[-1] - np.sort(q)[-2] > 1e-6)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got.values())
    if domain == "lang":
        assert sum(got[i].domain == d for i, d, _ in rows) > 0.8 * len(rows)
        assert mixing.mixed_documents(frame, labels, weights=weights).count() == sum(r.copies for r in got.values())


def test_mixing_steps_with_clipped_rates(spark):
    """Rates at zero: the targets are met by the others."""
    p = [[0.9, 0.1], [0.6, 0.4], [0.2, 0.8], [0.05, 0.95]] * 25
    cells = spark.createDataFrame([(x, 10 + i % 7) for i, x in enumerate(p)], "_p array<double>, _tokens long")
    history, report = mixing.fit_rates(cells, {"domains": ["a", "b"], "base": [0, 0]}, {"a": 0.12, "b": 0.88}, 400.0)
    rates = [r[0] for r in cells.select(mixing.folded(F.col("_p"), history)).collect()]
    assert min(rates) == 0.0 and np.allclose(report["reached"], [48, 352], atol=0.5)
    with pytest.warns(UserWarning, match="misses"):
        mixing.fit_rates(cells, {"domains": ["a", "b"], "base": [0, 0]}, {"a": 1.0}, 400.0)  # no document is of one domain alone


def test_mixing_places_short_texts(spark):
    # each text holds two of its language's 60 words, so that a few words say nothing of most texts
    rows = [(i, f"{'xy'[i % 2]}{i * 7 % 60} {'xy'[i % 2]}{i * 11 % 60}", "xy"[i % 2]) for i in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.document_rates(frame, frame.where("doc_id < 900")).join(frame, "doc_id").collect()
    assert len(got) == 1200 and all(r.domain == r.lang for r in got)


def test_mixing_edges(spark, docs, none):
    tagged = docs.withColumn("lang", F.when(F.col("doc_id") > 2, "en"))
    labels = spark.createDataFrame([(3,), (4,), (None,), (9,)], "doc_id long")
    got = mixing.document_rates(tagged, labels)
    assert got.count() == len(ROWS) and {r.domain for r in got.collect()} == {"en"} and all(r.rate == pytest.approx(1) for r in got.collect())
    assert {(r.domain, r.copies) for r in mixing.document_rates(tagged, labels.limit(0)).collect()} == {(None, 1)}
    assert mixing.document_rates(none.withColumn("lang", F.lit("x")), labels).count() == 0
    clash = tagged.withColumn("_mix", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("_hash", F.lit(3)).withColumn("domain", F.lit(4)).withColumn("copies", F.lit(5))
    repeated = mixing.mixed_documents(clash, labels)
    assert repeated.columns == clash.columns and repeated.count() == len(ROWS)
    # a tie goes to the first domain; the sample holds one row of a repeated id
    even = spark.createDataFrame([(i, "same words", "ba"[i % 2]) for i in range(8)] + [(0, "same words", "a")], "doc_id long, text string, lang string")
    assert {r.domain for r in mixing.document_rates(even.where("doc_id > 0"), even).collect()} <= {"a", "b"}
    assert mixing.labelled_sample(even, even, "lang", "doc_id", "text", 100).count() == 8
    assert {r.domain for r in mixing.document_rates(even.where("doc_id > 1"), even).collect()} == {"a"}


def test_mixing_drops_no_document(spark):
    p = [[0.5, 0.5]] * 4000  # a rate of 0.9: one in ten would go
    frame = spark.createDataFrame([(i, x, 3, i) for i, x in enumerate(p)], "doc_id long, _p array<double>, _tokens long, _hash long")
    model = {"domains": ["a", "b"]}
    copies = lambda weights, budget: {r[0] for r in mixing.with_mix(frame, model, [[0.1, 0.1]], "doc_id", mixing.kept_domains(model, weights, budget)).select("copies").collect()}
    assert copies(None, None) == copies({"a": 1.0}, None) == {1}
    assert copies({"b": 1.0}, None) == copies(None, 9000.0) == {0, 1}  # no weight, or too small a budget


def test_annotated_passes_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "t", "a", 2.0)], "row int, text string, value string, key double")
    out = common.annotated(frame, "text", lambda: lambda texts: [len(t) for t in texts], "long")
    assert [tuple(r) for r in out.select("row.*", F.col("value").alias("n")).collect()] == [(1, "t", "a", 2.0, 1)]


def test_pipeline_against_plain_stages(spark, small):
    got = {}
    for r in corpus_pipeline.run(spark, small).collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = {r["doc_id"]: r for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    labels, bench = spark.read.parquet(f"{small}/labels.parquet"), pq.read_table(f"{small}/benchmark.parquet").to_pylist()
    scores = {r.doc_id: r.score for r in quality.classify_quality(spark.read.parquet(f"{small}/documents.parquet"), labels).collect()}
    kept = {k: d for k, d in docs.items() if scores[k] >= 0.3}
    groups = brute({k: simhash.fingerprint(d["text"]) for k, d in kept.items()})
    kept = {k: d for k, d in kept.items() if groups[k] == k}
    leaked = plain_leaks([(k, d["text"]) for k, d in kept.items()], [(b["item_id"], b["text"]) for b in bench])
    kept = {k: d for k, d in kept.items() if k not in leaked}
    assert set(got) == set(kept)  # mixing repeats documents, and drops none of a domain with a weight
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entries.tokenizer_file(entries.WORD_BPE))
    frame = spark.createDataFrame([(k, d["text"], d["lang"]) for k, d in kept.items()], "doc_id long, text string, lang string")
    domains, p = plain_posteriors([(k, d["lang"], d["text"]) for k, d in kept.items()], {r.doc_id for r in labels.collect()})
    rates = {r.doc_id: r for r in mixing.document_rates(frame, labels, weights=entries.MIXTURE).collect()}
    tokens, rate = (np.array([getattr(rates[k], c) for k in kept]) for c in ("tokens", "rate"))
    share = np.array([entries.MIXTURE[d] for d in domains])
    assert np.allclose((tokens * rate) @ p / (tokens * rate).sum(), share / share.sum(), atol=0.002)
    for k, rows in got.items():
        own = [*tokenizer.encode(kept[k]["text"] or "", add_special_tokens=False).ids, 2]
        assert len(rows) == rates[k].copies and {(r.n_tokens, r.ids_crc32) for r in rows} == {(len(own), zlib.crc32(np.array(own, "<u4").tobytes()))}
    ordered, at = sorted((r for rows in got.values() for r in rows), key=lambda r: r.start), 0
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_pipeline_stages_on_odd_rows(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", None, 5), (2, "", "en", "s", 0), (5, "some words of a text that stay here for good", "en", "s", 44), (5, "other words", "en", "s", 11)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = odd.selectExpr("*", "1 as value", "2 as row", "3 as component_id", "4 as n", "5 as key", "6 as _hash", "7 as copies")
    for frame in (odd, odd.limit(0), clash):
        df = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = common.materialise(stage(spark, df, small), f"odd{k}")
            assert k == 4 or df.columns == frame.columns
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, odd, small).select("doc_id", "text").collect()]
    assert len(kept) == 3 and (1, None) in kept and (None, "no id") in kept and len([k for k, _ in kept if k == 5]) == 1


def test_scratch_paths_are_released(spark):
    since = common.mark()
    df = common.materialise(spark.range(5), "gone")
    assert df.count() == 5 and len(common._paths) == since + 1
    path = common._paths[-1]
    common.release(spark, since)
    assert len(common._paths) == since and not os.path.exists(path.removeprefix("file://"))


def test_components_with_hubs(spark):
    r = random.Random(4)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(300)] + [(r.randint(9000, 9400), r.randint(9000, 9400)) for _ in range(200)] + [(7, 7), (3, 0), (None, 4)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_entries_are_complete():
    assert {int(n[2:].split("_")[0]) for n in entries.QUERIES} == set(range(1, 11))


def test_workers_give_memory_back_when_their_batches_are_done(monkeypatch):
    from lakeweave.llm import common, token_output

    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1))
    some = common.trimmed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(some) == 2 and not calls and list(some) == [3] and calls == [1]
    assert token_output.MEMORY <= 400_000
