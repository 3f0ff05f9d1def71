"""The training-data operators against plain versions, over the smallest tables and hand-made cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log1p

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontam, html, licenses, neardup, packing, quality, rules, sharding, shared, training, warc
from quillon.llm import words as W

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \t\n", "one", "One  two\x0bthree", "a b c d", "a b c d", "x " * 400, "é ü z " * 30, "A" * 70000]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def docs_frame(spark, texts=TEXTS):
    """Odd rows: nulls, repeated rows and ids, an extra column with a clashing name."""
    rows = [(i, t, "en", "s", 0, "x") for i, t in enumerate(texts)] + [(3, "one", "en", None, 0, "x"), (None, "lost words here", None, "t", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def empty_docs(spark):
    return docs_frame(spark).limit(0)


def word_list(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def shingle_set(text, k):
    w = word_list(text, True)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


# words


def test_words_and_shingles():
    with np.errstate(over="ignore"):
        h, begin, end, first = W.words(*W.flat(pa.array(TEXTS)), lower=True)
        sh, at = W.shingles(h, first, 3)
    seen = {}
    for i, t in enumerate(TEXTS):
        w = word_list(t, True)
        assert first[i + 1] - first[i] == len(w)
        for x, y in zip(w, h[first[i] : first[i + 1]], strict=True):
            assert seen.setdefault(x, int(y)) == int(y)
        assert len(set(sh[at[i] : at[i + 1]].tolist())) == len(shingle_set(t, 3))
    assert len(set(seen.values())) == len(seen)


# 1 quality


def test_quality_learns_and_is_stable(spark):
    rng = np.random.default_rng(0)
    good = [" ".join("".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(60)) for _ in range(60)]
    bad = [" ".join("".join(rng.choice(list("AEIOULNRST"), 5)) + "!!" for _ in range(60)) for _ in range(30)]
    y = np.array([1.0] * 60 + [0.0] * 30)
    order = rng.permutation(90)
    net = quality.fit(pa.array([(good + bad)[i] for i in order]), y[order])
    p = quality.score(net, pa.array(good + bad))
    assert (p[:60] >= 0.3).mean() > 0.95 and (p[60:] < 0.3).mean() > 0.95
    alone = np.array([quality.score(net, pa.array([t]))[0] for t in [None, "", "abc", good[0]]])
    together = quality.score(net, pa.array([None, "", "abc", good[0]]))
    assert np.allclose(alone, together, atol=1e-6) and ((together >= 0) & (together <= 1)).all()


def plain_net():
    rng = np.random.default_rng(2)
    return quality.Net(
        np.eye(256, 8, dtype=np.float32), np.ones((64, quality.FILTERS), np.float32), np.zeros(quality.FILTERS, np.float32),
        rng.normal(size=(256, 8)).astype(np.float32), rng.normal(size=9).astype(np.float32), np.ones(quality.FILTERS + 2, np.float32),
    )


def test_quality_products_by_hand():
    """The filter of products against loops over bytes, and its gradient against nudged weights."""
    net = plain_net()
    texts = ["word word again again", "short", "", "ab" * 40]
    grid, starts, halves = quality.layout(*W.flat(pa.array(texts)))
    best, lags = quality.products(net, grid, starts, halves)
    at = 0
    for t in texts:
        raw = t.encode() + bytes(40)
        for w in range(max(1, -(-len(t.encode()) // 4))):
            sums = {}
            for lag in quality.LAGS:
                if 4 * w >= lag:
                    sums[lag] = sum(float((net.twin[raw[4 * w + k]] * net.twin[raw[4 * w + k - lag]] * net.weigh[:8]).sum()) for k in range(8))
            if sums:
                assert abs(best[at + w] - max(sums.values())) < 1e-3 and abs(sums[int(lags[at + w])] - max(sums.values())) < 1e-3
            else:
                assert best[at + w] == -np.inf
        at += max(1, -(-len(t.encode()) // 4)) + 1
    grad = np.where(np.isfinite(best), 1, 0).astype(np.float32)
    g_twin, g_weigh = quality.twin_gradient(net, grid, lags, grad)
    total = lambda: float(np.where(grad > 0, quality.products(net, grid, starts, halves)[0], 0).astype(np.float64).sum())
    for weights, gradient, i in ((net.twin, g_twin, (ord("a"), 3)), (net.twin, g_twin, (ord("w"), 0)), (net.weigh, g_weigh, (5,))):
        before, kept = total(), weights[i]
        weights[i] += 1e-2
        assert abs((total() - before) / 1e-2 - gradient[i]) < 0.05 * max(1, abs(gradient[i]))
        weights[i] = kept


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.classify(docs, labels).collect() if r.held_out and r.doc_id in want]
    assert len(rows) > 50 and np.mean([r.predicted == want[r.doc_id] for r in rows]) > 0.9


def test_quality_gradient():
    """Forward passes with a nudged filter move the loss as the chain rule says: the pooled answer is what it is by hand."""
    net = plain_net()
    text = bytes(range(8)) * 200
    data, offsets = W.flat(pa.array([text.decode("latin1")]))
    pooled = quality.forward(net, *quality.layout(data, offsets))[-1][0]
    windows = [sum(1 for b in text[i : i + 8]) for i in range(0, len(text), 4)]
    chunks = [np.mean(windows[a : a + 128]) for a in range(0, len(windows) - 64, 64)]
    assert abs(pooled[0] - max(chunks)) < 1e-4


def test_quality_query(spark):
    got = quality.classify(docs_frame(spark), read(spark, "labels"), train=read(spark, "documents")).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert quality.classify(empty_docs(spark), read(spark, "labels").limit(0)).count() == 0
    assert {r.score for r in quality.classify(docs_frame(spark), read(spark, "labels").limit(0)).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = read(spark, "labels").unionByName(spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    texts, y = training.labelled_sample(read(spark, "documents"), labels, rows=20)
    assert len(texts) == len(y) == 20
    long = spark.createDataFrame([(1, "x" * 200_000), (2, "short")], "doc_id long, text string")
    texts_, _ = training.labelled_sample(long, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert all(len(x) <= training.SAMPLE_BYTES for x in texts_.to_pylist())
    fold = {r.text for r in read(spark, "documents").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    rest = {r.text for r in read(spark, "documents").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert not (set(texts.to_pylist()) & (fold - rest))


def test_calibration():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(3 * z + 1)))).astype(float)
    a, b = training.calibrate(z, y)
    assert abs(a - 3) < 0.4 and abs(b - 1) < 0.3


# 2 chat


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "\\h\\b\\e\\", "####</turn></turn", None, "", "a\n### user: x", "<</turn>", "###", "é</turn>\\"]
    rows = [(1, i, ("user", "assistant", "assistant", "x: y###")[i % 4], t, "t") for i, t in enumerate(odd)] + [(2, 1, "assistant", "b", ""), (2, 0, "assistant", "a", ""), (None, 0, None, "n", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = defaultdict(list)
    for conv, _, role, text, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[conv].append((role or "", text or ""))
    for conv, pairs in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == pairs
        assert got[conv].loss_text == "".join(t for r, t in pairs if r == "assistant")
    text = {r.conv_id: r.formatted for r in made.collect()}
    assert text[2] == "### assistant: a</turn>b</turn>"
    digest = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert digest[2].turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\nb\n").hexdigest() and digest[2].n_turns == 2
    assert chat.digests(turns.limit(0)).count() == 0


# 3 near duplicates


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    d = read(spark, "documents")
    base = " ".join(f"w{i}" for i in range(60))
    near = [" ".join(x if i != j else "zz" for i, x in enumerate(base.split())) for j in (5, 6, 30, 59)] * 2 + [base, base.upper()]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*TEXTS, *near])], "doc_id long, text string")
    rows = d.select("doc_id", "text").unionByName(extra)
    want = brute_components({r.doc_id: shingle_set(r.text, k) for r in rows.collect()}, percent)
    got = neardup.near_duplicates(rows, k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    got = neardup.near_duplicates(docs_frame(spark)).collect()
    assert Counter(r.doc_id for r in got)[3] == 2 and None not in {r.doc_id for r in got}
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_near_duplicates_in_parts(spark, monkeypatch):
    """Groups that the first comparisons leave in parts: copies like their base only, chains, over several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PROBES", 1)
    rng = np.random.default_rng(6)
    texts = {}
    base = [f"b{i}" for i in range(300)]
    for i in range(50):
        t = list(base)
        for at in rng.choice(300, int(rng.integers(3, 10)), replace=False):
            t[at] = f"x{i}y{at}"
        texts[i] = " ".join(t)
    texts[90] = " ".join(base)
    words = [f"c{i}" for i in range(500)]
    for i in range(30):  # each like the next few only
        texts[int(100 + rng.permutation(100)[i] * 100 + i)] = " ".join(words[5 * i : 5 * i + 150])
    want = brute_components({i: shingle_set(t, 3) for i, t in texts.items()}, 85)
    assert len(set(want.values())) >= 2
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_registers_estimate():
    rng = np.random.default_rng(2)
    with np.errstate(over="ignore"):
        a = W.mix(rng.integers(0, 2**62, 3000).astype(np.uint64))
        b = np.concatenate([a[:2700], W.mix(rng.integers(0, 2**62, 300).astype(np.uint64))])
        s = neardup.sketch(np.concatenate([a, b]), np.array([0, 3000, 6000]))
        n = np.array([3000])
        assert abs(neardup.estimate(s[:1], s[1:], n, n)[0] - 2700 / 3300) < 0.12
        assert neardup.common([np.sort(a), np.sort(b)])[0, 1] == 2700


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# 4 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "v\r\nX: y", "same"), (3, None, None), (4, "w", ""), (5, "w", "é\r\n\r\n" * 500), (5, "w", "é\r\n\r\n" * 500), (None, "n", "same"), (9, "z", "other")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    index = warc.write_bundles(pages, str(tmp_path / "bundles"))
    got = sorted(warc.read_bundles(index).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "response", None), (9, "response", None),
    ]
    for r in got:
        payload = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest(payload)
    for r in index.collect():
        frame = warc.read_frame(r.bundle, r.frame)
        headers, _, end = warc.parse_record(frame, r.offset)
        assert headers["WARC-Record-ID"] == r.record_id and end == r.offset + r.length
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_bundles(warc.write_bundles(pages.where("page_id < 3"), least=100)).collect()} == {"response"}


# 5 rules


def brute_rules(text):
    w = word_list(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if word_list(x)]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_rules(spark):
    texts = [*TEXTS, "a b c d e f g h i\n" * 3, "a\n\n a\na\n", "# * $ % & | < >", "q " * 19, " x y"]
    model = rules.Model()
    rows = [r.text for r in read(spark, "documents").collect()] + texts
    got = rules.measures(pa.array(rows), model)
    for i, t in enumerate(rows):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_rules(t), t and t[:80]
    out = rules.judge(docs_frame(spark), read(spark, "labels"), train=read(spark, "documents")).collect()
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.judge(empty_docs(spark), read(spark, "labels").limit(0)).count() == 0


def test_rules_model():
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["the", "of", "sea", "land", "sky"], 40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["buy", "now", "$$$", "win"], 40)) for _ in range(30)]
    y = np.array([1.0] * 60 + [0.0] * 30)
    order = rng.permutation(90)
    model = rules.fit(pa.array([(good + bad)[i] for i in order]), y[order])
    p = rules.measures(pa.array(good + bad), model)["probability"]
    assert (p[:60] > 0.5).all() and (p[60:] < 0.3).all()


# 6 licences


def test_licences(spark):
    said = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, f"Prose before.\n{t}\nProse after.") for i, t in enumerate(said.values())] + [(10, "She lost her license in public."), (11, None), (12, ""), (None, "Released under the MIT License."), (0, "nothing")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: r.family for r in got}
    assert [found[i] for i in range(4)] == list(said) and found[10] is None and found[11] is None and found[None] is None
    assert len(got) == len(rows)
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_licences_that_are_no_templates(spark):
    said = {
        "MIT License": "MIT", "License: MIT.": "MIT", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "The MIT License (MIT)": "MIT",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL", "This code is released under the MIT license...": "MIT",
        "SPDX-License-Identifier: EPL-2.0": None, "He lost his license.": None, "She studied at MIT.": None, "The license plate was lost.": None,
    }
    rows = list(enumerate(said))
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == said


def test_licences_unseen_wordings_and_wrapped_notices(spark):
    """Wordings that are no templates, comment signs and lines wrapped at 70 columns; one notice each."""
    said = {
        "We put all of this code under the MIT License, so go ahead.": "MIT",
        "For what you may do with this, see the GNU General Public License.": "GPL",
        " * This file is part of a project that is licensed under the\n * Apache License, Version 2.0, and so are its tests.": "Apache-2.0",
        "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal in\nthe Software without restriction under the terms of the MIT license.": "MIT",
        "Figures are shared by us under CC BY-SA 4.0": "CC-BY-SA",
        "The general public\nwas at the library to license a new style of boat": None,
        "A driving license\n\nThe general public": None,
    }
    rows = list(enumerate(said))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.family, r.n_notices) for r in licenses.scan(frame).collect()}
    assert {t: got[i] for i, t in rows} == {t: (f, int(f is not None)) for t, f in said.items()}


def test_licences_held_out_templates(spark):
    """Of the model in use, on patterns, notices and names that set neither weights nor temperature alone: precision, recall, calibration error."""
    grams, offsets, temperature = licenses.train(spark)
    classes, weight = sorted(offsets), dict(grams)
    rows = licenses.model_rows(spark).where("use = 'test'").select("family", "grams", "w").collect()
    told = set(licenses.marks(grams, offsets))
    right = said = there = 0
    bins = defaultdict(list)
    for r in rows:
        z = np.array([sum(weight[g][i] for g in r.grams if g in weight) + offsets[c] for i, c in enumerate(classes)]) / temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = classes[int(p.argmax())]
        if not told & set(r.w):
            assert best == licenses.UNKNOWN  # what isn't looked at couldn't be a notice
        bins[int(p.max() * 10)].append((p.max(), best == r.family))
        said += best != licenses.UNKNOWN
        there += r.family != licenses.UNKNOWN
        right += best == r.family != licenses.UNKNOWN
    error = sum(abs(sum(p for p, _ in b) - sum(ok for _, ok in b)) for b in bins.values()) / len(rows)
    assert len(rows) > 500 and right / said > 0.98 and right / there > 0.95 and error < 0.05


# 7 packing


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    extra = [None, "", "it's we'll’ 中文 \U0001f600", "  two  spaces\n\n\nlines \t x", "<|endoftext|> a", "tail  ", "x\n", "1234 a1b2\x00", "a" * 3000]
    rows = [(r.doc_id, r.text, r.source) for r in read(spark, "documents").collect()] + [(5000 + i, x, None) for i, x in enumerate(extra)] + [(5000, "again", "s")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), path, with_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        seqs[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
    want = Counter()
    for i, x, _ in rows:
        want[(i, (*t.encode(x or "", add_special_tokens=False).ids, 1))] += 1
    have = Counter()
    for (i, n), ps in pieces.items():
        ps.sort(key=lambda r: r.start)
        ids = [x for r in ps for x in r.ids]
        assert len(ids) == n
        have[(i, tuple(ids))] += 1
    assert have == want
    sizes = {}
    for s, rs in seqs.items():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        sizes[s] = at
    assert sorted(seqs) == list(range(len(seqs)))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values()) and sum(n == 2048 for n in sizes.values()) >= len(sizes) - 11
    assert packing.pack(empty_docs(spark), path).count() == 0


def test_packing_mixture(spark):
    """Every full mixture window is within one packet of each source's share, which deficits carried over make sure of."""
    sizes = spark.range(6000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), (F.col("id") % 700 + 1).alias("n"))
    got = packing.plan(sizes).join(sizes.select("row", "source"), "row").groupBy((F.col("sequence_id") / packing.WINDOW).cast("int").alias("w"), "source").agg(F.sum("length").alias("n")).collect()
    total = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    last = max(r.w for r in got)
    for r in got:
        if r.w < last:
            assert abs(r.n - total[r.source] / sum(total.values()) * packing.WINDOW * packing.LENGTH) < 700 * 8


def test_packing_many_sources(spark):
    """Sources too small for a packet in each window take turns: no window or group of rounds holds them all."""
    sizes = spark.range(20_000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(300).cast("long").alias("n"))
    got = packing.plan(sizes).join(sizes.select("row", "source"), "row").withColumn("w", (F.col("sequence_id") / packing.WINDOW).cast("int"))
    # the last digit of the source stands for a group of sources with a tenth of the tokens each
    per = {(r.w, r.g): r.n for r in got.groupBy("w", F.substring("source", -1, 1).alias("g")).agg(F.sum("length").alias("n")).collect()}
    window = packing.WINDOW * packing.LENGTH
    last = max(w for w, _ in per)
    assert last == 20_000 * 300 // window
    assert all(abs(n - window / 10) < window / 20 for (w, _), n in per.items() if w < last)


def test_packing_shares(spark):
    """Given shares hold in each window for as long as every source has tokens; then the others fill its place."""
    sizes = spark.range(4000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(700).cast("long").alias("n"))
    got = packing.plan(sizes, {"a": 3.0, "b": 1.0}).join(sizes.select("row", "source"), "row")
    per = {(r.w, r.source): r.n for r in got.groupBy((F.col("sequence_id") / packing.WINDOW).cast("int").alias("w"), "source").agg(F.sum("length").alias("n")).collect()}
    window = packing.WINDOW * packing.LENGTH
    full = 2000 * 700 * 4 // 3 // window
    assert full > 10
    assert all(abs(per[w, "a"] - window * 3 / 4) < 3 * 700 for w in range(full))
    assert sum(per.values()) == 4000 * 700 and ((full + 2), "a") not in per


def test_encoder_pieces():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), packing.Encoder(path, known=500)
    parts = ["don't", "'", "s", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "'ve", "l", "ve", "é", "中文", "٣", "½", "!", "''", "'m", "\xa0", "\u2003", "😀", "'d", "\x1f", "\x85", "１", " '", "word"]
    rng = np.random.default_rng(3)
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(6000)]
    for at in range(0, len(texts), 300):
        batch = texts[at : at + 300]
        assert [x.tolist() for x in own.encode(batch)] == [x.ids for x in plain.encode_batch(batch, add_special_tokens=False)]
    assert len(own.key) <= 1000  # the limit, and one batch


# 8 sharding


def test_sharding(spark):
    d = read(spark, "documents")
    got = sharding.assign(d, 60_000).collect()
    assert len(got) == d.count()
    size, rows = Counter(), Counter()
    for r in got:
        size[r.shard] += r.bytes
        rows[r.shard] += 1
    assert all(size[r.shard] == r.shard_bytes for r in got)
    assert all(n <= 60_000 or rows[s] == 1 for s, n in size.items())
    tree = {(r.depth, r.prefix) for r in got}
    for depth, prefix in tree:  # no bucket lies within another, and each split was needed
        assert not any((e, prefix >> (depth - e)) in tree for e in range(depth))
        if depth:
            under = sum(r.bytes for r in got if r.depth >= depth - 1 and (r.prefix >> (r.depth - depth + 1)) == prefix >> 1)
            assert under > 60_000
    same = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, None), (None, "y")], "doc_id long, text string")
    over = Counter(r.shard for r in sharding.assign(same, 1000).collect() if r.bytes == 100)
    assert len(over) == 5 and set(over.values()) == {10}
    assert sharding.assign(empty_docs(spark)).count() == 0


def test_write_shards(spark, tmp_path):
    d = read(spark, "documents")
    sharding.write_shards(d, str(tmp_path / "s"), 60_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    # what was written is what was assigned, text for text
    want = Counter((r.doc_id, r.shard) for r in sharding.assign(d, 60_000).collect())
    assert Counter((r.doc_id, r.shard) for r in back.collect()) == want
    assert back.drop("shard").exceptAll(d).count() == 0 == d.exceptAll(back.drop("shard")).count()


def test_write_shards_odd_tables(spark, tmp_path):
    """An empty table, names that clash with ours, rows equal in id and text, nulls, very long texts."""
    sharding.write_shards(empty_docs(spark), str(tmp_path / "empty"))
    names = ["depth", "prefix", "hash", "bytes", "part", "shard", "row", "overflow", "at"]
    rows = [(1, "x" * 100, *names)] * 50 + [(2, None, *names), (None, "y", *names), (3, "z" * 300_000, *names)]
    d = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    sharding.write_shards(d, str(tmp_path / "clash"), 1000)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert back.drop("shard_").exceptAll(d).count() == 0 and back.count() == len(rows)
    sizes = Counter()
    for r in back.collect():
        sizes[r.shard_] += len(r.text or "")
    assert all(n <= 1000 or n == 300_000 for n in sizes.values())
    assert Counter(r.shard for r in sharding.assign(d, 1000).collect() if r.bytes == 100) == Counter({s: 10 for s in sizes if sizes[s] == 1000})


# 9 decontamination


def brute_leaks(docs, items):
    sets = {i: [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] for i, t in items for w in [word_list(t.lower())] if w}
    df = Counter(s for x in sets.values() for s in set(x))
    n, out = len(sets), {}
    weight = lambda s: log1p(n / df[s])
    for d, t in docs:
        w = word_list((t or "").lower())
        places = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for i, x in sets.items():
            own, k = set(x), len(x)
            whole = sum(map(weight, own))
            for a in range(len(places)):
                part = places[a : a + k]
                s = sum(weight(y) for y in set(part) & own) / (whole + sum(y not in own for y in part) * log1p(n))
                if s >= 0.8 - 1e-9:
                    out[(d, i)] = max(out.get((d, i), 0), s)
    return out


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    rng = np.random.default_rng(4)
    longest = max(items, key=lambda x: len(x[1]))[1].split()
    changed = " ".join(x if i != 3 else "other" for i, x in enumerate(longest))
    extra = [(2000, f"before words {changed} after"), (2001, items[0][1].upper() + " " + items[1][1]), (2002, None), (2003, ""), (2004, items[2][1][:60]), (2005, " ".join(rng.permutation(longest)))]
    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()] + extra
    frame = spark.createDataFrame([*docs, extra[1], (None, items[0][1])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(frame, read(spark, "benchmark")).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert {(2000, max(items, key=lambda x: len(x[1]))[0]), (2001, items[0][0]), (2001, items[1][0])} <= set(got)
    assert decontam.leaks(empty_docs(spark), read(spark, "benchmark")).count() == 0
    assert decontam.leaks(frame, read(spark, "benchmark").limit(0)).count() == 0
    assert decontam.clean(frame, read(spark, "benchmark")).count() == frame.count() - sum(1 for d, _ in [*docs, extra[1]] if d in {k[0] for k in want})


def test_decontamination_by_shuffle(spark):
    """With nothing sent to all tasks the result is the same."""
    small = {(r.doc_id, r.item_id, r.start) for r in decontam.leaks(read(spark, "documents"), read(spark, "benchmark")).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(r.doc_id, r.item_id, r.start) for r in decontam.leaks(read(spark, "documents"), read(spark, "benchmark")).collect()} == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_decontamination_inside_runs(spark):
    """Items within a longer run of known shingles, and rows that repeat an id."""
    w, v, x = ([f"{c}{i}" for i in range(100)] for c in "wvx")
    parts = [w[0:50], w[25:75], w[50:100], v[0:40] + w[26:74] + v[40:80], x[0:12]]
    items = [(i, " ".join(p)) for i, p in enumerate(parts)]
    own = [(1, " ".join(w[10:90])), (2, " ".join(w)), (3, " ".join(["foreign"] * 30 + v[0:40] + w[26:74] + v[40:80])), (4, " ".join(["b"] + w[30:50] + ["c"] + w[10:25]))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(own, items)
    assert {(1, 1), (2, 0), (2, 1), (2, 2), (3, 3), (3, 1)} <= set(want)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    twice = [(5, " ".join(x[0:12] + ["end"] * 9)), (5, " ".join(["a"] * 7 + w[20:60] + x[5:9]))]
    found = decontam.leaks(spark.createDataFrame(twice, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start) for r in found} == {(5, 4, 0)}


def test_index_reaches_the_radius():
    bounds = decontam._block_bounds()
    assert len(bounds) == decontam.BLOCKS and [a for a, _ in bounds[1:]] + [decontam.BITS] == [a + n for a, n in bounds]
    assert all(a // 64 == (a + n - 1) // 64 for a, n in bounds)
    assert len(decontam._near_masks(9)) == 1 + 9 + 36
    assert decontam.RADIUS < decontam.BLOCKS * (decontam.RADIUS // decontam.BLOCKS + 1)  # by the pigeonhole principle


# 10 pages


def page(article, host="h", extra=""):
    return (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>c</p> -->'
        f'<div class="ad">Buy</div>{extra}<article>{article}</article><div id="cookie-notice">We use</div><section class="comments"><p>First!</p></section><footer>&copy; {host}</footer></body></html>'
    )


def test_pages(spark):
    rows = [
        (1, "http://h/1", page("<h1>A &amp; B</h1><p><b>One\n  two<br><p>Three <i>four</i>&nbsp;five")), (2, "http://h/2", page("<p>Other</p>", extra="<aside>side</aside><form>mail <input></form>")),
        (3, None, None), (4, "::", ""), (5, "http://k/1", "<div class=x><p>Plain</p></div><div class=x>text"), (6, "http://m/1", "<main><header><h1>Head</h1></header><p>Body</p><aside>no</aside></main>"),
        (1, "http://h/1", page("<p>Again</p>")),
    ] + [(20 + i, f"http://r/{i}", f"<div class='top'>Same banner text</div><div class='body'><p>Story {w}</p></div>") for i, w in enumerate(["one", "two", "three"])]
    got = html.main_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()
    text = {(r.page_id, r.text) for r in got}
    assert text == {
        (1, "A & B\n\nOne two\n\nThree four five"), (2, "Other"), (3, ""), (4, ""), (5, "Plain\n\ntext"), (6, "Head\n\nBody"), (1, "Again"), (20, "Story one"), (21, "Story two"), (22, "Story three"),
    }
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert html.main_text(read(spark, "pages").limit(0)).count() == 0


def test_pages_marked_by_class_or_form(spark):
    """The mark of a wrapper, or of a section inside an article, takes no text that is a page's own."""
    htmls = {
        1: '<html class="no-ads"><body class="has-sidebar"><article><p>Body</p></article></body></html>',
        2: '<html><body><form id="aspnetForm"><div><p>All in a form</p></div></form></body></html>',
        3: '<body><div class="sidebar-layout"><article><p>Text</p><section id="discussion"><p>Discussed</p></section><section id="related-work"><p>Related</p></section></article></div></body>',
        4: '<body><aside><p>Links</p><main><p>Inside</p></main></aside></body>',
        5: '<body class="no-sidebar"><p>Plain page</p><nav>Menu</nav></body>',
    }
    rows = [(i, f"http://marked{i}/", h) for i, h in htmls.items()]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Body" and got[2] == "All in a form" and got[3] == "Text\n\nDiscussed\n\nRelated" and got[4].endswith("Inside") and got[5] == "Plain page"


def test_pages_malformed():
    """Megabytes of what never ends are read once; an unclosed button or svg takes no text with it."""
    import time

    n, began = 1_000_000, time.process_time()
    for bad in ("<a " * n, "<!x" * n, "<div>" * (n // 4) + "</section>" * (n // 4), "<head>" * (n // 4), "<article>" * (n // 8), '<p a="' * n, "<!--" * n, "&" * n, "<" * n, "</" * n):
        assert isinstance(html.Page(f"<p>One</p>{bad}").text(set()), str)
    assert time.process_time() - began < 120
    assert html.Page("<p>One<button>Two<svg><p>Three").text(set()) == "One Two\n\nThree"
    assert html.Page("<p title='a>b' don't>One</p><p x=\"1\"y>Two").text(set()) == "One\n\nTwo"


def test_pages_by_entropy(spark):
    """On pages with an article, too, what repeats on the host goes and what doesn't stays."""
    names = ["one", "two", "three", "four"]
    rows = [(i, f"http://e/{i}", f'<main><div class="top">Same for all</div><div><p>Story {w}</p></div></main>') for i, w in enumerate(names)]
    rows += [(10 + i, f"http://f/{i}", f'<article>Card</article><div class="text"><p>Real {w}</p></div><div class="foot">Repeated</div>') for i, w in enumerate(names)]
    # marked inside an article: own text stays, repeated text goes
    rows += [(20 + i, f"http://g/{i}", f'<article><p>Text {w}</p><div class="related">Read more</div><div id="discussion">Point {w}</div></article>') for i, w in enumerate(names)]
    # copies of one article under different navigation stay
    rows += [(30 + i, f"http://k/{i}", f"<nav>{w}</nav><article><p>Copied</p></article>") for i, w in enumerate(names)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, w in enumerate(names):
        assert got[i] == f"Story {w}" and got[10 + i] == f"Card\n\nReal {w}"
        assert got[20 + i] == f"Text {w}\n\nPoint {w}" and got[30 + i] == "Copied"


def test_pages_of_the_tables(spark):
    import html as entities
    import re

    for r in html.main_text(read(spark, "pages")).join(read(spark, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# all together


def test_queries_equal_sql(spark):
    import duckdb

    from quillon.llm import queries as q

    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in q.oracle_sql().items():
        got, rel = q.queries()[name](spark, SF), con.sql(sql)
        place = [rel.columns.index(c) for c in got.columns]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in place)) for r in rel.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = read(spark, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    kept = docs
    for name, stage in p.STAGES[:-1]:
        new = shared.table(stage(spark, kept, SF), "stage")
        assert new.columns == docs.columns and new.count() <= kept.count()
        if name == "near duplicates":
            comp = brute_components({r.doc_id: shingle_set(r.text, 5) for r in kept.collect()}, 80)
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in kept.collect() if comp[r.doc_id] == r.doc_id}
        kept = new
    left = {r.doc_id for r in kept.collect()}
    assert sum(1 for d, q in labels.items() if q == 0 and d in left) <= 2
    out = p.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left and sum(r.length for r in out if r.start == 0) > 0


def test_pipeline_odd_rows(spark):
    """Nulls, repeated ids, a column named like one of a stage's own, and an empty table, through every stage."""
    import corpus_pipeline as p

    good = max((r for r in read(spark, "documents").join(read(spark, "labels").where("quality = 1"), "doc_id").collect()), key=lambda r: len(set(r.text.split())))
    rows = [(1, good.text, "en", "s", 0, "x"), (2, good.text, "en", None, 0, "x"), (2, good.text, None, "s", None, None), (None, good.text, "en", "s", 0, "x"), (4, None, "en", "s", 0, "x"), (5, "", "en", "s", 0, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    left = {}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns
        left[name] = Counter(r.doc_id for r in got.collect())
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert left["quality rules"] == Counter({1: 1, 2: 2, None: 1})
    assert left["near duplicates"] == Counter({1: 1, None: 1, 4: 1, 5: 1})  # of one text the smallest id stays
    assert sum(left["benchmark decontamination"].values()) in (len(rows), len(rows) - 4)
    packed = p.STAGES[-1][1](spark, odd, SF).collect()
    assert sum(r.length for r in packed if r.doc_id in (4, 5)) == 2 and sum(r.start == 0 for r in packed) == len(rows)
    assert p.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_chat_of_many_turns(spark):
    """Places of loss spans in a conversation of thousands of turns, null turns and repeated rows among them."""
    rows = [(1, i if i % 50 else None, "assistant" if i % 3 else "user", f"text {i % 7} </turn> \\\\h ###") for i in range(3000)] + [(1, 3, "assistant", "same")] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(frame)).first()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    assert len(got.turns) == len(rows) and Counter((t.role, t.text) for t in got.turns) == Counter((r[2], r[3]) for r in want)
    assert got.loss_text == "".join(t.text for t in got.turns if t.role == "assistant")

