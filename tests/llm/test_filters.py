import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from findinglake.llm.licenses import rules, scan, scan_licenses
from findinglake.llm.packing import Encoder, best_fit, pack
from findinglake.llm.quality_mcd import FLOORS, _consistency, _estimate, chi_square_quantile, estimates, quality_rules
from findinglake.llm.toxicity import is_held_out, score_documents, toxicity_scores, train

SCHEMA = "doc_id long, text string, lang string, source string, kept string, score double"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "All rights\nreserved; all RIGHTS reserved."), (5, "dup id"),
    (None, "no id here"), (7, "cc by cc-by CC_BY occ by cc byé"), (8, "GNU General Public License, version 3 or later"),
    (9, "a b c a b c\nx # y\na b c a b c\n\n \nx # y"), (10, "é" * 30 + " ß|ß <b> 50% $&*"), (11, "\x0b".join("abcab")),
]


def _docs(spark):
    return spark.createDataFrame([(d, t, None if d == 3 else "en", None, "k", 0.5) for d, t in ODD], SCHEMA)


def test_license_base_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = {(d, t) for d, t in ODD} | {(r.doc_id, r.text) for r in docs.collect()}
    got = Counter()
    for r in scan_licenses(docs).collect() + scan_licenses(_docs(spark)).collect():
        got[(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)] += 1
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for d, t in rows:
        x = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
        at = [(i, l) for p, l in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        own = [i for i, _ in at]
        want = (d, len(w), len(at), min(own, default=None), max(own, default=None), ",".join(sorted({l for _, l in at})))
        assert got[want], want


def test_license_names_over_indented_lines():
    labels = lambda t: [x for _, _, x, _ in scan(t.lower())]
    wrap = "\n" + " " * 12 + "# "
    assert labels(f"GNU Lesser General{wrap}Public License") == labels("GNU Lesser General Public License") == ["lgpl"]
    assert labels(f"the Apache{wrap}License,{wrap}Version 2.0") == ["apache-2.0"]
    assert labels(f"Creative{wrap}Commons Attribution{wrap}International 4.0") == labels("Creative Commons Attribution International 4.0")


def test_license_rules():
    assert len(rules()) > 250
    labels = lambda t: [x[2] for x in scan(t.lower())]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["licensed", "apache-2.0"]
    assert labels("GNU Lesser General Public License v2.1") == ["lgpl-2.1"]  # not gpl within it
    assert labels("the general public license") == ["gpl"]
    assert labels("cc by-nc-sa 4.0") == ["cc-by-nc-sa-4.0"]
    assert labels("BSD 3-Clause") == ["bsd-3-clause"]
    assert labels("occ by") == []


def test_quality_counts_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {(d, t) for d, t in ODD} | {(r.doc_id, r.text) for r in docs.collect()}
    out = quality_rules(docs.withColumn("kept", docs.lang)).collect() + quality_rules(_docs(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        bad = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want = (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), bad)
        assert got[want], want
    assert all(not r.kept for r in out if r.base_failed)
    assert quality_rules(docs.limit(0)).count() == 0
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(good[r.doc_id], r.kept) for r in out if r.doc_id in good and not r.base_failed and r.doc_id > 11]
    assert all(k for q, k in judged if q == 1)


def test_mcd_ignores_outliers(spark):
    rng = np.random.default_rng(1)
    p = len(FLOORS)
    mix = np.eye(p) + 0.4 * rng.standard_normal((p, p))
    x = rng.standard_normal((900, p)) @ mix + 5
    far = rng.standard_normal((150, p)) + 60
    rows = [("g", v.tolist()) for v in np.concatenate([x, far])]
    r = estimates(spark.createDataFrame(rows, "key string, v array<double>"), steps=5).first()
    assert r.rows == 1050 and np.abs(np.array(r.center) - x.mean(0)).max() < 0.5
    inverse = np.array(r.inverse).reshape(p, p)
    d = np.einsum("ij,jk,ik->i", x - r.center, inverse, x - r.center)
    assert 0.5 * p < np.median(d) < 1.5 * p
    d = np.einsum("ij,jk,ik->i", far - r.center, inverse, far - r.center)
    assert d.min() > 100


def test_best_fit_by_brute_force():
    rng = np.random.default_rng(4)
    for size in (10, 64, 100):
        lengths = np.sort(rng.integers(1, size, 300))[::-1]
        sequence, offset = best_fit(lengths, size)
        space: list[int] = []
        for n, s, o in zip(lengths.tolist(), sequence, offset):
            fits = [c for c in space if c >= n]
            if fits:
                assert size - o == min(fits)
                space.remove(min(fits))
            else:
                assert o == 0
                fits = [size]
            space.append(min(fits) - n)
        assert len(set(sequence)) == len(space)


def test_packing_is_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(900, None), (901, "x<|endoftext|>y 日本"), (902, "long word " * 5000), (None, "no id")], docs.schema)
    docs = docs.unionByName(more)
    rows = pack(docs, group_rows=100).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in docs.collect():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d)
        cut = range(0, len(ids), 4096)
        assert own == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(cut)]
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 4096
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 4096) + 8
    assert pack(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity_scores(docs.withColumn("score", docs.n_chars), labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == is_held_out(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    judged = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.85
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", (1 - labels.toxic)).where("crc32(string(doc_id)) % 4 = 2")
    kept = labels.where("crc32(string(doc_id)) % 4 <> 2")
    assert (train(docs, kept.unionByName(other)) == train(docs, labels)).all()


def test_toxicity_odd_rows(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    rows = toxicity_scores(docs, labels).collect()
    assert len(rows) == len(ODD) and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    assert toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0
    located = score_documents(docs, train(docs, labels))
    assert set(located.columns) == {*docs.columns, "sentences"}


def test_license_scan_without_gate_or_shortcuts(spark, sf):
    """Every rule tried on every text, and each match compared with all before it."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for _, t in ODD]
    texts += ["gpl " * 400, "GNU Lesser General Public License v2.1, all rights reserved. cc by-sa 4.0; CC BY; the apache license 2.0, MIT License.",
              "permission is hereby granted, free of charge, to any person obtaining a copy; released into the public domain"]
    found = 0
    for t in texts:
        x = t.encode().lower().decode("latin-1")
        hits = sorted((r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.confidence) for r in rules() for m in r.pattern.finditer(x))
        taken = []
        for _, _, s, e, label, c in hits:
            if not any(a <= s and e <= b for a, b, _, _ in taken):
                taken.append((s, e, label, c))
        assert scan(x) == sorted(taken)
        found += len(taken)
    assert found > 400
    assert len({r.pattern.pattern for r in rules()}) > 380


def test_minimum_determinant_by_many_starts(spark):
    """No subset that hundreds of random starts lead to has a smaller determinant."""
    rng = np.random.default_rng(5)
    p, share = len(FLOORS), 0.75
    x = np.concatenate([rng.standard_normal((70, p)) @ rng.standard_normal((p, p)), 3 + rng.standard_normal((30, p))]).round(3)
    rows = spark.createDataFrame([("g", v.tolist()) for v in x], "key string, v array<double>")
    got = estimates(rows, share).first()
    h, best = int(np.ceil(len(x) * share)), np.inf
    for _ in range(300):
        own = rng.choice(len(x), p + 1, replace=False)
        for _ in range(60):
            center, inverse, log_det = _estimate(x[own].mean(0), np.cov(x[own].T, bias=True), _consistency(share, p))
            d = np.einsum("ij,jk,ik->i", x - center, np.array(inverse).reshape(p, p), x - center)
            new = np.argsort(d, kind="stable")[:h]
            if own.size == h and set(new) == set(own):
                break
            own = new
        best = min(best, log_det)
    assert got.log_det <= best + 0.05
    assert abs(chi_square_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(chi_square_quantile(0.975, 2) - 7.3778) < 1e-3


def test_packed_words_are_the_tokenizers():
    """The Latin-1 word split is the tokenizer's: no pair of characters is cut in another place."""
    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    chars = [chr(i) for i in range(256)]
    for a in chars:
        text = " ".join(f"x{a}{b}y" for b in chars)
        assert encode(text) == encode.whole(text), hex(ord(a))


def test_encoder_forgets_words_but_not_their_ids():
    """Ids are the tokenizer's own, whatever is remembered, for ASCII, Latin-1 and other texts."""
    import random

    from findinglake.llm import packing

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeABC019'-_!") for _ in range(rng.randrange(1, 7)))
    texts = [rng.choice(" \t\n").join(word() for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["''s don't 'tis WE'LL", "a\x1cb\x85c\xa0d", "<|endoftext|> x", "<| x", "ÀÉß ªº ²³ l'été", "İx ſ", "a\x00b \x1d'S", "x" * 3000, ""]
    small, large = (packing.Encoder(packing.default_tokenizer(), n) for n in (40, 100_000))
    for t in texts * 2:
        assert small(t) == large(t) == large.whole(t)
    assert len(small.known) <= 200 and len(small.older) <= 200 and len(large.known) > 400
