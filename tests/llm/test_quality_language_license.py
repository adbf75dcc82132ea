import collections
import itertools
import math
import random

import numpy as np
import pytest

from trellis.llm import op1_quality_crf as op1
from trellis.llm import op2_language_id as op2
from trellis.llm import op9_license_scan as op9

PROSE = "The quick brown fox jumps over the lazy dog and runs home."


def test_base_figures_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a\n\na\na ", "é#|x  *y\r\nz", "a b c d e f a b c d e", "a b c d e " * 3, "x " * 400, "\n" * 50 + "w"]
    texts += ["".join(rng.choice("ab #\n é") for _ in range(rng.randrange(200))) for _ in range(200)]
    s = op1.scan(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        many = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(5)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.strip(op1.WHITE):
                dup += line in seen
                seen.add(line)
        assert [x[i] for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)] == [
            len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)
        ], repr(t)
        assert s.first[i + 1] - s.first[i] == sum(bool(x.strip(op1.WHITE)) for x in lines)


def test_viterbi_equals_all_paths():
    rng = random.Random(2)
    chain = op1.Chain(start=[0.3, -0.2], step=[[0.1, -0.9], [-0.4, 0.2]])
    for _ in range(100):
        odds = [rng.uniform(-3, 3) for _ in range(rng.randrange(1, 8))]

        def total(path):
            return chain.start[path[0]] + sum(chain.step[a][b] for a, b in zip(path, path[1:])) + sum(o for o, s in zip(odds, path) if s)

        best = max(itertools.product((0, 1), repeat=len(odds)), key=total)
        assert total(chain.decode(odds)) == pytest.approx(total(best))
    assert chain.decode([]) == []


def test_likelihood_equals_all_paths():
    """Log likelihood by listing every state sequence; its gradient by differences."""
    rng = np.random.default_rng(5)
    features = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 6, 4)]
    states = [rng.integers(0, 2, len(f)) for f in features]
    weight = rng.uniform(0.5, 2, 5)
    sequences = op1.Sequences(features, states, weight)
    p = rng.normal(size=9)

    def brute(p):
        start, step, out = p[3:5], p[5:].reshape(2, 2), 0.0
        for f, y, w in zip(features, states, weight):
            total = lambda path: start[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:])) + sum(f[i] @ p[:3] for i, s in enumerate(path) if s)  # noqa: B023, E731
            out += w * (total(tuple(y)) - np.log(sum(np.exp(total(path)) for path in itertools.product((0, 1), repeat=len(f)))))
        return out

    value, grad = sequences.likelihood(p)
    assert value == pytest.approx(brute(p))
    for i in range(9):
        step = np.eye(9)[i] * 1e-5
        assert grad[i] == pytest.approx((brute(p + step) - brute(p - step)) / 2e-5, abs=1e-5)


def test_training_reaches_the_maximum():
    rng = np.random.default_rng(6)
    states = [np.array(([0] * 9 + [1] * 9) * 3) if i % 2 else np.zeros(27, int) for i in range(40)]
    features = [np.column_stack([np.ones(len(y)), y + rng.normal(size=len(y)) * 1.5]) for y in states]
    weight = np.ones(40)
    chain = op1.fit_chain(features, states, weight, np.zeros(2))
    p = np.array([*chain.weights, *chain.start, *np.ravel(chain.step)])
    _, g = op1.Sequences(features, states, weight).likelihood(p)
    assert np.abs(g - p / op1.VARIANCE).max() < 0.5  # no direction leads higher
    assert chain.step[0][0] > chain.step[0][1] and chain.step[1][1] > chain.step[1][0]  # states last
    right = sum(int((np.array(chain.decode((f @ chain.weights).tolist())) == y).sum()) for f, y in zip(features, states))
    alone = sum(int(((f @ op1._logistic(np.concatenate(features), np.concatenate(states).astype(float), np.ones(sum(map(len, states)))) > 0) == y).sum()) for f, y in zip(features, states))
    assert right > alone


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = op1.fit(docs, labels.where("doc_id % 2 = 0"))
    got = op1.rate(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert len(got) > 100 and sum(r.kept == (r.quality == 1) for r in got) >= 0.98 * len(got)


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, PROSE, 1), (1, PROSE, 1), (2, None, 1), (None, "| " * 50, 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = op1.rate(docs, op1.fit(docs, labels)).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in got) == [("1", False, True), ("1", False, True), ("2", True, False), ("None", True, False)]
    assert op1.rate(docs.limit(0), op1.Chain()).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op2.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", "lang") for i in range(40)]
    rows += [(100, None, "en", ""), (101, "123 !? _", "en", ""), (102, "The DOG", None, ""), (None, "und der", "de", ""), (103, "", None, ""), (104, "²³", "en", "")]
    got = {r.doc_id: r for r in op2.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, None, 103, 104)] == ["und", "und", "en", "de", "und", "und"]
    assert got[100].score == 0.0 and got[None].held_out is False
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in op2.identify(none).collect()] == [("und", 0.0)]
    assert op2.identify(none.limit(0)).count() == 0


def brute_profile(text):
    """Counts of hashed n-grams, one at a time."""
    squeezed = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    found = collections.Counter()
    if squeezed.strip():
        for n in op2.ORDERS:
            for i in range(len(squeezed) - n + 1):
                g = ord(squeezed[i]) + n
                for c in squeezed[i + 1 : i + n]:
                    g = (g * int(op2._P) + ord(c)) % 2**64
                found[g * int(op2._MULT) % 2**64 >> 64 - op2.BITS] += 1
    return found


ODD = [None, "", "a", " 12 ", "Ünïcode text, with 12 words — and 漢字 😀 too! " * 7, "İ x", "the cat", "\n\nder  hund\n", "𐐀𐐁 x", "a" * 50, "x y " * 300]


def test_profiles_equal_brute_force(monkeypatch):
    for block in (op2.BLOCK, 13):
        monkeypatch.setattr(op2, "BLOCK", block)
        doc, bucket, n = op2.profiles(ODD)
        assert (np.diff(doc) >= 0).all()
        for i, t in enumerate(ODD):
            assert dict(zip(bucket[doc == i].tolist(), n[doc == i].tolist())) == brute_profile(t), (block, t)


def test_scores_equal_brute_force(monkeypatch):
    """Naive Bayes by the definition, over several blocks of languages."""
    rng = np.random.default_rng(3)
    langs, docs = [f"l{i:02}" for i in range(11)], [int(x) for x in rng.integers(1, 90, 11)]
    counts = np.zeros((11, op2.BUCKETS))
    for i in range(11):
        for b, k in brute_profile(" ".join(rng.choice(["der", "hund", "cat", "the", "chat", "漢字", "gato"], 40))).items():
            counts[i, b] += k
    counts[7] = counts[3]
    docs[7] = docs[3]  # a tie: the first language wins
    whole = op2.Model(langs, docs, counts)
    monkeypatch.setattr(op2, "LANG_BLOCK", 4)
    monkeypatch.setattr(op2, "GATHER", 50)
    model = op2.Model(langs, docs, counts)
    assert len(model.blocks) == 3 and len(whole.blocks) == 1
    texts = [*ODD, "the cat the dog", "le chat"]
    got, score = model.predict(texts)
    assert got == whole.predict(texts)[0] and np.allclose(score, whole.predict(texts)[1])
    for i, t in enumerate(texts):
        p = brute_profile(t)
        if not p:
            assert (got[i], score[i]) == ("und", 0.0)
            continue
        logs = [math.log(docs[k] / sum(docs)) + sum(n * math.log((counts[k, b] + op2.ALPHA) / (counts[k].sum() + op2.ALPHA * op2.BUCKETS)) for b, n in p.items()) for k in range(11)]
        top = max(logs)
        assert abs(score[i] - 1 / sum(math.exp(x - top) for x in logs)) < 1e-3
        assert logs[langs.index(got[i])] > top - 1e-2 and got[i] != "l07"


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300)}{chr(0x4E00 + i % 300)} word", f"lang{i % 300:03}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op2.fit(docs)
    assert len(model.langs) == 300 and len(model.blocks) == 2
    got = op2.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and {r.lang_pred for r in got} >= {"lang000", "lang299"}
    assert all(0 < r.score <= 1 for r in got)


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(op2, "MOST_LANGS", 2)
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang values"):
        op2.fit(docs)


def test_language_of_repeated_tied_and_long_rows(spark):
    rows = [(i, "aa bb" if i % 2 else "aa bb", "x" if i % 4 < 2 else "b") for i in range(64)] + [(900, "cc " * 300_000, None), (901, "cc", "c"), (902, "cc", "c"), (903, "cc", "c"), (904, "cc", "c"), (905, "cc", "c")]
    rows += [(900, "cc " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter((r.doc_id, r.lang_pred) for r in op2.identify(docs).where("doc_id >= 900").collect())
    assert got[900, "c"] == 2 and len(got) == 6


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return op9.train([" ".join(rng.choice(["red", "blue", "house", "runs", "the", "of", "and", "under"]) for _ in range(12)) for _ in range(300)])


def test_licenses_held_out(spark, model):
    """Unseen wordings of each family, and paragraphs that are none."""
    texts = [
        ("apache", "This project is licensed under the Apache License, Version 2.0, see LICENSE."), ("mit", "released under the mit license"), ("gpl", "The work is licensed under the GNU General Public License version 3"),
        ("cc-by-nc", "Text licensed under CC BY-NC 4.0"), ("proprietary", "2024 Acme. All rights reserved."), (None, "The house of the red and blue runs under the house."), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, f"red house runs\n\n{t}\nblue" if t else t, "x") for i, (_, t) in enumerate(texts)], "doc_id long, text string, family string")
    got = {r.doc_id: r for r in op9.scan(docs, model).collect()}
    assert {i: r.family for i, r in got.items()} == {i: f for i, (f, _) in enumerate(texts) if f}
    assert all(r.confirmed and r.paragraph == 2 for r in got.values())


def test_wrapped_notices_are_judged_whole(spark, model):
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation."]
    red = "red house runs the blue of the house"
    texts = {
        1: ["#!/bin/x", "", *[f"# {x}" for x in bsd], "#", f"# {red}"], 2: ["/*", *[f" * {x}" for x in gpl], " */", red], 3: [red, *[f"// {x}" for x in bsd], red],
        4: ["# Released under the MIT License.", "# All rights reserved."], 5: [bsd[0], "", red, red],
    }
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.similarity) for r in op9.scan(docs, model).where("confirmed").collect())
    assert got == [(1, 2, "bsd", 1.0), (2, 1, "gpl", 1.0), (3, 1, "bsd", 1.0), (4, 0, "mit", 1.0), (4, 1, "proprietary", 1.0)]
    assert op9.scan(docs.where("doc_id < 4"), model).count() == 3


def test_reworded_notices_are_no_sample_of_unknown_ones(monkeypatch):
    rows = []
    monkeypatch.setattr(op9, "features", lambda t, f=op9.features: (rows.append(" ".join(t)), f(t))[1])
    op9.train(["Redistribution and use in source and binary forms, with or without", "red house runs under the blue roof"])
    assert "red house runs under the blue roof" in rows and "redistribution and use in source and binary forms with or without" not in rows


def test_license_empty_and_trained_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op9.scan(none).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in docs.where("text rlike '(Licensed under|Released under the|licensed under the GNU|All rights reserved)'").collect()}
    assert {r.doc_id for r in op9.scan(docs).where("confirmed").collect()} == want


def brute_scan(text, model):
    """The reported paragraphs of one text by the definition: word tuples, one paragraph at a time."""
    clean = lambda line: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in line).lower().split()
    pairs = lambda w: set(zip(w, w[1:])) or {tuple(w)}
    templates = [(f, pairs(clean(t))) for f in model.families[1:] for t in op9.TEMPLATES[f]]
    lines = [(k, w) for k, line in enumerate((text or "").split("\n")) if (w := clean(line))]
    known = set().union(*(t for _, t in templates))
    chained = lambda i, j: all(lines[k + 1][0] == lines[k][0] + 1 for k in range(i, j))
    joined = lambda i, j: [w for _, own in lines[i : j + 1] for w in own]

    def touched(k):
        around = [lines[k][1]]
        around += [[lines[k - 1][1][-1], lines[k][1][0]]] if k and chained(k - 1, k) else []
        around += [[lines[k][1][-1], lines[k + 1][1][0]]] if k + 1 < len(lines) and chained(k, k + 1) else []
        return any(set(zip(w, w[1:])) & known for w in around)

    spans = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if not chained(i, j):
                break
            w = joined(i, j)
            alone = (i == 0 or not chained(i - 1, i)) and (j + 1 == len(lines) or not chained(j, j + 1))
            near = any(len(t & pairs(w)) >= op9.NEAR * len(t) for _, t in templates)
            if i == j or (len(w) <= op9.MOST_WORDS and (alone or (near and touched(i) and touched(j)))):
                spans.append((i, j, w))
    rows = []
    for i, j, w in spans:
        z = (np.mean([model.weights[b] for b in op9.features(w)], axis=0) * op9.SCALE + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        f = int(p.argmax())
        if f and p[f] >= op9.LEAST_PROBABILITY:
            alike = {g: max(len(t & pairs(w)) / len(t) for h, t in templates if h == g) for g in model.families[1:]}
            mine = alike[model.families[f]]
            rows.append((-mine, j - i, -p[f], i, model.families[f], mine >= op9.LEAST_SIMILAR and mine >= max(alike.values())))
    taken, kept = set(), []
    for s, more, q, i, family, confirmed in sorted(rows):
        if taken.isdisjoint(range(i, i + more + 1)):
            taken |= set(range(i, i + more + 1))
            kept.append((lines[i][0], family, -q, -s, confirmed))
    return sorted(kept)


def test_license_scan_equals_brute_force(model):
    rng = random.Random(12)
    notices = [t for ts in op9.TEMPLATES.values() for t in ts]
    prose = ["the house of the red", "runs under the blue of the house", "software of the house", "in the License of the town", ""]
    texts = [None, "", "\n\n", "# \n//", "MIT", "é", "Released under the MIT License.", "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."]
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                own, at = rng.choice(notices).split(), 0
                own = [w for w in own if rng.random() > 0.05]
                width = rng.choice([4, 8, 100])
                lines += [rng.choice(["# ", " * ", "// ", ""]) + " ".join(own[k : k + width]) for k in range(at, len(own), width)]
            lines += rng.choices(prose, k=rng.randrange(3))
        texts.append("\n".join(lines))
    got = op9.Batch(texts, model).paragraphs()
    for i, t in enumerate(texts):
        want, mine = brute_scan(t, model), [r[1:] for r in got if r[0] == i]
        assert [(r[0], r[1], r[4]) for r in mine] == [(r[0], r[1], r[4]) for r in want], t
        assert all(abs(x[2] - y[2]) < 1e-4 and x[3] == pytest.approx(y[3]) for x, y in zip(mine, want))


def test_more_families_as_they_stand_in_files(spark, model):
    """Customary notices, wrapped as projects wrap them, of wordings that are not the templates'."""
    texts = {
        "mit": "Copyright (c) 2019 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software, and to\npermit persons to whom the Software is furnished to do so, subject to\nthe following conditions:\n",
        "isc": "/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n */",
        "lgpl": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 3 of the License, or (at your option) any later version.",
        "agpl": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, either version 3 of the\n// License, or (at your option) any later version.",
        "gpl": ";; This file is free software; you can redistribute it and/or modify\n;; it under the terms of the GNU General Public License as published by\n;; the Free Software Foundation; either version 2, or (at your option)\n;; any later version.",
        "unlicense": "This is free and unencumbered software released into the public\ndomain.",
        "apache": "<!--\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n-->",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = op9.scan(docs, model).where("confirmed").collect()
    assert {(r.doc_id, r.family) for r in got} == set(enumerate(texts))


def test_license_rows_that_repeat_tie_or_are_very_long(spark, model):
    notice = "Released under the MIT License."
    long = "\n".join(["the red house runs"] * 200_000 + [notice] + ["of the blue"] * 100_000) + " " + "word " * 400_000
    rows = [(1, notice, "x"), (1, notice, "x"), (2, f"{notice}\n\n{notice}", "x"), (3, long, "x"), (None, notice, "x"), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    got = collections.Counter((r.doc_id, r.paragraph, r.family) for r in op9.scan(docs, model).where("confirmed").collect())
    assert got == {(1, 0, "mit"): 2, (2, 0, "mit"): 1, (2, 2, "mit"): 1, (3, 200_000, "mit"): 1, (None, 0, "mit"): 1}
