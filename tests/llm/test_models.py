import random
import zlib

import numpy as np
import pytest
from heddle.llm import licenses, quality_gam


def plain_scan(text, templates, containment=0.8):
    """Every window of a template's length, by plain sets."""
    clean = lambda t: [w.strip(licenses.STRIP).lower() for w in t.split()]
    w, out = clean(text), set()
    for name, t in templates.items():
        t = clean(t)
        n = min(5, len(t))
        grams = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        own = grams(t)
        for p in range(max(1, len(w) - len(t) + 1)):
            if len(own & grams(w[p : p + len(t)])) >= containment * len(own):
                out.add(name)
    return out


def test_scan_finds_what_plain_windows_find(docs):
    r = random.Random(4)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    for name, t in licenses.TEMPLATES.items():
        text = f"{filler(r.randrange(60))} {t} {filler(r.randrange(60))}"
        assert {x for x, _, _ in scanner.scan(text)} == plain_scan(text, licenses.TEMPLATES) >= {name}
        assert {x for x, _, _ in scanner.scan(t.upper())} >= {name}
        words = text.split()
        for _ in range(3):  # with one word changed it may or may not reach the threshold
            changed = list(words)
            changed[r.randrange(len(words))] = "other"
            found = {x for x, _, _ in scanner.scan(" ".join(changed))}
            assert found >= plain_scan(" ".join(changed), licenses.TEMPLATES)
    assert scanner.scan(filler(500)) == [] and scanner.scan("") == []


def test_recall_of_edited_templates_and_what_is_found_is_true():
    """500 templates with words changed, dropped or put in, inside other text: all that reach the containment are found."""
    r = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    clean = lambda t: [w.strip(licenses.STRIP).lower() for w in t.split()]
    filler = lambda n: [f"w{r.randrange(9999)}" for _ in range(n)]
    wanted = met = 0
    for k in range(500):
        name = r.choice([n for n, t in licenses.TEMPLATES.items() if len(t.split()) > 5])
        words = licenses.TEMPLATES[name].split()
        for _ in range(r.randrange(1 + len(words) // 25 + (k % 2))):
            p = r.randrange(len(words))
            words[p : p + 1] = r.choice([["other"], [], [words[p], "extra"]])
        text = " ".join(filler(r.randrange(80)) + words + filler(r.randrange(80)))
        found = scanner.scan(text)
        want = plain_scan(text, licenses.TEMPLATES)
        wanted += len(want)
        met += len(want & {x for x, _, _ in found})
        for other, first, share in found:  # and nothing is found that plain sets do not confirm
            t = clean(licenses.TEMPLATES[other])
            n = min(5, len(t))
            grams = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
            stride = max(1, len(t) // 8)
            near = clean(text)[max(0, first - stride) : first + len(t) + stride]
            assert abs(len(grams(t) & grams(near)) / len(grams(t)) - share) < 1e-9 and share >= 0.8
    assert wanted > 300 and met >= 0.999 * wanted


def test_scanner_with_many_bands():
    assert {x for x, _, _ in licenses.Scanner({"a": "one two three four five six seven eight nine ten"}, containment=0.05, rows=3).scan("zero one two three four five six seven eight nine ten")} == {"a"}


def test_scan_counts_and_places(spark, no_docs):
    from helpers import make

    t = licenses.TEMPLATES["MIT"]
    rows = [(1, f"a b {t} c\n{t}", "s"), (2, None, "s"), (3, "", "s"), (1, f"a b {t} c\n{t}", "s"), (None, "All rights reserved.", None), (4, "w " * 30_000 + t, "s")]
    found = sorted(((r.doc_id, r.license, r.first_word, r.containment) for r in licenses.scan(make(spark, rows)).collect()), key=str)
    assert found == sorted([(1, "MIT", 2, 1.0), (1, "MIT", 8, 1.0)] * 2 + [(None, "All-Rights-Reserved", 0, 1.0), (4, "MIT", 30_000, 1.0)], key=str)
    assert licenses.scan(no_docs).count() == 0


def test_band_plan():
    for s in (0.2, 0.5, 0.9):
        for rows in (1, 2, 3):
            bands = licenses.band_plan(s, 0.999, rows)
            assert 1 - (1 - s**rows) ** bands >= 0.999 > (1 - (1 - s**rows) ** (bands - 1) if bands > 1 else 0)


def test_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 0.7)).astype(float)
    m = quality_gam.AdditiveModel().fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_like_a_plain_sum():
    """A score is the logistic of the intercept, one entry per feature and one per pair, looked up one by one."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5))
    m = quality_gam.AdditiveModel(n_bins=8, rounds=20, n_pairs=3).fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    bin_of = lambda cuts, v: sum(1 for c in cuts if c <= v)
    for row, s in zip(x[:200], m.score(x[:200])):
        f = m.intercept + sum(t[bin_of(m.cuts[j], row[j])] for j, t in enumerate(m.tables))
        f += sum(t[bin_of(m.coarse[a], row[a]), bin_of(m.coarse[b], row[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert abs(s - 1 / (1 + np.exp(-f))) < 1e-12


def test_features_one_by_one():
    """The features of a text, counted character by character."""
    t = "Ab ab ab! #1 |x, é\nAb ab ab! #1 |x, é\n\nc."
    w = t.split()
    lines = [x for x in t.split("\n") if x.strip()]
    want = [np.log1p(len(w)), (len(t) - len(w)) / len(w), len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w)]
    up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    want += [up / (up + low), sum(c.isdigit() for c in t) / len(t), t.count("#") / len(w), t.count("|") / len(w), t.count("!") / len(w), t.count(".") / len(w), t.count(",") / len(w), t.count("\n") / len(w)]
    want += [1 - len(set(lines)) / len(lines), sum(c == "é" for c in t) / len(t), sum(x.isalpha() for x in w) / len(w)]
    assert quality_gam.features(t) == [float(x) for x in want] or max(abs(a - b) for a, b in zip(quality_gam.features(t), want)) < 1e-12
    assert quality_gam.features(None) == quality_gam.features(" ") == [0.0] * 15


def test_classify(spark, no_docs):
    from helpers import make

    r = random.Random(1)
    good = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else "SPAM!! " * 50, "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (None, good(), "s"), (1, good(), "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(400)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (7777, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    out = quality_gam.classify(make(spark, rows), labels).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        if x.doc_id is not None and x.doc_id < 400 and x.held_out:
            assert x.predicted == int(x.doc_id % 3 > 0)
    # held-out labels are never learned from
    flipped = spark.createDataFrame([(i, int(i % 3 > 0) ^ (zlib.crc32(str(i).encode()) % 5 == 0), 0, "x") for i in range(400)], "doc_id bigint, quality int, toxic int, text string")
    again = quality_gam.classify(make(spark, rows), flipped).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert quality_gam.classify(no_docs, labels).count() == 0
    assert {x.score for x in quality_gam.classify(make(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_features_of_blank_texts():
    assert quality_gam.features(None) == quality_gam.features(" \n") == [0.0] * len(quality_gam.FEATURES)
    assert all(np.isfinite(quality_gam.features(t)).all() for t in ("a", "é" * 10, "1", "\x1cx", "|"))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_rows(n):
    m = quality_gam.AdditiveModel().fit(np.zeros((n, 3)), np.ones(n))
    assert (m.score(np.ones((2, 3))) > 0.5).all()
