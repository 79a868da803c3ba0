import hashlib
import re
from collections import Counter

import pytest
from heddle.llm import host_rules, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def judged(rows, max_rate):
    base = [(i, s, *(m := measure(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t, s in rows]
    hosts = {}
    for r in base:
        n, f = hosts.get(r[1], (0, 0))
        hosts[r[1]] = n + 1, f + r[-1]
    rates = [f / n for n, f in hosts.values()]
    mean = sum(rates) / len(rates)
    var = sum((x - mean) ** 2 for x in rates) / len(rates)
    var -= mean * (1 - mean) * sum(1 / n for n, _ in hosts.values()) / len(hosts)  # what chance alone makes of it
    strength = min(1000, max(1, mean * (1 - mean) / var - 1)) if var > 1e-12 else 1000
    ok = {s: (f + mean * strength) / (n + strength) <= max_rate for s, (n, f) in hosts.items()}
    return sorted(((r[0], *r[2:8], not r[-1] and ok[r[1]]) for r in base), key=str)


@pytest.mark.parametrize("max_rate", [0.6, 0.3, 0.0])
def test_rules(docs, corpus, max_rate):
    line = "one two three four five six seven eight nine ten"
    extra = [(900, f"{line}\n{line}\n{line} " + "x " * 30, "bad"), (901, "# * $\n\n# * $", "bad"), (902, "a b c d e f g h a b c d e f g h", "bad")]
    from helpers import make

    rows = corpus + extra
    out = host_rules.judge(make(docs.sparkSession, rows), max_rate=max_rate)
    assert {"lang", "h1", "text", "host_rate", "_host", "_h", "_p", "n_docs"} <= set(out.columns)
    assert len(set(out.columns)) == len(out.columns) and out.filter("_host <> 'h' or _h <> 8 or _p <> 9 or host_rate = 0.5").isEmpty()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()), key=str) == judged(rows, max_rate)


def test_rules_on_nothing(no_docs):
    assert host_rules.judge(no_docs).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, total, target = set(names), sum(sizes.values()), {}
    while left:
        share = (total - sum(target.values())) / sum(w[s] for s in left)
        over = [s for s in left if w[s] * share > cap * sizes[s]]
        if not over:
            return target | {s: w[s] * share for s in left}
        for s in over:
            target[s] = cap * sizes[s]
            left.remove(s)
    return target


def test_mix(docs, corpus, no_docs):
    rows = mixing.mix(docs, bucket_rows=3).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))  # neither buckets nor partitions matter
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in corpus)
    assert mixing.mix(no_docs).count() == 0


def test_mix_order(spark):
    """Copies by finish time, against a plain sort of all copies."""
    from helpers import make

    data = [(i, "w " * (1 + i * 7 % 13), "ab"[i % 5 == 0]) for i in range(60)]
    found = {r.doc_id: r.taken for r in mixing.mix(make(spark, data)).collect()}
    sizes, place = {i: 1 + i * 7 % 13 for i, _, _ in data}, lambda i: hashlib.md5(str(i).encode()).hexdigest()
    total = {s: sum(sizes[i] for i, _, t in data if t == s) for s in "ab"}
    target, copies = brute_targets(total), []
    for s in "ab":
        cum = 0
        for i in sorted((i for i, _, t in data if t == s), key=place):
            cum += sizes[i]
            copies += [((e * total[s] + cum) / target[s], s, place(i), i) for e in range(3)]
    want, left = Counter(), sum(total.values())
    for *_, i in sorted(copies):
        left -= sizes[i]
        if left < 0:
            break
        want[i] += sizes[i]
    assert found == {i: want[i] for i in sizes}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 50, "c": 2, None: 9}, {"a": 100}, {"a": 0, "b": 7}, {"z": 3, "ä": 300, "b": 20, "c": 1, "d": 900}])
def test_targets(spark, sizes):
    t = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    assert {r.source: pytest.approx(r.target) for r in mixing.targets(t).collect()} == brute_targets(sizes)


def test_mix_without_words(spark):
    from helpers import make

    assert {r.taken for r in mixing.mix(make(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {0}


def test_mix_of_rows_without_id(spark):
    """Each text is queued for itself, so no source misses its target by more than a document; the pipeline takes as many."""
    import corpus_pipeline
    from helpers import make

    rows = [(None, f"t{i} " * (1 + i % 7), "a" if i % 4 else "b") for i in range(80)] + [(1, "x y", "a"), (1, "x z", "a"), (1, "x z", "a")]
    found = mixing.mix(make(spark, rows)).collect()
    for s in "ab":
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 7
    out = corpus_pipeline.mix_sources(spark, make(spark, rows), "").collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in found)
