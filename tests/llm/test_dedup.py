import random
import re
from collections import Counter

from helpers import make
from heddle.llm import components, ngram_join, sentence_spans


def sets_of(rows, n):
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    return out


def brute_components(rows, n, num, den):
    s = sets_of(rows, n)
    parent = {i: i for i, _ in s if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, x) for i, x in s if i is not None and x]
    for k, (i, x) in enumerate(known):
        for j, y in known[:k]:
            both = len(x & y)
            if den * both >= num * (len(x) + len(y) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return sorted(((i, len(x), None if i is None else top(i)) for i, x in s), key=str)


def check(spark, rows, n, num, den, **more):
    found = ngram_join.join_components(make(spark, rows), n=n, num=num, den=den, **more).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, n, num, den)


def test_join_against_brute_force(spark, corpus):
    check(spark, corpus, 3, 90, 100)


def test_join_of_chains_in_small_blocks(spark):
    """Chains of near copies, a group with more members than a block, and common passages."""
    r = random.Random(8)
    rows, line = [], [r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(60)]
    passage = [f"p{k}" for k in range(12)]
    for i in range(70):
        if i % 20 == 0:
            line = [f"{r.choice('abcdefghijkl')}{r.randint(0, 40)}" for _ in range(60)]
        line = list(line)
        line[r.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(line + passage * (i % 3 == 0)), "s"))
    check(spark, rows, 3, 80, 100, block_rows=4, common_from=5)
    check(spark, rows, 3, 90, 100, block_rows=3, common_from=2, common_most=4)


def test_join_of_nothing(spark, no_docs):
    assert ngram_join.join_components(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (205, 203)]
    found = {(r.node, r.label) for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 160)} | {(203, 203), (205, 203)}


def brute_spans(rows):
    key = lambda i: (i is not None, i or 0)
    where = {}
    uniq = {(i, t) for i, t, _ in rows if t is not None}
    for i, t in uniq:
        parts = sentence_spans.sentences(t)
        for a, b, _ in sentence_spans.runs(parts):
            words = tuple(tuple(p.lower().split()) for p in parts[a:b] if p.split())
            where.setdefault(words, []).append((key(i), i, t, a, b))
    gone = {}
    for places in where.values():
        order = sorted((k, a) for k, _, _, a, _ in places)
        for k, i, t, a, b in places:
            if (k, a) != order[0]:
                gone.setdefault((i, t), set()).update(range(a, b))
    out = []
    for i, t, _ in rows:
        parts = sentence_spans.sentences(t) if t else []
        cut = gone.get((i, t), set())
        out.append((i, "".join(p for k, p in enumerate(parts) if k not in cut) if t is not None else None, len(cut)))
    return sorted(out, key=str)


def test_spans_against_brute_force(docs, no_docs, corpus):
    found = sentence_spans.remove_repeats(docs)
    assert {"lang", "source", "h1", "a", "comp"} <= set(found.columns)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in found.collect()), key=str) == brute_spans(corpus)
    assert sentence_spans.remove_repeats(no_docs).count() == 0


def test_sentences_join_to_the_text(corpus):
    for _, t, _ in corpus:
        if t:
            assert "".join(sentence_spans.sentences(t)) == t
    assert "".join(sentence_spans.sentences("a b " * 100 + "end")) == "a b " * 100 + "end"
    assert sentence_spans.sentences("x " * 60)[0] == "x " * 25


def test_planted_passage_is_removed_once(spark):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"{text(17).capitalize()}." for _ in range(4))
    rows = [(i, f"{text(12)}. {text(9)}.\n{passage}\n{text(15)}.", "s") for i in range(9)]
    found = {x.doc_id: x.text for x in sentence_spans.remove_repeats(make(spark, rows)).collect()}
    assert passage in found[0]
    assert all(passage not in found[i] and found[i] == rows[i][1].replace(passage + "\n", "") for i in range(1, 9))


def test_unpunctuated_passage_at_different_offsets(spark):
    """A passage of 60 words in the middle of one long sentence, after 0 to 39 other words."""
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(text(i) + passage + text(80 - i)), "s") for i in range(40)]
    found = {x.doc_id: x.text.split() for x in sentence_spans.remove_repeats(make(spark, rows)).collect()}
    assert found[0] == rows[0][1].split()
    for i in range(1, 40):
        own = rows[i][1].split()
        assert [w for w in found[i] if w not in passage] == own[:i] + own[i + 60 :]
        assert len([w for w in found[i] if w in passage]) < 30


def test_piece_of_a_long_sentence_is_a_run():
    parts = ["a " * 14, "b " * 5, "c. ", "d " * 14 + ". ", "e."]
    assert {(0, 1), (1, 4), (2, 4), (3, 5)} <= {x[:2] for x in sentence_spans.runs(parts)}


def test_words_between_other_white_space(spark):
    """Copies of a text without marks whose words stand between tabs or no-break spaces lose their words; the last few may stay."""
    r = random.Random(4)
    rows = [(10 * k + i, t, "s") for k, gap in enumerate(["\t", "\u00a0"]) for t in [gap.join(f"w{r.randrange(10**6)}" for _ in range(60))] for i in range(2)]
    assert all("".join(sentence_spans.sentences(t)) == t and len(sentence_spans.sentences(t)) > 2 for _, t, _ in rows)
    found = {x.doc_id: x.text for x in sentence_spans.remove_repeats(make(spark, rows)).collect()}
    assert all(len(found[i].split()) < 15 if i % 10 else found[i] == t for i, t, _ in rows)


def test_short_last_sentence_of_a_passage(spark):
    """Sentences of 10, 8 and 3 words, then other text: the third one goes with the others."""
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + ". "
    passage = text(10) + text(8) + text(3)
    rows = [(i, text(9) + passage + text(9), "s") for i in range(3)]
    found = {x.doc_id: x.text for x in sentence_spans.remove_repeats(make(spark, rows)).collect()}
    assert found == {i: t.replace(passage, "") if i else t for i, t, _ in rows}


def word_windows(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_repeats_by_plain_word_windows(spark):
    """No use of the operator's own sentences or runs: what repeats are is told by windows of words alone."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]

    def prose(n, ends=".!?\n"):
        out = []
        while n > 0:
            k = min(n, r.randint(3, 16))
            out.append(" ".join(r.choice(vocabulary) for _ in range(k)).capitalize() + r.choice(ends) + " ")
            n -= k
        return "".join(out)

    passages = [prose(60), prose(90), prose(70, [","]), " ".join(r.choice(vocabulary) for _ in range(80)) + " "]  # the last two without sentence ends
    rows = []
    for i in range(90):
        parts = [prose(r.randint(20, 120)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(r.randint(1, 2), passages[i // 3 % 4])
        rows.append((i, "".join(parts), "s"))
    rows += [(100 + i, prose(60) + rows[1][1] + prose(40), "s") for i in range(3)]  # a whole document within others
    clean = {i for i, _, _ in rows if i % 3 and i < 90 and i != 1}
    out = {x.doc_id: x.text for x in sentence_spans.remove_repeats(make(spark, rows)).collect()}
    before, texts = {}, {i: t for i, t, _ in rows}
    for i, t in texts.items():
        for w in word_windows(t, 50):
            before.setdefault(w, set()).add(i)
    repeated = {w: ids for w, ids in before.items() if len(ids) > 1}
    assert len(repeated) > 100
    left = {}
    for i, t in out.items():
        for w in word_windows(t, 50) & repeated.keys():
            left.setdefault(w, set()).add(i)
    assert all(len(ids) < 2 for ids in left.values())
    # The first document that holds a repeat keeps all of its text; documents without any are as they were.
    assert all(out[i] == texts[i] for i in clean | {0, 1, 3, 6, 9})
    # Nothing else goes: what is left of a text and the repeats of it are all of its words.
    for i, t in out.items():
        common = {w for win in repeated if i in repeated[win] for w in win}
        gone = Counter(texts[i].lower().split()) - Counter(t.lower().split())
        assert set(gone) <= common | {w for p in passages for w in p.lower().split()} | set(rows[1][1].lower().split())
