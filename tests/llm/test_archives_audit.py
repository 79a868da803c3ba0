"""op11 to op13 against plain versions, and what they do with odd input."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import make
from pyspark.sql import functions as F

from heddle.llm import divergence, fill_middle, warc
from heddle.sources.staging import shared_dir

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_audit(rows, min_docs, top, scale=10**9):
    df, n, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        groups.add((lang, source))
        terms = TERM.findall(text.translate(LOWER))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        sources, kept = sorted(s for l, s in groups if l == lang), [t for (l, t), k in df.items() if l == lang and k >= min_docs]
        of = {s: [n[lang, s, t] for t in kept] for s in sources}
        share = lambda c: [1 + scale * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        p, q = {s: share(of[s]) for s in sources}, share([sum(x) for x in zip(*of.values(), strict=True)])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            lead = [(t, f(a, b)) for t, a, b, c in zip(kept, p[s], q, of[s], strict=True) if c and a > b]
            order = lambda x: (-x[1], x[0].encode())
            out |= {(lang, s, "pair", *x, k) for k, x in enumerate(sorted(pairs, key=order), 1)}
            out |= {(lang, s, "term", *x, k) for k, x in enumerate(sorted(lead, key=order)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeABÀé漢") for _ in range(r.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(400):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["a", "a", "a", "b", "c", None])
        some = vocabulary[: r.choice([20, 60, 120])]
        rows.append((i % 300, r.choice(["", None, " ".join(r.choice(some) for _ in range(r.randint(1, 60))), "@[`{" + r.choice(some)]), lang, source))
    rows += [(1, "term " * 30_000, "fr", "b"), (2, None, "xx", "a"), (3, "rare words", "xx", "b"), (4, "one", "yy", "a")]
    return rows


def table(spark, rows):
    out = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return out.withColumns({k: F.lit(1) for k in ("n", "docs", "block", "term", "strip", "v", "value", "rank")})


def found(df):
    return {tuple(r) for r in df.collect()}


def test_divergence_agrees_with_a_plain_count(spark, mixed):
    want = plain_audit([(lang or "", source or "", text or "") for _, text, lang, source in mixed], 10, 10)
    got = divergence.audit(table(spark, mixed)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == want
    assert any(r["lang"] == "xx" and r["value"] == 0 and r["part"] == "pair" for r in got)


def test_divergence_blocks_strips_and_short_batches_change_nothing(spark, mixed):
    want = plain_audit([(lang or "", source or "", text or "") for _, text, lang, source in mixed], 3, 2)
    docs = table(spark, mixed).repartition(7)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        terms = divergence.run_lengths(divergence.block_counts(docs, room=50), 3).cache()
        rows = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
        groups = rows.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang")
        parts = divergence.compare(terms, groups, top=2, room=3).collect()  # strips of one source
    finally:
        spark.conf.set(key, before)
    pairs, best = Counter(), defaultdict(list)
    for r in parts:
        if r["part"] == "pair":
            pairs[r["lang"], r["source"], r["item"]] += r["value"]
        else:
            best[r["lang"], r["source"]].append((-r["value"], r["item"].encode()))
    have = {(g["lang"], g["source"]) for g in groups.collect()}
    assert dict(pairs) == {x[:2] + (x[3],): x[4] for x in want if x[2] == "pair" and (x[0], x[1]) in have and (x[0], x[3]) in have}
    assert {(*k, -v, t.decode()) for k, x in best.items() for v, t in sorted(x)[:2]} == {(x[0], x[1], x[4], x[3]) for x in want if x[2] == "term"}


def test_divergence_shares_are_exact_for_large_counts():
    import numpy as np

    for c, n, v in ((10**15, 3 * 10**15, 10**9), (0, 4 * 10**15, 1), (5, 5, 1), (10**12, 10**12, 1)):
        assert divergence.shares(np.array([c]), np.array([n]), v, 10**9)[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_divergence_of_nothing(spark, mixed):
    assert found(divergence.audit(table(spark, mixed[:0]))) == set()
    assert found(divergence.audit(table(spark, [(1, None, None, None)]))) == set()


def plain_fim(doc_id, text, seed="1", percent=90, spm=20):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[a : a + 8], 16) for a in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def fim_rows(corpus):
    r = random.Random(8)
    odd = ["a<P>b", "<S>", "x<M>", "<", "<<P", "P><S", "é", "漢字", "🙂", "\n", "a" * 70_000 + "é🙂" * 9000]
    rows = [*corpus, *((1000 + i, t, "s") for i, t in enumerate(odd))]
    return rows + [(2000 + i, "".join(r.choice("aé漢🙂<P>S \n") for _ in range(r.randint(0, 9))), "s") for i in range(300)]


@pytest.mark.parametrize("piece", [1, 500, 4 << 20])
def test_fill_middle_agrees_with_slices_and_comes_back(spark, corpus, piece):
    rows = fim_rows(corpus)
    docs = make(spark, rows).withColumn("n", F.lit(7)).withColumn("form", F.lit("x"))
    out = fill_middle.arrange(docs, piece_bytes=piece).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out) == Counter((i, *plain_fim(i, t), t or "") for i, t, _ in rows)
    assert {"psm", "spm", "plain"} == {r["form"] for r in out}
    assert all(r["h1"] == 1 and r["_th"] == "t" for r in out)


def test_fill_middle_by_words_and_lines(spark):
    text = "one two  three\nfour\n\nfive six"
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id bigint, text string")
    for unit, units in (("word", ["one ", "two  ", "three\n", "four\n\n", "five ", "six"]), ("line", ["one two  three\n", "four\n", "\n", "five six"])):
        out = fill_middle.arrange(docs, unit=unit, percent=100, spm_percent=0).collect()
        for r in out:
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            assert r["n"] == len(units)
            assert r["output"] == "<P>" + "".join(units[:a]) + "<S>" + "".join(units[b:]) + "<M>" + "".join(units[a:b])
    with pytest.raises(ValueError):
        fill_middle.arrange(docs, unit="page")
    with pytest.raises(ValueError):
        fill_middle.arrange(docs, markers=("<P>", "<P>", "<M>"))


def test_fill_middle_of_nothing(spark, no_docs):
    assert fill_middle.arrange(no_docs).count() == 0
    assert fill_middle.arrange(make(spark, [(None, None, None)])).select("n", "form", "output").collect() == [(0, "plain", "")]
    assert fill_middle.arrange(spark.createDataFrame([("ab",)], "text string").withColumn("doc_id", F.lit(3))).count() == 1


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({k: F.lit(1) for k in ("digest", "kept", "key", "body", "name", "shared", "refers_to", "_maybe")})


def plain_warc(rows):
    kept = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            kept[html] = max(kept.get(html, i), i)
    out = []
    for i, _, html in rows:
        data, target = (html or "").encode(), kept.get(html)
        first = target is None or target == i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else target))
    return Counter(out)


@pytest.fixture(scope="module")
def page_rows():
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abc <>é漢\r\n0") for _ in range(n))
    same, large = text(1500), text(90_000)
    rows = [(i, f"http://h/{i}", text(r.choice([0, 5, 400, 3000, 20_000]))) for i in range(120)]
    rows += [(200 + i, f"http://same/{i}", same) for i in range(90)]  # one group of copies
    rows += [(300 + i, "http://x y\n/é", large) for i in range(3)]
    rows += [(400, None, None), (401, "", ""), (402, "u", "x" * 999), (403, "u", "x" * 999), (404, "u", "y" * 1000), (405, "v", "y" * 1000)]
    rows += [(None, "n", same), (None, "n", text(5000)), (None, None, None), (None, "m", "z" * 2000), (None, "m", "z" * 2000)]
    rows += [(302, "http://again", large), (119, "http://h/119", rows[119][2]), (7, "u", "0\r\n\r\n" * 500)]
    return rows


@pytest.mark.parametrize("segment", [100, 1 << 14, 1 << 20])
def test_warc_round_trip(spark, page_rows, segment):
    out = warc.write_and_read(pages_of(spark, page_rows), segment_bytes=segment, file_bytes=30_000, chunk_bytes=777)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in out.collect()) == plain_warc(page_rows)


def test_warc_payloads_come_back_and_files_are_plain_gzip(spark, page_rows):
    folder = f"{shared_dir(spark)}/warc-test"
    manifest = warc.write(pages_of(spark, page_rows), folder, segment_bytes=5000, file_bytes=50_000)
    back = warc.read(manifest, folder).filter("record_type = 'response'")
    got = Counter((r["page_id"], bytes(r["payload"]).decode(), r["url"]) for r in back.collect())
    kept = Counter((i, html or "", None if url is None else "".join(warc.SAFE.get(ord(c), c) for c in url)) for i, url, html in page_rows)
    assert not got - kept and {k[1] for k in got} == {k[1] for k in kept}
    seen = 0
    for r in manifest.collect():
        with gzip.open(folder.removeprefix("file://") + "/" + r["file"]) as f:
            data = f.read()
        seen += len(re.findall(rb"WARC/1\.1\r\nWARC-Type: ", data))
    assert seen == manifest.agg(F.sum("n_records")).first()[0]
    assert manifest.count() > 4


def test_warc_tells_what_is_wrong(spark, page_rows):
    folder = f"{shared_dir(spark)}/warc-damage"
    block = warc.HTTP + warc.chunked(b"p" * 5000, 999)
    name = "<urn:uuid:00000000-0000-0000-0000-00000000000%d>"
    part = lambda i, k, total, data: ([("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", name % (i if k == 1 else 9)), *([("WARC-Segment-Origin-ID", name % i)] if k > 1 else [("WARC-Page-ID", i)]), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], data)
    whole = lambda i, data, digest=None: ([("WARC-Type", "response"), ("WARC-Record-ID", name % i), ("WARC-Page-ID", i), ("WARC-Payload-Digest", digest)], data)
    records = [
        part(1, 2, None, block[3000:4000]), part(1, 3, len(block), block[4000:]), part(1, 1, None, block[:3000]),  # in any order
        part(2, 1, None, block[:3000]), part(2, 3, len(block), block[4000:]),  # one lacks
        part(3, 1, None, block[:3000]), part(3, 2, len(block) + 1, block[3000:]),  # another length
        part(4, 2, len(block), block[3000:]),  # the first lacks
        whole(5, block[:-9]), whole(6, block, "sha1:" + "A" * 32), whole(7, b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nplain body"), whole(8, b"no headers"),
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "x")], b""),
        ([("WARC-Type", "revisit"), ("WARC-Page-ID", 11), ("WARC-Refers-To", name % 1), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(b"p" * 5000).hexdigest())], warc.HTTP),
        ([("WARC-Type", "revisit"), ("WARC-Page-ID", 12), ("WARC-Refers-To", name % 5), ("WARC-Payload-Digest", "sha1:00")], warc.HTTP),
    ]
    import os

    os.makedirs(folder.removeprefix("file://"))
    with open(folder.removeprefix("file://") + "/a.warc.gz", "wb") as f:
        for fields, data in records:
            f.write(gzip.compress(warc.record(fields, data)))
        f.write(gzip.compress(b"not a record"))
        f.write(b"no gzip")
    manifest = spark.createDataFrame([("a.warc.gz",)], "file string")
    got = {(r["page_id"], r["record_type"]): (r["payload_bytes"], r["refers_to"], r["problem"]) for r in warc.resolved(warc.read(manifest, folder, with_payload=False)).collect() if r["record_type"] != "damaged"}
    assert got == {
        (1, "response"): (5000, None, None), (2, "response"): (None, None, "segments are missing"), (3, "response"): (None, None, "the segments do not add up to the total length"),
        (None, "response"): (None, None, "segments are missing"), (5, "response"): (None, None, "a chunk is shorter than its size"), (6, "response"): (None, None, "the payload has another digest"),
        (7, "response"): (10, None, None), (8, "response"): (None, None, "no HTTP headers"), (11, "revisit"): (5000, 1, None), (12, "revisit"): (None, None, "the response it refers to is not there"),
    }
    assert warc.read(manifest, folder).filter("record_type = 'damaged'").count() == 2


def test_chunks():
    for n in (0, 1, 776, 777, 778, 5000):
        assert warc.unchunked(warc.chunked(b"\r\n0" * n, 777)) == b"\r\n0" * n
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"-1\r\nx\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"1\r\na\r\n0\r\n", b"0x1\r\na\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_warc_of_nothing(spark):
    assert warc.write_and_read(pages_of(spark, [])).collect() == []
