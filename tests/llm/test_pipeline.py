import corpus_pipeline
from test_dedup import brute_components, brute_spans
from test_rules_mix import judged

from heddle.llm import mixing


def step(spark, k, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.STAGES[k][1](spark, docs, "").write.parquet(f"{tmp_path}/{k}")
    return spark.read.parquet(f"{tmp_path}/{k}").collect()


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in dict.fromkeys(corpus) if i is not None]
    plain = lambda rs: [(r[0], r[1], r[3]) for r in rs]
    a = step(spark, 0, rows, tmp_path)
    assert {r[0] for r in a} == {x[0] for x in judged(plain(rows), 0.6) if x[-1]}
    b = step(spark, 1, a, tmp_path)
    assert sorted(r[0] for r in b) == sorted(i for i, _, c in brute_components(plain(a), 5, 80, 100) if i == c)
    c = step(spark, 2, b, tmp_path)
    want = {i: t for i, t, _ in brute_spans(plain(b))}
    assert {r[0]: r[1] for r in c} == {i: t for i, t in want.items() if t.strip()}
    assert all(r[4] == len(r[1]) for r in c)
    d = step(spark, 3, c, tmp_path)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(c)).collect() if r.taken}
    counted = {}
    for r in d:
        counted[r[0]] = counted.get(r[0], 0) + 1
    assert counted == taken
    e = step(spark, 4, d, tmp_path)
    assert sorted(r.doc_id for r in e) == sorted(r[0] for r in d)
    assert all(len(r.ids) == r.n_tokens for r in e)
    for k in range(4):
        assert [f.name for f in spark.read.parquet(f"{tmp_path}/{k}").schema] == list(corpus_pipeline.COLUMNS)


def test_near_duplicates_without_id_and_repeated(spark, tmp_path):
    """One row a group stays: of copies without ids, of rows repeated with their id, of texts that share an id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(1) + " more"
    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (7, near), (8, text(2)), (8, text(2)), (9, text(3)), (9, text(4)), (3, text(4)), (None, text(5))]
    found = step(spark, 1, [(i, t, "en", "s", len(t)) for i, t in rows], tmp_path)
    assert sorted(((r[0], r[1]) for r in found), key=str) == sorted([(None, text(0)), (7, near), (8, text(2)), (9, text(3)), (3, text(4)), (None, text(5))], key=str)


def test_stages_built_one_upon_the_other(spark, docs, no_docs, tmp_path):
    """All stages over each other's plans, written at the end only: with null ids, repeated rows and extra columns; and of nothing."""
    for k, start in enumerate((docs, no_docs)):
        out, plans = start, []
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, "")
            plans.append(out)
        out.write.parquet(f"{tmp_path}/lazy{k}")
        counts = [p.count() for p in plans]  # what the first stages have staged is still there
        assert counts[-1] == spark.read.parquet(f"{tmp_path}/lazy{k}").count() and (counts[0] > 20) == (k == 0)
        assert all(p.columns == list(corpus_pipeline.COLUMNS) for p in plans[:-1])


def test_run_like_its_stages(spark, corpus, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for k in range(5):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    found = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda d: sorted(map(str, d.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    assert key(found) == key(docs)
