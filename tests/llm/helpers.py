SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h1 int, a int, _c int, comp string, label string, rank int, _id int, _th string, _r int, _gid int, _host string, _h int, _p int, key int, host_rate double, n_docs int"


def make(spark, rows):
    """documents of (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3, "y", "z", 4, 5, "t", 6, 7, "h", 8, 9, 10, 0.5, 11) for i, t, s in rows], SCHEMA)
