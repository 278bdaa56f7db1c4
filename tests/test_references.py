"""Reference lists and citation markers on hand-made lists."""

from inkstat.operators import references as RF


def listed(spark, text, *more):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, refs string")
    return RF.reference_list(df, "refs").orderBy("number").select("doc_id", "number", *more).collect()


def test_numbers_in_text_order(spark):
    text = "References\n[1] A. Alpha. A first thing we like. 2001.\n17\n[2] B. Beta and C. Coe. The second thing we like, as in [1]. 2002.\n[2] stands here again.\n[3] C. Gamma and F. Foe. One more thing we like. In ACM, 2003.\n[4] D. Delta, E. Eps. Yet another small thing. Journal of X, 2004.\n[9] z\nNeurIPS Paper Checklist\n[5] no entry of the list any more here."
    rows = listed(spark, text, "raw", "title", "surname", "year")
    assert [r.number for r in rows] == [1, 2, 3, 4] and {r.doc_id for r in rows} == {1}
    assert [(r.title, r.surname, r.year) for r in rows] == [
        ("A first thing we like", "Alpha", 2001), ("The second thing we like, as in [1]", "Beta", 2002), ("One more thing we like", "Gamma", 2003), ("Yet another small thing", "Delta", 2004)]
    assert rows[1].raw.endswith("2002. [2] stands here again.") and "17" not in rows[0].raw


def test_author_year_lists(spark):
    text = ("Smith, Jane and Doe, Ann. How we learn to read. Journal of Y, 2015.\nKo, Bea. A re-\nview of many small models. arXiv:2302.01234, 2019a. URL https://x.y/z "
            "Luk, Cy. Short.\n2020. Müller, Dan. What is in a name? In Proceedings of W, 2021.")
    rows = listed(spark, text, "title", "surname", "year", "arxiv")
    assert [tuple(r)[2:] for r in rows] == [
        ("How we learn to read", "Smith", 2015, None), ("A review of many small models", "Ko", 2019, "2302.01234"), ("What is in a name", "Müller", 2021, None)]


def test_markers(spark):
    df = spark.createDataFrame([(1, "a [3-5], [2,4 – 10] and [301] (Doe, 2001) (see x) [a]\n7\n"), (2, None), (3, "")], "doc_id long, body string")
    got = {r.doc_id: (r.numbers, r.n_markers, r.n_author_year) for r in RF.citation_markers(df, "body").collect()}
    assert got == {1: ([2, 3, 4, 5, 6, 7, 8, 9, 10], 3, 1), 2: ([], 0, 0), 3: ([], 0, 0)}
    ends = {r.doc_id: r.numbers for r in RF.citation_markers(df, "body", ranges=False).collect()}
    assert ends[1] == [2, 3, 4, 5, 10]
