"""Names of several words and of any script are removed, with their later mentions."""

from shelltrace.llm import private


def test_whole_names_and_bare_mentions(spark):
    rows = [
        (1, "Mrs Anna Jones met Mr McDonald. Jones left, McDonald's dog and Smith-Jones stayed."),
        (2, "Herr Müller-Lüdenscheidt und Mr O'Brien; O'Brien ging."),
        (3, "Mr Արամ and Mr Їє and Mr 王小明. Then 王小明 spoke to Արամ."),
        (4, "Jones is no name here."),
        (5, "Mrs Jones"),
        (6, "Mr Smith. The end; The Smiths."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private.replace_private(df, "a key").collect()}
    for name in ("Anna", "McDonald", "Donald"):
        assert name not in got[1].text
    assert "Jones left" not in got[1].text and got[1].n_entities >= 5
    # The same name has the same surrogate with its title and without.
    jones = got[5].text.removeprefix("Mrs ")
    assert f"{jones} left" in got[1].text and jones != "Jones"
    assert "denscheid" not in got[2].text and "Brien" not in got[2].text
    for name in ("Արամ", "Їє", "王小明"):
        assert name not in got[3].text
    assert got[3].n_entities == 5
    assert got[4].text == rows[3][1] and got[4].n_entities == 0
    assert got[6].text.endswith(". The end; The Smiths.")
