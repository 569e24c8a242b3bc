"""Language identification: held-out accuracy, and evidence beside the text."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import language
from rankloom.llm.language import learn_languages, page_fields, page_languages

FOLDER = "/root/testdata/sf0.001"
EN, FR = "the weather of the town was with them and that is how they went", "le temps de la ville est avec eux et que nous allons"


@pytest.fixture
def model(spark):
    rows = [(EN, "en"), (FR, "fr"), (None, "en"), ("", "fr"), ("x", None)] * 4
    return learn_languages(spark.createDataFrame(rows, "text string, lang string"))


def judged(spark, model, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("declared", F.lit("zz"))
    return {r["page_id"]: r for r in page_languages(pages, *model).collect()}


def test_blocks_count_each_trigram_once(monkeypatch):
    text = (EN + "  É " + FR).encode()
    whole = language._cell_counts(text)
    assert whole.sum() == len(b" ".join(text.decode().lower().encode().split()))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.array_equal(language._cell_counts(text), whole)
    assert language._cell_counts(b"").sum() == 0


def test_text_decides_and_the_host_helps(spark, model):
    rows = [(i, "https://fr.site.org/x", f'<html lang="fr"><p>{FR}</p></html>') for i in range(30)]
    rows += [(100 + i, "https://en.site.com/x", f"<html lang=en><p>{EN}</p></html>") for i in range(30)]
    rows += [
        (200, "https://fr.site.org/y", ""),
        (201, "https://en.site.com/y", None),
        (202, None, f"<script>{FR}{FR}</script><!-- {FR} --><p>{EN}"),
        (203, "https://fr.site.org/z", f'<html lang="fr">{EN} {EN}</html>'),
        (204, None, None),
        (None, "https://fr.site.org/w", FR),
    ]
    got = judged(spark, model, rows)
    assert len(got) == len(rows)
    assert got[0]["lang"] == "fr" and got[100]["lang"] == "en"
    assert got[200]["lang"] == "fr" and got[201]["lang"] == "en" and got[200]["text_lang"] is None
    assert got[202]["lang"] == "en" and got[203]["text_lang"] == "en" and got[None]["lang"] == "fr"
    assert all(0 < r["posterior"] <= 1 for r in got.values())


def test_a_page_does_not_vote_for_itself(spark, model):
    """Two lone hosts with the same doubtful text differ only in how many other pages they have."""
    rows = [(1, "https://lone.org", "xx"), (2, "https://fr.site.org", "xx")]
    rows += [(10 + i, "https://fr.site.org", FR) for i in range(50)]
    got = judged(spark, model, rows)
    assert got[2]["lang"] == "fr" and got[2]["posterior"] > 0.9


def plain_posteriors(rows, langs, votes):
    """Posteriors of pages without text by hand: rows are (id, suffix, domain, host), votes the text languages."""

    def share(lang, level, key, me):
        mine = [votes[r[0]] for r in rows if r[level] == key and r[0] != me and votes[r[0]]]
        return mine.count(lang), len(mine)

    out = {}
    for me, suffix, domain, host in rows:
        if votes[me]:
            continue
        scores = []
        for lang in langs:
            others = [votes[r[0]] for r in rows if votes[r[0]]]
            p = (others.count(lang) + 1) / (len(others) + len(langs))
            for level, key in ((1, suffix), (2, domain), (3, host)):
                n, whole = share(lang, level, key, me)
                p = (n + language.SMOOTHING * p) / (whole + language.SMOOTHING)
            # No page declares a language, so the missing declaration is as likely as the pages' votes say.
            n = others.count(lang)
            scores.append(p * (n + 1) / (n + 1 + len(langs)))
        out[me] = max(scores) / sum(scores)
    return out


def test_posteriors_are_those_of_plain_counts(spark, model):
    """Pages without text: only the chain of host, domain, suffix and all decides, and the suffix counts once."""
    rows = [(i, "fr", f"a{i}.fr", f"a{i}.fr", FR) for i in range(20)]
    rows += [(100 + i, "com", f"b{i}.com", f"b{i}.com", EN) for i in range(15)]
    rows += [(200 + i, "uk", f"c{i % 2}.co.uk", f"w{i}.c{i % 2}.co.uk", EN if i % 3 else FR) for i in range(9)]
    rows += [(300, "fr", "new.fr", "new.fr", ""), (301, "com", "b1.com", "b1.com", ""), (302, "uk", "c1.co.uk", "w1.c1.co.uk", "")]
    rows += [(303, "uk", "c0.co.uk", "x.c0.co.uk", ""), (304, "org", "z.org", "z.org", "")]
    got = judged(spark, model, [(r[0], f"https://{r[3]}/p", r[4]) for r in rows])
    votes = {r[0]: got[r[0]]["text_lang"] for r in rows}
    assert all(votes[r[0]] == {FR: "fr", EN: "en", "": None}[r[4]] for r in rows)
    expected = plain_posteriors([r[:4] for r in rows], model[0], votes)
    assert {i: got[i]["posterior"] for i in expected} == pytest.approx(expected)
    assert got[300]["lang"] == "fr" and got[302]["lang"] == "en"


def test_fields(spark):
    row = spark.createDataFrame(
        [("https://u@M.Example.co.uk:80/p?q", '<HTML class=a LANG="pt-BR"><b>a&amp;b</b>')], "url string, html string"
    )
    got = row.select(*[c.alias(k) for k, c in page_fields(row).items()]).first()
    assert tuple(got) == ("pt", "m.example.co.uk", "example.co.uk", "uk", "a b")


def test_empty_pages(spark, model):
    assert judged(spark, model, []) == {}


def test_no_labelled_text(spark):
    with pytest.raises(ValueError):
        learn_languages(spark.createDataFrame([], "text string, lang string"))


def test_pages_without_labelled_text_have_no_language(spark):
    model = language.learn_any_languages(spark.createDataFrame([("x", None)], "text string, lang string"))
    got = judged(spark, model, [(1, "https://a.org/x", f"<html lang=en>{EN}"), (2, None, None)])
    assert [tuple(got[i]) for i in (1, 2)] == [(1, None, None, None, "en", "a.org"), (2, None, None, None, None, None)]


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    rows = [(f"{EN} {i * 'q'}", f"en-{i}") for i in range(5)] + [(FR, "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    pages = [(i, f"https://{'fr' if i % 3 else 'en'}.org", FR if i % 3 else EN) for i in range(20)] + [(50, None, None), (51, "https://fr.org", "")]
    whole = judged(spark, learn_languages(docs), pages)
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 4)
    model = learn_languages(docs)
    assert isinstance(model[1], language.Cells) and judged(spark, model, pages) == whole


def test_more_languages_than_a_block(spark):
    rows = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{i} " * 20, f"l{i:03}") for i in range(300)]
    model = learn_languages(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    got = judged(spark, model, [(i, None, rows[i][0]) for i in (0, 100, 299)])
    assert {i: r["text_lang"] for i, r in got.items()} == {i: f"l{i:03}" for i in (0, 100, 299)}


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = learn_languages(docs.filter("doc_id % 2 = 0"))
    pages = docs.filter("doc_id % 2 = 1").select(
        F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang"
    )
    found = page_languages(pages.drop("lang"), *model).join(pages.select("page_id", F.col("lang").alias("actual")), "page_id")
    assert found.filter("lang = actual").count() >= 0.97 * found.count()
