"""Texts that need no Python stay in the JVM; the others are rewritten as before."""

import html
import unicodedata
from types import SimpleNamespace

import quillframe as qf
from quillframe.operators import clean, nlp


def test_only_texts_with_entities_are_sent(spark, monkeypatch):
    real = html.unescape

    def strict(t):
        if "&" not in t:
            raise ValueError("no entity")
        return real(t)

    monkeypatch.setattr(clean, "html", SimpleNamespace(unescape=strict))
    texts = ["<p>plain</p>", "<b>a &amp; b</b>", None, "", "&eacute;<br>"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2)
    got = {r["i"]: r["t"] for r in qf.apply(df, "clean.remove_html_tags", column="t").collect()}
    assert [got[i] for i in range(5)] == ["plain", "a & b", None, "", "é"] and got == {i: got[i % 5] for i in range(1500)}


def test_only_accented_texts_are_sent(spark, monkeypatch):
    real = unicodedata.normalize

    def strict(form, t):
        if t.isascii():
            raise ValueError("no accent")
        return real(form, t)

    monkeypatch.setattr(nlp, "unicodedata", SimpleNamespace(normalize=strict, combining=unicodedata.combining))
    df = spark.createDataFrame(list(enumerate(["Plain", "Crème Brûlée", "", "ﬁn Ünder"] * 300)), "i long, t string").repartition(2)
    got = {r["i"]: r["t"] for r in qf.apply(df, "nlp.text_normalize", column="t", stem=False).collect()}
    assert [got[i] for i in range(4)] == ["plain", "creme brulee", "", "fin under"] and got == {i: got[i % 4] for i in range(1200)}
