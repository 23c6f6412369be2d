"""The text rules on hand-made strings and random texts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlab.functions import normalize as nz

GOLDEN = {
    '5-10min 10 minütiger #db (xD) "ok" 20€ & a b':
        "<<<tokentimeexpression>>> <<<tokentimeexpression>>> <<<tokenbahnhashtag>>> xd <<<tokenquote>>> "
        "ok <<<tokenquote>>> <<<tokenmoneyamount>>> und",
    "AB- -cd e--f 5#min x.y-z": "ab cd <<<tokentime>>> <<<tokenhyperlink>>>",
    "Feedback zur S-Bahn: 10-15 Minuten Verspätung :) 3.50€ @DB_Bahn #bahn www.bahn.de/x-y "
    "Warum...ja??!! :-) ;-)":
        "fee <<<tokendbusername>>> ack zur sbahn <<<tokentimeexpression>>> verspätung "
        "<<<tokenhappysmiley>>> <<<tokenhyperlink>>> <<<tokendbusername>>> bahn <<<tokenbahnhashtag>>> "
        "<<<tokenhyperlink>>> <<<tokenhyperlink>>> <<<tokenstrongquestion>>> <<<tokenstrongexclamation>>>",
    "": "",
    "xhttp://a.b/c/d?e=f%20 g": "<<<tokenhyperlink>>>",
    "wort.. na... http://x a..b": "wort na <<<tokenannoyeddots>>> http <<<tokenhyperlink>>>",
    "line one\nline two": "line oneline two",
    "❤ ☺ :( „ja“": "<<<tokenheart>>> <<<tokenhappysmiley>>> <<<tokensadsmiley>>> <<<tokenquote>>> ja <<<tokenquote>>>",
    "12 und 7 5min": "<<<tokennumber>>> und <<<tokennumber>>> <<<tokentimeexpression>>>",
}


def piecewise(text: str) -> list[str]:
    """The rules piece by piece, each pattern as stated."""
    text = re.sub(nz.TIME_EXPRESSION, " <<<tokentimeexpression>>> ", text.lower())
    text = text.replace("s bahn", "sbahn").replace("s-bahn", "sbahn")
    found = []
    for piece in re.split("[ -]", text):
        p = re.sub(nz.HYPERLINK, " <<<tokenhyperlink>>> ", piece)
        p = p.replace("#bahn", " <<<tokenbahnhashtag>>> ").replace("#db", " <<<tokenbahnhashtag>>> ").replace("#", "")
        p = re.sub("[0-9]+min", " <<<tokentime>>> ", p)
        p = re.sub("[0-9]+€", "<<<tokenmoneyamount>>> ", p)
        p = re.sub("[0-9]+", " <<<tokennumber>>> ", p).replace("&", "und")
        p = re.sub(r"\.{3,}", " <<<tokenannoyeddots>>> ", p)
        p = p.replace(":)", " <<<tokenhappysmiley>>> ").replace("☺", " <<<tokenhappysmiley>>> ")
        p = p.replace(":(", " <<<tokensadsmiley>>> ")
        p = re.sub("[,.:]", "", p)
        p = re.sub("[/%+]", " ", p).replace(";", "")
        p = re.sub("!!+", " <<<tokenstrongexclamation>>> ", p)
        p = re.sub(r"\?\?+", " <<<tokenstrongquestion>>> ", p)
        p = re.sub(r"[?!()\[\]|]", "", p)
        p = re.sub('["„“]', " <<<tokenquote>>> ", p)
        p = p.replace("db", " <<<tokendbusername>>> ").replace("❤", " <<<tokenheart>>> ")
        p = "".join(c for c in p if c in nz.LETTERS)
        found += [t for t in p.split(" ") if len(t) >= 2]
    return found


def tokens_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", nz.normalize_tokens(F.col("t")).alias("k")).orderBy("i").collect()
    return [r["k"] for r in rows]


def test_golden_strings(spark):
    assert [" ".join(t) for t in tokens_of(spark, list(GOLDEN))] == list(GOLDEN.values())


def test_golden_strings_piecewise():
    assert [" ".join(piecewise(t)) for t in GOLDEN] == list(GOLDEN.values())


PIECES = st.sampled_from([
    "a", "z", "min", "minute", "minuten", "ütige", "r", "db", "#", "#bahn", "#db", "http://", "https://", ".", "..",
    "...", "/", "-", " ", "  ", "0", "15", "€", "&", ":", ")", "(", "☺", "!", "?", "\n", "\x02", "\x03", "s bahn",
    "s-bahn", "ä", "é", "„", "“", '"', "|", "[", "]", "%", "=", "+", "_", ";", ",", "❤", "@", "X",
])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=150, max_size=150))
def test_random_texts(spark, texts):
    got = tokens_of(spark, texts)
    for text, tokens in zip(texts, got):
        assert tokens == piecewise(text), repr(text)
        assert all(len(t) >= 2 and set(t) <= set(nz.LETTERS) - {" "} for t in tokens)


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).head()["x"]


def test_blank_split(spark):
    assert one(spark, nz.blank_split, "a  b ") == ["a", "", "b"]
    assert one(spark, nz.blank_split, "   ") == []
    assert one(spark, nz.blank_split, "") == [""]


def test_clean_sentence(spark):
    assert one(spark, nz.clean_sentence, "http://x.de/a?b Hallo (Welt) http://y.de") == " hallo welt http://y.de"


def test_clean_news_line(spark):
    assert one(spark, nz.clean_news_line, "Um 12:30 Uhr.") == "um <<<number>>><<<number>>> uhr"


def test_clean_markup_line(spark):
    line = "[[Bild:x.jpg|thumb]] Ein '''Wort''' [[ziel|Text]] {{vorlage|x}} &lt;ref&gt;weg&lt;/ref&gt; 1999"
    assert one(spark, nz.clean_markup_line, line).split() == ["ein", "wort", "text", "<<<number>>>"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    rows = df.select(nz.ngrams(F.col("t"), 2).alias("x")).collect()
    assert [r["x"] for r in rows] == [["a b", "b c"], [], []]
