"""Text rules as native column expressions (no UDF).

Every function takes and returns a Column, so a rule chain is a single projection that Catalyst keeps
next to the scan, whatever the frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.binding import apply_where

# ---- fixed values: patterns, replacements and alphabets that decide the tokens -------------------
TIME_EXPRESSION = r"[0-9]*-?[0-9]+[ \t\n\x0B\f\r]?min((ute)?n?)((ütige)?r?)"
HYPERLINK = r"(https?://)?([a-z0-9.]+\.[a-z0-9]+(/([a-z0-9_/.?&%=+])*)*)"
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüß<> "
NOT_LETTERS = "[^abcdefghijklmnopqrstuvwxyzäöüß<> ]"
REVIEW_PUNCTUATION = "#,.:!?()"
LEADING_URL = r"^(https?|ftp|file)://[-a-zA-Z0-9+&@#/%?=~_|!:,.;]*[-a-zA-Z0-9+&@#/%=~_|]"
MIN_TOKEN_LENGTH = 2
MARKUP_RULES = [
    (r"<.*>", ""),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"\|thumb", ""),
    (r"\|left", ""),
    (r"\|right", ""),
    (r"\|[0-9]+px", ""),
    (r"\[\[image:[^\[\]]*\|", ""),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
    (r"[<>]", ""),
    (r"[0-9]+", " <<<number>>> "),
]
NOISE_LINE = r"^(\||!|\{|\*|:|==|#)"
# ---- end of fixed values --------------------------------------------------------------------------


# The two expensive patterns in an equal but faster form. Runs of digits are one DIGITS character by
# then. A link cannot start in the middle of a run of link characters unless at "http", so only run
# starts are tried; its path is one run, as the slash is itself a path character.
DIGITS, _OTHER_CONTROL = "\x02", "\x03"
_FAST_TIME = f"(?:{DIGITS}(?:-{DIGITS})?|-{DIGITS})[ \t\n\x0B\f\r]?min(?:ute)?n?(?:ütige)?r?"
_FAST_LINK = (
    f"(?:https?://|(?<![a-z{DIGITS}.]))[a-z{DIGITS}.]+\\.[a-z{DIGITS}]+(?:/[a-z{DIGITS}_/.?&%=+]*+)?"
)
_LINK_DOT = f"\\.[a-z{DIGITS}]"


def _mark(name: str) -> str:
    return f" <<<token{name}>>> "


def _swap(text: Column, characters: str, replacement: str) -> Column:
    """Plain replacements; a character that does not occur costs one scan and no copy."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(replacement))
    return text


def normalize_text(text: Column) -> Column:
    """The normalised text: blanks separate the tokens, placeholders stand for links, times, ...

    No rule looks across a blank, so all rules run on the whole text at once. Digits become one marker
    character first, which turns three digit patterns into plain replacements. A marker character in
    the text itself is swapped for another control character; no rule tells control characters apart.
    The costly patterns only run on texts that pass a cheap test they cannot match without.
    """
    def has_digits(t: Column) -> Column:
        return t.contains(DIGITS)

    def number_words(t: Column) -> Column:
        t = F.replace(t, F.lit(DIGITS + "min"), F.lit(_mark("time")))
        t = F.replace(t, F.lit(DIGITS + "€"), F.lit(_mark("moneyamount").lstrip()))
        return _swap(t, DIGITS, _mark("number"))

    def where_there(t: Column, part: str, pattern: str, name: str) -> Column:
        return apply_where(t, lambda x: x.contains(part), lambda x: F.regexp_replace(x, pattern, _mark(name)))

    c = _swap(F.lower(text), DIGITS, _OTHER_CONTROL)
    c = F.regexp_replace(c, "[0-9]+", DIGITS)
    c = apply_where(
        c, has_digits, lambda t: F.regexp_replace(t, _FAST_TIME, _mark("timeexpression")))
    c = F.replace(F.replace(c, F.lit("s bahn"), F.lit("sbahn")), F.lit("s-bahn"), F.lit("sbahn"))
    c = _swap(c, "-", " ")
    c = apply_where(
        c, lambda t: t.rlike(_LINK_DOT), lambda t: F.regexp_replace(t, _FAST_LINK, _mark("hyperlink")))
    for tag in ("#bahn", "#db"):
        c = F.replace(c, F.lit(tag), F.lit(_mark("bahnhashtag")))
    c = _swap(c, "#", "")
    c = apply_where(c, has_digits, number_words)
    c = _swap(c, "&", "und")
    c = where_there(c, "...", r"\.{3,}", "annoyeddots")
    for smiley in (":)", "☺"):
        c = F.replace(c, F.lit(smiley), F.lit(_mark("happysmiley")))
    c = F.replace(c, F.lit(":("), F.lit(_mark("sadsmiley")))
    c = _swap(F.regexp_replace(c, "[,.:;]+", ""), "/%+", " ")
    c = where_there(c, "!!", "!!+", "strongexclamation")
    c = where_there(c, "??", r"\?\?+", "strongquestion")
    c = F.regexp_replace(c, r"[?!()\[\]|]+", "")
    c = _swap(c, '"„“', _mark("quote"))
    c = F.replace(c, F.lit("db"), F.lit(_mark("dbusername")))
    c = _swap(c, "❤", _mark("heart"))
    return F.regexp_replace(c, NOT_LETTERS, "")


def normalize_tokens(text: Column) -> Column:
    """Tokens of the normalised text, at least two characters long."""
    return F.filter(
        F.split(normalize_text(text), " ", -1), lambda t: F.length(t) >= MIN_TOKEN_LENGTH
    )


def lowercase(text: Column) -> Column:
    return F.lower(text)


def blank_split(text: Column) -> Column:
    """Split on single blanks; trailing empty pieces go, inner ones stay, empty text is one piece."""
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(F.rtrim(text) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.rtrim(text), " ", -1))
    )


def raw_tokens(text: Column) -> Column:
    """Lower-cased blank-split pieces without any cleaning."""
    return blank_split(F.lower(text))


def strip_punct_tokens(*fields: Column) -> Column:
    """The fields joined by a blank, lower-cased, split on blanks, punctuation taken out of each piece."""
    joined = F.lower(F.concat_ws(" ", *fields))
    return F.transform(blank_split(joined), lambda t: _swap(t, REVIEW_PUNCTUATION, ""))


def clean_sentence(text: Column) -> Column:
    """Without a leading URL and without round brackets, in lower case."""
    no_url = F.regexp_replace(text, LEADING_URL, "")
    return F.lower(_swap(no_url, "()", ""))


def clean_news_line(line: Column) -> Column:
    """Lower case, numbers as a placeholder, letters only. Empty lines stay."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(line), "[0-9]+", "<<<number>>>"), NOT_LETTERS, ""
    )


def java_trim(text: Column) -> Column:
    """Strip control characters and blanks (code points up to 32) from both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_noise_line(line: Column) -> Column:
    """Table, list, heading and directive lines of a markup dump."""
    return java_trim(line).rlike(NOISE_LINE) | F.lower(line).contains("notoc")


def clean_markup_line(line: Column) -> Column:
    """Markup taken out of one dump line, letters only."""
    c = F.lower(java_trim(line))
    for pattern, replacement in MARKUP_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return F.regexp_replace(c, NOT_LETTERS, "")


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank."""
    starts = F.when(
        F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def concat_tokens(*columns: Column) -> Column:
    """Any number of token columns, one after the other."""
    return F.concat(*columns)
