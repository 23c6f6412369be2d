"""Suffix stemming of single words as column expressions.

Meant for *distinct* words: a corpus is stemmed by joining its tokens with the stemmed vocabulary
(``postlab.operators.terms``). Every stage binds its input to a name first (``let``), so the expression
stays linear in size although a stage mentions its input several times, wherever Catalyst moves it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlab.functions.binding import let

# ---- fixed values: German ------------------------------------------------------------------------
DE_VOWELS = "aeiouyäöü"
DE_S_ENDING = "bdfghklmnrt"
DE_ST_ENDING = "bdfghklmnt"
DE_STEP_1 = ["em", "ern", "er", "e", "en", "es", "s"]
DE_STEP_2 = ["en", "er", "est", "st"]
DE_STEP_3 = ["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"]

# ---- fixed values: English -----------------------------------------------------------------------
EN_VOWELS = "aeiouy"
EN_DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
EN_LI_ENDING = "cdeghkmnrt"
EN_REGION_PREFIXES = ["gener", "commun", "arsen"]
EN_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_STOP_AFTER_PLURAL = [
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
]
EN_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
EN_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
EN_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize",
]
# ---- end of fixed values -------------------------------------------------------------------------


def _chain(word: Column, stages: list[Callable[[Column], Column]]) -> Column:
    if not stages:
        return word
    return let(stages[0](word), lambda w: _chain(w, stages[1:]))


def _on_ending(endings, rule: Callable[[Column, Column, Column], Column]) -> Callable[[Column], Column]:
    """A stage that looks up the longest of ``endings`` and calls ``rule(word, ending, word cut)``."""
    pattern = f"({'|'.join(endings)})$"
    return lambda w: let(
        F.regexp_extract(w, pattern, 1), lambda e: let(_cut(w, e), lambda cut: rule(w, e, cut))
    )


def _cut(word: Column, ending: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(ending))


def _region(word: Column, vowels: str, times: int) -> Column:
    """Characters up to the ``times``-th non-vowel that follows a vowel; 0 if there is none."""
    return F.length(F.regexp_extract(word, f"^((?:[^{vowels}]*[{vowels}]+[^{vowels}]){{{times}}})", 1))


def stem_german(word: Column) -> Column:
    """The German stem of a word. Placeholder tokens end in ``>`` and stay as they are."""
    # u and y between vowels count as consonants; \x01 marks them before they turn upper case
    marked = F.regexp_replace(
        F.replace(word, F.lit("ß"), F.lit("ss")),
        f"([{DE_VOWELS}])([uy])(?=[{DE_VOWELS}])", "$1\x01$2",
    )
    prepared = F.replace(F.replace(marked, F.lit("\x01u"), F.lit("U")), F.lit("\x01y"), F.lit("Y"))

    def region(w: Column, times: int, at_least: int) -> Column:
        found = _region(w, DE_VOWELS, times)
        return F.when(
            (F.length(w) >= 3) & (found > 0), F.greatest(found, F.lit(at_least))
        ).otherwise(F.length(w))

    def stages(p1: Column, p2: Column) -> list[Callable[[Column], Column]]:
        def inflection(w, e, cut):
            return (
                F.when((e == "") | (F.length(cut) < p1), w)
                .when(e.isin("em", "ern", "er"), cut)
                .when(e.isin("e", "en", "es"), F.regexp_replace(cut, "niss$", "nis"))
                .when(cut.rlike(f"[{DE_S_ENDING}]$"), cut)
                .otherwise(w)
            )

        def comparison(w, e, cut):
            return (
                F.when((e == "") | (F.length(cut) < p1), w)
                .when((e != "st") | cut.rlike(f"^.{{3,}}[{DE_ST_ENDING}]$"), cut)
                .otherwise(w)
            )

        def derivation(w, e, cut):
            def without(ending: str, region_start: Column) -> Column:
                return cut.endswith(ending) & (F.length(cut) - len(ending) >= region_start)

            return (
                F.when((e == "") | (F.length(cut) < p2), w)
                .when(
                    e.isin("end", "ung"),
                    F.when(without("ig", p2) & ~cut.endswith("eig"), _cut(cut, F.lit("ig"))).otherwise(cut),
                )
                .when(e.isin("ig", "ik", "isch"), F.when(cut.endswith("e"), w).otherwise(cut))
                .when(
                    e.isin("lich", "heit"),
                    F.when(without("er", p1) | without("en", p1), _cut(cut, F.lit("er"))).otherwise(cut),
                )
                .when(without("lich", p2), _cut(cut, F.lit("lich")))
                .when(without("ig", p2), _cut(cut, F.lit("ig")))
                .otherwise(cut)
            )

        return [
            _on_ending(DE_STEP_1, inflection),
            _on_ending(DE_STEP_2, comparison),
            _on_ending(DE_STEP_3, derivation),
            lambda w: F.translate(w, "UYäöü", "uyaou"),
        ]

    return let(prepared, lambda w: let(region(w, 1, 3), lambda p1: let(
        region(w, 2, 0), lambda p2: _chain(w, stages(p1, p2)))))


def stem_english(word: Column) -> Column:
    """The English stem of a word."""
    v = EN_VOWELS
    short_end = f"([^{v}][{v}][^{v}wxY]|^[{v}][^{v}])$"

    def literal_map(pairs: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    # y at the start or after a vowel counts as a consonant, written Y
    initial = F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y")
    prepared = F.regexp_replace(initial, f"([{v}])y", "$1Y")

    def first_region(w: Column) -> Column:
        prefix = F.length(F.regexp_extract(w, f"^({'|'.join(EN_REGION_PREFIXES)})", 1))
        found = F.when(prefix > 0, prefix).otherwise(_region(w, v, 1))
        return F.when(found > 0, found).otherwise(F.length(w))

    def second_region(w: Column, p1: Column) -> Column:
        beyond = _region(F.substring(w, p1 + 1, F.length(w)), v, 1)
        return F.when(beyond > 0, p1 + beyond).otherwise(F.length(w))

    def plural(w, e, cut):
        return (
            F.when(e == "sses", F.concat(cut, F.lit("ss")))
            .when(e.isin("ied", "ies"),
                  F.concat(cut, F.when(F.length(cut) > 1, F.lit("i")).otherwise(F.lit("ie"))))
            .when((e == "s") & cut.rlike(f"[{v}]."), cut)
            .otherwise(w)
        )

    def stages(p1: Column, p2: Column) -> list[Callable[[Column], Column]]:
        def in_r1(part):
            return F.length(part) >= p1

        def in_r2(part):
            return F.length(part) >= p2

        def past(w, e, cut):
            return (
                F.when(e.isin("eed", "eedly"),
                       F.when(in_r1(cut), F.concat(cut, F.lit("ee"))).otherwise(w))
                .when((e == "") | ~cut.rlike(f"[{v}]"), w)
                .when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e")))
                .when(cut.rlike(f"({'|'.join(EN_DOUBLES)})$"), _cut(cut, F.lit("x")))
                .when((F.length(cut) == p1) & cut.rlike(short_end), F.concat(cut, F.lit("e")))
                .otherwise(cut)
            )

        def derivation_2(w, e, cut):
            return (
                F.when((e == "") | ~in_r1(cut), w)
                .when(e == "ogi", F.when(cut.endswith("l"), F.concat(cut, F.lit("og"))).otherwise(w))
                .when(e == "li", F.when(cut.rlike(f"[{EN_LI_ENDING}]$"), cut).otherwise(w))
                .otherwise(F.concat(cut, F.try_element_at(literal_map(EN_STEP_2), e)))
            )

        def derivation_3(w, e, cut):
            return (
                F.when((e == "") | ~in_r1(cut), w)
                .when(e == "ative", F.when(in_r2(cut), cut).otherwise(w))
                .otherwise(F.concat(cut, F.try_element_at(literal_map(EN_STEP_3), e)))
            )

        def derivation_4(w, e, cut):
            return (
                F.when((e == "") | ~in_r2(cut), w)
                .when((e == "ion") & ~cut.rlike("[st]$"), w)
                .otherwise(cut)
            )

        def final_letter(w, e, cut):
            return (
                F.when((e == "e") & (in_r2(cut) | (in_r1(cut) & ~cut.rlike(short_end))), cut)
                .when((e == "l") & in_r2(cut) & cut.endswith("l"), cut)
                .otherwise(w)
            )

        return [
            _on_ending(["eedly", "ingly", "edly", "eed", "ing", "ed"], past),
            lambda w: F.regexp_replace(w, f"(.[^{v}])[yY]$", "$1i"),
            _on_ending([*EN_STEP_2, "ogi", "li"], derivation_2),
            _on_ending([*EN_STEP_3, "ative"], derivation_3),
            _on_ending([*EN_STEP_4, "ion"], derivation_4),
            _on_ending(["e", "l"], final_letter),
        ]

    def stemmed(w: Column, p1: Column, p2: Column) -> Column:
        no_quote = F.regexp_replace(w, "('s'|'s|')$", "")
        return let(no_quote, lambda q: let(
            _on_ending(["sses", "ied", "ies", "us", "ss", "s"], plural)(q),
            lambda s: F.when(s.isin(EN_STOP_AFTER_PLURAL), s).otherwise(_chain(s, stages(p1, p2))),
        ))

    regular = let(prepared, lambda w: let(first_region(w), lambda p1: let(
        second_region(w, p1), lambda p2: F.translate(stemmed(w, p1, p2), "Y", "y"))))
    return (
        F.when(word.isin(list(EN_WHOLE_WORDS)), F.try_element_at(literal_map(EN_WHOLE_WORDS), word))
        .when(F.length(word) < 3, word)
        .otherwise(regular)
    )
