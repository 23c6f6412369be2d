"""DuckDB SQL that states each query's result independently of Spark, for side-by-side checks."""

from __future__ import annotations

from postlab.functions import normalize as nz
from postlab.functions import stem as st
from postlab.operators.subwords import BUCKETS, LONGEST, SHORTEST
from postlab.plans.models import TF_WIDTH, TOP_FEATURES
from postlab.queries import (
    BLOCK_TAG, DUMP_END, DUMP_START, FOLDS, LINE_BREAK, MAX_DISTANCE, NEIGHBOURS, SAMPLE_ROWS, SEED,
    SELECTED_FEATURES, SEQUENCE_LENGTH, TARGET_LABELS, TOP_TERMS,
)
from postlab.testtables import (
    DICTIONARY_MIN_DF, DIM, LEXICON_RANKS, N_CENTERS, SCORE_CHARACTERS, SCORE_CLASSES, SPLIT_PARTS, SPLIT_SEED,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {_text(pattern)}, {_text(replacement)}, 'g')"


def _lit(expr: str, old: str, new: str) -> str:
    return f"replace({expr}, {_text(old)}, {_text(new)})"


def _normalized(column: str) -> str:
    """The text rules one by one, in their order."""
    c = f"lower({column})"
    c = _sub(c, nz.TIME_EXPRESSION, " <<<tokentimeexpression>>> ")
    c = _lit(_lit(c, "s bahn", "sbahn"), "s-bahn", "sbahn")
    c = _lit(c, "-", " ")
    c = _sub(c, nz.HYPERLINK, " <<<tokenhyperlink>>> ")
    c = _lit(_lit(c, "#bahn", " <<<tokenbahnhashtag>>> "), "#db", " <<<tokenbahnhashtag>>> ")
    c = _lit(c, "#", "")
    c = _sub(c, "[0-9]+min", " <<<tokentime>>> ")
    c = _sub(c, "[0-9]+€", "<<<tokenmoneyamount>>> ")
    c = _sub(c, "[0-9]+", " <<<tokennumber>>> ")
    c = _lit(c, "&", "und")
    c = _sub(c, r"\.{3,}", " <<<tokenannoyeddots>>> ")
    c = _lit(_lit(c, ":)", " <<<tokenhappysmiley>>> "), "☺", " <<<tokenhappysmiley>>> ")
    c = _lit(c, ":(", " <<<tokensadsmiley>>> ")
    for gone in [",", ".", ":"]:
        c = _lit(c, gone, "")
    for blank in ["/", "%", "+"]:
        c = _lit(c, blank, " ")
    c = _lit(c, ";", "")
    c = _sub(c, "!!+", " <<<tokenstrongexclamation>>> ")
    c = _sub(c, r"\?\?+", " <<<tokenstrongquestion>>> ")
    for gone in ["?", "!", "(", ")", "[", "]", "|"]:
        c = _lit(c, gone, "")
    for quote in ['"', "„", "“"]:
        c = _lit(c, quote, " <<<tokenquote>>> ")
    c = _lit(c, "db", " <<<tokendbusername>>> ")
    c = _lit(c, "❤", " <<<tokenheart>>> ")
    return _sub(c, f"[^{nz.LETTERS}]", "")


def _tokens(column: str) -> str:
    return f"list_filter(string_split({_normalized(column)}, ' '), lambda x: length(x) >= 2)"


def _blank_split(column: str) -> str:
    return (
        f"CASE WHEN {column} = '' THEN [''] WHEN rtrim({column}, ' ') = '' THEN CAST([] AS VARCHAR[]) "
        f"ELSE string_split(rtrim({column}, ' '), ' ') END"
    )


def _left_over(reduced: str) -> str:
    return f"CAST(length(text) - length({reduced}) AS DOUBLE)"


SCORES = "[CAST(length(text) AS DOUBLE), " + ", ".join(
    [_left_over(_lit("text", c, "")) for c in SCORE_CHARACTERS]
    + [_left_over(_sub("text", p, "")) for p in SCORE_CLASSES]
) + "]"

# ---- shared tables ---------------------------------------------------------------------------------------
TOK = f"tok AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS tokens FROM documents)"
LAB = """lab AS MATERIALIZED (SELECT doc_id, quality AS relevance,
  CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS sentiment FROM labels)"""
NAMED = """named AS (SELECT *, CASE sentiment WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral'
  ELSE 'positive' END AS sentiment_name FROM lab)"""
WORDS = """words AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS word,
  unnest(range(len(tokens))) AS pos FROM tok)"""
TF = "tf AS MATERIALIZED (SELECT doc_id, word AS term, count(*) AS tf FROM words GROUP BY ALL)"
IDF = """idf AS MATERIALIZED (SELECT term, count(*) AS df,
  ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term)"""
RANKED = """ranked AS MATERIALIZED (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank
  FROM (SELECT word, count(*) AS n FROM words GROUP BY word))"""
EMB = "emb AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
WV = """wv AS MATERIALIZED (SELECT r.word, r.n, e.vec_id AS id, e.v, e.label
  FROM ranked r JOIN emb e ON e.vec_id = r.rank - 1)"""
SUBWORDS = f"""marked AS (SELECT word, '<' || word || '>' AS m, unnest(range({SHORTEST}, {LONGEST} + 1)) AS n FROM ranked),
  grams AS MATERIALIZED (SELECT word, CAST('0x' || left(md5(substr(m, i, n)), 8) AS BIGINT) % {BUCKETS} AS b FROM (
    SELECT word, m, n, unnest(range(1, length(m) - n + 2)) AS i FROM marked)),
  held AS (SELECT g.b, unnest(wv.v) AS x, unnest(range({DIM})) AS dim FROM grams g JOIN wv ON wv.word = g.word),
  of_buckets AS MATERIALIZED (SELECT b, dim, avg(x) AS x FROM held GROUP BY b, dim),
  composed AS (SELECT g.word, o.dim, avg(o.x) AS x FROM grams g JOIN of_buckets o ON o.b = g.b
    WHERE g.word NOT IN (SELECT word FROM wv) GROUP BY g.word, o.dim),
  of_words AS MATERIALIZED (SELECT r.word, wv.word IS NOT NULL AS known,
    coalesce(wv.v, c.v, list_transform(range({DIM}), lambda i: 0.0::DOUBLE)) AS v FROM ranked r
    LEFT JOIN wv ON wv.word = r.word
    LEFT JOIN (SELECT word, list(x ORDER BY dim) AS v FROM composed GROUP BY word) c ON c.word = r.word)"""
LEX = f"""lex AS MATERIALIZED (SELECT word, CASE WHEN rank % 2 = 1 THEN 'positive' ELSE 'negative' END AS polarity,
  CAST((rank - 1) // 2 AS INTEGER) AS i FROM ranked WHERE rank <= {LEXICON_RANKS}),
  slots AS MATERIALIZED (SELECT word, polarity, CAST(i + 2 + CASE WHEN polarity = 'negative'
    THEN (SELECT count(*) FROM lex WHERE polarity = 'positive') ELSE 0 END AS INTEGER) AS idx FROM lex)"""
HITS = """hits AS MATERIALIZED (SELECT t.doc_id, s.word, s.polarity, s.idx
  FROM (SELECT DISTINCT doc_id, word FROM words) t JOIN slots s ON t.word = s.word)"""
DIST = "sqrt(list_sum(list_transform(range(1, {n} + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
CENTERS = f"""centers AS MATERIALIZED (SELECT label AS center, list(m ORDER BY d) AS v FROM (
    SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range({DIM})) AS d FROM emb)
    GROUP BY label, d) GROUP BY label),
  assigned AS MATERIALIZED (SELECT vec_id, label, center, distance FROM (
    SELECT vec_id, label, center, distance,
      row_number() OVER (PARTITION BY vec_id ORDER BY distance, center) AS r
    FROM (SELECT e.vec_id, e.label, c.center, {DIST.format(n=DIM, a='e.v', b='c.v')} AS distance
      FROM emb e CROSS JOIN centers c)) WHERE r = 1)"""
MEANS = f"""sums AS MATERIALIZED (SELECT doc_id, d, sum(x * n) / sum(n) AS value FROM (
    SELECT w.doc_id, w.tf AS n, unnest(wv.v) AS x, unnest(range({DIM})) AS d
    FROM tf w JOIN wv ON wv.word = w.term) GROUP BY doc_id, d),
  means AS MATERIALIZED (SELECT t.doc_id, g.d AS dim, coalesce(s.value, 0.0) AS value
    FROM documents t CROSS JOIN (SELECT unnest(range({DIM})) AS d) g
    LEFT JOIN sums s ON s.doc_id = t.doc_id AND s.d = g.d)"""
LINES = f"""lines AS MATERIALIZED (SELECT page_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (
    SELECT page_id, string_split_regex(regexp_replace(html, {_text(BLOCK_TAG)}, E'\\n<\\\\1', 'g'),
      {_text(LINE_BREAK)}) AS l FROM pages)),
  kept AS (SELECT *, {_sub('line', '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')} AS trimmed FROM lines
    WHERE NOT regexp_matches({_sub('line', '^[\\x00-\\x20]+', '')}, {_text(nz.NOISE_LINE)})
      AND NOT contains(lower(line), 'notoc')),
  marked AS (SELECT *, last_value(CASE WHEN starts_with(trimmed, {_text(DUMP_END)}) THEN 0
      WHEN starts_with(trimmed, {_text(DUMP_START)}) THEN 1 END IGNORE NULLS)
      OVER (PARTITION BY page_id ORDER BY pos) AS state FROM kept),
  inside AS MATERIALIZED (SELECT page_id, pos, line, trimmed FROM marked WHERE state = 1)"""
VOTES = f"""scored AS (SELECT doc_id, text, {SCORES} AS s FROM documents),
  votes AS MATERIALIZED (SELECT doc_id, text, CASE WHEN s[1] >= 2000 THEN 1.5 ELSE 0.4 END AS v1,
    CASE WHEN s[9] >= 5 THEN 1.0 ELSE 0.0 END AS v2, CASE WHEN s[3] >= 5 THEN 2.0 ELSE 1.0 END AS v3 FROM scored),
  voted AS MATERIALIZED (SELECT doc_id, text, v2, CAST((SELECT x FROM (
      SELECT x, count(*) AS n FROM (VALUES (floor(v1 + 0.5)), (floor(v2 + 0.5)), (floor(v3 + 0.5))) t(x) GROUP BY x)
    ORDER BY n DESC, x LIMIT 1) AS INTEGER) AS prediction FROM votes)"""


def _with(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


def _line(vector: str) -> str:
    """All values of a vector, in millionths, as one text."""
    return f"array_to_string(list_transform({vector}, lambda x: CAST(round(x * 1e6) AS BIGINT)), ' ')"


def _chi2(source: str, feature: str, value: str, prefix: str) -> str:
    """Chi-square by the full table of observed and expected counts, zero counts included."""
    p = prefix
    return f"""{p}_n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM lab),
  {p}_class AS (SELECT relevance AS c, CAST(count(*) AS DOUBLE) AS size FROM lab GROUP BY relevance),
  {p}_seen AS MATERIALIZED (SELECT s.{feature} AS f, CAST(s.{value} AS DOUBLE) AS x, l.relevance AS c,
    CAST(count(*) AS DOUBLE) AS o FROM {source} s JOIN lab l ON l.doc_id = s.doc_id WHERE s.{value} <> 0
    GROUP BY ALL),
  {p}_zero AS (SELECT g.f, 0.0 AS x, g.c, g.size - coalesce(sum(s.o), 0) AS o
    FROM (SELECT f, c, size FROM (SELECT DISTINCT f FROM {p}_seen) CROSS JOIN {p}_class) g
    LEFT JOIN {p}_seen s ON s.f = g.f AND s.c = g.c GROUP BY g.f, g.c, g.size),
  {p}_grid AS (SELECT r.f, r.x, k.c, k.size FROM (SELECT DISTINCT f, x FROM {p}_seen) r CROSS JOIN {p}_class k),
  {p}_all AS (SELECT g.f, g.x, g.c, g.size, coalesce(s.o, 0) AS o FROM {p}_grid g
      LEFT JOIN {p}_seen s ON s.f = g.f AND s.x = g.x AND s.c = g.c
    UNION ALL SELECT z.f, z.x, z.c, k.size, z.o FROM {p}_zero z JOIN {p}_class k ON k.c = z.c),
  {p}_rows AS (SELECT f, x, sum(o) AS r FROM {p}_all GROUP BY f, x HAVING sum(o) > 0),
  {p}_chi AS MATERIALIZED (SELECT a.f, round(sum((a.o - w.r * a.size / total) ^ 2 / (w.r * a.size / total)), 6) + 0.0
      AS statistic, CAST((count(DISTINCT a.x) - 1) * ((SELECT count(*) FROM {p}_class) - 1) AS BIGINT) AS dof
    FROM {p}_all a JOIN {p}_rows w ON w.f = a.f AND w.x = a.x CROSS JOIN {p}_n GROUP BY a.f)"""


def _german_stem(words: str) -> str:
    """CTEs that end in ``stemmed(word, n, stem)``; ``words`` names a table (word, n)."""
    v = st.DE_VOWELS
    consonants = (
        f"list_reduce(list_transform(range(1, length(w0) + 1), lambda i: substr(w0, i, 2)), "
        f"lambda acc, p: acc || CASE WHEN p[1] IN ('u', 'y') AND length(p) = 2 AND contains('{v}', p[2]) "
        f"AND acc <> '' AND contains('{v}', right(acc, 1)) THEN upper(p[1]) ELSE p[1] END, '')"
    )

    def longest(w: str, endings: list[str]) -> str:
        ordered = sorted(endings, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN ends_with({w}, '{e}') THEN '{e}'" for e in ordered) + " ELSE '' END"

    def cut(n: int, source: str, endings: list[str]) -> str:
        return (
            f"e{n} AS (SELECT *, {longest(source, endings)} AS s{n} FROM {'w0p' if n == 1 else f'd{n - 1}'}), "
            f"c{n} AS (SELECT *, left({source}, length({source}) - length(s{n})) AS b{n} FROM e{n})"
        )

    return f"""w00 AS (SELECT word, n, replace(word, 'ß', 'ss') AS w0 FROM {words}),
  w01 AS (SELECT word, n, {consonants} AS w FROM w00),
  w02 AS (SELECT *, length(regexp_extract(w, '^[^{v}]*[{v}]+[^{v}]', 0)) AS r1,
    length(regexp_extract(w, '^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}]', 0)) AS r2 FROM w01),
  w0p AS (SELECT word, n, w, CASE WHEN length(w) >= 3 AND r1 > 0 THEN greatest(r1, 3) ELSE length(w) END AS p1,
    CASE WHEN length(w) >= 3 AND r2 > 0 THEN r2 ELSE length(w) END AS p2 FROM w02),
  {cut(1, 'w', st.DE_STEP_1)},
  d1 AS (SELECT word, n, p1, p2, CASE WHEN s1 = '' OR length(b1) < p1 THEN w
    WHEN s1 = 's' THEN CASE WHEN b1 <> '' AND contains('{st.DE_S_ENDING}', right(b1, 1)) THEN b1 ELSE w END
    WHEN s1 IN ('e', 'en', 'es') AND ends_with(b1, 'niss') THEN left(b1, length(b1) - 1)
    ELSE b1 END AS w1 FROM c1),
  {cut(2, 'w1', st.DE_STEP_2)},
  d2 AS (SELECT word, n, p1, p2, CASE WHEN s2 = '' OR length(b2) < p1 THEN w1
    WHEN s2 = 'st' AND NOT (length(b2) >= 4 AND contains('{st.DE_ST_ENDING}', right(b2, 1))) THEN w1
    ELSE b2 END AS w2 FROM c2),
  {cut(3, 'w2', st.DE_STEP_3)},
  d3 AS (SELECT word, n, CASE WHEN s3 = '' OR length(b3) < p2 THEN w2
    WHEN s3 IN ('ig', 'ik', 'isch') THEN CASE WHEN ends_with(b3, 'e') THEN w2 ELSE b3 END
    WHEN s3 IN ('end', 'ung') AND ends_with(b3, 'ig') AND NOT ends_with(b3, 'eig') AND length(b3) - 2 >= p2
      THEN left(b3, length(b3) - 2)
    WHEN s3 IN ('lich', 'heit') AND right(b3, 2) IN ('er', 'en') AND length(b3) - 2 >= p1
      THEN left(b3, length(b3) - 2)
    WHEN s3 = 'keit' AND ends_with(b3, 'lich') AND length(b3) - 4 >= p2 THEN left(b3, length(b3) - 4)
    WHEN s3 = 'keit' AND ends_with(b3, 'ig') AND length(b3) - 2 >= p2 THEN left(b3, length(b3) - 2)
    ELSE b3 END AS w3 FROM c3),
  stemmed AS MATERIALIZED (SELECT word, n, translate(w3, 'UYäöü', 'uyaou') AS stem FROM d3)"""


def _english_stem(words: str) -> str:
    """CTEs that end in ``stemmed(word, n, stem)``; ``words`` names a table (word, n)."""
    v = st.EN_VOWELS
    nv = f"[^{v}]"
    whole = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in st.EN_WHOLE_WORDS.items())
    stop = ", ".join(f"'{x}'" for x in st.EN_STOP_AFTER_PLURAL)
    doubles = ", ".join(f"'{x}'" for x in st.EN_DOUBLES)
    prefixes = "|".join(st.EN_REGION_PREFIXES)
    short = f"(regexp_matches({{x}}, '{nv}[{v}][^{v}wxY]$') OR regexp_matches({{x}}, '^[{v}]{nv}$'))"

    def longest(w: str, endings) -> str:
        ordered = sorted(endings, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN ends_with({w}, '{e}') THEN '{e}'" for e in ordered) + " ELSE '' END"

    def cut(n: int, source: str, before: str, endings) -> str:
        return (
            f"e{n} AS (SELECT *, {longest(source, endings)} AS s{n} FROM {before}), "
            f"c{n} AS (SELECT *, left({source}, length({source}) - length(s{n})) AS b{n} FROM e{n})"
        )

    def swap(pairs: dict[str, str], ending: str) -> str:
        return f"CASE {ending} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in pairs.items()) + " END"

    # y after a vowel turns upper case from left to right; an upper-case Y is no vowel for the next one
    consonants = (
        f"list_reduce(string_split(w0, ''), lambda acc, c: acc || CASE WHEN c = 'y' AND "
        f"(acc = '' OR contains('{v}', right(acc, 1))) THEN 'Y' ELSE c END, '')"
    )
    return f"""w00 AS (SELECT word, n, regexp_replace(word, '^''', '') AS w0 FROM {words}),
  w01 AS (SELECT word, n, {consonants} AS w FROM w00),
  w02 AS (SELECT *, CASE WHEN regexp_matches(w, '^({prefixes})') THEN length(regexp_extract(w, '^({prefixes})', 0))
    ELSE length(regexp_extract(w, '^{nv}*[{v}]+{nv}', 0)) END AS r1 FROM w01),
  w03 AS (SELECT word, n, w, CASE WHEN r1 > 0 THEN r1 ELSE length(w) END AS p1 FROM w02),
  w04 AS (SELECT *, length(regexp_extract(substr(w, p1 + 1), '^{nv}*[{v}]+{nv}', 0)) AS r2 FROM w03),
  w05 AS (SELECT word, n, p1, CASE WHEN r2 > 0 THEN p1 + r2 ELSE length(w) END AS p2,
    regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM w04),
  {cut(1, 'w', 'w05', ['sses', 'ied', 'ies', 's', 'us', 'ss'])},
  d1 AS (SELECT word, n, p1, p2, CASE WHEN s1 = 'sses' THEN b1 || 'ss'
    WHEN s1 IN ('ied', 'ies') THEN b1 || CASE WHEN length(b1) > 1 THEN 'i' ELSE 'ie' END
    WHEN s1 = 's' AND regexp_matches(b1, '[{v}].') THEN b1 ELSE w END AS w1 FROM c1),
  {cut(2, 'w1', 'd1', ['ed', 'eed', 'ing', 'edly', 'eedly', 'ingly'])},
  d2 AS (SELECT word, n, p1, p2, w1, CASE WHEN s2 IN ('eed', 'eedly') THEN
      CASE WHEN length(b2) >= p1 THEN b2 || 'ee' ELSE w1 END
    WHEN s2 = '' OR NOT regexp_matches(b2, '[{v}]') THEN w1
    WHEN right(b2, 2) IN ('at', 'bl', 'iz') THEN b2 || 'e'
    WHEN right(b2, 2) IN ({doubles}) THEN left(b2, length(b2) - 1)
    WHEN length(b2) = p1 AND {short.format(x='b2')} THEN b2 || 'e' ELSE b2 END AS w2 FROM c2),
  y2 AS (SELECT word, n, p1, p2, w1, regexp_replace(w2, '(.{nv})[yY]$', '\\1i') AS w2 FROM d2),
  {cut(3, 'w2', 'y2', [*st.EN_STEP_2, 'ogi', 'li'])},
  d3 AS (SELECT word, n, p1, p2, w1, CASE WHEN s3 = '' OR length(b3) < p1 THEN w2
    WHEN s3 = 'ogi' THEN CASE WHEN ends_with(b3, 'l') THEN b3 || 'og' ELSE w2 END
    WHEN s3 = 'li' THEN CASE WHEN b3 <> '' AND contains('{st.EN_LI_ENDING}', right(b3, 1)) THEN b3 ELSE w2 END
    ELSE b3 || {swap(st.EN_STEP_2, 's3')} END AS w3 FROM c3),
  {cut(4, 'w3', 'd3', [*st.EN_STEP_3, 'ative'])},
  d4 AS (SELECT word, n, p1, p2, w1, CASE WHEN s4 = '' OR length(b4) < p1 THEN w3
    WHEN s4 = 'ative' THEN CASE WHEN length(b4) >= p2 THEN b4 ELSE w3 END
    ELSE b4 || {swap(st.EN_STEP_3, 's4')} END AS w4 FROM c4),
  {cut(5, 'w4', 'd4', [*st.EN_STEP_4, 'ion'])},
  d5 AS (SELECT word, n, p1, p2, w1, CASE WHEN s5 = '' OR length(b5) < p2 THEN w4
    WHEN s5 = 'ion' AND right(b5, 1) NOT IN ('s', 't') THEN w4 ELSE b5 END AS w5 FROM c5),
  d6 AS (SELECT word, n, w1, CASE
    WHEN ends_with(w5, 'e') AND (length(w5) - 1 >= p2 OR (length(w5) - 1 >= p1
      AND NOT {short.format(x='left(w5, length(w5) - 1)')})) THEN left(w5, length(w5) - 1)
    WHEN ends_with(w5, 'll') AND length(w5) - 1 >= p2 THEN left(w5, length(w5) - 1)
    ELSE w5 END AS w6 FROM d5),
  stemmed AS MATERIALIZED (SELECT word, n, coalesce(CASE word {whole} END, CASE WHEN length(word) < 3 THEN word
    WHEN w1 IN ({stop}) THEN w1 ELSE replace(w6, 'Y', 'y') END) AS stem FROM d6)"""


VOCABULARY = "vocab AS MATERIALIZED (SELECT word, count(*) AS n FROM words GROUP BY word)"
STEM_ARRAYS = """SELECT t.doc_id, coalesce(string_agg(s.stem, ' ' ORDER BY w.pos), '') AS stems
  FROM documents t LEFT JOIN words w ON w.doc_id = t.doc_id LEFT JOIN stemmed s ON s.word = w.word GROUP BY t.doc_id"""


def _joined(table: str, tokens: str, separator: str = " ") -> str:
    return (
        f"SELECT doc_id, array_to_string(t, {_text(separator)}) AS tokens, CAST(len(t) AS BIGINT) AS n "
        f"FROM (SELECT doc_id, {tokens} AS t FROM {table})"
    )


PAIRS = "list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])"
NEWS = _sub(_sub("lower(line)", "[0-9]+", "<<<number>>>"), f"[^{nz.LETTERS}]", "")


def _markup(column: str) -> str:
    c = f"lower({column})"
    for pattern, replacement in nz.MARKUP_RULES:
        c = _sub(c, pattern, replacement)
    return _sub(c, f"[^{nz.LETTERS}]", "")


def _md5(key: str) -> str:
    return f"md5('{SEED}:' || CAST({key} AS VARCHAR))"


SPLIT = f"""CASE WHEN l.relevance IS NULL THEN 'test'
  WHEN CAST('0x' || left(md5('{SPLIT_SEED}:' || d.doc_id), 8) AS BIGINT) % {SPLIT_PARTS} = 0 THEN 'dev' ELSE 'train' END"""
CORPUS = f"""corpus AS MATERIALIZED (SELECT d.doc_id, d.text, l.relevance, l.sentiment, {SPLIT} AS split
  FROM documents d LEFT JOIN lab l ON l.doc_id = d.doc_id)"""
SOFT = ["+".join(f"(n_chars * {i + 1}) % 7" for i in range(10)),
        "+".join(f"(n_chars * {i + 2}) % 5" for i in range(10)),
        "+".join(f"(n_chars + {i}) % 6" for i in range(10))]
BY_LABEL = "(SELECT label, center, count(*) AS n FROM assigned GROUP BY label, center)"

ORACLE: dict[str, str] = {
    "corpus_load": _with(LAB) + f"""SELECT d.doc_id, l.relevance AS relevant, l.sentiment,
        CAST(len({_tokens("translate(d.text, chr(9) || chr(10) || chr(13), '   ')")}) AS BIGINT) AS n_tokens,
        list_sum({SCORES}) / 4 AS score_sum FROM documents d JOIN lab l ON l.doc_id = d.doc_id""",
    "encode_labels": _with(LAB) + """SELECT doc_id, CASE WHEN relevance = 1 THEN 1 ELSE 0 END AS relevance,
        sentiment, CAST(sentiment + 1 AS DOUBLE) AS sentiment_1based FROM lab""",
    "vectors_load": _with(EMB) + """SELECT vec_id, CAST(len(v) AS BIGINT) AS dim, """ + _line("v") + """ AS vector FROM emb""",
    "review_json_parse": """SELECT event_id, 'r' || event_id AS "reviewID", event_type AS asin, NULL::VARCHAR AS "reviewerName",
        (event_id % 7) || ',' || (event_id % 11) AS helpful, props AS "reviewText", CAST(event_id % 5 + 1 AS INTEGER) AS overall,
        CASE WHEN event_id % 3 > 0 THEN event_type END AS summary, CAST(event_id * 1000003 AS BIGINT) AS "unixReviewTime",
        CAST(user_id AS VARCHAR) AS "reviewTime" FROM events""",
    "normalize_tokens": _with(TOK) + _joined("tok", "tokens"),
    "raw_tokens": _joined("documents", _blank_split("lower(text)")),
    "strip_punct_tokens": _joined(
        "documents",
        f"list_transform({_blank_split('''lower(source || ' ' || text)''')}, lambda x: translate(x, {_text(nz.REVIEW_PUNCTUATION)}, ''))",
    ),
    "bigrams": _with(TOK) + _joined("tok", PAIRS, "|"),
    "concat_token_arrays": _with(TOK) + _joined("tok", f"list_concat(tokens, {PAIRS})", "|"),
    "lowercase_text": "SELECT conv_id, turn, lower(text) AS text FROM conversations",
    "clean_sentence": f"""SELECT conv_id, turn, lower(replace(replace(
        regexp_replace(text, {_text(nz.LEADING_URL)}, ''), '(', ''), ')', '')) AS text FROM conversations""",
    "clean_news_lines": f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, {NEWS} AS line FROM (SELECT doc_id, unnest(l) AS line,
        unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split_regex(text, {_text(LINE_BREAK)}) AS l FROM documents))""",
    "section_lines": _with(LINES) + "SELECT page_id, CAST(pos AS INTEGER) AS pos, line FROM inside",
    "section_lines_any_order": _with(LINES) + "SELECT page_id, CAST(pos AS INTEGER) AS pos, line FROM inside",
    "clean_markup_lines": _with(LINES) + f"""SELECT page_id, pos, line FROM (SELECT page_id, CAST(pos AS INTEGER) AS pos,
        {_markup('trimmed')} AS line FROM inside) WHERE line <> ''""",
    "term_counts": _with(TOK, WORDS, TF) + "SELECT doc_id, term, tf FROM tf",
    "idf_terms": _with(TOK, WORDS, TF, IDF) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_terms": _with(TOK, WORDS, TF, IDF) + """SELECT tf.doc_id, tf.term, tf.tf, round(tf.tf * idf.idf, 6) AS tfidf
        FROM tf JOIN idf ON idf.term = tf.term""",
    "top_terms_by_class": _with(LAB, TOK, WORDS, TF) + f"""SELECT relevance, rank, term, weight FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY relevance ORDER BY weight DESC, term) AS INTEGER) AS rank FROM (
          SELECT l.relevance, tf.term, round(sum(tf.tf * i.idf), 6) AS weight FROM tf JOIN lab l ON l.doc_id = tf.doc_id
          JOIN (SELECT term, ln(((SELECT count(*) FROM lab JOIN documents USING (doc_id)) + 1) / (count(*) + 1)) AS idf
            FROM tf WHERE doc_id IN (SELECT doc_id FROM lab) GROUP BY term) i ON i.term = tf.term
          GROUP BY l.relevance, tf.term)) WHERE rank <= {TOP_TERMS}""",
    "chi2_terms": _with(LAB, TOK, WORDS, TF, _chi2("tf", "term", "tf", "t"))
        + "SELECT f AS term, statistic, dof FROM t_chi",
    "selected_dense_features": _with(
        LAB, TOK, WORDS, TF, _chi2("tf", "term", "tf", "t"),
        f"""dense AS MATERIALIZED (SELECT doc_id, unnest(s) AS value, unnest(range(len(s))) AS dim
          FROM (SELECT doc_id, {SCORES} AS s FROM documents))""",
        _chi2("dense", "dim", "value", "d"),
    ) + f"""SELECT count(dim) AS n_selected, coalesce(string_agg(CAST(dim + 1 AS VARCHAR), ' ' ORDER BY dim), '') AS selected FROM (
        SELECT dim FROM (SELECT 1 AS dense, lpad(CAST(f AS VARCHAR), 4, '0') AS name, f AS dim, statistic FROM d_chi
          UNION ALL SELECT 0, f, NULL, statistic FROM t_chi) ORDER BY statistic DESC, dense DESC, name LIMIT {SELECTED_FEATURES})""",
    "stem_german": _with(TOK, WORDS, VOCABULARY, _german_stem("vocab")) + STEM_ARRAYS,
    "stem_english": _with(TOK, WORDS, VOCABULARY, _english_stem("vocab")) + STEM_ARRAYS,
    "stem_groups": _with(TOK, WORDS, VOCABULARY, _german_stem("vocab"))
        + "SELECT stem, count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n FROM stemmed GROUP BY stem",
    "relative_length": _with(TOK) + """SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens,
        round(len(tokens) / (SELECT avg(len(tokens)) FROM tok), 6) AS relative_length FROM tok""",
    "corpus_stats": _with(LAB, CORPUS) + f"""SELECT split, relevance, sentiment, n, round(m, 6) AS mean_words,
        round(s, 6) AS sd_words FROM (
        SELECT split, relevance, sentiment, count(*) AS n, avg(wc) AS m, stddev_samp(wc) AS s,
          grouping(relevance, sentiment) AS g
        FROM (SELECT split, relevance, sentiment, len({_blank_split('text')}) AS wc FROM corpus)
        GROUP BY GROUPING SETS ((split, relevance), (split, sentiment), (split)))
        WHERE g = 3 OR relevance IS NOT NULL OR sentiment IS NOT NULL""",
    "word_counts_by_class_wide": _with(LAB, NAMED) + f"""SELECT position,
        max(CASE WHEN c = 'negative' THEN wc END) AS negative, max(CASE WHEN c = 'neutral' THEN wc END) AS neutral,
        max(CASE WHEN c = 'positive' THEN wc END) AS positive FROM (
        SELECT sentiment_name AS c, CAST(len({_blank_split('d.text')}) AS INTEGER) AS wc,
          row_number() OVER (PARTITION BY sentiment_name ORDER BY d.doc_id) AS position
        FROM documents d JOIN named ON named.doc_id = d.doc_id) GROUP BY position""",
    "contiguous_folds": f"""SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1)
        // (count(*) OVER () // {FOLDS}), {FOLDS}) AS INTEGER) AS fold FROM labels""",
    "kfold_assign": f"""SELECT doc_id, CAST(CAST('0x' || left({_md5('doc_id')}, 8) AS BIGINT) % {FOLDS} AS INTEGER) AS fold
        FROM labels""",
    "hash_sample": f"SELECT doc_id FROM documents ORDER BY {_md5('doc_id')}, doc_id LIMIT {SAMPLE_ROWS}",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {_md5('doc_id')}, doc_id) AS position FROM documents",
    "union_splits": _with(LAB, CORPUS) + """SELECT origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
        SELECT split AS origin, text FROM corpus UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY origin""",
    "token_vectors": _with(TOK, WORDS, RANKED, EMB, WV) + """SELECT w.doc_id, CAST(w.pos AS INTEGER) AS pos, w.word,
        """ + _line("wv.v") + """ AS vector FROM words w JOIN wv ON wv.word = w.word""",
    "token_vectors_with_default": _with(TOK, WORDS, RANKED, EMB, WV) + """SELECT w.doc_id, CAST(w.pos AS INTEGER) AS pos,
        w.word, """ + _line(f"coalesce(wv.v, list_transform(range({DIM}), lambda i: 0.0::DOUBLE))")
        + """ AS vector FROM words w LEFT JOIN wv ON wv.word = w.word""",
    "subword_vectors": _with(TOK, WORDS, RANKED, EMB, WV, SUBWORDS)
        + "SELECT word, known, " + _line("v") + " AS vector FROM of_words",
    "token_vectors_composed": _with(TOK, WORDS, RANKED, EMB, WV, SUBWORDS, f"""sums AS (SELECT doc_id, dim, avg(x) AS x, count(*) AS n
        FROM (SELECT w.doc_id, unnest(o.v) AS x, unnest(range({DIM})) AS dim FROM words w JOIN of_words o ON o.word = w.word)
        GROUP BY doc_id, dim)""") + "SELECT doc_id, any_value(n) AS n_tokens, " + _line("list(x ORDER BY dim)")
        + " AS vector FROM sums GROUP BY doc_id",
    "word_vector_lookup": _with(TOK, WORDS, RANKED, EMB, WV) + """SELECT f.word, CAST(coalesce(len(wv.v), 0) AS BIGINT) AS dim,
        coalesce(""" + _line("wv.v") + """, '') AS vector FROM (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z]+')) AS word
          FROM documents) f LEFT JOIN wv ON wv.word = lower(f.word) WHERE f.word <> ''""",
    "prune_empty": _with(TOK, WORDS, RANKED, EMB, WV) + """SELECT w.doc_id, count(*) AS n_known
        FROM words w JOIN wv ON wv.word = w.word GROUP BY w.doc_id""",
    "sentence_vectors": _with(TOK, WORDS, TF, RANKED, EMB, WV, MEANS)
        + "SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(value, 6) + 0.0 AS value FROM means",
    "sequence_vectors": _with(TOK, WORDS, RANKED, EMB, WV) + f"""SELECT g.doc_id, CAST(g.dim AS INTEGER) AS dim,
        round(coalesce(k.x, 0.0), 6) + 0.0 AS value FROM (
          SELECT doc_id, unnest(range({SEQUENCE_LENGTH * DIM})) AS dim FROM (SELECT DISTINCT w.doc_id FROM words w
            JOIN wv ON wv.word = w.word)) g
        LEFT JOIN (SELECT doc_id, unnest(v) AS x, unnest(range({DIM})) + (place - 1) * {DIM} AS dim FROM (
          SELECT w.doc_id, wv.v, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.pos) AS place
          FROM words w JOIN wv ON wv.word = w.word) WHERE place <= {SEQUENCE_LENGTH}) k
        ON k.doc_id = g.doc_id AND k.dim = g.dim""",
    "vector_math": _with(EMB) + f"""SELECT a.vec_id AS a, b.vec_id AS b, {_line("list_transform(list_zip(a.v, b.v), lambda p: p[1] + p[2])")} AS "sum",
        {_line("list_transform(list_zip(a.v, b.v), lambda p: p[1] - p[2])")} AS difference, round({DIST.format(n=DIM, a='a.v', b='b.v')}, 6) AS distance
        FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""",
    "embedding_as_double": _with(EMB) + f"""SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 6) + 0.0 AS value FROM (
        SELECT vec_id, unnest(v) AS x, unnest(range({DIM})) AS dim FROM emb)""",
    "knn_exact": _with(EMB) + f"""SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
        SELECT vec_id, neighbour, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank
        FROM (SELECT a.vec_id, b.vec_id AS neighbour, {DIST.format(n=DIM, a='a.v', b='b.v')} AS distance
          FROM emb a CROSS JOIN emb b)) WHERE rank <= {NEIGHBOURS}""",
    "closest_within": _with(EMB) + f"""SELECT a.vec_id, n.neighbour, round(n.distance, 6) AS distance FROM emb a LEFT JOIN (
        SELECT vec_id, neighbour, distance FROM (SELECT vec_id, neighbour, distance,
          row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM (
            SELECT a.vec_id, b.vec_id AS neighbour, {DIST.format(n=DIM, a='a.v', b='b.v')} AS distance
            FROM emb a CROSS JOIN emb b WHERE b.label < {TARGET_LABELS}) WHERE distance <= {MAX_DISTANCE}) WHERE rank = 1) n
        ON n.vec_id = a.vec_id""",
    "substitute_words": _with(TOK, WORDS, RANKED, EMB, WV, f"""subs AS MATERIALIZED (SELECT word, substitute FROM (
          SELECT word, substitute, row_number() OVER (PARTITION BY word ORDER BY distance, id) AS rank FROM (
            SELECT a.word, b.word AS substitute, b.id, {DIST.format(n=DIM, a='a.v', b='b.v')} AS distance
            FROM wv a CROSS JOIN wv b WHERE b.label < {TARGET_LABELS}) WHERE distance < {MAX_DISTANCE}) WHERE rank = 1)""")
        + """SELECT t.doc_id, coalesce(string_agg(coalesce(s.substitute, w.word), ' ' ORDER BY w.pos), '') AS tokens,
        count(CASE WHEN s.substitute <> w.word THEN 1 END) AS n_replaced
        FROM documents t LEFT JOIN words w ON w.doc_id = t.doc_id LEFT JOIN subs s ON s.word = w.word GROUP BY t.doc_id""",
    "nearest_center": _with(EMB, CENTERS) + "SELECT vec_id, center, round(distance, 6) AS distance FROM assigned",
    "cluster_one_hot": _with(EMB, CENTERS) + f"""SELECT vec_id, CAST(idx AS INTEGER) AS idx,
        CASE WHEN idx = center THEN 1.0 ELSE 0.0 END::DOUBLE AS value
        FROM assigned CROSS JOIN (SELECT unnest(range({N_CENTERS})) AS idx)""",
    "wssse_fixed_centers": _with(EMB, CENTERS) + "SELECT round(sum(distance * distance), 6) AS wssse FROM assigned",
    "lexicon_hits": _with(TOK, WORDS, RANKED, LEX, HITS) + "SELECT doc_id, word, polarity, idx FROM hits",
    "lexicon_counts": _with(TOK, WORDS, RANKED, LEX, HITS) + """SELECT t.doc_id,
        count(CASE WHEN h.polarity = 'positive' THEN 1 END) AS positive,
        count(CASE WHEN h.polarity = 'negative' THEN 1 END) AS negative
        FROM documents t LEFT JOIN hits h ON h.doc_id = t.doc_id GROUP BY t.doc_id""",
    "lexicon_vector": _with(TOK, WORDS, RANKED, LEX, HITS) + """SELECT doc_id, polarity AS idx,
        CAST(sum(n) AS DOUBLE) AS value FROM (
          SELECT doc_id, unnest([0, 1]) AS polarity, 0 AS n FROM documents
          UNION ALL SELECT doc_id, CASE WHEN polarity = 'positive' THEN 0 ELSE 1 END, 1 FROM hits) GROUP BY ALL
        UNION ALL SELECT doc_id, idx, 1.0::DOUBLE FROM hits""",
    "misspelling_ratio": _with(TOK, WORDS, TF, f"""known AS MATERIALIZED (SELECT term FROM tf GROUP BY term
        HAVING count(*) >= {DICTIONARY_MIN_DF})""") + """SELECT t.doc_id, CAST(coalesce(sum(tf.tf), 0) AS BIGINT) AS n_tokens,
        CAST(coalesce(sum(CASE WHEN k.term IS NULL AND NOT starts_with(tf.term, '<<<') THEN tf.tf END), 0) AS BIGINT) AS n_unknown,
        round(coalesce(sum(CASE WHEN k.term IS NULL AND NOT starts_with(tf.term, '<<<') THEN tf.tf END), 0)
          / greatest(coalesce(sum(tf.tf), 0), 1), 6) AS ratio
        FROM documents t LEFT JOIN tf ON tf.doc_id = t.doc_id LEFT JOIN known k ON k.term = tf.term GROUP BY t.doc_id""",
    "assemble_features": _with(TOK, WORDS, TF, RANKED, EMB, WV, MEANS, LEX, HITS) + f"""SELECT doc_id, CAST(dim AS INTEGER) AS dim,
        round(value, 6) + 0.0 AS value FROM (
        SELECT doc_id, dim, value FROM means
        UNION ALL SELECT doc_id, {DIM} + unnest(range(len(s))), unnest(s) FROM (SELECT doc_id, {SCORES} AS s FROM documents)
        UNION ALL SELECT t.doc_id, {DIM + 1 + len(SCORE_CHARACTERS) + len(SCORE_CLASSES)},
          CAST(count(CASE WHEN h.polarity = 'positive' THEN 1 END) AS DOUBLE)
          FROM documents t LEFT JOIN hits h ON h.doc_id = t.doc_id GROUP BY t.doc_id
        UNION ALL SELECT t.doc_id, {DIM + 2 + len(SCORE_CHARACTERS) + len(SCORE_CLASSES)},
          CAST(count(CASE WHEN h.polarity = 'negative' THEN 1 END) AS DOUBLE)
          FROM documents t LEFT JOIN hits h ON h.doc_id = t.doc_id GROUP BY t.doc_id)""",
    "feature_matrix_lines": _with(LAB) + f"""SELECT doc_id, sentiment || ',' || array_to_string(
        list_transform(s, lambda x: CAST(CAST(x AS DECIMAL(18, 1)) AS VARCHAR)), ',') AS line
        FROM (SELECT d.doc_id, l.sentiment, {SCORES} AS s FROM documents d JOIN lab l ON l.doc_id = d.doc_id)""",
    "majority_vote": _with(VOTES) + "SELECT doc_id, prediction FROM voted",
    "soft_vote": f"""SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS prediction
        FROM (SELECT doc_id, {SOFT[0]} AS a, {SOFT[1]} AS b, {SOFT[2]} AS c FROM documents)""",
    "join_predictions": _with(LAB, VOTES) + """SELECT l.doc_id, l.sentiment, v.prediction FROM lab l
        JOIN voted v ON v.doc_id = l.doc_id""",
    "submission_rows": _with(VOTES, "free AS (SELECT * FROM voted WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
        + """SELECT CAST(doc_id AS VARCHAR) AS id, text, 'unknown' AS relevance,
        CASE prediction WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment, 'sentiment' AS task FROM free
        UNION ALL SELECT CAST(doc_id AS VARCHAR), text, CASE WHEN v2 = 0 THEN 'false' ELSE 'true' END, 'unknown', 'relevance' FROM free""",
    "bare_text": f"""SELECT origin, key, array_to_string({_tokens('text')}, ' ') AS line FROM (
        SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS key, text FROM documents
        UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations
        UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark)""",
    "labelled_lines": _with(LAB, TOK) + """SELECT t.doc_id, array_to_string(t.tokens, ' ') || ' __label__' || l.sentiment || '.0' AS line
        FROM tok t JOIN lab l ON l.doc_id = t.doc_id""",
    "confusion_matrix": _with(EMB, CENTERS) + f"""SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
        coalesce(c.n, 0) AS n FROM (SELECT unnest(range({N_CENTERS})) AS a) CROSS JOIN (SELECT unnest(range({N_CENTERS})) AS p)
        LEFT JOIN {BY_LABEL} c ON c.label = a AND c.center = p""",
    "weighted_f1": _with(EMB, CENTERS, f"cells AS MATERIALIZED {BY_LABEL}") + """SELECT round(sum(f * support) / sum(support), 6) AS f1 FROM (
        SELECT support, CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / called) * (hit / support) / (hit / called + hit / support) END AS f
        FROM (SELECT l.label, (SELECT sum(n) FROM cells WHERE label = l.label) AS support,
          coalesce((SELECT sum(n) FROM cells WHERE center = l.label), 0) AS called,
          coalesce((SELECT sum(n) FROM cells WHERE label = l.label AND center = l.label), 0) AS hit
          FROM (SELECT DISTINCT label FROM cells) l))""",
    "micro_f1": _with(EMB, CENTERS) + """SELECT round(avg(CASE WHEN label = center THEN 1.0 ELSE 0.0 END), 6) AS f1
        FROM assigned""",
}


# ---- fold statistics: bucket counts and chi-square of every training side ----------------------------------
HASHED = f"""hashed AS MATERIALIZED (SELECT w.doc_id,
    CAST(CAST('0x' || left(md5(s.stem), 8) AS BIGINT) % {TF_WIDTH} AS INTEGER) AS f, CAST(count(*) AS DOUBLE) AS x
  FROM words w JOIN stemmed s ON s.word = w.word GROUP BY ALL)"""
_STEP = "pow(10, floor(log10(greatest(abs(v), 1e-9))) - 1)"
BINS = f"""bins AS MATERIALIZED (SELECT doc_id, CAST({TF_WIDTH} + i AS INTEGER) AS f,
    CASE WHEN v = 0 THEN 0.0 ELSE round(v / {_STEP}) * {_STEP} END AS x
  FROM (SELECT doc_id, unnest(s) AS v, unnest(range(len(s))) AS i FROM (SELECT doc_id, {SCORES} AS s FROM documents)))"""
TRAINED = f"""placed AS (SELECT *, CAST('0x' || left({_md5('doc_id')}, 8) AS BIGINT) % {FOLDS} AS fold,
    CAST('0x' || left(md5('{SPLIT_SEED}:' || doc_id), 8) AS BIGINT) % {SPLIT_PARTS} = 0 AS dev FROM lab),
  trained AS MATERIALIZED (SELECT CAST(side AS INTEGER) AS side, p.* FROM placed p
    CROSS JOIN (SELECT unnest(range(-2, {FOLDS})) AS side) WHERE side = -1 OR (side = -2 AND NOT dev) OR (side >= 0 AND side <> fold)),
  side_size AS (SELECT side, count(*) AS n FROM trained GROUP BY side)"""
FREQUENCIES = """freq AS MATERIALIZED (SELECT side, f, count(*) AS df FROM hashed JOIN trained USING (doc_id) GROUP BY side, f)"""


def _side_chi2(task: str) -> str:
    """Ends in ``ranked_features``: expected counts cell by cell, and the p-value from the closed sums of its gamma function."""
    return f"""cells AS (SELECT * FROM hashed UNION ALL SELECT * FROM bins WHERE x <> 0),
  class_size AS MATERIALIZED (SELECT side, {task} AS c, CAST(count(*) AS DOUBLE) AS size FROM trained GROUP BY ALL),
  seen AS MATERIALIZED (SELECT side, f, x, {task} AS c, CAST(count(*) AS DOUBLE) AS o FROM cells JOIN trained USING (doc_id) GROUP BY ALL),
  grid AS (SELECT r.side, r.f, r.x, k.c, k.size FROM (SELECT DISTINCT side, f, x FROM seen) r JOIN class_size k ON k.side = r.side),
  filled AS MATERIALIZED (SELECT g.*, coalesce(s.o, 0) AS o FROM grid g
    LEFT JOIN seen s ON s.side = g.side AND s.f = g.f AND s.x = g.x AND s.c = g.c),
  zeros AS (SELECT side, f, 0.0 AS x, c, any_value(size) AS size, any_value(size) - sum(o) AS o FROM filled GROUP BY side, f, c),
  every AS (SELECT * FROM filled UNION ALL SELECT * FROM zeros),
  margins AS (SELECT *, sum(o) OVER (PARTITION BY side, f, x) AS r, CAST(n AS DOUBLE) AS n FROM every JOIN side_size USING (side)),
  raw_chi AS (SELECT side, f, sum((o - r * size / n) ^ 2 / (r * size / n)) AS chi,
      (count(DISTINCT x) - 1) * (count(DISTINCT c) - 1) AS free FROM margins WHERE r > 0 GROUP BY side, f),
  chi AS MATERIALIZED (SELECT r.side, r.f, CASE WHEN q.df = z.n THEN 0.0 ELSE chi END AS statistic,
      CASE WHEN q.df = z.n THEN 0 ELSE free END AS dof
    FROM raw_chi r JOIN side_size z USING (side) LEFT JOIN freq q ON q.side = r.side AND q.f = r.f),
  halves AS (SELECT *, statistic / 2 AS x, sqrt(greatest(statistic, 1e-300) / 2) AS z, CASE WHEN dof % 2 = 1 THEN 0.5 ELSE 1.0 END AS a FROM chi),
  tails AS (SELECT *, CASE WHEN dof % 2 = 0 THEN 1.0 WHEN z < 1 THEN exp(x) - 2 / sqrt(pi()) * list_sum([
        exp((2 * i + 1) * ln(z) + 2 * i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) FOR i IN range(31)])
      ELSE 1 / sqrt(pi()) / (z + list_reduce(list_concat([0.0::DOUBLE], list_transform(range(120, 0, -1), lambda i: i::DOUBLE)),
        lambda s, i: i / 2 / (z + s))) END AS head FROM halves),
  ranked_features AS (SELECT side, f AS feature, f >= {TF_WIDTH} AS dense, round(statistic + 1e-9, 6) + 0.0 AS statistic, CAST(dof AS BIGINT) AS dof,
      CASE WHEN dof <= 0 OR statistic <= 0 THEN 0.0 ELSE round(1e-9 + ln(head + coalesce(list_sum([
        exp((a + i) * ln(x) - lgamma(a + i + 1)) FOR i IN range(CAST((dof + 1) // 2 AS BIGINT) - 1)]), 0.0)) - x, 6) + 0.0 END AS log_p
    FROM tails),
  ordered AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY side ORDER BY log_p, feature) AS INTEGER) AS rank FROM ranked_features)"""


_STEMMED = (LAB, TOK, WORDS, VOCABULARY, _german_stem("vocab"), HASHED)
ORACLE["hashed_tf"] = _with(*_STEMMED) + "SELECT doc_id, f AS bucket, x AS tf FROM hashed"
ORACLE["fold_statistics"] = _with(*_STEMMED, TRAINED, FREQUENCIES) + """SELECT side, f AS feature, df,
    round(1e-9 + ln((n + 1) / (df + 1)), 6) + 0.0 AS idf FROM freq JOIN side_size USING (side)"""
for _task, _suffix in (("relevance", ""), ("sentiment", "_sentiment")):
    _ranking = _with(*_STEMMED, BINS, TRAINED, FREQUENCIES, _side_chi2(_task))
    ORACLE[f"chi2_select{_suffix}"] = _ranking + f"SELECT * FROM ordered WHERE rank <= {TOP_FEATURES}"
    ORACLE[f"chi2_all_features{_suffix}"] = _ranking + "SELECT * FROM ordered"
    ORACLE[f"dense_among_best{_suffix}"] = _ranking + f"""SELECT count(feature) AS n_selected,
        coalesce(string_agg(CAST(feature - {TF_WIDTH} + 1 AS VARCHAR), ' ' ORDER BY feature), '') AS selected
        FROM ordered WHERE side = -1 AND dense AND rank <= {TOP_FEATURES}"""
