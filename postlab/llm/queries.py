"""The queries of the language model operators and the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlab.llm import (
    bpe, chunk_bpe, exact_dedup, hamming, jaccard_join, langid, merkle, mixing, substring_dedup, toxicity, url_filter, warc,
    whitening,
)
from postlab.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLE: dict[str, str] = {}


def _query(function: Query) -> Query:
    LLM_QUERIES[function.__name__] = function
    return function


# ---- fixed values: settings of the queries ----------------------------------------------------------------
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
TOP_K = 10
MIX = {"weights": (1, 2, 3), "most": 3, "block": 64, "shard_slots": 4096, "seed": 1}
# ---- end of fixed values ----------------------------------------------------------------------------------


# ---- 1: WARC ------------------------------------------------------------------------------------------------

@_query
def op1_warc(spark, sf):
    """All pages written as WARC records in seekable bundles, and what the records say when read back."""
    pages = read_table(spark, sf, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.read_records(*warc.write_archives(pages), with_payload=False)
    return records.select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


LLM_ORACLE["op1_warc"] = """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
    ), digits AS (
        SELECT page_id, html, hex, min(page_id) OVER (PARTITION BY html) AS first FROM hashed
    )
    SELECT page_id, strlen(html) AS payload_bytes,
           array_to_string([substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (('0x' || substr(hex, 5 * (d // 4) + 1, 5))::BIGINT >> (15 - 5 * (d % 4))) % 32 + 1, 1)
               FOR d IN range(32)], '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM digits
"""


# ---- 2: byte-level BPE ------------------------------------------------------------------------------------

@_query
def op2_bpe(spark, sf):
    """Token ids of every whole text, and the bytes decoded from them, as digests."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    tokens = bpe.encode(read_table(spark, sf, "documents"), ranks, pattern)
    decoded = bpe.decode(tokens.withColumn("ids_sha256", F.sha2("ids", 256)), ranks, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- 3: exact duplicates ---------------------------------------------------------------------------------

@_query
def op3_exact_dedup(spark, sf):
    """Copies of whole texts; the largest doc_id of each group stays."""
    return exact_dedup.merge_runs(read_table(spark, sf, "documents"), keep="largest")


LLM_ORACLE["op3_exact_dedup"] = """
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
           count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
"""


# ---- 4: Jaccard join -----------------------------------------------------------------------------------------

@_query
def op4_jaccard_join(spark, sf):
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 85 % or more."""
    return jaccard_join.similar_documents(read_table(spark, sf, "documents"), n=4, percent=85)


# ---- 5: repeated passages --------------------------------------------------------------------------------------

@_query
def op5_substring_dedup(spark, sf):
    """Every document without the words of passages of 20 words that occur earlier."""
    found = substring_dedup.remove_repeats(read_table(spark, sf, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# ---- 6: url filters --------------------------------------------------------------------------------------

@_query
def op6_url_filter(spark, sf):
    """Host, path, deciding rule and verdict of every page's url."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "judged.*")


LLM_ORACLE["op6_url_filter"] = r"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), split AS (
        SELECT page_id,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut
    ), judged AS (
        SELECT page_id, host, path, '.' || host AS dotted,
               CASE WHEN dotted LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                    WHEN dotted LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                    WHEN dotted LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
                    WHEN dotted LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                    WHEN dotted LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule
        FROM split
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
"""


# ---- 7: mixing sources -------------------------------------------------------------------------------------

@_query
def op7_mixing(spark, sf):
    """Words that a mix of all sources takes from every document."""
    mix = mixing.Mix(mixing.word_sizes(read_table(spark, sf, "documents")), **MIX)
    return mix.per_row().select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _mixed_sql(x: str, salt: str) -> str:
    """``mixing.mixed`` as SQL: its steps nested in one-row subqueries."""
    p = mixing.PRIME
    y = f"(SELECT ((({x}) + ({salt}) * 1000003) % {p} + {p}) % {p} AS y)"
    for k in mixing.FACTORS:
        y = f"(SELECT (y * y + {k} * y + 11) % {p} AS y FROM {y})"
    return f"(SELECT y FROM {y})"


LLM_ORACLE["op7_mixing"] = f"""
    WITH RECURSIVE sizes AS (
        SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
        FROM documents
    ), totals AS (
        SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
    ), numbered AS (
        SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM totals
    ), weighed AS (
        SELECT *, (src - 1) % 3 + 1 AS weight, source_size * {MIX['most']} AS top FROM numbered
    ), shares AS (
        SELECT *, ((SELECT sum(source_size) FROM weighed)
                   - coalesce(sum(top) OVER (ORDER BY top / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  )::DOUBLE / sum(weight) OVER (ORDER BY top / weight, src
                                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
        FROM weighed
    ), sources AS (
        SELECT src, source, source_size, target,
               CAST(ceil(source_size / {MIX['block']}) AS BIGINT) AS n_blocks,
               CAST(CASE WHEN source_size > 0
                    THEN round(ceil(source_size / {MIX['block']}) * target / source_size) ELSE 0 END AS BIGINT) AS n_slots
        FROM (SELECT *, least(top::DOUBLE, weight * (
                  SELECT arg_min(share, top / weight) FROM shares WHERE share * weight <= top)) AS target FROM shares)
    ), groups AS (
        SELECT greatest(1, CAST(ceil(count(*) / {mixing.GROUP_ROWS}) AS BIGINT)) AS n_groups,
               greatest(1, CAST(ceil(sum(size) / ({MIX['block']} * {MIX['shard_slots']})) AS BIGINT)) AS n_shards
        FROM sizes
    ), placed AS (
        SELECT s.src, d.doc_id, d.size,
               coalesce(sum(d.size) OVER (
                   PARTITION BY s.src ORDER BY {_mixed_sql('d.doc_id', str(MIX['seed'] + 3))} % n_groups, d.doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
        FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source, groups
        WHERE d.size > 0
    ), pieces AS (
        SELECT src, doc_id, block, least(pos + size, (block + 1) * {MIX['block']}) - greatest(pos, block * {MIX['block']}) AS n
        FROM (SELECT *, unnest(generate_series(pos // {MIX['block']}, (pos + size - 1) // {MIX['block']})) AS block FROM placed)
    ), thrown AS (
        SELECT src, n_blocks, {_mixed_sql('j', f"(src * 7 + {MIX['seed']})")} % n_shards AS shard, j
        FROM (SELECT src, n_blocks, unnest(generate_series(0, n_slots - 1)) AS j FROM sources WHERE n_slots > 0), groups
    ), slots AS (
        SELECT src, n_blocks, row_number() OVER (PARTITION BY src ORDER BY shard, j) - 1 AS j FROM thrown
    ), rounds AS (
        SELECT src, turn, n_blocks, r, {_mixed_sql('r', 'salt')} AS number, {_mixed_sql(f'r + {mixing.ROUNDS}', 'salt')} AS other
        FROM (SELECT src, turn, n_blocks, src * 1009 + turn * 31 + {MIX['seed']} AS salt, unnest(range({mixing.ROUNDS})) AS r
              FROM (SELECT *, unnest(range({MIX['most']})) AS turn FROM sources WHERE n_blocks > 0))
    ), turned AS (
        SELECT src, j % n_blocks AS pos, j // n_blocks AS turn, 0::BIGINT AS r FROM slots
        UNION ALL
        SELECT src, CASE WHEN spread * spread % {mixing.PRIME} % 2 = 1 THEN mirror ELSE pos END, turn, r + 1
        FROM (SELECT *, (greatest(pos, mirror) % {mixing.PRIME} * {mixing.FACTORS[0]} + number) % {mixing.PRIME} AS spread
              FROM (SELECT t.*, number, ((number * {mixing.PRIME} + other) % n_blocks - pos + n_blocks) % n_blocks AS mirror
                    FROM turned t JOIN rounds k ON k.src = t.src AND k.turn = t.turn AND k.r = t.r))
    ), uses AS (
        SELECT src, pos AS block, count(*) AS times FROM turned WHERE r = {mixing.ROUNDS} GROUP BY ALL
    ), sums AS (
        SELECT doc_id, sum(n * times)::BIGINT AS taken FROM pieces JOIN uses USING (src, block) GROUP BY doc_id
    )
    SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken
    FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN sums t ON t.doc_id = d.doc_id
"""


# ---- 8: toxicity -------------------------------------------------------------------------------------------

def _remainder(parts: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@_query
def op8_toxicity(spark, sf):
    """Toxicity of every text; rows of remainder 0 are held out of the fit."""
    docs, held = read_table(spark, sf, "documents").select("doc_id", "text"), _remainder(5) == 0
    model = toxicity.fit(docs.where(~held), read_table(spark, sf, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


# ---- 9: language ---------------------------------------------------------------------------------------------

@_query
def op9_language(spark, sf):
    """Language of every text; rows of remainder 2 are held out of the fit."""
    docs, held = read_table(spark, sf, "documents").select("doc_id", "text", "lang"), _remainder(4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


# ---- 10: nearest binary codes ----------------------------------------------------------------------------------

@_query
def op10_hamming_topk(spark, sf):
    """The nearest sign codes of every embedding whose id is divisible by 50."""
    vectors = read_table(spark, sf, "embeddings")
    found = hamming.top_k(vectors, F.col("vec_id") % 50 == 0, TOP_K)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


LLM_ORACLE["op10_hamming_topk"] = f"""
    WITH codes AS (
        SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END
                                 FOR i IN range(1, 65)])::UBIGINT AS code
        FROM embeddings
    ), ranked AS (
        SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INTEGER AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id)::INTEGER AS rank
        FROM codes q, codes c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {TOP_K}
"""


# ---- 11: Merkle manifest -----------------------------------------------------------------------------------------

@_query
def op11_merkle(spark, sf):
    """A leaf and a proof for every document, and whether the table as it was tampered with still folds to the root."""
    docs = read_table(spark, sf, "documents")
    tampered = F.when(_remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = merkle.hashed(*[merkle.field(tampered if c == "text" else F.col(c)) for c in LEAF_COLUMNS])
    manifest = merkle.build(docs, LEAF_COLUMNS, carry={"tampered": changed})
    payload = ["leaf_id", F.col("digest").alias("leaf"), "tampered"]
    proofs = merkle.prove(manifest, manifest.leaves, payload)
    return proofs.select(
        F.col("leaf_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.col("path"), F.col("tampered")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    fields = [text if c == "text" else f"{c}::VARCHAR" for c in LEAF_COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _crc_sql(data: str) -> str:
    """CRC-32 of a decimal number: bit by bit over the bits of its characters, highest power first."""
    bits = f"flatten([[(ord({data}[i + 1]) >> b) & 1 FOR b IN range(8)] FOR i IN range(strlen({data}))])"
    return (f"xor(list_reduce({bits}, lambda r, bit: xor(r >> 1, CASE WHEN xor(r & 1, bit) = 1 THEN 3988292384 ELSE 0 END),"
            " 4294967295::BIGINT), 4294967295)")


LLM_ORACLE["op11_merkle"] = f"""
    WITH RECURSIVE marked AS (
        SELECT *, {_crc_sql('(doc_id::VARCHAR)')} % 2 = 0 AS even FROM documents
    ), leaves AS (
        SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
               {_leaf_sql("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")} AS tampered
        FROM marked
    ), ranked AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS rank
        FROM leaves
    ), nodes AS (
        SELECT tree, 0 AS level, rank, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM ranked
        UNION ALL
        SELECT tree, level + 1, parent, digest, count(*) OVER (PARTITION BY tree) FROM (
            SELECT tree, level, rank // 3 AS parent, sha256(string_agg(digest, '' ORDER BY rank)) AS digest
            FROM nodes WHERE width > 1 GROUP BY ALL)
    ), tops AS (
        SELECT tree, level AS height, digest AS subroot FROM nodes WHERE width = 1
    ), joints AS (
        SELECT 0 AS level, tree - 1 AS rank, subroot AS digest, count(*) OVER () AS width FROM tops
        UNION ALL
        SELECT level + 1, parent, digest, count(*) OVER () FROM (
            SELECT level, rank // 3 AS parent, sha256(string_agg(digest, '' ORDER BY rank)) AS digest
            FROM joints WHERE width > 1 GROUP BY ALL)
    ), whole AS (
        SELECT tree, level, rank, digest FROM nodes WHERE width > 1
        UNION ALL
        SELECT t.tree, t.height + j.level, j.rank, j.digest FROM tops t, joints j WHERE j.width > 1
    ), steps AS (
        SELECT tree, level, rank,
               coalesce(string_agg(other, '' ORDER BY o) FILTER (WHERE o < rank), '') AS before,
               coalesce(string_agg(other, '' ORDER BY o) FILTER (WHERE o > rank), '') AS after
        FROM (SELECT a.tree, a.level, a.rank, b.rank AS o, b.digest AS other
              FROM whole a JOIN whole b ON a.tree = b.tree AND a.level = b.level AND a.rank // 3 = b.rank // 3)
        GROUP BY ALL
    ), folds AS (
        SELECT doc_id, r.tree, rank, 0 AS level, leaf, tampered AS node, '' AS seen, height FROM ranked r JOIN tops USING (tree)
        UNION ALL
        SELECT doc_id, f.tree, CASE WHEN f.level + 1 = height THEN f.tree - 1 ELSE f.rank // 3 END, f.level + 1, leaf,
               sha256(before || node || after), seen || before || after, height
        FROM folds f JOIN steps s ON s.tree = f.tree AND s.level = f.level AND s.rank = f.rank
    )
    SELECT doc_id, leaf, subroot, digest AS root, sha256(seen) AS proof_sha256, node AS folded_root, node = digest AS verified
    FROM folds f JOIN tops USING (tree) JOIN joints j ON j.width = 1
    WHERE f.level = f.height + j.level
"""


# ---- 12: chunk reuse -------------------------------------------------------------------------------------------

@_query
def op12_chunk_bpe(spark, sf):
    """Token ids of every whole text, with shared chunks encoded once, and the text decoded from them, as digests."""
    path = public_tokenizers.path(TOKENIZER)
    tokens = chunk_bpe.encode(read_table(spark, sf, "documents"), path)
    decoded = chunk_bpe.decode(tokens.withColumn("ids_sha256", F.sha2("ids", 256)), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# ---- 13: whitening ---------------------------------------------------------------------------------------------

@_query
def op13_whitening(spark, sf):
    """The 16 strongest whitened components of every vector, fitted on distinct vectors."""
    return whitening.whitened_rows(read_table(spark, sf, "embeddings")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
