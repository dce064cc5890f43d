"""The queries of this subpackage and the DuckDB SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from calzada.llm import (
    bpe, exact_dedup, language, lexical, lines, mixing, negatives, quality, sentences, sharding, simhash, token_counts, topk)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_top_products(spark, sf_dir):
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark, sf_dir):
    return sentences.without_repeats(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return lines.repeated_lines(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op12_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_top_products": op1_top_products,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}


def _apportion(rows: str, group: str, item: str) -> str:
    """SQL for the seats of ``rows`` (group, item, vote, seats, cap): highest quotients, as recursion-free ranking."""
    return f"""
        (SELECT {group}, {item}, max(sure) + count(*) FILTER (seat < cap AND place <= seats - sure_all) AS blocks FROM (
           SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN seat < cap THEN vote / (2 * seat + 1) END DESC NULLS LAST, {item} NULLS LAST, seat) AS place
           FROM (SELECT *, unnest(range(sure, near + reach + 1)) AS seat
                 FROM (SELECT *, sum(sure) OVER (PARTITION BY {group}) AS sure_all
                       FROM (SELECT *, least(greatest(0, near - reach), cap) AS sure
                             FROM (SELECT *, floor(share * seats + 0.5)::BIGINT AS near, ceil(share * n)::BIGINT + 1 AS reach
                                   FROM (SELECT *, coalesce(vote / nullif(sum(vote) OVER (PARTITION BY {group}), 0), 0) AS share,
                                                count(*) OVER (PARTITION BY {group}) AS n FROM {rows})))))) GROUP BY ALL)"""


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '7', {', '.join(f"coalesce({p}::VARCHAR, 'null')" for p in parts)})), 1, 15))::BIGINT"


ORACLES = {
    "op1_top_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, {_draw('doc_id', "md5(coalesce(text, ''))")} AS draw FROM documents),
        c AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
                     (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, (3 * sum(size))::DOUBLE AS cap FROM d GROUP BY source),
        l AS (SELECT *, row_number() OVER o AS place,
                     (sum(source_size) OVER () - coalesce(sum(cap) OVER e, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER e, 0)) AS level
              FROM c WINDOW o AS (ORDER BY cap / weight, source NULLS LAST),
                            e AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT *, coalesce(least(cap, weight * (SELECT arg_min(level, place) FROM l WHERE cap > level * weight)), cap) AS target FROM l),
        q AS (SELECT * FROM {_apportion("(SELECT 0 AS g, source, target AS vote, (sum(source_size) OVER ())::BIGINT AS seats, 3 * source_size AS cap FROM t)", "g", "source")}),
        r AS (SELECT d.*, source_size, target, blocks AS seats, draw % ceil(n_docs / 2000)::BIGINT AS shard
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        s AS (SELECT * FROM {_apportion("(SELECT source, shard, sum(size)::DOUBLE AS vote, any_value(seats) AS seats, 3 * sum(size)::BIGINT AS cap FROM r GROUP BY source, shard)", "source", "shard")}),
        p AS (SELECT r.*, blocks, sum(size) OVER (PARTITION BY r.source, r.shard)::BIGINT AS words,
                     sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
              FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source AND r.shard = s.shard),
        w AS (SELECT *, blocks AS wanted, 16 * ({_draw('source', 'shard')} % greatest(1, words // 16)) AS a FROM p),
        z AS (SELECT *, coalesce(wanted // nullif(words, 0), 0) AS whole FROM w),
        y AS (SELECT *, a + wanted - whole * words AS b FROM z)
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(stop, b) - greatest(stop - size, a))
               + greatest(0, least(stop + words, b) - greatest(stop - size + words, a)))::BIGINT AS taken FROM y""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g""",
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (
                 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                 FROM embeddings
                 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS MATERIALIZED (
                 SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
                 FROM v a JOIN v b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_sharding": """
        WITH RECURSIVE
             d AS (SELECT doc_id, coalesce(text, '') AS text, substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS draw FROM documents),
             chain AS (SELECT draw, n, ('0x' || draw)::UBIGINT AS state, 0::BIGINT AS shard, 0::BIGINT AS ahead
                       FROM (SELECT DISTINCT draw FROM d), (VALUES (16), (17)) s(n)
                       UNION ALL
                       SELECT draw, n, state, ahead, floor((ahead + 1) * (2147483648::DOUBLE / ((state >> 33) + 1)::DOUBLE))::BIGINT
                       FROM (SELECT draw, n, ahead, ((state::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616)::UBIGINT AS state
                             FROM chain WHERE ahead < n)),
             shards AS (SELECT draw, max(shard) FILTER (n = 16)::INT AS shard, max(shard) FILTER (n = 17)::INT AS grown_shard
                        FROM chain WHERE ahead >= n GROUP BY draw),
             steps AS (SELECT list(v ORDER BY i) AS steps
                       FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
                             FROM range(256) r(i))),
             c AS (SELECT doc_id, draw, strlen(text) + 1 AS size, xor(4294967295, list_reduce(
                          list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
                          lambda a, x: xor(a >> 8, steps[xor(a & 255, x) + 1]), 4294967295)) AS text_crc32
                   FROM d, steps)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
               row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id NULLS LAST, size, text_crc32) - 1 AS slot
        FROM c JOIN shards USING (draw)""",
    "op13_lexical_search": rf"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
             d AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM t WHERE len(terms) > 0),
             f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM d GROUP BY ALL),
             a AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM t WHERE len(terms) > 0),
             w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term),
             i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             s AS (SELECT item_id, text, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
                   FROM i JOIN f USING (term) JOIN w USING (term), a GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
