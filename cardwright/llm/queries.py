"""The driver's queries of the thirteen operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import conversation_digests
from .collocations import collocations
from .common import table, work_path
from .decontamination import find_contamination
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle, restore_text
from .html_text import extract_text
from .language_id import fit_language_model, held_out, identify
from .line_dedup import line_dedup
from .minhash import minhash_components
from .ngram_join import ngram_components
from .source_mix import mix_sources
from .token_output import read_token_file, write_token_file
from .url_filter import filter_urls


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: The conversation that the contract adds: control strings inside the texts.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return conversation_digests(turns.unionByName(probe))


#: Target weights of the production mix: out of 36, with 1 for all other sources.
MIX_WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2} | {f"src{k}": 1 for k in range(5, 20)}


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


#: The contract's rules.
URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed="7", percent=100, spm_percent=50)
    back = restore_text(made.withColumn("output_sha256", F.sha2("output", 256)))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), words=5, num=85, den=100)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


#: Components of documents by exact Jaccard similarity of their shingles.
_COMPONENTS = r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < %(words)d THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - %(words)d + 2), lambda i: array_to_string(w[i:i + %(words)d - 1], ' ')))
                   END AS s FROM w
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= %(num)d * (any_value(a.n) + any_value(b.n) - count(*))
        ), both_ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (
            SELECT a AS doc_id, a AS other FROM both_ways
            UNION SELECT r.doc_id, l.b FROM r JOIN both_ways l ON l.a = r.other
        ), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id%(more)s
        FROM s LEFT JOIN c ON s.doc_id = c.doc_id
    """

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    """,
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), w AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                   string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END,
                              '' ORDER BY turn, role, text) AS codes,
                   sum(length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
                       + length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))) AS chars
            FROM t GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
               regexp_full_match(codes, 's?(ua)+') AS valid
        FROM w
    """,
    "op3_source_mix": """
        WITH RECURSIVE k AS (
            SELECT doc_id, source, CASE WHEN source IN (%(names)s) THEN source ELSE '*' END AS g, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
        ), d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, doc_id) - 1 AS rank FROM k),
        w AS (SELECT * FROM (VALUES %(weights)s) AS t(g, a)),
        c AS (SELECT g, a, count(*) AS n, CAST(ceil(count(*) / 8.0) AS BIGINT) AS blocks FROM d JOIN w USING (g) GROUP BY g, a),
        s0 AS (SELECT list(g ORDER BY g) AS gs, list(a ORDER BY g) AS weights, list(blocks ORDER BY g) AS total FROM c),
        e AS (
            -- One slot a step: of the released blocks the one that is due first.
            SELECT 0 AS slot, 0 AS now, 0 AS base, 0 AS phase, gs, weights, total,
                   list_transform(gs, lambda x: 0) AS done, list_transform(gs, lambda x: 0) AS before,
                   CAST(NULL AS VARCHAR) AS g, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS release, CAST(0 AS BIGINT) AS due
            FROM s0
            UNION ALL
            SELECT slot + 1, CASE WHEN ends THEN 0 ELSE now + 1 END, CASE WHEN ends THEN slot + 1 ELSE base END,
                   CASE WHEN ends THEN phase + 1 ELSE phase END, gs, weights, total, newly,
                   CASE WHEN ends THEN newly ELSE before END, gs[pick], done[pick], release, due
            FROM (
                SELECT *, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END) AS newly,
                       done[pick] + 1 = total[pick] AS ends,
                       base + ((done[pick] - before[pick]) * period) // weights[pick] AS release,
                       base + ((done[pick] - before[pick] + 1) * period + weights[pick] - 1) // weights[pick] AS due
                FROM (
                    SELECT *, list_position(keys, list_min(keys)) AS pick FROM (
                        SELECT *, list_transform(gs, lambda x, i: CASE
                                   WHEN done[i] < total[i] AND ((done[i] - before[i]) * period) // weights[i] <= now
                                   THEN (((done[i] - before[i] + 1) * period + weights[i] - 1) // weights[i]) * 1000 + i END) AS keys
                        FROM (SELECT * EXCLUDE (g, block, release, due), list_sum(list_transform(weights, lambda x, i: CASE WHEN done[i] < total[i] THEN x ELSE 0 END))::BIGINT AS period
                              FROM e WHERE EXISTS (SELECT 1 FROM c) AND slot < (SELECT sum(blocks) FROM c))
                    )
                )
            )
        ), b AS (
            SELECT g, block, slot - 1 AS slot, lag(phase, 1, 0) OVER (ORDER BY slot) AS phase, release, due FROM e WHERE g IS NOT NULL
        ), q AS (SELECT d.*, b.* EXCLUDE (g), count(*) OVER (ORDER BY b.slot, d.rank ROWS UNBOUNDED PRECEDING) - 1 AS position
                 FROM d JOIN b ON d.g = b.g AND d.rank // 8 = b.block)
        SELECT doc_id, source, g AS mix_group, CAST(block AS BIGINT) AS mix_block, CAST(phase AS INTEGER) AS mix_phase,
               CAST(release AS BIGINT) AS mix_release, CAST(due AS BIGINT) AS mix_deadline, CAST(slot AS BIGINT) AS mix_slot,
               CAST(position AS BIGINT) AS mix_position
        FROM q
    """ % {
        "names": ", ".join(f"'{s}'" for s in MIX_WEIGHTS),
        "weights": ", ".join(f"('{s}', {a})" for s, a in [("*", 1), *MIX_WEIGHTS.items()]),
    },
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), t AS (
            SELECT *, list_distinct(list_concat(
                list_transform(range(1, len(l)), lambda i: 'h:' || array_to_string(l[i:], '.')),
                list_transform(l, lambda x: 'l:' || x),
                list_transform(list_filter(regexp_split_to_array(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'),
                                           lambda x: x <> ''), lambda x: 'p:' || x))) AS own
            FROM (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS l FROM p)
        ), j AS (
            SELECT doc_id, max(toxic = 1 OR quality = 0) AS bad FROM labels GROUP BY doc_id
        ), x AS (
            SELECT page_id, own, bad FROM t JOIN j ON page_id = doc_id WHERE bad IS NOT NULL AND (len(own) > 0 OR bad)
        ), n AS (SELECT count(*) AS n, avg(bad::INT) AS base, greatest(20, ceil(0.002 * count(*))) AS least FROM x),
        one AS (SELECT row_number() OVER () AS r, bad, own FROM x),
        k AS (SELECT r, bad, unnest(own) AS tok FROM one),
        c AS (
            SELECT [tok] AS tokens, bad FROM k
            UNION ALL SELECT [a.tok, b.tok], a.bad FROM k a JOIN k b ON a.r = b.r AND a.tok < b.tok
            UNION ALL SELECT [a.tok, b.tok, d.tok], a.bad FROM k a JOIN k b ON a.r = b.r AND a.tok < b.tok JOIN k d ON b.r = d.r AND b.tok < d.tok
        ), m AS (
            SELECT tokens, count(*) AS hits, count(*) FILTER (bad) AS bads, count(*) FILTER (bad) / count(*) AS conf FROM c GROUP BY tokens
        ), f AS (
            SELECT tokens, conf FROM m, n WHERE bads >= least AND conf >= 0.6 AND conf / base >= 1.5
        ), g AS (
            SELECT * FROM f a WHERE NOT EXISTS (
                SELECT 1 FROM f b WHERE len(b.tokens) < len(a.tokens) AND len(list_intersect(b.tokens, a.tokens)) = len(b.tokens) AND b.conf >= a.conf)
        ), h AS (
            SELECT page_id, arg_min(array_to_string(tokens, ' '), (-conf, array_to_string(tokens, ' '))) AS mined_rule
            FROM t JOIN g ON len(list_intersect(tokens, own)) = len(tokens) GROUP BY page_id
        ), r AS (
            SELECT p.*, mined_rule, CASE
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM p LEFT JOIN h ON p.page_id = h.page_id
        )
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, mined_rule
        FROM r
    """,
    "op8_ngram_join": _COMPONENTS % {"words": 3, "num": 90, "more": ""},
    "op12_minhash": _COMPONENTS % {"words": 5, "num": 85, "more": ", coalesce(c.component_id, s.doc_id) = s.doc_id AS kept"},
    "op11_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                   sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
        ), c AS (
            SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                   CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
        ), f AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
        ), p AS (
            SELECT *, array_to_string(u[1:low], '') AS a, array_to_string(u[low + 1:high], '') AS b, array_to_string(u[high + 1:], '') AS c FROM f
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                      ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p
    """,
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        o AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)
        ), f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM o GROUP BY lang, k, phrase),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
        held AS (
            SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3)
            GROUP BY lang, phrase
        ), x AS (
            SELECT c.* FROM c LEFT JOIN held ON c.lang = held.lang AND c.phrase = held.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
        ), cuts AS (
            SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
            FROM x, (VALUES (1), (2)) AS s(cut) WHERE cut < k
        ), s AS (
            SELECT cuts.*, l.a AS l, r.a AS r, (1000000 * cuts.a * cuts.a) // (l.a * r.a) AS score
            FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.first JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rest
        ), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op10_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        w AS (
            SELECT doc_id, pos, [l[pos], l[pos + 1], l[pos + 2]] AS k
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS pos FROM d WHERE len(l) >= 3)
        ), later AS (
            SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1
        ), c AS (
            SELECT doc_id, list(DISTINCT p) AS covered
            FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM later) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(covered), 0) AS BIGINT) AS n_removed,
               CASE WHEN covered IS NULL THEN text
                    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(covered, i)), lambda i: l[i]), chr(10)), '') END AS text
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_chat_format, op3_source_mix, op4_decontamination, op5_html_text, op6_language_id,
        op7_url_filter, op8_ngram_join, op9_token_output, op10_line_dedup, op11_fill_in_middle, op12_minhash, op13_collocations,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
