"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, language_id, language_model, lexical_search, licenses, merkle, mixing, packing, quality_classifier, quality_rules, suffix_dedup, web_archive
from .common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_corpus(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_corpus(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archive_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_lm_scoring, op3_packing, op4_suffix_dedup, op5_language_id, op6_quality_rules, op7_quality_classifier, op8_license_scan,
        op9_jaccard_join, op10_mixing, op11_lexical_search, op12_merkle_manifest, op13_web_archive,
    )
}

_WS = "\\x20\\x09-\\x0D"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"
# crc32 of the decimal identifier, bit by bit
_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: ((ascii(c) >> i::INTEGER) & 1)::BIGINT))),
    lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
_RUN = "(i // pow(3, h)::BIGINT)"
_STEPS = f"array_to_string(nodes[{_RUN} - {_RUN} % 3 + 1:{_RUN}], '') AS b, array_to_string(nodes[{_RUN} + 2:{_RUN} - {_RUN} % 3 + 3], '') AS a"
_UP = "list_transform(range((len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1:3 * j + 3], '')))"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
    "op9_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        x AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gs FROM w),
        s AS (SELECT doc_id, md5(unnest(gs)) AS g FROM x),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN x p ON p.doc_id = a JOIN x q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.gs) + len(q.gs) - n)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
        SELECT x.doc_id, len(gs)::BIGINT AS n_shingles, min(root) AS component_id,
               CASE WHEN len(gs) = 0 THEN x.doc_id ELSE min(x.doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(gs), chr(10)))) END AS class_id
        FROM x JOIN r USING (doc_id) GROUP BY x.doc_id, gs""",
    "op11_lexical_search": f"""
        WITH t AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
        s AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, sum(len(ws))::BIGINT AS terms FROM t),
        c AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM t) GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        w AS (SELECT item_id, term, times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN d USING (term), s),
        x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
              FROM w JOIN c USING (term), s GROUP BY ALL),
        r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT * FROM r WHERE rank <= 20""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE k AS (SELECT doc_id, source, {_LEAF('text')} AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
            CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF('text')} END AS seen FROM documents),
        up(source, h, nodes) AS (SELECT source, 0, list(leaf ORDER BY doc_id) FROM k GROUP BY source
            UNION ALL SELECT source, h + 1, {_UP} FROM up WHERE len(nodes) > 1),
        subs AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM up WHERE len(nodes) = 1),
        top(h, nodes) AS (SELECT 0, list(subroot ORDER BY i) FROM subs UNION ALL SELECT h + 1, {_UP} FROM top WHERE len(nodes) > 1),
        steps AS (SELECT doc_id, h AS lvl, {_STEPS} FROM k JOIN up ON k.source IS NOT DISTINCT FROM up.source WHERE len(nodes) > 1
            UNION ALL SELECT doc_id, 1000 + h, b, a FROM k JOIN (SELECT source, h, {_STEPS} FROM subs, top WHERE len(nodes) > 1) x ON k.source IS NOT DISTINCT FROM x.source),
        nth AS (SELECT doc_id, b, a, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS n FROM steps),
        fold(doc_id, n, x) AS (SELECT doc_id, 0::BIGINT, seen FROM k UNION ALL SELECT fold.doc_id, nth.n, sha256(b || x || a) FROM fold JOIN nth ON nth.doc_id = fold.doc_id AND nth.n = fold.n + 1),
        proofs AS (SELECT doc_id, sha256(string_agg(b || a, '' ORDER BY n)) AS proof FROM nth GROUP BY doc_id)
        SELECT k.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256, x AS folded_root,
            x = (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS verified
        FROM k JOIN subs ON k.source IS NOT DISTINCT FROM subs.source LEFT JOIN proofs USING (doc_id)
        JOIN (SELECT doc_id, arg_max(x, n) AS x FROM fold GROUP BY doc_id) USING (doc_id)""",
    "op13_web_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, translate(array_to_string([to_base(('0x' || s[10 * i + 1:10 * i + 10])::BIGINT, 32, 8) for i in range(4)], ''),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g""",
    "op6_quality_rules": f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS ws FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) AS ls FROM w),
        u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL),
        r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) x(o) WHERE n > 1 GROUP BY doc_id),
        c AS (
            SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                   len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
                   length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
            FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
        SELECT *, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3
               AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5 AND n_stop_words / n_words >= 0.02
               AND n_upper / word_chars <= 0.5 AS kept
        FROM b""",
}
