"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardflow.llm.decontamination import find_leaks
from wardflow.llm.exact_dedup import exact_dedup
from wardflow.llm.filter_audit import audit_filters
from wardflow.llm.hard_negatives import hard_negatives
from wardflow.llm.html_text import extract_pages
from wardflow.llm.language_id import language_id
from wardflow.llm.licences import DICE, TEMPLATES, scan_licences
from wardflow.llm.packing import pack
from wardflow.llm.quality import quality_scores
from wardflow.llm.secrets import find_secrets, secret_digests
from wardflow.llm.simhash_dedup import simhash_dedup
from wardflow.llm.substring_dedup import remove_repeats
from wardflow.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@register("op5_simhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup(table(spark, folder, "documents"))


@register("op6_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
          FROM documents)
    WINDOW same AS (PARTITION BY normal)""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@register("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


@register("op8_html_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))


@register("op9_warc", """
    WITH base AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS hexed FROM pages),
    coded AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(hexed, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)), '')
        AS payload_digest FROM base),
    best AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response_id FROM coded)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> response_id THEN response_id END AS refers_to, url FROM best""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return warc_round_trip(table(spark, folder, "pages"))


OP10_SQL = """
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    sized AS (SELECT doc_id, hx, length(hx) // 2 AS n FROM docs),
    strings AS (SELECT doc_id, i, substr(hx, CAST(2 * i + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, hx, unnest(range(n - 99)) AS i FROM sized WHERE n >= 100)),
    again AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 100 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY ALL),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
    cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
            string_agg(substr(hx, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
           sha256(unhex(coalesce(head || substr(hx, CAST(2 * last + 1 AS BIGINT)), hx))) AS kept_sha256
    FROM sized LEFT JOIN cut USING (doc_id)"""


@register("op10_suffix_dedup", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def vocabulary() -> str:
    """The public byte-level vocabulary installed beside the tokenizer library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary())


def _values(rows: list[tuple[str, str]]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(rows))


OP1_SQL = f"""
    WITH templates(template, licence, wording) AS (VALUES {_values(TEMPLATES)}),
    pieces AS (SELECT doc_id, unnest(list_concat([text], CASE WHEN len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) > 1
                 THEN regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') ELSE [] END, string_split(text, chr(10)),
                 regexp_split_to_array(text, '[.!?]+[ \\t\\r\\n]+'))) AS unit
               FROM documents WHERE text <> ''),
    normal AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit FROM pieces),
    known AS (SELECT template, licence, string_split(trim(regexp_replace(lower(wording), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates),
    sides AS (SELECT template, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM known),
    units AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
              FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM normal) WHERE len(w) >= 2),
    scored AS (SELECT doc_id, unit, licence, 2 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM units, sides
               WHERE 2 * least(len(a), len(b)) >= {DICE} * (len(a) + len(b)) AND list_has_any(a, b))
    SELECT doc_id, licence, max(dice) AS dice, count(DISTINCT unit) AS n_units FROM (
        SELECT * FROM scored WHERE dice >= {DICE} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, licence) = 1) GROUP BY ALL"""


@register("op1_licence_scan", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


OP4_SQL = """
    WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
    shingled AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(greatest(len(w) - 4, 1)),
                   lambda p: {'p': p, 'h': array_to_string(w[p + 1:p + 5], ' ')})) AS x FROM split WHERE len(w) > 0),
    places AS (SELECT doc_id, n, x.p AS p, x.h AS h FROM shingled),
    parts AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
    items AS (SELECT item_id, m, h, count(*) AS wanted FROM (
                SELECT item_id, len(w) AS m, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p + 1:p + 5], ' '))) AS h
                FROM parts WHERE len(w) > 0) GROUP BY ALL),
    windows AS (SELECT DISTINCT doc_id, n, m, least(p, greatest(n - m, 0)) AS s, greatest(least(n, m) - 4, 1) AS span
                FROM places JOIN (SELECT DISTINCT m, h FROM items) USING (h)),
    counted AS (SELECT w.doc_id, w.m, w.s, w.span, p.h, count(*) AS found FROM windows w JOIN places p
                ON w.doc_id = p.doc_id AND p.p >= w.s AND p.p < w.s + w.span GROUP BY ALL),
    totals AS (SELECT item_id, sum(wanted) AS item_span FROM items GROUP BY ALL),
    common AS (SELECT doc_id, item_id, c.m, s, span, sum(least(found, wanted)) AS same FROM counted c JOIN items i ON c.m = i.m AND c.h = i.h GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, CAST(s AS BIGINT) AS start_word, CAST(m AS BIGINT) AS n_words,
               CAST(same AS DOUBLE) / CAST(span + item_span - same AS DOUBLE) AS similarity FROM common JOIN totals USING (item_id))
    SELECT doc_id, item_id, similarity, start_word, n_words FROM scored WHERE similarity >= 0.8
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1"""


@register("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP11_SQL = """
    WITH base AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
                  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
               FROM base a JOIN base b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER w <= 3"""


@register("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


@register("op12_secret_scan")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(find_secrets(table(spark, folder, "documents")))


OP13_SQL = """
    WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM base),
    judged AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
                + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
                + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
                + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INT) AS mask
              FROM split LEFT JOIN judged USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
               WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps AS (SELECT filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS l,
                list_sum(list_transform(range(1, step), lambda i: 1 << CAST(ord(substr(filter_order, CAST(i AS INT), 1)) - 65 AS BIGINT))) AS before
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    known AS (SELECT filter_order, step, l, CAST(coalesce(before, 0) AS BIGINT) AS before, 1 << CAST(ord(l) - 65 AS BIGINT) AS bit FROM steps),
    counted AS (SELECT part, filter_order, step, l,
                  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
                FROM cells, known GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
    FROM counted"""


@register("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))
