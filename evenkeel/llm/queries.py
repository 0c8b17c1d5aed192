"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, neardup, packing, pii, quality, repeats, secrets, store, token_files, warc

CAPACITY, PACK_END, FILE_END = 2048, 0, 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: quality.digest(table(spark, sf_dir, "documents")), "op1_kneser_ney_quality")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "op2_winnowing")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: packing.pack(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY, PACK_END), "op3_best_fit_packing")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: licenses.digest(table(spark, sf_dir, "documents")), "op4_license_scan")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary(), FILE_END), "op5_token_files")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: repeats.remove(table(spark, sf_dir, "documents")), "op6_repeats")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: pii.digest(table(spark, sf_dir, "documents")), "op7_pii")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: secrets.digest(table(spark, sf_dir, "documents")), "op8_secrets")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: neardup.clusters(table(spark, sf_dir, "documents")), "op9_minhash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.settled(lambda: warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "op10_warc")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kneser_ney_quality, op2_winnowing, op3_best_fit_packing, op4_license_scan, op5_token_files, op6_repeats, op7_pii, op8_secrets, op9_minhash, op10_warc)
}



def _secrets_sql() -> str:
    """Each rule's matches with their places: what is between them and they themselves, added up."""
    found = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(f"""
            SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, {str(rule.base).lower()} AS base, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS what, unnest(y) AS held, unnest(g[1:len(x)]) AS gap
            FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS x, regexp_extract_all(text, '{pattern}', {rule.group}) AS y, regexp_split_to_array(text, '{pattern}') AS g FROM t WHERE regexp_matches(text, '{pattern}'))""")
    return f"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({" UNION ALL ".join(found)}),
        p AS (SELECT *, CAST(sum(length(gap) + length(what)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) AS stop FROM m),
        s AS (SELECT rid, rank, kind, base, stop - length(what) AS start, stop FROM p WHERE length(held) >= least),
        a AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                     string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE base) AS own, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (rid)
    """


ORACLE_SQL: dict[str, str] = {
    "op6_repeats": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
        w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM t WHERE n >= 100)),
        m AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM m),
        s AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY doc_id, run),
        g AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS z FROM s UNION ALL SELECT t.doc_id, coalesce(max(high), 0), any_value(n) FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id),
        k AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z) AS kept FROM g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id),
        c AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
        SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN k ON k.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
    """,
    "op8_secrets": _secrets_sql(),
    "op9_minhash": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.id = w.doc_id
    """,
    "op2_winnowing": """
        WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
        i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
              FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
        d AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        h AS (SELECT doc_id, s, d.n, item_id FROM d JOIN i ON d.win = i.win AND d.n = i.n),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d JOIN f USING (h)
    """,
}
