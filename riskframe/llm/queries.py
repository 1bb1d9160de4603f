"""Registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, exact_dedup, html_extract, licenses, line_dedup, lm, packing, pii, quality, simhash, toxicity, vector_codes
from .common import ID, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """Text of a public vocabulary file (read on the driver, sent with the job)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@_query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select(ID, "fingerprint", "component_id")


@_query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), tokenizer_json()))


@_query(
    "op5_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_query("op6_quality_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(
    "op10_decontamination",
    r"""
    WITH docs AS (
      SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents),
    bench AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
    d AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
    b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM bench),
    b_at AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM b_at),
    d_at AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM grams) ON len(w) >= k),
    runs AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram FROM d_at),
    hits AS (SELECT rid, i, k, item_id FROM runs JOIN grams USING (k, gram)),
    words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
    items AS (
      SELECT rid, count(DISTINCT item_id) + max((item_id IS NULL)::BIGINT) AS n_items,
             sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
      FROM hits GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@_query("op2_lm_interpolation")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@_query("op4_toxicity_chain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op7_html_differencing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@_query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@_query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def _staged_share(count: str, total: str, terms: str) -> str:
    return f"(1 + 1000000000::HUGEINT * ({count} + 2) // ({total} + 2 * {terms}))"


@_query(
    "op11_source_divergence",
    rf"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents),
    t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
    v AS (SELECT lang, count(*) AS kept, sum(n_lang) AS in_lang FROM kept GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
    a AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang, v.kept, v.in_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT lang, source, term, n, {_staged_share('n', 'total', 'kept')} AS p, {_staged_share('n_lang', 'in_lang', 'kept')} AS q FROM a),
    pairs AS (
      SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    all_pairs AS (
      SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
      FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def _codebook_rounds() -> str:
    """CTEs b0, a0, b1, a1, b2, a2: codebooks and assignments, brute force."""
    steps = []
    for i in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"""d{i} AS (SELECT rid, p, e, sum((x - y) * (x - y)) AS d FROM pt JOIN b{i} USING (p, pos) GROUP BY rid, p, e),
            a{i} AS (SELECT rid, p, e, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1),
            m{i} AS (SELECT p, e, pos, sum(x) AS s, count(*) AS n FROM pt JOIN a{i} USING (rid, p) GROUP BY ALL),
            b{i + 1} AS (SELECT p, e, pos, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM b{i} LEFT JOIN m{i} USING (p, e, pos))"""
        )
    return ",\n".join(steps)


@_query(
    "op12_vector_codes",
    f"""
    WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS width
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cell AS (SELECT rid, v, width, unnest(range(len(v))) AS i FROM kept),
    pt AS (SELECT rid, (i // width)::INTEGER AS p, (i % width)::INTEGER AS pos, v[i + 1] AS x FROM cell),
    b0 AS (SELECT p, (rid - 1)::INTEGER AS e, pos, x AS y FROM pt WHERE rid <= 64),
    {_codebook_rounds()},
    books AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, pos)) AS s FROM b2),
    codes AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM kept JOIN codes USING (rid), books
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def _template_rows() -> str:
    """VALUES rows of the scan's templates: template, label, base, length, place, word, mandatory."""
    rows = []
    for i, t in enumerate([*licenses.BASE, *licenses.NOTICES]):
        rows += [f"({i}, '{t.label}', {t.base}, {len(t.words)}, {at}, '{word}', {at in t.must})" for at, word in enumerate(t.words)]
    return ", ".join(rows)


@_query(
    "op13_license_scan",
    rf"""
    WITH tmpl(template, label, base, len, place, word, must) AS (VALUES {_template_rows()}),
    docs AS (
      SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    spot AS (SELECT rid, w, unnest(range(len(w))) AS pos FROM docs),
    word AS (SELECT rid, pos, w[pos + 1] AS word FROM spot WHERE w[pos + 1] IN (SELECT word FROM tmpl)),
    held AS (SELECT word, count(DISTINCT rid) AS docs FROM word GROUP BY 1),
    ranked AS (SELECT tmpl.*, row_number() OVER (PARTITION BY template ORDER BY coalesce(docs, 0), place) AS n FROM tmpl LEFT JOIN held USING (word)),
    index AS (SELECT *, n <= (CASE WHEN base THEN 1 ELSE least({licenses.RAREST}, len) END) AS rare FROM ranked),
    start AS (
      SELECT rid, template, label, base, pos - place AS start, len, count(*) AS same, count_if(must) AS musts, count_if(rare) AS rares
      FROM word JOIN index USING (word) GROUP BY ALL),
    need AS (SELECT template, count_if(must) AS musts, ceil(count_if(rare) / 2) AS rares FROM index GROUP BY 1),
    hit AS (SELECT rid, label, base, start, same / len AS score FROM start s JOIN need n USING (template) WHERE s.musts = n.musts AND s.rares >= n.rares),
    found AS (
      SELECT rid, count_if(base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM hit GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM docs LEFT JOIN found USING (rid)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("places")
