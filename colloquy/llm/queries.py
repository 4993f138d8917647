"""The registered queries of the operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filters, licenses, mixing, neardup, nearest, packing, pages, pii, quality, sharding, substrings, vectorcodes, wordpieces
from .common import table


def tokenizer_path() -> str:
    """The public byte-level tokenizer of 50k tokens, from the installed vocabulary files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_key(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_page_text, op3_quality_rules, op4_mixing, op5_near_duplicates, op6_repeated_passages, op7_token_counts, op8_sharding, op9_nearest, op10_packing, op11_filter_audit, op12_vector_codes, op13_license_scan)}
#: Windows of 20 words, each word covered by one that starts earlier elsewhere.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS s FROM g),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM x),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM r WHERE n > 1), range(0, 20) t(k)),
k AS (SELECT d.doc_id, u.p, u.t FROM d, (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) u
      WHERE u.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.p = u.p)),
j AS (SELECT doc_id, count(*) AS kept, string_agg(t, ' ' ORDER BY p) AS s FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""

#: All pairs that share a shingle, then reachability.
OP5_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(list_aggregate(w[i:i + 4], 'string_agg', ' ')) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, o) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.o),
m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.o, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.o, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Masks by text, copies by the least id of a text, every order spelled out.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, least IS NOT NULL)} AS f
      FROM w LEFT JOIN l USING (doc_id)),
k AS (SELECT part, good, toxic, f, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c)
      JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, step, filter_order[step] AS c FROM o, range(1, 6) r(step)),
u AS (SELECT k.*, [v.c for v in [{'c': 'A', 'f': f.A}, {'c': 'B', 'f': f.B}, {'c': 'C', 'f': f.C}, {'c': 'D', 'f': f.D}, {'c': 'E', 'f': f.E}] if v.f] AS failed FROM k),
y AS (SELECT part, filter_order, step, s.c, n, good, toxic, failed, list_contains(failed, s.c) AS here,
             len([q for q in failed if strpos(filter_order, q) < step]) > 0 AS early FROM u, s),
r AS (SELECT part, filter_order, step::INT AS step, c,
             sum(CASE WHEN NOT here AND NOT early THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN here AND NOT early THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN here AND early THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here AND len(failed) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN here AND NOT early AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN here AND NOT early AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM y GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""

ORACLES: dict[str, str] = {"op5_near_duplicates": OP5_SQL, "op6_repeated_passages": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_vector_codes": vectorcodes.sql()}
