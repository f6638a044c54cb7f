"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm.common import fold_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.secrets import counted, scan, spelled

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, every = F.col("base_spans"), F.col("all_spans")
    return found.select(
        "doc_id", counted(base, "assign").alias("n_assign"), counted(base, "access").alias("n_access"), counted(base, "hex").alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(every).alias("spans"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with html is a labelled outcome of its host, bad if its text holds one of the stated words.

    A host is blocked if the lower 95 % bound of its bad share exceeds 1.5 times the overall share.
    """
    from tidewire.llm.reputation import page_outcomes, url_filter

    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, page_outcomes(pages))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.flac import digests, store

    return digests(store(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.periodic import digests, periodic_runs, planted

    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.audit import FILTERS, audit, masks

    masked = masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnsRenamed({"good": "good_lost", "toxic": "toxic_lost"})
    return audit(masked, FILTERS, rows="rows", losses=("good_lost", "toxic_lost"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_URL_FILTERS = r"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT page_id, max(regexp_matches(regexp_replace(lower(html), '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '(^|[^a-z])(adult|ads|bets|casino|pills|poker|porn|spam|viagra)([^a-z]|$)')::INT) AS bad FROM pages WHERE html IS NOT NULL GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
s AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h),
e AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$|^\[') AS whole, list_contains(['co.uk', 'org.uk', 'ac.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'co.nz', 'com.br', 'co.za', 'co.in', 'com.mx'], array_to_string(string_split(bare, '.')[-2:], '.')) AS pair FROM s),
d AS (SELECT host, n, bad, CASE WHEN whole THEN bare ELSE array_to_string(parts[CASE WHEN pair THEN -3 ELSE -2 END:], '.') END AS domain, CASE WHEN whole THEN bare ELSE array_to_string(parts[CASE WHEN pair THEN -2 ELSE -1 END:], '.') END AS suffix FROM e),
b AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean FROM h),
x1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS m FROM d, b GROUP BY 1),
w1 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 OR sum(pow(bad - n * m, 2) / n - m * (1 - m)) <= 0 THEN 200.0 ELSE least(200.0, greatest(2.0, sum(m * (1 - m) * (n - 1)) / sum(pow(bad - n * m, 2) / n - m * (1 - m)) - 1)) END AS w FROM x1 WHERE n > 0),
x2 AS (SELECT domain, sum(d.n) AS n, sum(d.bad) AS bad, any_value((x1.bad + w * m) / (x1.n + w)) AS m FROM d JOIN x1 USING (suffix), w1 GROUP BY domain, suffix),
w2 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 OR sum(pow(bad - n * m, 2) / n - m * (1 - m)) <= 0 THEN 200.0 ELSE least(200.0, greatest(2.0, sum(m * (1 - m) * (n - 1)) / sum(pow(bad - n * m, 2) / n - m * (1 - m)) - 1)) END AS w FROM x2 WHERE n > 0),
x3 AS (SELECT host, d.n, d.bad, (x2.bad + w * m) / (x2.n + w) AS m FROM d JOIN x2 USING (domain), w2),
w3 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 OR sum(pow(bad - n * m, 2) / n - m * (1 - m)) <= 0 THEN 200.0 ELSE least(200.0, greatest(2.0, sum(m * (1 - m) * (n - 1)) / sum(pow(bad - n * m, 2) / n - m * (1 - m)) - 1)) END AS w FROM x3 WHERE n > 0),
y AS (SELECT host, bad + w * m AS alpha, n - bad + w * (1 - m) AS beta, least(0.99, 1.5 * mean) AS lim FROM x3, w3, b),
z0 AS (SELECT *, ln(alpha / beta) AS peak, greatest(12 * sqrt(1 / alpha + 1 / beta), 40 / alpha) AS down, greatest(12 * sqrt(1 / alpha + 1 / beta), 40 / beta) AS up FROM y),
z1 AS (SELECT *, [peak - down + (up + down) * (i + 0.5) / 8000 FOR i IN range(8000)] AS grid FROM z0),
z2 AS (SELECT host, list_sum([CASE WHEN t > ln(lim / (1 - lim)) THEN exp(alpha * (t - peak) - (alpha + beta) * (ln(1 + exp(-abs(t))) + greatest(t, 0) - ln(1 + exp(-abs(peak))) - greatest(peak, 0))) ELSE 0 END FOR t IN grid])
/ list_sum([exp(alpha * (t - peak) - (alpha + beta) * (ln(1 + exp(-abs(t))) + greatest(t, 0) - ln(1 + exp(-abs(peak))) - greatest(peak, 0))) FOR t IN grid]) > 0.95 AS over FROM z1),
r AS (SELECT page_id, host, path, over, host = 'org' OR host LIKE '%.org' AS org, host = 'com' OR host LIKE '%.com' AS com, host = 'example.org' OR host LIKE '%.example.org' AS own FROM p JOIN z2 USING (host)),
v AS (SELECT *, CASE WHEN own AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN own AND path LIKE '/es/%' THEN 'example.org/es/' WHEN com AND path LIKE '/fr/%' THEN 'com/fr/' WHEN com AND path LIKE '/de/%' THEN 'com/de/' WHEN org AND path LIKE '/%' THEN 'org/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN over THEN 'block' ELSE 'allow' END AS verdict FROM v"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PERIODIC_RUNS = rf"""WITH RECURSIVE crc AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
sums AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(s[j + 1])::BIGINT FOR j IN range(length(s))]), lambda h, x: xor(h >> 8, t[xor(h & 255, x) + 1])), 4294967295::BIGINT) AS h FROM ids, steps),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT row, d.doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d JOIN sums ON d.doc_id IS NOT DISTINCT FROM sums.doc_id),
p AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)] ELSE w END AS w FROM g),
e AS (SELECT row, n, unnest(w) AS word, unnest(range(n)) AS i FROM p),
l AS (SELECT row, n, word, list(i ORDER BY i) AS places FROM e GROUP BY ALL HAVING count(*) > 1),
o AS (SELECT row, n, places[k] AS i, unnest(list_slice(places, k + 1, len(places))) AS j FROM (SELECT row, n, places, unnest(range(1, len(places) + 1)) AS k FROM l)),
m AS (SELECT row, n, i, j - i AS q FROM o WHERE 2 * (j - i) <= n),
s AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM m) GROUP BY row, q, island HAVING count(*) >= q AND count(*) + q >= 12),
r AS (SELECT row, start, length, min(q) AS period FROM s GROUP BY ALL),
drops AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS words FROM e ANTI JOIN drops USING (row, i) GROUP BY row),
b AS (SELECT row, count(*) AS n_runs, arg_min(struct_pack(start, length, period), struct_pack(x := -length, y := start, z := period)) AS best,
string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spelled FROM r GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
sha256(coalesce(spelled, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256 FROM p LEFT JOIN b USING (row) LEFT JOIN kept USING (row)"""

_FILTER_AUDIT = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails FROM t LEFT JOIN k USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS i), o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS places FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT places, list_aggregate([substr('ABCDE', i + 1, 1) FOR i IN places], 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, filter_order, step, places[step] AS filter, n, good, toxic, fails[places[step] + 1] AS here, list_bool_or([false] || [fails[i + 1] FOR i IN list_slice(places, 1, step - 1)]) AS earlier, len(list_filter(fails, lambda z: z)) = 1 AS alone FROM c, s),
y AS (SELECT part, filter_order, step, filter, sum(CASE WHEN here OR earlier THEN 0 ELSE n END) AS kept, sum(CASE WHEN here AND NOT earlier THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND earlier THEN n ELSE 0 END) AS redundant,
sum(CASE WHEN here AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM y"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the other operators are tested against brute force, libraries and held-out rows."""
    return {"op4_url_filters": _URL_FILTERS, "op11_periodic_runs": _PERIODIC_RUNS, "op12_filter_audit": _FILTER_AUDIT}
