"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import bpe, filter_audit, html_extract, lm_scoring, mixing, quality, sharding, toxicity, url_filter, whitening
from ruleloom.llm.embedding_dedup import near_duplicates
from ruleloom.llm.line_dedup import line_dedup
from ruleloom.llm.ngram_join import ngram_jaccard_components


#: Labels that are sent to every executor at most; more are joined by a shuffle.
SEND_LABELS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the multilingual byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 3-word shingles, Jaccard 0.9 or more."""
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labels of rows that are not held out.

    A null id is held out; of an id's labels one toxic one is enough.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    known = _table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic").where("toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = F.broadcast(known) if known.count() <= SEND_LABELS else known  # else the texts would be shuffled for a few bytes each
    model = toxicity.train(docs.join(known, "doc_id"))
    # the id says which rows are held out after the scoring; it is no input of a score
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, and the url's template with its purity."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS id FROM pages),
g AS (SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
             list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM u),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given FROM g),
h AS (SELECT count(DISTINCT host) AS hosts FROM v),
c0 AS (SELECT host, segs[1] AS seg, count(*) AS n FROM v WHERE len(segs) > 0 GROUP BY ALL),
w0 AS (SELECT seg FROM c0, h GROUP BY seg, hosts HAVING count(*) >= 8 AND count(*) * 20 >= hosts),
l0 AS (SELECT host, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host) AS every FROM c0) WHERE (n >= 3 AND n * 20 >= every) OR seg IN (SELECT seg FROM w0)),
b AS (SELECT v.*, CASE WHEN len(segs) = 0 THEN '' WHEN l0.seg IS NOT NULL THEN segs[1] ELSE '*' END AS branch FROM v LEFT JOIN l0 ON v.host = l0.host AND v.segs[1] = l0.seg),
d AS (SELECT id, host, branch, i AS level, segs[i] AS seg FROM b, unnest(range(2, len(segs) + 1)) AS r(i)),
c1 AS (SELECT host, branch, level, seg, count(*) AS n FROM d GROUP BY ALL),
w1 AS (SELECT level, seg FROM c1, h GROUP BY level, seg, hosts HAVING count(DISTINCT host) >= 8 AND count(DISTINCT host) * 20 >= hosts),
l1 AS (SELECT c.host, c.branch, c.level, c.seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, branch, level) AS every FROM c1) c LEFT JOIN w1 ON c.level = w1.level AND c.seg = w1.seg WHERE (n >= 3 AND n * 20 >= every) OR w1.seg IS NOT NULL),
r AS (SELECT d.id, list(CASE WHEN l1.seg IS NOT NULL THEN d.seg ELSE '*' END ORDER BY d.level) AS rest FROM d LEFT JOIN l1 ON d.host = l1.host AND d.branch = l1.branch AND d.level = l1.level AND d.seg = l1.seg GROUP BY d.id),
t AS (SELECT b.*, CASE WHEN len(segs) = 0 THEN '' ELSE concat('/', array_to_string(list_prepend(branch, coalesce(rest, [])), '/')) END AS template FROM b LEFT JOIN r ON b.id = r.id),
n AS (SELECT host, template, count(given) AS told, count(*) FILTER (given = 'block') AS bad, count(*) AS urls FROM t GROUP BY ALL),
o AS (SELECT coalesce(sum(bad) / sum(told), 0.0) AS overall FROM n),
x AS (SELECT DISTINCT template, k, CASE WHEN k = 0 THEN '' ELSE concat('/', array_to_string(list_filter(string_split(template, '/'), lambda y: y <> '')[1:k], '/')) END AS prefix
      FROM n, unnest(range(0, len(list_filter(string_split(template, '/'), lambda y: y <> '')) + 1)) AS q(k)),
i AS (SELECT host, prefix, sum(told)::BIGINT AS told, sum(bad)::BIGINT AS bad FROM n JOIN x ON n.template = x.template GROUP BY ALL HAVING sum(told) > 0 AND sum(told) * 2 >= sum(urls)),
z AS (SELECT prefix, sum(bad * 1000000 // told)::BIGINT AS rates, count(*) AS voters FROM i GROUP BY prefix),
e AS (SELECT template, list({'rates': rates::DOUBLE, 'voters': voters::DOUBLE} ORDER BY k) AS chain FROM x JOIN z ON x.prefix = z.prefix GROUP BY template),
p AS (SELECT template, list_reduce(list_prepend({'rates': overall, 'voters': 0.0::DOUBLE}, chain), lambda a, y: {'rates': (y.rates / 1000000 + a.rates * 4.0) / (y.voters + 4.0), 'voters': 0.0::DOUBLE}).rates AS prior FROM e, o),
s AS (SELECT host, template, told, bad, regexp_replace(template, '/[^/]+', '/*', 'g') AS shape FROM n WHERE told > 0 AND told * 2 >= urls),
f AS (SELECT *, sum(bad) OVER (PARTITION BY host, shape) / sum(told) OVER (PARTITION BY host, shape) AS rate FROM s),
m AS (SELECT *, CASE WHEN abs(bad / told - rate) <= 1.96::DOUBLE * sqrt(greatest(rate * (1 - rate), 1e-4) / told) THEN '' ELSE template END AS merged FROM f),
y AS (SELECT host, template, sum(bad) OVER (PARTITION BY host, shape, merged) AS b, sum(told) OVER (PARTITION BY host, shape, merged) AS t FROM m),
j AS (SELECT n.host, n.template, round((coalesce(y.b, 0) + coalesce(p.prior, overall) * 4.0::DOUBLE) / (coalesce(y.t, 0) + 4.0::DOUBLE), 6) AS purity
      FROM n CROSS JOIN o LEFT JOIN p ON n.template = p.template LEFT JOIN y ON n.host = y.host AND n.template = y.template)
SELECT page_id, t.host, path, rule, coalesce(given, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, t.template, purity FROM t JOIN j ON t.host = j.host AND t.template = j.template
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return bpe.encode(_table(spark, sf_dir, "documents"), *tokenizer(), digests=True)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept: cosine 0.93 or more among equal labels."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its repeated lines."""
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), every_length=True).select("doc_id", "n_lines", "n_dropped", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base_failed, kept under the current policy, and the failure bits."""
    book = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~quality.passes("base")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.passes(quality.CURRENT).alias("kept"), F.col("failures"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, ws[i:i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
rep AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM rep, unnest([i, i + 1, i + 2]) AS u(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
               + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines > 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
               + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
               + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 63) = 0 AS kept, failures FROM f
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the output shard of each copy."""
    planned = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (of 16), slot, grown_shard (of 17)."""
    return sharding.shard(_table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learnt from the rows that are not held out (a null id is not)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return lm_scoring.score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the first 8 components of each vector."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and the counts of every order of the five filters."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
             100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > first, false) AS e
      FROM d JOIN e USING (t) LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(q) AS good, sum(x) AS bad FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT concat(k1.f, k2.f, k3.f, k4.f, k5.f) AS filter_order, [k1.bit, k2.bit, k3.bit, k4.bit, k5.bit] AS bits FROM k k1, k k2, k k3, k k4, k k5
      WHERE k1.bit + k2.bit + k3.bit + k4.bit + k5.bit = 31 AND k1.bit | k2.bit | k3.bit | k4.bit | k5.bit = 31),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, unnest(range(1, 6)) AS r(i))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM m, s GROUP BY part, filter_order, step
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_url_templates": op3_url_templates,
    "op4_bpe": op4_bpe,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_html_main_text": op10_html_main_text,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": op13_filter_audit,
}
SQL: dict[str, str] = {"op3_url_templates": OP3_SQL, "op7_quality_rules": OP7_SQL, "op13_filter_audit": OP13_SQL}
