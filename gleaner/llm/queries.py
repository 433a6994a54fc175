"""The registered queries of the operators in this package, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    classifier, crosstok, decontaminate, langid, lines, lm, mixing, pii, rules, simhash, spelling, tokens, wrappers,
)


def tokenizer_path(name: str = "byte_bpe_50k.json", variable: str = "GLEANER_TOKENIZER") -> str:
    """A vocabulary of the public tokenizers; the environment's ``variable`` names another file."""
    path = os.environ.get(variable)
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, counts=True)


def op2_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "text")
    usable = ~classifier.held_out()
    model = classifier.fit(classifier.training_rows(docs, read(spark, base, "labels"), usable=usable))
    scored = classifier.score(docs, model, drop_text=True)
    return scored.select(
        "doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_simhash(spark: SparkSession, base: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, base, "documents"))


def op4_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return tokens.count_tokens(read(spark, base, "documents"), tokenizer_path())


def op5_decontamination(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, base, "benchmark"), drop_text=True)
    items = F.col("contamination")["items"]
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        F.col("contamination")["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op6_mixing(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op7_pii(spark: SparkSession, base: str) -> DataFrame:
    found = pii.find(read(spark, base, "documents").select("doc_id", "text"))
    sure = F.filter("pii", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(sure), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    docs = read(spark, base, "documents").select("doc_id", "source", "text")
    return rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"),
    )


def op9_language_id(spark: SparkSession, base: str) -> DataFrame:
    model = langid.fit_text_model(read(spark, base, "documents"))
    return langid.identify(read(spark, base, "pages"), model)


def op10_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    return lm.score(read(spark, base, "documents"), classifier.held_out(folds=7, fold=2))


def op11_spelling_variants(spark: SparkSession, base: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, base, "documents"))


def op12_html_extraction(spark: SparkSession, base: str) -> DataFrame:
    return wrappers.extract(read(spark, base, "pages"))


def op13_cross_tokenizer(spark: SparkSession, base: str) -> DataFrame:
    pieces = tokenizer_path("piece_bpe_32k.model", "GLEANER_PIECES")
    found = crosstok.align(read(spark, base, "documents"), tokenizer_path(), pieces, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


REGISTRY = {f.__name__: f for f in (
    op1_line_dedup, op2_quality_classifier, op3_simhash, op4_token_counts, op5_decontamination, op6_mixing,
    op7_pii, op8_quality_rules, op9_language_id, op10_lm_scoring, op11_spelling_variants,
    op12_html_extraction, op13_cross_tokenizer,
)}

# The words and windows of both tables, the windows joined by their words.
OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
items AS (
  SELECT DISTINCT id AS item, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
wins AS (
  SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
    SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= size)),
hits AS (SELECT n, i, size, item FROM wins JOIN items USING (size, win)),
covered AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM hits) GROUP BY n),
listed AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT n, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY n)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN covered USING (n) LEFT JOIN listed USING (n) WHERE kind = 'd'
"""

OP1_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
held AS (
  SELECT source, line, count(*) AS c FROM (
    SELECT DISTINCT source, text, trim(unnest(l), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM docs)
  WHERE line <> '' GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT text) AS t FROM docs GROUP BY source),
gone AS (SELECT source, line FROM held JOIN totals USING (source) WHERE c >= 5 AND c > 0.1 * t),
numbered AS (SELECT n, source, unnest(l) AS line, unnest(range(len(l))) AS i FROM docs),
kept AS (
  SELECT n, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered
  WHERE (source, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) NOT IN (SELECT (source, line) FROM gone) GROUP BY n)
SELECT doc_id, docs.source AS source, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(k, 0) AS BIGINT) AS n_dropped
FROM docs LEFT JOIN kept USING (n)
"""

OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS s, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM docs GROUP BY source),
steps AS (
  SELECT 3.0 * s / w AS r, (sum(s) OVER () - coalesce(sum(3.0 * s) OVER before, 0)) /
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM sources
  WINDOW before AS (ORDER BY 3.0 * s / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, CAST(s AS BIGINT) AS s, least(3.0 * s, w * (SELECT arg_min(level, r) FROM steps WHERE level <= r))::DOUBLE AS target FROM sources),
budgets AS (SELECT *, CAST(round(target) AS BIGINT) AS b FROM shares),
line AS (
  SELECT doc_id, size, s, target, b, sum(size) OVER (PARTITION BY docs.source ORDER BY place, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM docs JOIN budgets ON docs.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, s AS source_size, round(target, 6) AS target,
  CAST((b // greatest(s, 1)) * size + greatest(0, least(size, b % greatest(s, 1) - (until - size))) AS BIGINT) AS taken
FROM line
"""

OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
runs AS (SELECT n, i, w[i:i + 2] AS run FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2)),
repeats AS (
  SELECT n, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT n, unnest([i, i + 1, i + 2]) AS p FROM runs JOIN (SELECT n, run FROM runs GROUP BY ALL HAVING count(*) > 1) USING (n, run))
  GROUP BY n),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (n) LEFT JOIN repeats USING (n)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
failing AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) AS failed FROM ruled),
hosts AS (SELECT source, count(*)::DOUBLE AS d, sum(failed::INT)::DOUBLE AS f FROM failing GROUP BY source),
moments AS (
  SELECT sum(d) AS n, count(*) AS h, sum(f) / sum(d) AS mean, sum(d * d) AS squares, sum(f * f / d) AS spread FROM hosts),
apart AS (
  SELECT *, (spread / n - mean * mean - mean * (1 - mean) * (h - 1) / n) AS between_,
    mean * (1 - mean) * (1 - squares / (n * n) - (h - 1) / n) AS room FROM moments),
prior AS (
  SELECT mean, greatest(1, 1 / least(1, greatest(CASE WHEN room > 0 THEN between_ / room ELSE 0 END, 1 / (n + 1))) - 1) AS m FROM apart)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT failed AND (f + greatest(mean * m, 1e-9)) / (d + greatest(mean * m, 1e-9) + greatest((1 - mean) * m, 1e-9)) <= 0.5 AS kept,
  round((f + greatest(mean * m, 1e-9)) / (d + greatest(mean * m, 1e-9) + greatest((1 - mean) * m, 1e-9)), 6) AS host_rate
FROM failing JOIN hosts ON failing.source IS NOT DISTINCT FROM hosts.source CROSS JOIN prior
"""

# CRC-32 by its table; near words share what is left when one letter of each is deleted.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, hex(id || ':' || run) AS h, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2),
    lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS code FROM counted, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN code % 31 = 0 THEN run[1:code % length(run)] || run[code % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cuts a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word, a.n FROM cuts a JOIN words w ON a.rest = w.word),
tops AS (
  SELECT word, count(*) AS n_near, max(m) AS form_n FROM pairs GROUP BY word),
firsts AS (SELECT word, n_near, form_n, min(other) AS form FROM pairs JOIN tops USING (word) WHERE m = form_n GROUP BY ALL),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
    CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN firsts USING (word)),
paths AS (
  SELECT word, form AS last FROM judged WHERE form IS NOT NULL
  UNION ALL SELECT paths.word, judged.form FROM paths JOIN judged ON paths.last = judged.word WHERE judged.form IS NOT NULL),
ends AS (SELECT paths.word, last FROM paths JOIN judged ON last = judged.word WHERE judged.form IS NULL)
SELECT judged.word AS word, form, coalesce(last, judged.word) AS root, n, n_near, form_n FROM judged LEFT JOIN ends ON judged.word = ends.word
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
}
