"""Queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, language_id, line_dedup, merkle, minhash, mixing, quality_classifier, quality_rules, token_counts, toxicity, url_filter
from .common import cut, table
from .labelled import in_fold

#: Score from which a document counts as toxic, or as good.
PREDICTED_FROM = 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "line_chars", "kept_chars")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "score", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = cut(quality_classifier.score_quality(docs, model).drop("text"))
    return quality_classifier.above_quantile(scored, 0.1).select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"), "kept"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs.select("doc_id", "text"), language_id.train(docs)).select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"text": merkle.lower_ascii(F.col("text"))}
    return merkle.audit(merkle.build(table(spark, sf_dir, "documents"), claims=tampered, claimed_by=in_fold(F.col("doc_id"), 5, 0)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_rules, op2_benchmark_decontamination, op3_chat_formatting, op4_url_filters, op5_token_counts,
        op6_minhash_near_dedup, op7_source_mixing, op8_toxicity, op9_quality_classifier, op10_language_id,
        op11_merkle_manifest, op12_source_divergence, op13_line_dedup,
    ]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents
), counted AS (
  SELECT r, doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w, string_split(body, chr(10)) AS lines FROM base
), places AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM counted))
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM places, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY r
), judged AS (
  SELECT r, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS real, length(line) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols, length(regexp_replace(line, '[^!]+', '', 'g')) AS exclaims,
    len(string_split_regex(line, ' [|»›•·] ')) - 1 AS separators,
    right(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) AS closing
  FROM (SELECT r, unnest(lines) AS line FROM counted)
), failed AS (
  SELECT *, real AND (chars > 60 AND NOT contains('.!?:;,"'')]}»”’…。！？：；，」』）؟۔।॥', closing)
    OR symbols * 100 > chars * 8 OR exclaims * 100 > chars * 7 OR separators >= 3 OR regexp_matches(lower(line),
    'rights reserved|copyright \(c\)|©|licensed under|released under the|public license|cookie policy|use cookies|privacy policy|terms of use|terms of service|terms and conditions|click here|subscribe to our|sign up for our|follow us on|share this article|skip to content|skip to main content|enable javascript|javascript is disabled|powered by wordpress|lorem ipsum')) AS fails
  FROM judged
), of_lines AS (
  SELECT r, count(*) FILTER (real) AS n_lines, count(*) FILTER (real) - count(DISTINCT line) FILTER (real) AS n_dup_lines,
    count(*) FILTER (fails) AS n_failed_lines, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars
  FROM failed GROUP BY r
), facts AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    n_lines, n_failed_lines, line_chars, kept_chars
  FROM counted JOIN of_lines USING (r) LEFT JOIN repeated USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (line_chars - kept_chars) <= 30 * line_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(line_chars AS BIGINT) AS line_chars, CAST(kept_chars AS BIGINT) AS kept_chars
FROM facts
"""

OP3_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n, role, text,
    string_agg(coalesce('r' || length(role) || role, 'n') || coalesce('t' || length(text) || text, 'n'), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), whole AS (
  SELECT prefix, place, min(conv_id) AS conv_id, count(*) AS n_copies FROM turns WHERE place = n GROUP BY prefix, place
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.place < t.n AND t.place = whole.place AND t.prefix = whole.prefix)
)
SELECT k.conv_id, CAST(k.place AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
  string_agg('<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>', chr(10) ORDER BY t.place) AS chat
FROM kept k JOIN turns t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), sources AS (
  SELECT *, CAST(CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM weighed
), filled AS (
  SELECT *, coalesce(sum(source_size) OVER f, 0) AS size_before, coalesce(sum(CASE WHEN source_size > 0 THEN weight ELSE 0 END) OVER f, 0) AS weight_before,
    sum(source_size) OVER () AS all_size, sum(weight) FILTER (source_size > 0) OVER () AS all_weight
  FROM sources WINDOW f AS (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), unit AS (
  SELECT max((CAST(1.5 AS DOUBLE) * all_size - CAST(2 AS DOUBLE) * size_before) / (all_weight - weight_before)) AS unit FROM filled WHERE source_size > 0
), targets AS (
  SELECT source, source_size, CASE WHEN source_size > 0 THEN least(weight * unit, CAST(2 AS DOUBLE) * source_size) ELSE 0 END AS target,
    ('0x' || substr(md5(coalesce('=' || source, '')), 1, 5))::INT / CAST(1048576 AS DOUBLE) AS start
  FROM filled, unit
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected, row_number() OVER (
    PARTITION BY d.source ORDER BY length(bin(d.size)), substr(bin(d.size), 1, 4), substr(md5(d.doc_id::VARCHAR), 1, 2), d.size, md5(d.doc_id::VARCHAR)) AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CAST(floor(start + place * expected) - floor(start + (place - 1) * expected) AS BIGINT) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM taken
"""


OP11_SQL = r"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256(concat(own, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    sha256(concat(own, coalesce(strlen(text) || ':' || CASE WHEN altered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-'))) AS claim
  FROM (
    SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS own, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0, FALSE) AS altered
    FROM documents)
), sources AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source
), placed AS (
  SELECT r, doc_id, leaf, claim, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), low AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 16, n
), high AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM sources) AS n, digest FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n
), nodes AS (
  SELECT tree, level, pos, n, digest FROM low UNION ALL SELECT -1, level, pos, n, digest FROM high
), walk AS (
  SELECT r, tree, 0 AS level, pos, n, claim AS fold, '' AS proof, tree AS home FROM placed
  UNION ALL
  SELECT w.r, CASE WHEN w.n > 1 THEN w.tree ELSE -1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.n > 1 THEN w.pos // 16 ELSE w.tree END,
    CASE WHEN w.n > 1 THEN (w.n + 15) // 16 ELSE (SELECT count(*) FROM sources) END,
    CASE WHEN w.n > 1 THEN sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.fold ELSE s.digest END, '' ORDER BY s.pos)) ELSE w.fold END,
    CASE WHEN w.n > 1 THEN w.proof || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> w.pos), '') ELSE w.proof END, w.home
  FROM walk w JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.pos // 16 = w.pos // 16
  WHERE w.tree >= 0 OR w.n > 1
  GROUP BY w.r, w.tree, w.level, w.pos, w.n, w.fold, w.proof, w.home
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = t.digest AS verified
FROM walk w JOIN placed p USING (r) JOIN low s ON s.tree = p.tree AND s.n = 1 JOIN high t ON t.n = 1 WHERE w.tree = -1 AND w.n = 1
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), held AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM held GROUP BY lang, term HAVING count(*) >= 10
), of_source AS (
  SELECT lang, source, term, sum(h.n)::HUGEINT AS n FROM held h JOIN kept USING (lang, term) GROUP BY ALL
), vocabulary AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(t.n, 0) AS total, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocabulary l USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS n FROM of_source GROUP BY ALL) t USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0) + 2))::HUGEINT // (g.total + 2 * g.v) AS p, 1 + (1000000000 * (k.n + 2))::HUGEINT // (g.lang_total + 2 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN of_source o USING (lang, source, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, i, l[i] AS line, trim(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT r, l.doc_id, i, line, coalesce(l.doc_id <> first, FALSE) AS dropped FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op7_source_mixing": OP7_SQL,
        "op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_line_dedup": OP13_SQL,
    }
