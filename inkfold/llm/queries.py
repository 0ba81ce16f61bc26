"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import pii, quality, warc
from inkfold.llm.audio import media_digest
from inkfold.llm.common import Scratch, table
from inkfold.llm.conversations import damaged, repair
from inkfold.llm.lines import line_report
from inkfold.llm.minhash import near_duplicates
from inkfold.llm.mixing import taken_words
from inkfold.llm.packing import pack
from inkfold.llm.rules import STOP_WORDS, quality_report
from inkfold.llm.substrings import kept_words
from inkfold.llm.topk import quantized, top_k
from inkfold.llm.whitening import whiten

#: The tokenizer vocabulary that the packing query uses.
TOKENIZER = "word_bpe_49k.json"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(table(spark, sf_dir, "documents"), with_text=False)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
keyed AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i+19], ' ') ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM keyed WHERE r > 1) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS g,
    list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS ks FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents"), path(TOKENIZER))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix-1:', CAST(doc_id AS VARCHAR))) AS k FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r, 2.0::DOUBLE * source_size AS cap FROM src),
weighted AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
                    1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM ranked),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER prev, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER prev, 0)) AS level
           FROM weighted WINDOW prev AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, s.k, coalesce('=' || s.source, '') AS queue,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st,
    row_number() OVER (PARTITION BY s.source ORDER BY s.k, s.size) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, st + c * source_size AS start FROM (SELECT *, unnest([0, 1]) AS c FROM placed)),
lengths AS (SELECT *, CASE WHEN start < target AND start + size > target THEN 16 ELSE greatest(size, 1) END AS l FROM copies),
packets AS (SELECT *, least(l, size - p * l) AS words FROM (SELECT *, unnest(range(0, greatest(CAST(ceil(size / l) AS BIGINT), 1))) AS p FROM lengths)),
finish AS (SELECT *, coalesce(CAST(start + p * l + words AS DOUBLE) / nullif(target, 0), 0) AS v FROM packets),
served AS (SELECT *, (SELECT CAST(round(sum(target)) AS BIGINT) FROM targets)
    - coalesce(sum(words) OVER (ORDER BY v, queue, k, place, c, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM finish)
SELECT doc_id, size, source_size, target, CAST(sum(least(greatest(left_over, 0), words)) AS BIGINT) AS taken
FROM served GROUP BY queue, place, doc_id, size, source_size, target
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = Scratch(spark, "warc").path("archive")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), archive)
    read = warc.read_warc(spark, archive, payload=False, verify=True)
    return read.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations),
coded AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))) % 20 AS kind
  FROM keyed),
copies AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
    lag(left(role, 1)) OVER w AS before, lag(turn) OVER w AS turn_before,
    regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS last
  FROM copies WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 1 WHEN time > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
everyone AS (SELECT DISTINCT conv_id FROM conversations),
rest AS (
  SELECT everyone.conv_id, coalesce(n, 0) + 1 AS i, {'c': 0, 's': '', 't': ''} AS st, {'c': 6, 's': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS sy,
    {'c': 3, 's': 'I', 't': 'assistant:'} AS us, {'c': 0, 's': '', 't': ''} AS an
  FROM everyone LEFT JOIN facts ON everyone.conv_id IS NOT DISTINCT FROM facts.conv_id
  UNION ALL
  SELECT conv_id, i, list_min([b0, i0, {'c': 3 + i2.c, 's': 'I' || i2.s, 't': 'user:' || CASE WHEN i2.t = '' THEN '' ELSE chr(10) || i2.t END}]),
    list_min([b1, i0, {'c': 3 + i2.c, 's': 'I' || i2.s, 't': 'user:' || CASE WHEN i2.t = '' THEN '' ELSE chr(10) || i2.t END}]),
    list_min([b2, i2, {'c': 3 + i0.c, 's': 'I' || i0.s, 't': 'assistant:' || CASE WHEN i0.t = '' THEN '' ELSE chr(10) || i0.t END}]),
    list_min([b3, i0, {'c': 3 + i2.c, 's': 'I' || i2.s, 't': 'user:' || CASE WHEN i2.t = '' THEN '' ELSE chr(10) || i2.t END}])
  FROM (
    SELECT conv_id, i, b0, b1, b2, b3, {'c': 3 + b2.c, 's': 'I' || b2.s, 't': 'user:' || CASE WHEN b2.t = '' THEN '' ELSE chr(10) || b2.t END} AS i0,
      {'c': 3 + b3.c, 's': 'I' || b3.s, 't': 'assistant:' || CASE WHEN b3.t = '' THEN '' ELSE chr(10) || b3.t END} AS i2
    FROM (
      SELECT conv_id, i,
        list_min([d0, {'c': 3 + more + us.c, 's': 'R' || us.s, 't': 'user:' || text || tu}] || CASE initial WHEN 's' THEN [{'c': more + sy.c, 's': 'K' || sy.s, 't': own || ts}] WHEN 'u' THEN [{'c': more + us.c, 's': 'K' || us.s, 't': own || tu}] ELSE [] END) AS b0,
        list_min([d1, {'c': 3 + more + us.c, 's': 'R' || us.s, 't': 'user:' || text || tu}] || CASE initial WHEN 'u' THEN [{'c': more + us.c, 's': 'K' || us.s, 't': own || tu}] ELSE [] END) AS b1,
        list_min([d2, {'c': 3 + more + an.c, 's': 'R' || an.s, 't': 'assistant:' || text || ta}] || CASE initial WHEN 'a' THEN [{'c': more + an.c, 's': 'K' || an.s, 't': own || ta}] ELSE [] END) AS b2,
        list_min([d3, {'c': 3 + more + us.c, 's': 'R' || us.s, 't': 'user:' || text || tu}] || CASE initial WHEN 'u' THEN [{'c': more + us.c, 's': 'K' || us.s, 't': own || tu}] ELSE [] END) AS b3
      FROM (
        SELECT r.conv_id, j.i, j.initial, j.text, st, sy, us, an, CASE j.fault WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 1000000000 END AS more, j.role || ':' || j.text AS own,
          CASE WHEN us.t = '' THEN '' ELSE chr(10) || us.t END AS tu, CASE WHEN sy.t = '' THEN '' ELSE chr(10) || sy.t END AS ts, CASE WHEN an.t = '' THEN '' ELSE chr(10) || an.t END AS ta,
          {'c': 4 + st.c, 's': 'D' || st.s, 't': st.t} AS d0, {'c': 4 + sy.c, 's': 'D' || sy.s, 't': sy.t} AS d1,
          {'c': 4 + us.c, 's': 'D' || us.s, 't': us.t} AS d2, {'c': 4 + an.c, 's': 'D' || an.s, 't': an.t} AS d3
        FROM rest r JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.i = r.i - 1))))
SELECT e.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(e.st.c AS BIGINT) AS cost, e.st.s AS audit, sha256(e.st.t) AS repaired_sha256
FROM rest e LEFT JOIN facts f ON e.conv_id IS NOT DISTINCT FROM f.conv_id WHERE e.i = 1
"""


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


OP12_SQL = (
    r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT k, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS g FROM w),
found AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM found WHERE n > 1) GROUP BY k),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(regexp_extract_all(text, '\p{Lu}{2,}')) AS n_shouts, len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
    len(list_filter(ws, lambda x: list_contains({stops}, x))) AS n_stop_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
  FROM w LEFT JOIN rep USING (k)),
f AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 10 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeats' END,
    CASE WHEN 100 * word_chars < 250 * n_words THEN 'short_words' END, CASE WHEN 100 * word_chars > 1500 * n_words THEN 'long_words' END,
    CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END, CASE WHEN 100 * n_shouts > 40 * n_words THEN 'shouting' END,
    CASE WHEN 100 * n_letter_words < 60 * n_words THEN 'no_letters' END, CASE WHEN n_words >= 50 AND 100 * n_stop_words < 2 * n_words THEN 'no_stop_words' END,
    CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 'same_lines' END, CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 'bullets' END,
    CASE WHEN 100 * n_cut_lines > 50 * n_lines THEN 'cut_lines' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed
FROM f
"""
).replace("{stops}", str([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_substrings": op2_substrings,
    "op3_lines": op3_lines,
    "op4_packing": op4_packing,
    "op5_media": op5_media,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_rules": op12_rules,
    "op13_whitening": op13_whitening,
}

ORACLE: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op2_substrings": OP2_SQL,
    "op6_mixing": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_conversations": OP11_SQL,
    "op12_rules": OP12_SQL,
}
