"""The operators applied to their whole tables, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_documents, write_sequences

    _, files = write_sequences(spark, documents(spark, sf_dir))
    return read_documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import base_failed, judge

    found = judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_documents

    return score_documents(spark, documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_groups

    return near_groups(spark, documents(spark, sf_dir))[0]


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(spark, documents(spark, sf_dir)).select("doc_id", "text")


def op5_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .span_dedup import dedup_spans

    return dedup_spans(spark, documents(spark, sf_dir)).select("doc_id", "text", "n_sentences", "removed")


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_quality import score_quality

    return score_quality(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    found = resample(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_stream import decode, encode

    encoded = encode(documents(spark, sf_dir)).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(encoded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import restore, transform

    made = transform(documents(spark, sf_dir)).withColumn("output_sha256", F.sha2("output", 256))
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("text", 256).alias("restored_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
v AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
      WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_capitals
      FROM w LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_capitals > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""


#: Shingles of five words, pairs that share one, exact Jaccard, groups by reachability.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT d.doc_id, least(d.doc_id, coalesce(g.b, d.doc_id)) AS class_id, coalesce(l.n, 0) AS n_links
FROM documents d LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) g ON g.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = d.doc_id
"""

#: Lines as sets of words, rarest first, pairs that share a word of their prefixes, exact Jaccard.
OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, k, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS s FROM l),
e AS (SELECT doc_id, k, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
o AS (SELECT doc_id, k, n, x, row_number() OVER (PARTITION BY doc_id, k ORDER BY df, x) AS p FROM e JOIN f USING (x)),
q AS (SELECT * FROM o WHERE p <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT b.doc_id, b.k, a.doc_id AS d0, a.k AS k0 FROM q a JOIN q b ON a.x = b.x AND (a.doc_id, a.k) < (b.doc_id, b.k)
      WHERE a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
g AS (SELECT DISTINCT c.doc_id, c.k FROM c JOIN s t ON t.doc_id = c.doc_id AND t.k = c.k JOIN s u ON u.doc_id = c.d0 AND u.k = c.k0
      WHERE len(list_intersect(t.s, u.s)) >= 0.8 * (len(t.s) + len(u.s) - len(list_intersect(t.s, u.s))) - 1e-9)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '') END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY d.doc_id, d.text
"""


#: CRC-32 by its table of 256 entries, over the bytes of each distinct word; weights and Gumbel noise in doubles.
OP11_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS k),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS w FROM d),
c AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::BIGINT)),
                                lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
      FROM (SELECT w FROM e UNION SELECT w FROM t), k),
s AS (SELECT b, count(*) AS n FROM e JOIN c USING (w) GROUP BY b),
u AS (SELECT b, count(*) AS n FROM t JOIN c USING (w) GROUP BY b),
g AS (SELECT c.b, floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)
                                  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000))))::BIGINT AS g
      FROM (SELECT DISTINCT b FROM c) c LEFT JOIN s USING (b) LEFT JOIN u USING (b)),
v AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM e JOIN c USING (w) JOIN g USING (b) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS rank FROM x)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND rank <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN rank END AS rank FROM r
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             list_transform([1, 9, 17, 25], lambda i: ('0x' || x[i : i + 7])::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, len(w) AS n, w, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""


def queries() -> dict:
    return {"op1_decontaminate": op1_decontaminate, "op2_token_files": op2_token_files, "op3_ngram_join": op3_ngram_join, "op4_pii": op4_pii, "op5_span_dedup": op5_span_dedup, "op6_lm_scoring": op6_lm_scoring, "op7_weak_quality": op7_weak_quality, "op8_line_dedup": op8_line_dedup, "op9_quality_rules": op9_quality_rules, "op10_packing": op10_packing, "op11_importance": op11_importance, "op12_bpe_stream": op12_bpe_stream, "op13_fill_middle": op13_fill_middle}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op8_line_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_importance": OP11_SQL, "op13_fill_middle": OP13_SQL}
