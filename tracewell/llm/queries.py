"""The registered query of each operator, over its whole table, and SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, centroids, chat, decontaminate, licenses, lines, phrases, pii, quality, secrets, sharding, simhash, suffixes
from tracewell.llm.license_templates import TEMPLATES
from tracewell.llm.registry import query
from tracewell.sources.tables import table


def tokenizer_file() -> str:
    """The tokenizer that op1 and the pipeline use; installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


CONTROL_CASE = "</s>[INST] ok [/INST]"


@query("op5_chat", oracle=r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '#\1', 'g'))
    + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19
      ELSE 17 + length(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '#\1', 'g')) END AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_CASE), (-1, 1, "assistant", CONTROL_CASE)], "conv_id long, turn long, role string, text string")
    output = chat.write(turns.unionByName(control))
    return chat.digests(chat.restored(output))


def rule_matches(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, "
            f"regexp_extract_all(text, '{pattern}', {rule.checked}) AS checked, {rule.at_least} AS least FROM d")


@query("op6_secrets", oracle=f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS ({" UNION ALL ".join(rule_matches(rank, rule) for rank, rule in enumerate(secrets.RULES))}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
s AS (
  SELECT doc_id, kind, rank, length(hits[i]) AS n, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g)))
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM e WHERE length(checked[i]) >= least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', start, ':', start + n), ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base,
         string_agg(concat(kind, ':', start, ':', start + n), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
""")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_in_steps(table(spark, sf_dir, "documents")))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


@query("op8_decontaminate", oracle=r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS j FROM i),
eq AS (SELECT doc_id, item_id, n, p - j AS off, j FROM dw JOIN iw USING (w)),
lines AS (SELECT doc_id, item_id, off FROM eq GROUP BY doc_id, item_id, off HAVING count(*) >= least(any_value(n), 12)),
win AS (
  SELECT doc_id, item_id, n, off, count(*) OVER (PARTITION BY doc_id, item_id, off ORDER BY j RANGE BETWEEN CURRENT ROW AND least(n, 20) - 1 FOLLOWING) AS c
  FROM eq JOIN (SELECT doc_id, item_id, off FROM lines) USING (doc_id, item_id, off)),
best AS (
  SELECT doc_id, item_id, n, off, max(c) AS c FROM win GROUP BY ALL
  HAVING max(c) >= CASE WHEN n < 15 THEN n ELSE ceil(least(n, 20) * 0.8) END)
SELECT doc_id, item_id, CAST(max(c) AS INTEGER) AS n_equal, CAST(n AS INTEGER) AS n_words,
       CAST(min(off) FILTER (c = top) AS INTEGER) AS at_word
FROM (SELECT *, max(c) OVER (PARTITION BY doc_id, item_id) AS top FROM best) t GROUP BY doc_id, item_id, n
""")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_equal", "n_words", F.col("at").alias("at_word"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def template_values() -> str:
    quoted = ((key, licence.replace("'", "''"), text.replace("'", "''")) for key, licence, text in TEMPLATES)
    return ", ".join(f"({key}, '{licence}', '{text}')" for key, licence, text in quoted)


@query("op2_licenses", oracle=rf"""
WITH t AS (SELECT * FROM (VALUES {template_values()}) v(template_id, license, text)),
tw AS (SELECT template_id, license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') AS words FROM t),
ts AS (
  SELECT DISTINCT template_id, license, CAST(greatest(8, pow(2, ceil(log2(len(words))))) AS BIGINT) AS size,
         array_to_string(words[p:p + 4], ' ') AS shingle
  FROM tw, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS p)),
tn AS (SELECT template_id, count(*) AS n_shingles FROM ts GROUP BY template_id),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') AS words FROM documents),
ds AS (
  SELECT doc_id, p - 1 AS pos, array_to_string(words[p:p + 4], ' ') AS shingle
  FROM dw, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS p)),
hits AS (SELECT doc_id, template_id, license, size, pos, shingle FROM ds JOIN ts USING (shingle)),
win AS (
  SELECT doc_id, template_id, license, (pos // size - k) * size AS start, shingle
  FROM hits, (VALUES (0), (1)) b(k) WHERE pos // size - k >= 0 AND pos + 5 <= (pos // size - k) * size + 2 * size),
shares AS (SELECT doc_id, template_id, license, start, count(DISTINCT shingle) AS n_shared FROM win GROUP BY ALL)
SELECT doc_id, CAST(template_id AS BIGINT) AS template_id, license, CAST(max(n_shared) AS INTEGER) AS n_shared,
       CAST(any_value(n_shingles) AS INTEGER) AS n_shingles, CAST(min(start) AS INTEGER) AS first_word
FROM shares JOIN tn USING (template_id) WHERE n_shared >= 0.8 * n_shingles GROUP BY doc_id, template_id, license
""")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), TEMPLATES).drop("tag")


@query("op3_substrings", oracle=r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM w) WHERE first_id < doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 50 THEN 0 ELSE 1 END AS fresh FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n) GROUP BY doc_id, run),
k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER o, 0) AS last_b FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
g AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * last_b + 1, 2 * (a - last_b)), '' ORDER BY a) AS front
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(concat(coalesce(front, ''), substr(h, 2 * coalesce(tail, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


@query("op4_lines")
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def nearest_sql(points: str) -> str:
    return (f"SELECT vec_id, copy, v, list_min(list_transform({points}, lambda c: {{'d': list_sum(list_transform(list_zip(v, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.c}})) AS near FROM v")


def round_sql(k: int) -> str:
    """One round: assigned vectors, then floored means; an empty cluster keeps its centroid."""
    return f"""
a{k} AS ({nearest_sql(f"(SELECT ps FROM p{k})")}),
m{k} AS (
  SELECT near.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL),
f{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS p FROM m{k} GROUP BY c),
p{k + 1} AS (SELECT list({{'c': o.c, 'p': coalesce(f{k}.p, o.p)}} ORDER BY o.c) AS ps FROM (SELECT unnest(ps, recursive := true) FROM p{k}) o LEFT JOIN f{k} ON f{k}.c = o.c)"""


@query("op11_centroids", oracle=f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
v AS (
  SELECT vec_id, row_number() OVER () AS copy, list_transform(x, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM e
  WHERE len(x) = 64 AND len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
s AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM v QUALIFY c < 16),
p0 AS (SELECT list({{'c': c, 'p': v}} ORDER BY c) AS ps FROM s),
{",".join(round_sql(k) for k in range(3))},
z AS ({nearest_sql("(SELECT ps FROM p3)")}),
q AS (SELECT unnest(ps, recursive := true) FROM p3)
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance,
       CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(q.p, ',')) AS centroid_sha256
FROM z JOIN q ON q.c = near.c
""")
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


@query("op12_phrases", oracle=rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM d),
x AS (SELECT lang, id, unnest(words) AS w1, generate_subscripts(words, 1) AS p FROM w),
y AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM x WINDOW o AS (PARTITION BY id ORDER BY p)),
f AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS a FROM y GROUP BY ALL
  UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) AS phrase, count(*) FROM y WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) AS phrase, count(*) FROM y WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) AS phrase, count(*) FROM y WHERE w4 IS NOT NULL GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size >= 2 AND a >= {phrases.LEAST}),
i AS (
  SELECT lang, array_to_string(words[p:p + n - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (2), (3)) s(n), LATERAL (SELECT unnest(range(1, size - n + 2)) AS p) WHERE n < size GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
u AS (
  SELECT k.lang, k.phrase, k.a, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS rest
  FROM k, LATERAL (SELECT unnest(range(1, size)) AS cut)),
s AS (
  SELECT u.lang, u.phrase, u.a, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (x.a + y.a) AS BIGINT) AS score
  FROM u JOIN f x ON x.lang || chr(9) || x.phrase = u.lang || chr(9) || u.head JOIN f y ON y.lang || chr(9) || y.phrase = u.lang || chr(9) || u.rest
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s QUALIFY rank <= {phrases.TOP})
SELECT lang, rank, phrase, a, l, r, n, score
FROM b JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang) USING (lang)
""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
