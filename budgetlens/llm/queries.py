"""Registered queries of the training-data operators, with the DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.llm import bpe, conversation_repair, decontaminate, jaccard_join, langid, line_dedup, periodic_runs, substring_dedup, suffix_dedup, topk, toxicity, url_filter, warc
from budgetlens.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# fixed values: what the SQL strips and lower-cases
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_AZ}) AS key FROM lines),
held AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, h.keeper IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), digest_only=True).withColumnRenamed("kept", "kept_sha256")


# fixed values: the contract's four rules, written out as (rule, verdict, host, path), longest host first
URL_FILTER_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, verdict, host, path) AS (VALUES
  ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'),
  ('net/', 'block', 'net', '/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""


@query("op7_url_filter", URL_FILTER_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "offending")


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), output="digests")


SUBSTRING_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN twice USING (h), range(0, 35) r(k)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words)
SELECT d.doc_id, count(e.pos) AS n_words, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN each e USING (doc_id) LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos
GROUP BY d.doc_id
"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest_only=True).withColumnRenamed("kept", "kept_sha256")


JACCARD_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


# fixed values: the base-32 alphabet and the bits of each hexadecimal digit
WARC_SQL = """
WITH payloads AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
hashed AS (
  SELECT page_id, strlen(body) AS payload_bytes,
    array_to_string(list_transform(string_split(sha1(body), ''), lambda c: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
      '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[strpos('0123456789abcdef', c)]), '') AS bits
  FROM payloads),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
      + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


TOPK_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op5_topk", TOPK_SQL)
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_loops(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# bytes are pairs of hexadecimal digits here: SQL's substr counts code points
SUFFIX_SQL = """
WITH bytes AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, (strlen(h) // 2 - 99)::BIGINT)) AS i FROM bytes WHERE strlen(h) >= 200),
strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM starts),
later AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
edges AS (
  SELECT doc_id, i, i > lag(i + 99, 1, -1) OVER (PARTITION BY doc_id ORDER BY i) + 1 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS opens FROM later),
numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM edges),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, span),
keeps AS (
  SELECT d.doc_id, coalesce(lag(s.b) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS a, s.a AS b FROM bytes d JOIN spans s USING (doc_id)
  UNION ALL
  SELECT d.doc_id, coalesce(max(s.b), 0), strlen(any_value(d.h)) // 2 FROM bytes d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.a) AS h FROM keeps k JOIN bytes d USING (doc_id) GROUP BY k.doc_id),
lost AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT k.doc_id, strlen(d.h) // 2 AS n_bytes, coalesce(l.n_removed, 0) AS n_removed, coalesce(l.n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM kept k JOIN bytes d USING (doc_id) LEFT JOIN lost l USING (doc_id)
"""


@query("op13_suffix_dedup", SUFFIX_SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")).withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


# fixed values: the polynomial of CRC-32, the contract's damage, faults, edits and their costs
def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _insert(state: str, role: str) -> str:
    return f"{{'c': {state}.c + 2, 'a': {state}.a || 'I', 'r': list_append({state}.r, '{role}:')}}"


def _edit(state: str, letter: str, price: str, turn: str, when: str) -> str:
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {price} ELSE 1000000000 END, 'a': {state}.a || '{letter}', 'r': {turn}}}"


def _row_step() -> str:
    """The four states behind a row, from those before it (b: inserts made)."""
    free, made = "NOT n.gone", lambda s, role: f"list_append(b.{s}.r, {role} || ':' || n.text)"
    drop = lambda s: _edit(f"b.{s}", "D", "3", f"b.{s}.r", "true")
    keep = lambda s, i: _edit(f"b.{s}", "K", "n.broken", made(s, "n.role"), f"{free} AND n.initial = '{i}'")
    turn = lambda s, role: _edit(f"b.{s}", "R", "2 + n.broken", made(s, f"'{role}'"), free)
    return ", ".join((
        f"{drop('o')} AS o", f"{_least(drop('s'), keep('o', 's'))} AS s",
        f"{_least(drop('u'), keep('o', 'u'), keep('s', 'u'), keep('a', 'u'), turn('o', 'user'), turn('s', 'user'), turn('a', 'user'))} AS u",
        f"{_least(drop('a'), keep('u', 'a'), turn('u', 'assistant'))} AS a"))


_NONE = "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"
REPAIR_SQL = f"""
WITH RECURSIVE
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [1, 2, 3, 4, 5, 6, 7, 8], lambda x, e: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS initial,
         regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM ordered),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
rows_ AS (SELECT conv_id, pos, role, text, initial, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS broken FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
walk(conv_id, pos, o, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, {_NONE}, {_NONE}, {_NONE} FROM rows_
  UNION ALL
  SELECT b.conv_id, n.pos, {_row_step()}
  FROM (SELECT conv_id, pos, o, s, u2 AS u, {_least('a', _insert('u2', 'assistant'))} AS a
        FROM (SELECT *, {_least('u', _insert('o', 'user'), _insert('s', 'user'), _insert('a', 'user'))} AS u2 FROM walk)) b
  JOIN rows_ n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.pos = b.pos + 1),
done AS (
  SELECT w.conv_id, {_least('o', 'a', _insert('u2', 'assistant'))} AS best
  FROM (SELECT *, {_least('u', _insert('o', 'user'), _insert('s', 'user'), _insert('a', 'user'))} AS u2 FROM walk) w
  JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(d.best.c, 0)::BIGINT AS cost, coalesce(d.best.a, '') AS audit, sha256(coalesce(array_to_string(d.best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    src = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    h = F.col("h")
    damaged = src.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), (h != 0).alias("there"),
        F.explode(F.array_repeat(h, F.when(h == 3, 2).otherwise(1))).alias("copy"))
    pieces = conversation_repair.repair(damaged, present_col="there")
    return conversation_repair.conversations(pieces).withColumnRenamed("conv", "conv_id")
