"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benthos.llm import best_fit, chat, exact_dedup, fingerprints, html_text, language_model, lexical, licenses, near_dedup, packing, periodic, quality, sentencepiece_codec
from benthos.session import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; whether that gave the text back."""
    return sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, read back from their formatted text."""
    control = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat.chat_digests(chat.format_conversations(rows))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearDedup(shingle=3, threshold=85))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that saw no label of the held-out fifth."""
    docs, held = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, after passages of one document in ten are made to repeat."""
    docs = table(spark, sf_dir, "documents")
    edited = docs.select("doc_id", periodic.repeat_passages(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.run_digests(periodic.periodic_runs(edited, least=12))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, limit=1024)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_sentencepiece, op2_chat_format, op3_near_dedup, op4_exact_dedup, op5_quality, op6_language_model, op7_html_text, op8_packing, op9_license_scan, op10_fingerprint, op11_periodic_runs, op12_best_fit, op13_lexical_search, pipeline]
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(21 + length(role) + length(text)
      + (length(role || text) - length(replace(role, '\', '')) - length(replace(text, '\', '')))
      + (length(role || '|' || text) - length(replace(role || '|' || text, '<s>', 'ss')))
      + (length(role || '|' || text) - length(replace(role || '|' || text, '</s>', '/ss')))
      + (length(role || '|' || text) - length(replace(role || '|' || text, '[INST]', 'INST.')))
      + (length(role || '|' || text) - length(replace(role || '|' || text, '[/INST]', 'INST..')))) AS formatted
  FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(told) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars FROM g"""

OP3_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 3
      THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.k + y.k - shared)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm ORDER BY size DESC, doc_id)"""


OP11_SQL = r"""
WITH w0 AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, CAST(doc_id AS VARCHAR) AS name FROM documents),
h AS MATERIALIZED (
  SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(name) + 1), lambda i: [CAST(ord(substr(name, CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384))) AS h FROM w0),
p AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE ws END AS ws FROM p),
g AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM w WHERE n >= 12)),
m AS MATERIALIZED (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
c AS MATERIALIZED (
  SELECT doc_id, min(i) AS start, count(*) + 5 + q AS length, q AS period FROM s GROUP BY doc_id, q, island
  HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
r AS MATERIALIZED (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.doc_id = c.doc_id AND d.period < c.period AND c.period % d.period = 0
    AND d.start <= c.start AND d.start + d.length >= c.start + c.length)),
o AS (
  SELECT doc_id, count(*) AS n_runs, list(struct_pack(s := start + period, e := start + length)) AS gone,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
    first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(gone, lambda x: i >= x.s AND i < x.e)) = 0), lambda i: ws[i + 1]) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN o ON o.doc_id = w.doc_id"""

OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
a AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
q AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
f AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY t, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN w USING (t), a GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def _license_sql() -> str:
    rows = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.TEMPLATES.items())
    words = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]))"
    return f"""
WITH t AS (SELECT template, {grams} AS g FROM (SELECT template, {words.format('notice')} AS ws FROM (VALUES {rows}) v(template, notice))),
d AS (SELECT doc_id, unnest({grams}) AS x FROM (SELECT doc_id, {words.format('text')} AS ws FROM documents)),
u AS (SELECT template, len(g) AS n, unnest(g) AS x FROM t)
SELECT doc_id, template, CAST(n AS BIGINT) AS n_shingles, count(*) AS n_found, count(*) / n AS containment
FROM d JOIN u ON d.x = u.x GROUP BY doc_id, template, n HAVING count(*) >= 0.8 * n - 1e-9"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_near_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op9_license_scan": _license_sql(), "op11_periodic_runs": OP11_SQL, "op13_lexical_search": OP13_SQL}
