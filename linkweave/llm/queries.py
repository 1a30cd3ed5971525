"""Registered queries of the training-text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import ann, bpe, decontaminate, html_extract, language_id, line_dedup, quality, simhash, substring, toxicity
from linkweave.llm import secret_scan, vector_codes, whitening
from linkweave.llm.common import held_out, table


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def line_dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id > first_doc, false) AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.train_and_identify(docs).withColumn("held_out", held_out(F.col("doc_id")))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def substring_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 34], ' ')) AS hash
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS pos FROM split)
), repeated AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY hash) > 1 AS hit FROM windows
), marked AS (
  SELECT w.doc_id, w.pos, word, coalesce(bool_or(hit) OVER (
    PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.pos = r.pos
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(CAST(gone AS BIGINT)) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def leaked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    best = F.get("leaks", F.lit(0))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.transform("leaks", lambda leak: leak["item_id"]).alias("item_ids"),
        best["item_id"].alias("best_item"),
        best["overlap"].alias("overlap"),
        best["question_overlap"].alias("question_overlap"),
        best["answer_overlap"].alias("answer_overlap"),
        best["score"].alias("score"),
    )


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.slice("neighbours", 1, 3).alias("nearest_examples"),
    )


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality", "good")


def vector_codes_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _vector_codes_sql() -> str:
    """K-means round by round as a chain of tables; lengths must be a multiple of the number of parts."""
    n_parts, scale = vector_codes.PARTS, vector_codes.SCALE
    far = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, len(v) + 1)])"
    chain = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), parts AS MATERIALIZED (
  SELECT rid, p, x[p * (len(x) // {n_parts}) + 1:(p + 1) * (len(x) // {n_parts})] AS v FROM kept, range({n_parts}) t(p)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e, min(rid) AS rid FROM kept GROUP BY vec_id ORDER BY vec_id LIMIT {vector_codes.ENTRIES}
), books0 AS MATERIALIZED (SELECT p, e, v AS c FROM firsts JOIN parts USING (rid))"""]
    for k in range(vector_codes.ROUNDS + 1):
        chain.append(f"""near{k} AS MATERIALIZED (
  SELECT rid, p, any_value(v) AS v, min({{'d': {far}, 'e': e}}) AS best FROM parts JOIN books{k} USING (p) GROUP BY rid, p
)""")
        if k < vector_codes.ROUNDS:
            chain.append(f"""sums{k} AS (
  SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, best.e AS e, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, e, i
), means{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM sums{k} GROUP BY p, e
), books{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM books{k} LEFT JOIN means{k} USING (p, e))""")
    last = f"near{vector_codes.ROUNDS}"
    chain.append(f"""coded AS MATERIALIZED (
  SELECT rid, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM {last} GROUP BY rid
), labelled AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (rid) GROUP BY label
), digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{vector_codes.ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) JOIN labelled l ON l.label IS NOT DISTINCT FROM kept.label, digest""")
    return ",\n".join(chain)


def secrets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, secret_scan.train(secret_scan.labelled_samples(docs)))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("markov"),
        F.sha2(F.encode(F.array_join(F.transform(base, place), ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", place), ",").alias("spans"),
    )


def _secrets_sql() -> str:
    """Places as running sums over pieces and matches; the models as tables of transitions."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    s = secret_scan
    assign, run, mask = q(s.ASSIGN), q(f"{s.RUN}{{{s.SCORED_CHARS},}}"), "chr(1)"
    kept = f"length(m) > 0 AND length(regexp_extract(m, {assign}, 2)) >= {s.ASSIGN_CHARS}"

    def placed(name: str, text: str, pattern: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT rid, m, CAST(sum(length(before) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop FROM (
    SELECT rid, unnest(list_append(regexp_extract_all({text}, {pattern}), '')) AS m, unnest(string_split_regex({text}, {pattern})) AS before,
      unnest(range(len(string_split_regex({text}, {pattern})))) AS i FROM docs WHERE regexp_matches({text}, {pattern})))"""

    hidden = f"CASE WHEN {kept} THEN repeat({mask}, length(m)) ELSE m END"
    return f"""WITH plain AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), hidden AS (
  SELECT rid, string_agg(before || {hidden}, '' ORDER BY i) AS masked FROM (
    SELECT rid, unnest(list_append(regexp_extract_all(text, {assign}), '')) AS m, unnest(string_split_regex(text, {assign})) AS before,
      unnest(range(len(string_split_regex(text, {assign})))) AS i FROM plain WHERE regexp_matches(text, {assign})) GROUP BY rid
), docs AS MATERIALIZED (SELECT rid, doc_id, text, coalesce(masked, text) AS masked FROM plain LEFT JOIN hidden USING (rid)
), {placed('given', 'text', assign)}, {placed('keys', 'text', q(s.ACCESS))}, {placed('digits', 'text', q(s.HEX))}, {placed('runs', 'masked', run)},
samples AS MATERIALIZED (
  SELECT DISTINCT value, random FROM (
    SELECT regexp_extract(m, {assign}, 2) AS value, true AS random FROM given WHERE {kept}
    UNION ALL SELECT m, true FROM keys WHERE m <> '' UNION ALL SELECT m, true FROM digits WHERE m <> '')
  WHERE regexp_matches(value, '[0-9]')
  UNION ALL
  SELECT DISTINCT value, false FROM (SELECT unnest(regexp_extract_all(masked, {q(f"{s.RUN}{{{s.ORDINARY_CHARS},}}")})) AS value FROM docs)
  WHERE length(value) < {s.SCORED_CHARS} AND NOT contains(value, {mask})
), steps AS (
  SELECT random, w[i] AS a, w[i + 1] AS b FROM (
    SELECT random, '{s.START}' || value AS w, unnest(range(1, length(value) + 1)) AS i FROM samples)
), counts AS MATERIALIZED (
  SELECT a, b, count(*) FILTER (WHERE random) AS r, count(*) FILTER (WHERE NOT random) AS o FROM steps GROUP BY a, b
), totals AS MATERIALIZED (SELECT a, sum(r) AS r, sum(o) AS o FROM counts GROUP BY a
), limits AS (
  SELECT CAST(round({s.MILLI} * ln((coalesce(sum(o), 0) + 1) / (coalesce(sum(r), 0) + 1) * {s.ODDS})) AS BIGINT) AS least FROM totals WHERE a = '{s.START}'
), wanted AS MATERIALIZED (
  SELECT row_number() OVER () AS k, rid, m, stop FROM runs
  WHERE m <> '' AND NOT contains(m, {mask}) AND regexp_matches(m, '{s.LETTER}') AND NOT regexp_matches(m, {q(f"{s.HEX}|{s.ACCESS}")})
), scores AS (
  SELECT k, sum(CAST(round({s.MILLI} * ln(
    ((coalesce(c.r, 0) + 1) / (coalesce(t.r, 0) + {s.ALPHABET})) / ((coalesce(c.o, 0) + 1) / (coalesce(t.o, 0) + {s.ALPHABET})))) AS BIGINT)) AS score
  FROM (SELECT k, w[i] AS a, w[i + 1] AS b FROM (SELECT k, '{s.START}' || m AS w, unnest(range(1, length(m) + 1)) AS i FROM wanted)) x
  LEFT JOIN counts c USING (a, b) LEFT JOIN totals t USING (a) GROUP BY k
), spans AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, stop - length(m) AS start, stop FROM given WHERE {kept}
  UNION ALL SELECT rid, 'access', 1, stop - length(m), stop FROM keys WHERE m <> ''
  UNION ALL SELECT rid, 'hex', 2, stop - length(m), stop FROM digits WHERE m <> ''
  UNION ALL SELECT rid, 'markov', 3, stop - length(m), stop FROM wanted JOIN scores USING (k), limits WHERE score > least
), joined AS (
  SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
    count(*) FILTER (WHERE rank = 2) AS n_hex, count(*) FILTER (WHERE rank = 3) AS n_markov,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_markov, 0) AS n_markov, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)"""


def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`deviation` is null where it leaves 64 bits; the operator itself gives it with 38 digits."""
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    shares = F.array(*[F.lit(v) for v in (model.explained if model else [])]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(model.n if model else None).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_of_documents,
    "op2_toxicity": toxic_documents,
    "op3_html_extract": page_text,
    "op4_simhash": simhash_components,
    "op5_line_dedup": line_dedup_kept,
    "op6_learned_partitions": nearest_vectors,
    "op7_decontaminate": leaked_documents,
    "op8_quality": document_quality,
    "op9_substring_dedup": substring_kept,
    "op10_bpe_codec": bpe_codec,
    "op11_vector_codes": vector_codes_of_embeddings,
    "op12_secret_scan": secrets_of_documents,
    "op13_whitening": whitened_embeddings,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op9_substring_dedup": SUBSTRING_SQL,
    "op11_vector_codes": _vector_codes_sql(),
    "op12_secret_scan": _secrets_sql(),
}
