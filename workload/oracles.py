"""SQL counterparts of the registered queries, over the plain tables.

Written independently of the Spark operators: overlap by counting exploded tokens,
positions by one global ``row_number``, medians by the built-in aggregate.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# White space, word separators and articles, as SQL regular expressions.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def clean(x: str) -> str:
    prefix = rf"(?i)\A(?:answer|assistant){SPACE}*:"
    return strip(f"regexp_replace({strip(f'coalesce({x}, {chr(39) * 2})')}, '{prefix}', '')")


def tokens(x: str) -> str:
    words = rf"string_split_regex(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+')"
    return f"list_filter({words}, lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


FLASHCARDS = """flashcards AS (
  SELECT u.conv_id * 1000000000 + u.turn AS example_id, 'Answer the question.' AS instruction,
         u.text AS input,
         CASE WHEN (u.conv_id * 1000000000 + u.turn) % 97 = 0 THEN '' ELSE a.text END AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
MODELS = """models AS (SELECT * FROM (VALUES ('org/echo', 1.0), ('org/lead', 1.0),
  ('org/parrot', 0.5), ('org/blank', 0.5)) AS m(model_id, alpha))"""
PREDICTIONS = """predictions AS (
  SELECT model_id, example_id, input AS question, output AS reference_answer,
         CASE model_id WHEN 'org/echo' THEN 'Answer: ' || output
                       WHEN 'org/lead' THEN input || ' ' || output
                       WHEN 'org/parrot' THEN input
                       ELSE CASE WHEN example_id % 2 = 0 THEN ''
                                 ELSE 'assistant :  The ' || output END END AS raw_generation
  FROM flashcards CROSS JOIN models)"""
REEVALUATED = """reevaluated AS (
  SELECT model_id, example_id, input AS question, output AS reference_answer,
         CASE model_id WHEN 'org/lead' THEN output || ' ' || output
                       ELSE 'Assistant: ' || input END AS raw_generation
  FROM flashcards CROSS JOIN models WHERE model_id IN ('org/lead', 'org/blank'))"""
LOW_PRECISION = """low_precision AS (
  SELECT model_id, example_id, question, reference_answer,
         raw_generation || ' ' || question AS raw_generation FROM predictions)"""
LINEAGE = """lineage AS (SELECT * FROM (VALUES ('org/parrot', 'org/parrot', 'base', 'small'),
  ('org/lead', 'org/parrot', 'tuned', 'small'), ('org/echo', 'org/echo', 'base', 'large'),
  ('org/blank', 'org/echo', 'tuned', 'large')) AS r(model_id, base_model, setup, size_class))"""


def overlap(source: str, out: str, key: str, left: str, right: str) -> str:
    """Counts ``nl, nr, o`` of two text columns per key, by exploding and counting tokens."""
    return f"""{out}_l AS (SELECT {key}, tok, count(*) AS c FROM
  (SELECT {key}, unnest({tokens(left)}) AS tok FROM {source}) GROUP BY {key}, tok),
{out}_r AS (SELECT {key}, tok, count(*) AS c FROM
  (SELECT {key}, unnest({tokens(right)}) AS tok FROM {source}) GROUP BY {key}, tok),
{out}_o AS (SELECT {key}, sum(least(l.c, r.c)) AS o
  FROM {out}_l l JOIN {out}_r r USING ({key}, tok) GROUP BY {key}),
{out} AS (SELECT s.*, len({tokens('s.' + left)}) AS nl, len({tokens('s.' + right)}) AS nr,
  coalesce(o, 0) AS o FROM {source} s LEFT JOIN {out}_o USING ({key}))"""


F1 = "CASE WHEN nl + nr = 0 THEN 1.0 ELSE CAST(2 * o AS DOUBLE) / (nl + nr) END"


def scored(source: str, out: str) -> str:
    return f"""{out}_clean AS (SELECT model_id, example_id, question,
  {clean('raw_generation')} AS generated_answer, {clean('reference_answer')} AS reference_answer
  FROM {source}),
{overlap(out + '_clean', out + '_counts', 'model_id, example_id', 'generated_answer', 'reference_answer')},
{out} AS (SELECT *, {F1} AS token_f1 FROM {out}_counts)"""


def board(source: str, out: str) -> str:
    return f"""{out} AS (SELECT model_id, count(*) AS n, avg(token_f1) AS token_f1_mean,
  stddev_samp(token_f1) AS token_f1_std FROM {source} GROUP BY model_id)"""


BASE = (FLASHCARDS, MODELS, PREDICTIONS)
SCORED = (*BASE, scored("predictions", "scored"))
BOARDS = (*SCORED, board("scored", "board"), REEVALUATED, scored("reevaluated", "again"),
          board("again", "board2"))
PLAIN = "model_id, n, round(token_f1_mean, 6) AS token_f1_mean, round(token_f1_std, 6) AS token_f1_std"

# Text metrics -------------------------------------------------------------------------

ORACLES["leaderboard_flagship"] = with_(*SCORED, board("scored", "board")) + f"""SELECT {PLAIN},
  row_number() OVER (ORDER BY token_f1_mean DESC, model_id) AS rank FROM board"""
ORACLES["clean_answer"] = with_(*BASE) + f"""SELECT model_id, example_id,
  {clean("chr(32) || chr(10) || raw_generation || ' ' || chr(9) || chr(12288)")} AS cleaned FROM predictions"""
ORACLES["answer_tokens"] = f"""SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens,
  md5(array_to_string(tokens, '|')) AS tokens_md5
FROM (SELECT doc_id, {tokens('text')} AS tokens FROM documents)"""
ORACLES["normalize_answer"] = with_(*BASE) + f"""SELECT model_id, example_id,
  array_to_string({tokens('raw_generation')}, ' ') AS normalized FROM predictions"""
ORACLES["token_f1_pairs"] = with_(*SCORED) + """SELECT model_id, example_id,
  CAST(o AS BIGINT) AS overlap,
  round(CASE WHEN nl > 0 THEN CAST(o AS DOUBLE) / nl END, 6) AS token_precision,
  round(CASE WHEN nr > 0 THEN CAST(o AS DOUBLE) / nr END, 6) AS token_recall,
  round(token_f1, 6) AS token_f1 FROM scored"""
ORACLES["token_f1_documents"] = with_(
    """pairs AS (SELECT d.doc_id, d.text, f.text AS following FROM documents d
  JOIN documents f ON f.doc_id = d.doc_id + 1)""",
    overlap("pairs", "counts", "doc_id", "text", "following"),
) + f"SELECT doc_id, round({F1}, 6) AS token_f1 FROM counts"
ORACLES["multiset_overlap"] = with_(
    *BASE, overlap("predictions", "counts", "model_id, example_id", "question", "raw_generation")
) + "SELECT model_id, example_id, CAST(o AS BIGINT) AS shared_tokens FROM counts"

# Splits, samples, positions -----------------------------------------------------------


def seeded(seed: int, row_id: str) -> str:
    return f"md5('{seed}:' || CAST({row_id} AS VARCHAR)), {row_id}"


SPLIT_DOCUMENTS = f"""ranked AS (SELECT doc_id, lang, n_chars,
  row_number() OVER (ORDER BY {seeded(42, 'doc_id')}) AS r, count(*) OVER () AS n FROM documents),
split_documents AS (SELECT doc_id, lang, n_chars, CASE WHEN r <= floor(n * 0.6) THEN 'train'
  WHEN r <= floor(n * 0.6) + floor((n - floor(n * 0.6)) / 2) THEN 'validation'
  ELSE 'test' END AS split FROM ranked)"""
SPLIT_FLASHCARDS = f"""ranked AS (SELECT *,
  row_number() OVER (ORDER BY {seeded(42, 'example_id')}) AS r, count(*) OVER () AS n FROM flashcards),
split_flashcards AS (SELECT example_id, instruction, input, output,
  CASE WHEN r <= floor(n * 0.6) THEN 'train'
  WHEN r <= floor(n * 0.6) + floor((n - floor(n * 0.6)) / 2) THEN 'validation'
  ELSE 'test' END AS split FROM ranked)"""

ORACLES["seeded_sample"] = f"""SELECT doc_id, lang, n_chars FROM documents
ORDER BY {seeded(42, 'doc_id')} LIMIT 500"""
ORACLES["seeded_sample_large"] = f"""SELECT o_orderkey, o_custkey FROM orders
ORDER BY {seeded(7, 'o_orderkey')} LIMIT 12000"""
ORACLES["seeded_shuffle"] = f"""SELECT doc_id, lang,
  row_number() OVER (ORDER BY {seeded(7, 'doc_id')}) - 1 AS position FROM documents"""
ORACLES["split_exact"] = with_(SPLIT_DOCUMENTS) + "SELECT doc_id, split FROM split_documents"
ORACLES["split_sizes"] = with_(
    SPLIT_DOCUMENTS,
    """counts AS (SELECT lang || ':' || split AS split, count(*) AS rows
  FROM split_documents GROUP BY ALL)""",
    "wanted AS (SELECT * FROM (VALUES ('en:train', 1), ('en:dev', 0)) AS w(split, expected))",
) + """SELECT split, coalesce(rows, 0) AS rows, CAST(expected AS BIGINT) AS expected,
  coalesce(coalesce(rows, 0) = expected, false) AS ok FROM counts FULL JOIN wanted USING (split)"""
ORACLES["split_caps"] = with_(SPLIT_DOCUMENTS) + f"""SELECT doc_id, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {seeded(42, 'doc_id')}) AS k
  FROM (SELECT doc_id, CASE WHEN split = 'test' AND lang = 'fr' THEN NULL ELSE split END AS split
    FROM split_documents))
WHERE split IS NULL OR split = 'test' OR (split = 'train' AND k <= 300) OR (split = 'validation' AND k <= 50)"""
ORACLES["dense_index"] = f"""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
  ORDER BY {seeded(42, 'doc_id')}) - 1 AS example_index FROM documents"""
ORACLES["positional_index"] = """SELECT event_type, event_id, row_number() OVER (
  PARTITION BY event_type ORDER BY event_id) - 1 AS example_index FROM events"""
ORACLES["batches"] = f"""SELECT doc_id, example_index,
  CAST(floor(example_index / 32) AS BIGINT) AS batch_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {seeded(42, 'doc_id')}) - 1 AS example_index
  FROM documents)"""

# Chat examples ------------------------------------------------------------------------

SYSTEM = "'You are an expert on every subject.' || chr(10) || instruction"

ORACLES["chat_examples"] = with_(FLASHCARDS) + f"""SELECT example_id, 'system,user' AS roles,
  {SYSTEM} AS system_text, input AS user_text, output AS assistant_text FROM flashcards"""
ORACLES["chat_passthrough"] = with_(FLASHCARDS) + f"""SELECT example_id,
  CAST(length(input) AS BIGINT) AS extra, {SYSTEM} AS system_text FROM flashcards"""
ORACLES["incomplete_rows"] = with_(FLASHCARDS) + """SELECT example_id, length(output) > 0 AS kept
FROM flashcards"""
ORACLES["question_reference"] = with_(FLASHCARDS) + f"""SELECT example_id, input AS question,
  {clean('output')} AS reference_answer FROM flashcards"""
RENDERED = f"""rendered AS (SELECT model_id, example_id, output, split, input, CASE model_id
  WHEN 'org/echo' THEN '<|system|>' || chr(10) || system_text || '<|end|>' || chr(10)
    || '<|user|>' || chr(10) || input || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)
  WHEN 'org/lead' THEN '[system] ' || system_text || chr(10) || '[user] ' || input || chr(10)
    || '[assistant] <think></think>'
  WHEN 'org/parrot' THEN 'system: ' || system_text || chr(10) || chr(10) || 'user: ' || input
    || chr(10) || chr(10) || 'assistant: '
  ELSE '## system' || chr(10) || system_text || chr(10) || '## user' || chr(10) || input
    || chr(10) || '## assistant' || chr(10) || '/no_think' || chr(10) END AS rendered
  FROM (SELECT *, {SYSTEM} AS system_text FROM split_flashcards) CROSS JOIN models)"""
ORACLES["render_prompt"] = with_(FLASHCARDS, MODELS, SPLIT_FLASHCARDS, RENDERED) + """
SELECT model_id, example_id, rendered FROM rendered"""
ORACLES["split_filter"] = with_(FLASHCARDS, SPLIT_FLASHCARDS) + """SELECT * FROM split_flashcards
WHERE split = 'validation'"""

# Data set sources ---------------------------------------------------------------------

ORACLES["publish_splits"] = with_(FLASHCARDS, SPLIT_FLASHCARDS) + "SELECT * FROM split_flashcards"
ORACLES["source_revision"] = with_(FLASHCARDS, SPLIT_FLASHCARDS) + """SELECT split,
  upper(split) AS output, count(*) AS newest_rows, CAST(sum(length(output)) AS BIGINT) AS first_chars
FROM split_flashcards GROUP BY split"""
ORACLES["prepared_dataset"] = with_(FLASHCARDS, SPLIT_FLASHCARDS) + f"""SELECT split, example_id,
  input AS question, {clean('output')} AS reference_answer FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {seeded(42, 'example_id')}) AS k
  FROM split_flashcards)
WHERE split = 'test' OR (split = 'train' AND k <= 100) OR (split = 'validation' AND k <= 20)"""

# Scores -------------------------------------------------------------------------------


def cosine(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    dot = "list_inner_product"
    return f"{dot}({a}, {b}) / (sqrt({dot}({a}, {a})) * sqrt({dot}({b}, {b})))"


VEC_PAIRS = f"""vec_pairs AS (SELECT a.vec_id AS example_id,
  CASE WHEN a.vec_id % 50 <> 0 THEN {cosine('a.embedding', 'b.embedding')} END AS answer_similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
UNIGRAM = f"""unigram AS (SELECT tok, count(*) AS c FROM
  (SELECT unnest({tokens('text')}) AS tok FROM documents) GROUP BY tok),
totals AS (SELECT sum(c) AS n, count(*) AS v FROM unigram),
token_logprobs AS (SELECT model_id, example_id,
  ln((coalesce(c, 0) + CAST(alpha AS DOUBLE)) / (n + CAST(alpha AS DOUBLE) * (v + 1))) AS logprob
  FROM (SELECT example_id, unnest({tokens(clean('output'))}) AS tok FROM flashcards) t
  LEFT JOIN unigram USING (tok) CROSS JOIN totals CROSS JOIN models)"""
SCORES = """reference_scores AS (SELECT model_id, example_id,
  sum(logprob) AS reference_answer_logprob_sum, -avg(logprob) AS reference_answer_nll_mean,
  exp(-avg(logprob)) AS reference_answer_token_perplexity,
  count(logprob) AS reference_answer_tokens
  FROM (SELECT model_id, example_id FROM flashcards CROSS JOIN models)
  LEFT JOIN token_logprobs USING (model_id, example_id) GROUP BY model_id, example_id)"""


def full_board(source: str) -> str:
    return f"""SELECT model_id, count(*) AS n, round(avg(token_f1), 6) AS token_f1_mean,
  round(stddev_samp(token_f1), 6) AS token_f1_std,
  round(avg(answer_similarity), 6) AS answer_similarity_mean,
  round(stddev_samp(answer_similarity), 6) AS answer_similarity_std,
  round(avg(reference_answer_nll_mean), 6) AS reference_answer_nll_mean,
  round(stddev_samp(reference_answer_nll_mean), 6) AS reference_answer_nll_std,
  round(avg(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_mean,
  round(stddev_samp(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_std,
  round(median(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_median,
  round(avg(reference_answer_tokens), 6) AS reference_answer_tokens_mean,
  round(stddev_samp(reference_answer_tokens), 6) AS reference_answer_tokens_std
FROM {source} GROUP BY model_id"""


def similarity(source: str, out: str) -> str:
    return f"""{out} AS (SELECT s.model_id, s.example_id, s.token_f1,
  v.answer_similarity FROM {source} s
  LEFT JOIN vec_pairs v ON v.example_id = (s.example_id // 1000000000 * 31
    + s.example_id % 1000000000) % (SELECT count(*) FROM embeddings))"""


WITH_SIMILARITY = similarity("scored", "with_similarity")

ORACLES["embedding_cosine"] = with_(VEC_PAIRS) + """SELECT example_id,
  round(answer_similarity, 6) AS answer_similarity FROM vec_pairs"""
ORACLES["valid_pairs"] = with_(*SCORED) + """SELECT model_id, example_id,
  length(generated_answer) > 0 AND length(reference_answer) > 0 AS valid FROM scored"""
ORACLES["reference_scores"] = with_(FLASHCARDS, MODELS, UNIGRAM, SCORES) + """SELECT model_id,
  example_id, round(reference_answer_logprob_sum, 6) AS reference_answer_logprob_sum,
  round(reference_answer_nll_mean, 6) AS reference_answer_nll_mean,
  round(reference_answer_token_perplexity, 4) AS reference_answer_token_perplexity,
  reference_answer_tokens FROM reference_scores"""
ORACLES["scored_predictions"] = with_(*SCORED, UNIGRAM, SCORES) + """SELECT model_id, example_id,
  generated_answer, round(token_f1, 6) AS token_f1,
  round(reference_answer_nll_mean, 6) AS reference_answer_nll_mean
FROM scored LEFT JOIN reference_scores USING (model_id, example_id)"""
ORACLES["summary_full"] = with_(
    *SCORED, VEC_PAIRS, UNIGRAM, SCORES, WITH_SIMILARITY,
    """full_scores AS (SELECT * FROM with_similarity
  LEFT JOIN reference_scores USING (model_id, example_id))""",
) + full_board("full_scores")
ORACLES["summary_minimal"] = with_(*SCORED, board("scored", "board")) + f"""SELECT {PLAIN},
  CAST(NULL AS DOUBLE) AS answer_similarity_mean, CAST(NULL AS DOUBLE) AS answer_similarity_std
FROM board"""
ORACLES["exact_median"] = """SELECT event_type, round(median(value), 6) AS value_median
FROM events GROUP BY event_type"""

# Token arrays -------------------------------------------------------------------------

TOKEN_ARRAYS = """token_arrays AS (SELECT user_id, CAST(floor(event_id / 1000) AS INT) AS chunk,
  CASE WHEN user_id % 5 <> 0 THEN 2 END AS eos_id, CASE WHEN user_id % 10 <> 0 THEN 0 END AS pad_id,
  list(CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END ORDER BY event_id) AS ids
  FROM events GROUP BY ALL)"""
ORACLES["token_count"] = with_(TOKEN_ARRAYS) + """SELECT user_id, chunk, CAST(
  CASE WHEN eos_id IS NOT NULL AND list_contains(ids, eos_id) THEN list_position(ids, eos_id)
       WHEN pad_id IS NOT NULL THEN len(list_filter(ids, lambda t: t <> 0))
       ELSE len(ids) END AS BIGINT) AS generated_tokens FROM token_arrays"""
ORACLES["span_slice"] = with_(TOKEN_ARRAYS) + """SELECT user_id, chunk,
  array_to_string(ids[user_id % 3 + 2:], ',') AS new_ids,
  coalesce(list_sum(list_transform(ids[user_id % 3 + 1:user_id % 3 + 2], lambda t: -t / 4.0)), 0.0)
    AS target_sum FROM token_arrays"""
ORACLES["pad_default"] = with_(TOKEN_ARRAYS) + """SELECT user_id, chunk,
  CAST(coalesce(pad_id, eos_id) AS BIGINT) AS pad_id FROM token_arrays"""

# Telemetry ----------------------------------------------------------------------------

BATCH_ROWS = """batch_rows AS (SELECT 'm' || CAST(user_id % 5 AS VARCHAR) AS model_id,
  CAST(floor(event_id / 32) AS BIGINT) AS batch_id, event_type AS device,
  CASE WHEN user_id % 5 = 4 THEN 0.0 ELSE value / 100 END AS inference_seconds,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS generated_tokens,
  CASE WHEN user_id % 5 <> 3 THEN value / 1000 END AS reference_seconds,
  CAST(floor(value) AS BIGINT) * 1048576 AS memory_bytes FROM events)"""
RUN_TELEMETRY = """run_telemetry AS (SELECT model_id, g + coalesce(r, 0) AS total_inference_seconds,
  g AS generation_inference_seconds, t AS generation_tokens,
  CASE WHEN g > 0 THEN t / g END AS generation_tokens_per_second,
  r AS reference_logprob_inference_seconds,
  CASE WHEN r > 0 THEN n / r END AS reference_logprob_examples_per_second
  FROM (SELECT model_id, sum(inference_seconds) AS g, CAST(sum(generated_tokens) AS BIGINT) AS t,
    sum(reference_seconds) AS r, count(*) AS n FROM batch_rows GROUP BY model_id))"""
PEAK_MEMORY = """peak_memory AS (SELECT model_id,
  CAST(sum(peak) AS DOUBLE) / 1048576 AS vram_peak_allocated_mb,
  CAST(sum(2 * peak) AS DOUBLE) / 1048576 AS vram_peak_reserved_mb
  FROM (SELECT model_id, device, max(memory_bytes) AS peak FROM batch_rows GROUP BY ALL)
  GROUP BY model_id)"""

ORACLES["batch_rates"] = with_(BATCH_ROWS) + """SELECT model_id, batch_id,
  round(s, 6) AS inference_seconds, t AS generated_tokens,
  round(CASE WHEN s > 0 THEN t / s END, 6) AS tokens_per_second
FROM (SELECT model_id, batch_id, sum(inference_seconds) AS s,
  CAST(sum(generated_tokens) AS BIGINT) AS t FROM batch_rows GROUP BY ALL)"""
ORACLES["run_telemetry"] = with_(BATCH_ROWS, RUN_TELEMETRY) + """SELECT model_id,
  round(total_inference_seconds, 6) AS total_inference_seconds,
  round(generation_inference_seconds, 6) AS generation_inference_seconds, generation_tokens,
  round(generation_tokens_per_second, 6) AS generation_tokens_per_second,
  round(reference_logprob_inference_seconds, 6) AS reference_logprob_inference_seconds,
  round(reference_logprob_examples_per_second, 6) AS reference_logprob_examples_per_second
FROM run_telemetry"""
ORACLES["run_telemetry_without_reference"] = with_(BATCH_ROWS, RUN_TELEMETRY) + """SELECT model_id,
  round(generation_inference_seconds, 6) AS total_inference_seconds,
  round(generation_inference_seconds, 6) AS generation_inference_seconds, generation_tokens,
  round(generation_tokens_per_second, 6) AS generation_tokens_per_second,
  CAST(NULL AS DOUBLE) AS reference_logprob_inference_seconds,
  CAST(NULL AS DOUBLE) AS reference_logprob_examples_per_second
FROM run_telemetry"""
ORACLES["peak_memory"] = with_(BATCH_ROWS, PEAK_MEMORY) + """SELECT model_id,
  round(vram_peak_allocated_mb, 6) AS vram_peak_allocated_mb,
  round(vram_peak_reserved_mb, 6) AS vram_peak_reserved_mb FROM peak_memory"""
ORACLES["summary_telemetry"] = with_(BATCH_ROWS, RUN_TELEMETRY, PEAK_MEMORY) + """SELECT s.model_id,
  s.n, round(s.f, 6) AS token_f1_mean, t.generation_tokens,
  round(t.total_inference_seconds, 6) AS total_inference_seconds,
  round(p.vram_peak_reserved_mb, 6) AS vram_peak_reserved_mb
FROM (SELECT 'm' || CAST(user_id % 7 AS VARCHAR) AS model_id, count(*) AS n,
  avg(value / 1000) AS f FROM events GROUP BY ALL) s
LEFT JOIN run_telemetry t USING (model_id) LEFT JOIN peak_memory p USING (model_id)"""

# Leaderboards -------------------------------------------------------------------------

MERGED = """merged AS (SELECT *, 1 AS version, NULL AS note FROM board
  WHERE model_id NOT IN (SELECT model_id FROM board2)
  UNION ALL SELECT *, 2 AS version, 'again' AS note FROM board2)"""

ORACLES["leaderboard_upsert"] = with_(*BOARDS, MERGED) + f"""SELECT {PLAIN},
  CAST(version AS BIGINT) AS version, note FROM merged"""
ORACLES["keep_last"] = """SELECT run_id, base_model, step, eval_loss FROM (
  SELECT user_id AS run_id, 'b' || CAST(user_id % 3 AS VARCHAR) AS base_model, event_id AS step,
    value AS eval_loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
  FROM events) WHERE r = 1"""
ORACLES["leaderboard_rebuild"] = with_(*BOARDS) + f"SELECT {PLAIN} FROM board2"
ORACLES["schema_union"] = with_(*BOARDS) + f"""SELECT {PLAIN}, 'first' AS run, NULL AS note FROM board
UNION ALL SELECT {PLAIN}, 'second' AS run, 'again' AS note FROM board2"""
ORACLES["leaderboard_concat"] = with_(*BOARDS) + f"""SELECT {PLAIN}, NULL AS note FROM board
UNION ALL SELECT {PLAIN}, 'again' AS note FROM board2"""
ORACLES["model_slug"] = with_(*BASE) + """SELECT replace(model_id, '/', '__') AS file_slug,
  replace(model_id, '/', '_') AS run_slug, count(*) AS n FROM predictions GROUP BY model_id"""
ORACLES["write_read_predictions"] = with_(*BASE, REEVALUATED) + """SELECT *,
  replace(model_id, '/', '__') AS model_slug FROM (
  SELECT * FROM predictions WHERE model_id IN ('org/echo', 'org/parrot')
  UNION ALL SELECT * FROM reevaluated)"""
ORACLES["write_read_predictions_csv"] = ORACLES["write_read_predictions"]
ORACLES["write_read_leaderboard"] = with_(*BOARDS, MERGED) + f"SELECT {PLAIN} FROM merged"

# Comparisons --------------------------------------------------------------------------

FINGERPRINTS = """fingerprints AS (SELECT model_id,
  bit_xor(CAST('0x' || substr(md5('test:' || CAST(example_id AS VARCHAR)), 1, 15) AS BIGINT))
    AS fingerprint, count(*) AS examples FROM predictions GROUP BY model_id)"""
SETUPS = """setups AS (SELECT model_id, a.token_f1_mean AS l, b.token_f1_mean AS r
  FROM board a FULL JOIN board_low b USING (model_id))"""
LOW = (*SCORED, board("scored", "board"), LOW_PRECISION, scored("low_precision", "low"),
       board("low", "board_low"), SETUPS)

ORACLES["sample_fingerprint"] = with_(*BASE, FINGERPRINTS) + "SELECT * FROM fingerprints"
ORACLES["tuned_gain"] = with_(*SCORED, board("scored", "board"), LINEAGE, FINGERPRINTS) + """SELECT
  l.base_model, l.model_id, round(t.token_f1_mean, 6) AS tuned, round(b.token_f1_mean, 6) AS base,
  round(t.token_f1_mean - b.token_f1_mean, 6) AS gain,
  f.fingerprint = g.fingerprint AND f.examples = g.examples AS same_sample
FROM lineage l JOIN board t ON t.model_id = l.model_id JOIN board b ON b.model_id = l.base_model
JOIN fingerprints f ON f.model_id = l.model_id JOIN fingerprints g ON g.model_id = l.base_model
WHERE l.setup = 'tuned'"""
ORACLES["quant_compare"] = with_(*LOW) + """SELECT model_id, round(l, 6) AS token_f1_mean_left,
  round(r, 6) AS token_f1_mean_right, round(r - l, 6) AS token_f1_mean_change FROM setups"""
ORACLES["quant_means"] = with_(*LOW) + """SELECT round(avg(l), 6) AS token_f1_mean_left,
  round(avg(r), 6) AS token_f1_mean_right,
  round(100 * (avg(r) / avg(l) - 1), 6) AS token_f1_mean_change_percent FROM setups"""
ORACLES["top_candidates"] = with_(*SCORED, board("scored", "board"), LINEAGE) + """SELECT size_class,
  model_id, round(token_f1_mean, 6) AS token_f1_mean FROM (SELECT *, row_number() OVER (
    PARTITION BY size_class ORDER BY token_f1_mean DESC NULLS LAST, model_id) AS k
  FROM board JOIN lineage USING (model_id)) WHERE k = 1"""
ORACLES["cross_model_means"] = with_(*SCORED, board("scored", "board")) + """SELECT
  count(*) AS models, round(avg(token_f1_mean), 6) AS token_f1_mean_avg,
  round(avg(token_f1_std), 6) AS token_f1_std_avg FROM board"""
MEMORY_SETUPS = """memory_setups AS (SELECT model_id, vram_peak_reserved_mb AS l,
  CASE WHEN model_id <> 'm4' THEN vram_peak_reserved_mb * CAST(0.44 AS DOUBLE) END AS r
  FROM peak_memory)"""
ORACLES["quant_memory"] = with_(BATCH_ROWS, PEAK_MEMORY, MEMORY_SETUPS) + """SELECT model_id,
  round(l, 6) AS vram_peak_reserved_mb_left, round(r, 6) AS vram_peak_reserved_mb_right,
  round(r - l, 6) AS vram_peak_reserved_mb_change FROM memory_setups"""
ORACLES["quant_memory_means"] = with_(BATCH_ROWS, PEAK_MEMORY, MEMORY_SETUPS) + """SELECT
  round(avg(l), 6) AS vram_peak_reserved_mb_left, round(avg(r), 6) AS vram_peak_reserved_mb_right,
  round(100 * (avg(r) / avg(l) - 1), 6) AS vram_peak_reserved_mb_change_percent
FROM memory_setups"""
ORACLES["cross_model_telemetry"] = with_(BATCH_ROWS, RUN_TELEMETRY, PEAK_MEMORY) + """SELECT
  count(*) AS models, round(avg(vram_peak_reserved_mb), 6) AS vram_peak_reserved_mb_avg,
  round(avg(vram_peak_allocated_mb), 6) AS vram_peak_allocated_mb_avg,
  round(avg(generation_tokens_per_second), 6) AS generation_tokens_per_second_avg
FROM run_telemetry JOIN peak_memory USING (model_id)"""
ORACLES["quant_similarity"] = with_(
    *SCORED, VEC_PAIRS, WITH_SIMILARITY, LOW_PRECISION, scored("low_precision", "low_scored"),
    similarity("low_scored", "low_similarity"),
    """boards AS (SELECT model_id, avg(a.token_f1) AS fl, avg(b.token_f1) AS fr,
  avg(a.answer_similarity) AS sl, avg(b.answer_similarity) AS sr
  FROM with_similarity a JOIN low_similarity b USING (model_id, example_id) GROUP BY model_id)""",
) + """SELECT round(avg(fl), 6) AS token_f1_mean_left, round(avg(fr), 6) AS token_f1_mean_right,
  round(avg(sl), 6) AS answer_similarity_mean_left, round(avg(sr), 6) AS answer_similarity_mean_right,
  round(100 * (avg(fr) / avg(fl) - 1), 6) AS token_f1_mean_change_percent,
  round(100 * (avg(sr) / avg(sl) - 1), 6) AS answer_similarity_mean_change_percent FROM boards"""
ORACLES["disagreement_report"] = with_(*SCORED, VEC_PAIRS, WITH_SIMILARITY) + """SELECT model_id,
  example_id, round(token_f1, 6) AS token_f1, round(answer_similarity, 6) AS answer_similarity,
  round(gap, 6) AS gap, gap_rank FROM (SELECT *, row_number() OVER (
    PARTITION BY model_id ORDER BY gap DESC, example_id) AS gap_rank FROM (
    SELECT *, token_f1 - answer_similarity AS gap FROM with_similarity
    WHERE token_f1 >= 0.8 AND answer_similarity <= 0.0)) WHERE gap_rank <= 20"""

# Training logs ------------------------------------------------------------------------

ORACLES["best_checkpoint"] = """SELECT user_id AS run_id, event_id AS step, value AS eval_loss
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events)
WHERE r = 1"""
ORACLES["best_trial"] = """SELECT base_model, user_id AS run_id, value AS eval_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY base_model ORDER BY value, user_id) AS r FROM (
    SELECT *, 'b' || CAST(user_id % 3 AS VARCHAR) AS base_model FROM events)) WHERE r = 1"""
ORACLES["early_stop"] = """WITH log AS (SELECT user_id AS run_id, event_id AS step,
  value AS loss, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS evaluations,
  min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
waits AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN pos END) OVER (
  PARTITION BY run_id ORDER BY pos) AS last FROM log),
stops AS (SELECT run_id, min(pos) AS pos FROM waits WHERE pos - last >= 5 GROUP BY run_id)
SELECT r.run_id, r.evaluations, s.pos AS stop_position, l.step AS stop_step
FROM (SELECT DISTINCT run_id, evaluations FROM log) r LEFT JOIN stops s USING (run_id)
LEFT JOIN log l ON l.run_id = s.run_id AND l.pos = s.pos"""

# Model hooks --------------------------------------------------------------------------


def generation(prompt: str) -> str:
    return f"'Answer: ' || replace({prompt}, '?', '.') || ' [' || model_id || ']'"


def words(x: str) -> str:
    return f"CAST(length({x}) - length(replace({x}, ' ', '')) + 1 AS BIGINT)"


def word_scores(x: str) -> str:
    return f"""list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''),
    lambda w: -length(w) / CAST(8.0 AS DOUBLE))"""


def stub_scores(source: str, out: str) -> str:
    return f"""{out} AS (SELECT model_id, example_id, len(lp) AS reference_answer_tokens,
  list_sum(lp) AS reference_answer_logprob_sum, -list_sum(lp) / len(lp) AS reference_answer_nll_mean,
  exp(-list_sum(lp) / len(lp)) AS reference_answer_token_perplexity
  FROM (SELECT model_id, example_id, {word_scores('reference_answer')} AS lp FROM {source}))"""


def stub_vector(x: str) -> str:
    counts = ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in "entaiosr")
    raw = f"CAST([{counts}, 1] AS DOUBLE[])"
    return f"""list_transform({raw}, lambda c: CAST(c / sqrt(list_inner_product({raw}, {raw})) AS FLOAT))"""


def stub_similarity(generated: str, reference: str) -> str:
    return f"""CASE WHEN length({generated}) > 0 AND length({reference}) > 0
  THEN {cosine(stub_vector(generated), stub_vector(reference))} END"""


REQUESTS = f"""requests AS (SELECT model_id, example_id, input AS prompt,
  {clean('output')} AS reference_answer FROM flashcards CROSS JOIN models)"""
GENERATED = f"generated AS (SELECT *, {generation('prompt')} AS raw_generation FROM requests)"
HOOKED = (FLASHCARDS, MODELS, REQUESTS, GENERATED)

ORACLES["generate_hook"] = with_(*HOOKED) + f"""SELECT model_id, example_id, raw_generation,
  {words('raw_generation')} AS generated_tokens FROM generated"""
ORACLES["generate_resumed"] = ORACLES["generate_hook"]
ORACLES["generation_accounting"] = with_(*HOOKED) + f"""SELECT model_id,
  CAST(sum({words('raw_generation')}) AS BIGINT) AS generation_tokens, true AS timed, true AS batched
FROM generated GROUP BY model_id"""
ORACLES["scorer_hook"] = with_(FLASHCARDS, MODELS, REQUESTS, stub_scores("requests", "stub")) + """
SELECT model_id, example_id, reference_answer_tokens,
  round(reference_answer_logprob_sum, 6) AS reference_answer_logprob_sum,
  round(reference_answer_nll_mean, 6) AS reference_answer_nll_mean,
  round(reference_answer_token_perplexity, 4) AS reference_answer_token_perplexity FROM stub"""
ORACLES["embed_hook"] = with_(*SCORED) + f"""SELECT model_id, example_id,
  round({stub_similarity('generated_answer', 'reference_answer')}, 6) AS answer_similarity
FROM scored"""
ORACLES["error_isolation"] = with_(*HOOKED) + """SELECT model_id,
  CASE WHEN model_id <> 'org/blank' THEN count(*) END AS kept_examples,
  CASE WHEN model_id = 'org/blank' THEN count(*) END AS failed_examples,
  CASE WHEN model_id = 'org/blank' THEN 'RuntimeError(''model not found'')' END AS error
FROM generated GROUP BY model_id"""
ORACLES["benchmark_run"] = with_(
    FLASHCARDS, MODELS, SPLIT_FLASHCARDS, RENDERED,
    f"""answered AS (SELECT model_id, example_id, input AS question, output AS reference_answer,
  {generation('rendered')} AS raw_generation FROM rendered
  WHERE split = 'validation' AND model_id <> 'org/blank')""",
    scored("answered", "scored"),
    stub_scores("scored", "stub"),
    f"""everything AS (SELECT *, {words('raw_generation')} AS generated_tokens,
  {stub_similarity('generated_answer', 'reference_answer')} AS answer_similarity
  FROM scored JOIN stub USING (model_id, example_id)
  JOIN (SELECT model_id, example_id, raw_generation FROM answered) USING (model_id, example_id))""",
) + """SELECT model_id, count(*) AS n, round(avg(token_f1), 5) AS token_f1_mean,
  round(stddev_samp(token_f1), 5) AS token_f1_std,
  round(avg(answer_similarity), 5) AS answer_similarity_mean,
  round(stddev_samp(answer_similarity), 5) AS answer_similarity_std,
  round(avg(reference_answer_nll_mean), 5) AS reference_answer_nll_mean,
  round(avg(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_mean,
  round(stddev_samp(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_std,
  round(median(reference_answer_token_perplexity), 4) AS reference_answer_token_perplexity_median,
  round(avg(reference_answer_tokens), 5) AS reference_answer_tokens_mean,
  round(stddev_samp(reference_answer_tokens), 5) AS reference_answer_tokens_std,
  CAST(sum(generated_tokens) AS BIGINT) AS generation_tokens
FROM everything GROUP BY model_id"""

# Streaming ----------------------------------------------------------------------------

ORACLES["stream_leaderboard"] = with_(*BOARDS, MERGED) + f"SELECT {PLAIN} FROM merged"

# Run configurations -------------------------------------------------------------------

BASE_KV = """base_kv AS (SELECT o_orderkey AS run_id, k.key,
  CASE k.key WHEN 'training.status' THEN o_orderstatus WHEN 'training.priority' THEN o_orderpriority
    ELSE CAST(o_custkey % 4 AS VARCHAR) END AS value
  FROM orders CROSS JOIN (VALUES ('training.status'), ('training.priority'), ('lora.r')) AS k(key))"""
OVERRIDE_KV = """override_kv AS (SELECT o_orderkey AS run_id, k.key,
  CASE WHEN k.key <> 'training.status' OR o_orderstatus <> 'F' THEN 'O' END AS value
  FROM orders CROSS JOIN (VALUES ('training.status'), ('new.key'), ('nodot')) AS k(key)
  WHERE o_orderpriority = '1-URGENT')"""

ORACLES["flatten_record"] = """SELECT o_orderkey AS run_id, o_orderstatus AS "training.status",
  o_orderpriority AS "training.priority.level", o_custkey AS "lora.r" FROM orders"""
ORACLES["override_merge"] = with_(BASE_KV, OVERRIDE_KV) + """SELECT run_id, key,
  coalesce(o.value, b.value) AS value FROM base_kv b FULL JOIN (SELECT * FROM override_kv
  WHERE value IS NOT NULL AND key LIKE '%.%') o USING (run_id, key)"""
ORACLES["layered_merge"] = with_(BASE_KV, OVERRIDE_KV) + """SELECT run_id, key, value FROM override_kv
UNION ALL SELECT run_id, key, value FROM base_kv b WHERE NOT EXISTS (
  SELECT 1 FROM override_kv o WHERE o.run_id = b.run_id AND o.key = b.key)"""
ORACLES["section_merge"] = with_(BASE_KV) + """SELECT run_id, key, value FROM base_kv
WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT o_orderkey, 'lora.r.init', 'zero' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT o_orderkey, 'training', o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW'"""
ORACLES["changed_keys"] = with_(BASE_KV, OVERRIDE_KV) + """SELECT run_id, key, o.value FROM override_kv o
JOIN base_kv b USING (run_id, key) WHERE o.value IS DISTINCT FROM b.value"""

OVERRIDE_STRINGS = """override_strings AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 6 WHEN 0 THEN l_returnflag WHEN 1 THEN 'TRUE'
    WHEN 2 THEN CAST(l_partkey AS VARCHAR) WHEN 3 THEN '1e-4' WHEN 4 THEN '5d' ELSE 'a=b' END AS value
  FROM lineitem)"""
ORACLES["parse_override"] = with_(OVERRIDE_STRINGS) + """SELECT l_orderkey, l_linenumber, l_partkey,
  l_suppkey, 'training.k' AS key, value, CAST(NULL AS VARCHAR) AS error FROM override_strings"""
ORACLES["parse_scalar"] = with_(OVERRIDE_STRINGS) + r"""SELECT l_orderkey, l_linenumber, l_partkey,
  l_suppkey, kind, CASE WHEN kind = 'bool' THEN lower(value) = 'true' END AS b,
  CASE WHEN kind = 'int' THEN CAST(value AS BIGINT) END AS i,
  CASE WHEN kind = 'float' THEN CAST(value AS DOUBLE) END AS d,
  CASE WHEN kind = 'string' THEN value END AS s
FROM (SELECT *, CASE WHEN lower(value) IN ('true', 'false') THEN 'bool'
  WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'int'
  WHEN regexp_full_match(value, '[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?') THEN 'float'
  ELSE 'string' END AS kind FROM override_strings)"""
