"""Queries for building training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.browse import random_select, selection_table, set_selection
from ..operators.ledger import read_ledger, record_replies, with_replies
from ..operators.samples import (DEFAULT_SYSTEM_PROMPT, DEFAULT_TOPIC_PROMPT, JSON_FORMAT_REQUEST, STYLES,
                                 build_dialogs, chat_request, classify_status, even_sample, expand_requests,
                                 flat_request, format_instruction, generate_responses, generation_errors, generation_summary,
                                 parse_reply_or_wrap, parse_reply_strict, preview_samples, render_prompt,
                                 reply_content, select_by_ids, style_instruction, system_prompt, truncate_tokens)
from ..operators.store import chunk_view
from ..session import scratch_path
from .fixtures import chunk_store, store_sql, table
from .q_chunking import WS
from .registry import query

C = store_sql("C")
PICK_SQL = f"SELECT id FROM ({C}) ORDER BY md5(CAST(id AS VARCHAR) || '#0'), id LIMIT 50"
STYLE_LIST = list(STYLES) + ["Freestyle"]
TEMPLATE = "Create one question and answer about the text below.\n\n{chunk}\n\n(Repeat: {chunk})"
MODEL = "llama3:8b"


def sql_lit(s: str) -> str:
    """A DuckDB string expression equal to ``s`` (newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


STYLE_SQL = "[" + ", ".join(sql_lit(s) for s in STYLE_LIST) + "][(id % 6) + 1]"
INSTR_SQL = "CASE style " + " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in STYLES.items()) + " ELSE '' END"
SYS_SQL = (f"{sql_lit(DEFAULT_SYSTEM_PROMPT)} || chr(10) || chr(10) || 'Style: ' || style || chr(10) || {INSTR_SQL}"
           f" || chr(10) || chr(10) || {sql_lit(JSON_FORMAT_REQUEST)}")
USER_SQL = f"replace({sql_lit(TEMPLATE)}, '{{chunk}}', chunk_text)"
PROMPTS_SQL = f"SELECT id, filename, chunk_text, style, {SYS_SQL} AS system_prompt, {USER_SQL} AS user_prompt FROM (SELECT *, {STYLE_SQL} AS style FROM ({C}))"


def _styled(spark, sf):
    s = chunk_store(spark, sf, "C")
    style = F.element_at(F.array(*[F.lit(x) for x in STYLE_LIST]), (F.col("id") % 6 + 1).cast("int"))
    return s.withColumn("style", style)


def _prompts(spark, sf):
    s = _styled(spark, sf)
    return s.select("id", "filename", "chunk_text", "style",
                    system_prompt(F.lit(DEFAULT_SYSTEM_PROMPT), F.col("style")).alias("system_prompt"),
                    render_prompt(F.lit(TEMPLATE), F.col("chunk_text")).alias("user_prompt"))


@query("select_by_ids", "F1", f"SELECT id, filename AS source, chunk_index FROM ({C}) WHERE id IN ({PICK_SQL})")
def q_select_ids(spark, sf):
    view = chunk_view(chunk_store(spark, sf, "C"))
    sel = random_select(selection_table(view), 50, seed=0)
    return select_by_ids(view, sel).select("id", "source", "chunk_index")


@query("even_sample", "F2", f"""
WITH v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM ({C})), n AS (SELECT count(*) AS n FROM v)
SELECT r AS sample_no, id FROM v, n WHERE r % greatest(1, n // 100) = 0 AND r // greatest(1, n // 100) < 100""")
def q_even(spark, sf):
    sel = set_selection(selection_table(chunk_view(chunk_store(spark, sf, "C"))), True).where("select")
    return even_sample(sel, 100, "id").select("sample_no", "id")


@query("style_lookup", "F3", f"SELECT id, style, {INSTR_SQL} AS instruction FROM (SELECT *, {STYLE_SQL} AS style FROM ({C}))")
def q_style(spark, sf):
    return _styled(spark, sf).select("id", "style", style_instruction("style").alias("instruction"))


@query("compose_system_prompt", "F4", f"SELECT id, system_prompt FROM ({PROMPTS_SQL})")
def q_system(spark, sf):
    return _prompts(spark, sf).select("id", "system_prompt")


@query("render_user_prompt", "F5", f"SELECT id, user_prompt FROM ({PROMPTS_SQL})")
def q_user(spark, sf):
    return _prompts(spark, sf).select("id", "user_prompt")


@query("expand_requests", "F6", f"""
SELECT p_partkey, request_no, replace({sql_lit(DEFAULT_TOPIC_PROMPT)}, '{{topic}}', p_name) AS prompt
FROM (SELECT p_partkey, p_name, unnest(range(1, 4)) AS request_no FROM part)""")
def q_expand(spark, sf):
    topics = table(spark, sf, "part").select("p_partkey", "p_name")
    r = expand_requests(topics, 3)
    return r.select("p_partkey", F.col("request_no").cast("long").alias("request_no"),
                    render_prompt(F.lit(DEFAULT_TOPIC_PROMPT), F.col("p_name"), "{topic}").alias("prompt"))


@query("chat_request", "F7", f"""
SELECT id, CAST(to_json({{'model': '{MODEL}', 'messages': [{{'role': 'system', 'content': system_prompt}}, {{'role': 'user', 'content': user_prompt}}],
                    'temperature': CAST(0.7 AS DOUBLE), 'max_tokens': 500}}) AS VARCHAR) AS request
FROM ({PROMPTS_SQL})""")
def q_chat(spark, sf):
    p = _prompts(spark, sf)
    return p.select("id", chat_request(F.lit(MODEL), F.col("system_prompt"), F.col("user_prompt"), F.lit(0.7)).alias("request"))


@query("flat_request", "F8", f"""
SELECT id, CAST(to_json({{'model': '{MODEL}', 'prompt': system_prompt || chr(10) || chr(10) || user_prompt, 'stream': false,
                    'options': {{'temperature': CAST(0.7 AS DOUBLE)}}}}) AS VARCHAR) AS request
FROM ({PROMPTS_SQL})""")
def q_flat(spark, sf):
    p = _prompts(spark, sf)
    return p.select("id", flat_request(F.lit(MODEL), F.col("system_prompt"), F.col("user_prompt"), F.lit(0.7)).alias("request"))


GEN_SQL = f"""
SELECT id, CASE kind WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
                     WHEN 2 THEN 'Sure! Here it is: ' || body || ' Hope it helps.' ELSE head END AS reply,
       CAST(NULL AS VARCHAR) AS error, 1 AS attempts
FROM (SELECT id, head, kind,
             '{{"instruction": "' || replace('What does this passage say about ' || array_to_string(list_slice(w, -3, -1), ' ') || '?', '"', chr(39))
             || '", "output": "' || head || '"}}' AS body
      FROM (SELECT id, w, replace(array_to_string(list_slice(w, -12, -1), ' '), '"', chr(39)) AS head,
                   list_sum(list_transform(string_split(right(prompt, 40), ''), lambda ch: unicode(ch))) % 4 AS kind
            FROM (SELECT id, prompt, list_filter(string_split_regex(prompt, '{WS}+'), lambda x: x <> '') AS w
                  FROM (SELECT id, system_prompt || chr(10) || chr(10) || user_prompt AS prompt FROM ({PROMPTS_SQL})))))"""


@query("generate_responses", "F9", GEN_SQL)
def q_generate(spark, sf):
    """Prompts of every chunk -> the offline generator on Arrow batches."""
    req = _prompts(spark, sf).select("id", F.concat("system_prompt", F.lit("\n\n"), "user_prompt").alias("prompt"))
    return generate_responses(req, "prompt").select("id", "reply", "error", "attempts")


@query("ledger_replies", "F9 (requests joined with the ledger of replies)", """
WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
r AS (SELECT q.text, min(n.text) AS reply FROM q JOIN conversations n ON n.conv_id = q.conv_id AND n.turn = q.turn + 1 AND n.role = 'assistant'
      WHERE q.conv_id % 3 <> 0 GROUP BY q.text)
SELECT q.conv_id, q.turn, r.reply, r.reply IS NOT NULL AS answered FROM q LEFT JOIN r ON q.text = r.text""")
def q_ledger(spark, sf):
    """User turns as requests; the answers that two thirds of the conversations hold are the ledger."""
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", chat_request(F.lit(MODEL), F.lit(""), F.col("text"), F.lit(0.7)).alias("request"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    path = scratch_path(spark, "ledger")
    record_replies(asked.where("conv_id % 3 <> 0").join(answer, ["conv_id", "turn"]), path)
    out = with_replies(asked, read_ledger(spark, path))
    return out.select("conv_id", "turn", "reply", F.col("reply").isNotNull().alias("answered"))


# ---------------------------------------------------------------------------------------------- replies
# Reply shapes derived from every chunk of store C: plain object, number value with extra key,
# missing key, JSON list, number, null, fenced block in prose, unclosed fence, prose around braces,
# two objects, single quotes, plain text.

def _reply_col():
    # the whole chunk text as a JSON string literal (Spark and DuckDB escape the same way)
    arr = F.to_json(F.array(F.col("chunk_text")))
    tj = arr.substr(F.lit(2), F.length(arr) - 2)
    k = F.col("id") % 12
    L = F.lit
    shapes = [
        F.concat(L('{"instruction": "About this passage?", "output": '), tj, L("}")),
        F.concat(L('{"instruction": 7, "output": '), tj, L(', "difficulty": "easy"}')),
        F.concat(L('{"instruction": '), tj, L("}")),
        L('["instruction", "output"]'),
        L("42"),
        L("null"),
        F.concat(L('Here you go:\n```json\n{"instruction": "F", "output": '), tj, L('}\n```\nDone.')),
        F.concat(L('Sure ```json {"instruction": "U", "output": '), tj, L("}}")),
        F.concat(L('The answer is {"instruction": "P", "output": '), tj, L("} as requested.")),
        L('{"instruction": "X", "output": "Y"} {"instruction": "Z", "output": "W"}'),
        L("{'instruction': 'S', 'output': 'T'}"),
        F.col("chunk_text"),
    ]
    expr = None
    for i, sh in enumerate(shapes):
        expr = F.when(k == i, sh) if expr is None else expr.when(k == i, sh)
    return expr


REPLY_SQL = """CASE id % 12
  WHEN 0 THEN '{"instruction": "About this passage?", "output": ' || tj || '}'
  WHEN 1 THEN '{"instruction": 7, "output": ' || tj || ', "difficulty": "easy"}'
  WHEN 2 THEN '{"instruction": ' || tj || '}'
  WHEN 3 THEN '["instruction", "output"]'
  WHEN 4 THEN '42'
  WHEN 5 THEN 'null'
  WHEN 6 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '{"instruction": "F", "output": ' || tj || '}' || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 7 THEN 'Sure ```json {"instruction": "U", "output": ' || tj || '}}'
  WHEN 8 THEN 'The answer is {"instruction": "P", "output": ' || tj || '} as requested.'
  WHEN 9 THEN '{"instruction": "X", "output": "Y"} {"instruction": "Z", "output": "W"}'
  WHEN 10 THEN '{''instruction'': ''S'', ''output'': ''T''}'
  ELSE chunk_text END"""
REPLIES_SQL = f"SELECT id, filename, {REPLY_SQL} AS reply FROM (SELECT id, filename, chunk_text, CAST(to_json(chunk_text) AS VARCHAR) AS tj FROM ({C}))"


def _ok(j):
    return (f"(json_valid({j}) AND json_type({j}) = 'OBJECT' AND json_exists({j}, '$.instruction') "
            f"AND json_exists({j}, '$.output'))")


def _text_of(j, k):
    return (f"CASE json_type({j}, '$.{k}') WHEN 'VARCHAR' THEN json_extract_string({j}, '$.{k}') WHEN 'NULL' THEN NULL "
            f"ELSE CAST(json_extract({j}, '$.{k}') AS VARCHAR) END")


STRICT_SQL = f"""
WITH r AS ({REPLIES_SQL}),
c AS (SELECT id, reply, strpos(reply, '```json') AS p,
             CASE WHEN strpos(reply, '{{') > 0 AND strpos(reply, '}}') > 0
                       AND length(reply) - strpos(reverse(reply), '}}') + 1 >= strpos(reply, '{{')
                  THEN substring(reply, strpos(reply, '{{'), length(reply) - strpos(reverse(reply), '}}') + 1 - strpos(reply, '{{') + 1)
                  ELSE '' END AS braces
      FROM r),
f AS (SELECT *, regexp_replace(CASE WHEN strpos(substring(reply, p + 7), '```') > 0
                                    THEN substring(reply, p + 7, strpos(substring(reply, p + 7), '```') - 1)
                                    ELSE substring(reply, p + 7, length(reply) - (p + 7)) END,
                               '^{WS}+|{WS}+$', '', 'g') AS fenced FROM c),
s AS (SELECT id, CASE WHEN reply IS NULL THEN NULL
                      WHEN json_valid(reply) THEN CASE WHEN {_ok('reply')} THEN reply END
                      WHEN p > 0 AND {_ok('fenced')} THEN fenced
                      WHEN {_ok('braces')} THEN braces END AS j FROM f)
SELECT id, {_text_of('j', 'instruction')} AS instruction, {_text_of('j', 'output')} AS output FROM s"""


def _strict(spark, sf):
    r = chunk_store(spark, sf, "C").select("id", "filename", _reply_col().alias("reply"))
    return r.withColumn("sample", parse_reply_strict("reply"))


@query("parse_reply_strict", "F10", STRICT_SQL)
def q_strict(spark, sf):
    return _strict(spark, sf).select("id", F.col("sample.instruction").alias("instruction"),
                                     F.col("sample.output").alias("output"))


@query("parse_reply_or_wrap", "F11", f"""
WITH r AS ({REPLIES_SQL})
SELECT id,
       CASE WHEN reply IS NULL OR reply = '' THEN NULL WHEN NOT json_valid(reply) THEN 'Question based on ' || filename
            WHEN {_ok('reply')} THEN {_text_of('reply', 'instruction')} END AS instruction,
       CASE WHEN reply IS NULL OR reply = '' THEN NULL WHEN NOT json_valid(reply) THEN reply
            WHEN {_ok('reply')} THEN {_text_of('reply', 'output')} END AS output,
       CAST(CASE WHEN reply IS NULL OR reply = '' THEN NULL WHEN NOT json_valid(reply) THEN 2
            WHEN {_ok('reply')} THEN len(json_keys(reply)) END AS INTEGER) AS n_keys
FROM r""")
def q_wrap(spark, sf):
    r = chunk_store(spark, sf, "C").select("id", "filename", _reply_col().alias("reply"))
    s = r.select("id", parse_reply_or_wrap("reply", "filename").alias("s"))
    return s.select("id", F.col("s.instruction").alias("instruction"), F.col("s.output").alias("output"),
                    F.col("s.n_keys").alias("n_keys"))


@query("generation_summary", "F12", f"""
WITH s AS ({STRICT_SQL}), e AS (SELECT id FROM s WHERE instruction IS NULL AND output IS NULL)
SELECT (SELECT count(*) FROM s WHERE NOT (instruction IS NULL AND output IS NULL)) AS samples,
       (SELECT count(*) FROM e) AS errors,
       (SELECT count(*) FROM s WHERE NOT (instruction IS NULL AND output IS NULL)) >= 1 AS success""")
def q_gen_summary(spark, sf):
    return generation_summary(_results(spark, sf))


@query("generation_errors", "F12", f"""
SELECT id AS request_no, 'Sample ' || CAST(id AS VARCHAR) || ': Unparseable reply' AS line
FROM ({STRICT_SQL}) WHERE instruction IS NULL AND output IS NULL""")
def q_gen_errors(spark, sf):
    return generation_errors(_results(spark, sf))


def _results(spark, sf):
    return _strict(spark, sf).select(F.col("id").alias("request_no"), "sample",
                                     F.when(F.col("sample").isNull(), F.lit("Unparseable reply")).alias("error"))


EVENTS_REPLY_SQL = """
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'openrouter' ELSE 'ollama' END AS provider,
       CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status,
       CASE event_type
         WHEN 'click' THEN '{"choices":[{"message":{"content":"click ' || json_extract_string(props, '$.k') || '"}}]}'
         WHEN 'view' THEN '{"choices":[]}'
         WHEN 'purchase' THEN '{"id":"x"}'
         WHEN 'signup' THEN '{"response":"signup ' || json_extract_string(props, '$.k') || '"}'
         ELSE '{"done":true}' END AS body
FROM events"""


@query("extract_reply_content", "F13", f"""
SELECT event_id,
       CASE WHEN status <> 200 THEN NULL
            WHEN provider = 'openrouter' THEN
              CASE WHEN json_extract(body, '$.choices') IS NULL THEN ''
                   WHEN json_extract(body, '$.choices[0]') IS NULL THEN NULL
                   ELSE coalesce(json_extract_string(body, '$.choices[0].message.content'), '') END
            ELSE coalesce(json_extract_string(body, '$.response'), '') END AS content
FROM ({EVENTS_REPLY_SQL})""")
def q_reply_content(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    et = F.col("event_type")
    body = (F.when(et == "click", F.concat(F.lit('{"choices":[{"message":{"content":"click '), k, F.lit('"}}]}')))
            .when(et == "view", F.lit('{"choices":[]}')).when(et == "purchase", F.lit('{"id":"x"}'))
            .when(et == "signup", F.concat(F.lit('{"response":"signup '), k, F.lit('"}'))).otherwise(F.lit('{"done":true}')))
    r = e.select("event_id", F.when(et.isin("click", "view", "purchase"), F.lit("openrouter")).otherwise(F.lit("ollama")).alias("provider"),
                 F.when(et == "error", F.lit(503)).otherwise(F.lit(200)).alias("status"), body.alias("body"))
    return r.select("event_id", reply_content("provider", "status", "body").alias("content"))


@query("classify_api_status", "F14", """
SELECT event_id,
       CASE WHEN provider = 'openrouter' THEN
              CASE status WHEN 200 THEN ' OpenRouter connection successful' WHEN 401 THEN 'L Invalid API key'
                          WHEN 402 THEN 'L Insufficient credits' ELSE 'L Error ' || CAST(status AS VARCHAR) || ': ' || substring(props, 1, 100) END
            ELSE CASE status WHEN 200 THEN ' Ollama connection successful'
                             WHEN 404 THEN 'L Model ''' || model || ''' not found. Run: ollama pull ' || model
                             ELSE 'L Error ' || CAST(status AS VARCHAR) || ': ' || substring(props, 1, 100) END END AS outcome
FROM (SELECT event_id, props, 'model-' || CAST(user_id AS VARCHAR) AS model,
             CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'openrouter' ELSE 'ollama' END AS provider,
             CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 401 WHEN 'purchase' THEN 402 WHEN 'signup' THEN 404 ELSE 500 END AS status
      FROM events)""")
def q_classify(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    status = (F.when(et == "click", 200).when(et == "view", 401).when(et == "purchase", 402)
              .when(et == "signup", 404).otherwise(500))
    provider = F.when(et.isin("click", "view", "purchase"), F.lit("openrouter")).otherwise(F.lit("ollama"))
    model = F.concat(F.lit("model-"), F.col("user_id").cast("string"))
    return e.select("event_id", classify_status(provider, status, F.col("props"), model).alias("outcome"))


PAIRS_SQL = """
SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"])


@query("format_instruction", "F16", f"""
SELECT conv_id, turn, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text
FROM ({PAIRS_SQL})""")
def q_format(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", format_instruction("instruction", "output").alias("text"))


@query("preview_samples", "F15", f"""
SELECT line_no, coalesce(instruction, 'N/A') AS instruction, substring(coalesce(output, 'N/A'), 1, 200) || '...' AS output_preview,
       (SELECT count(*) FROM ({PAIRS_SQL})) AS total
FROM (SELECT conv_id * 4294967296 + turn AS line_no, instruction, output FROM ({PAIRS_SQL}) ORDER BY line_no LIMIT 5)""")
def q_preview_samples(spark, sf):
    p = _pairs(spark, sf).select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("line_no"), "instruction", "output")
    return preview_samples(p, "line_no", 5)


@query("truncate_tokens", "F17", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS text
FROM (SELECT doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '')[1:512] AS t FROM documents)""")
def q_truncate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", truncate_tokens("text", 512).alias("t"))
    return d.select("doc_id", F.size("t").cast("int").alias("n_tokens"), F.array_join("t", " ").alias("text"))


@query("build_dialogs", "F18", """
SELECT conv_id, CAST(to_json({'messages': list({'role': role, 'content': text} ORDER BY turn)}) AS VARCHAR) AS dialog
FROM conversations GROUP BY conv_id""")
def q_dialogs(spark, sf):
    return build_dialogs(table(spark, sf, "conversations"))
