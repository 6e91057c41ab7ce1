"""Building supervised training samples from chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (CHUNK_PLACEHOLDER, CLOUD_PROVIDER, DEFAULT_SYSTEM_PROMPT, DEFAULT_TOPIC_PROMPT,  # noqa: F401
                     ELLIPSIS, ERROR_LINE, FENCE, FENCE_JSON, INSTRUCTION_FORMAT, JSON_FORMAT_REQUEST, MAX_PARALLEL_REQUESTS, MAX_TOKENS,
                     MISSING, MSG_MIN_SAMPLES, MSG_NONE_SELECTED, MSG_TOO_MANY, PREVIEW_OUTPUT_CHARS, PREVIEW_SAMPLES,
                     SFT_MAX_TOKENS, STATUS_BAD_KEY, STATUS_BODY_CHARS, STATUS_CLOUD_OK, STATUS_LOCAL_OK,
                     STATUS_NO_CREDIT, STATUS_NO_MODEL, STATUS_OTHER, STYLE_LINE, STYLES, WRAP_INSTRUCTION)
from ..functions.jsonx import has_key, is_object, object_keys, strict_json, text_of
from ..functions.ordering import with_row_index
from ..functions.text import col_, fill, let, ustrip


def select_by_ids(view: DataFrame, selection: DataFrame) -> DataFrame:
    """chunks whose id is flagged in ``selection`` (``id, select``); none flagged is an error."""
    flagged = selection.where("select").select("id")
    if flagged.isEmpty():
        raise ValueError(MSG_NONE_SELECTED)
    return view.join(flagged, "id", "left_semi")


def even_sample(rows: DataFrame, k: int, order: str = "id") -> DataFrame:
    """``k`` of ``n`` rows in ``order``: every ``max(1, n // k)``-th from the first, first ``k``.
    ``k < 1`` or ``k > n`` is an error. The ordinal is distributed (range partitioned) and made of
    the unique ``order`` column alone; the other columns are fetched for the ``k`` rows only."""
    keys = rows.select(order)
    n = keys.count()
    if k < 1:
        raise ValueError(MSG_MIN_SAMPLES)
    if k > n:
        raise ValueError(MSG_TOO_MANY.format(k, n))
    step = max(1, n // k)
    r = with_row_index(keys, [order], "sample_no")
    picked = r.where((F.col("sample_no") % step == 0) & (F.floor(F.col("sample_no") / step) < k))
    return rows.join(picked, order)


def style_instruction(style) -> Column:
    """style name -> instruction text, unknown -> ``""`` (a constant map, no join)."""
    m = F.create_map(*[x for kv in STYLES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, col_(style)), F.lit(""))


def system_prompt(base, style) -> Column:
    """base prompt, the style line, its instruction and the JSON format request."""
    return F.concat(col_(base), F.lit(STYLE_LINE), col_(style), F.lit("\n"), style_instruction(style),
                    F.lit("\n\n" + JSON_FORMAT_REQUEST))


def render_prompt(template, value, placeholder: str = CHUNK_PLACEHOLDER) -> Column:
    """every ``placeholder`` in the template replaced by the value (plain text, not regex)."""
    return F.replace(col_(template), F.lit(placeholder), col_(value))


def expand_requests(topics: DataFrame, n: int) -> DataFrame:
    """``n`` requests per topic, ``request_no`` 1..n."""
    return topics.withColumn("request_no", F.explode(F.sequence(F.lit(1), F.lit(n))))


def chat_request(model, system, user, temperature) -> Column:
    """chat request JSON (system and user messages, temperature, ``max_tokens`` 500)."""
    msgs = F.array(F.struct(F.lit("system").alias("role"), col_(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), col_(user).alias("content")))
    return F.to_json(F.struct(col_(model).alias("model"), msgs.alias("messages"),
                              col_(temperature).cast("double").alias("temperature"),
                              F.lit(MAX_TOKENS).alias("max_tokens")))


def flat_request(model, system, user, temperature) -> Column:
    """F8: one-prompt request JSON: ``system + "\\n\\n" + user``, ``stream=false``, options."""
    return F.to_json(F.struct(col_(model).alias("model"),
                              F.concat(col_(system), F.lit("\n\n"), col_(user)).alias("prompt"),
                              F.lit(False).alias("stream"),
                              F.struct(col_(temperature).cast("double").alias("temperature")).alias("options")))


# ----------------------------------------------------------------------------------------------
# calling a text generator
# ----------------------------------------------------------------------------------------------

def offline_generator(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a model service: replies in the shapes real models produce
    (plain JSON, fenced JSON, prose around JSON, plain text), chosen from the prompt text."""
    out = []
    for p in prompts.fillna(""):
        words = p.split()
        head = " ".join(words[-12:]).replace('"', "'")
        kind = sum(map(ord, p[-40:])) % 4
        q = f"What does this passage say about {' '.join(words[-3:])}?".replace('"', "'")
        body = '{"instruction": "' + q + '", "output": "' + head + '"}'
        out.append([body, "```json\n" + body + "\n```", "Sure! Here it is: " + body + " Hope it helps.", head][kind])
    return pd.Series(out, dtype="string")


def generate_responses(requests: DataFrame, prompt_col: str, generate: Callable[[pd.Series], pd.Series] | None = None,
                       parallelism: int | None = None, retries: int = 3, backoff: float = 0.5) -> DataFrame:
    """add ``reply``, ``error`` and ``attempts`` by calling ``generate`` on Arrow batches.

    ``parallelism`` caps concurrent calls (one task per partition), for services with a rate limit
    (the original allowed ``MAX_PARALLEL_REQUESTS``); by default the input's partitions decide. A failing batch is retried
    with growing waits; a request that still fails gets a null reply and its error text. Tasks may
    run twice, so keep ``request_id`` in the result and deduplicate downstream if the service
    has side effects."""
    import time

    gen = generate or offline_generator
    df = requests.repartition(parallelism) if parallelism else requests
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType(list(df.schema.fields) + [StructField("reply", StringType()), StructField("error", StringType()),
                                                  StructField("attempts", IntegerType())])

    def run(batches):
        for pdf in batches:
            reply, err, tries = None, None, 0
            for attempt in range(1, retries + 1):
                tries = attempt
                try:
                    reply = gen(pdf[prompt_col]).astype("string")
                    err = None
                    break
                except Exception as e:  # noqa: BLE001 - the service's error is the result
                    err = str(e)
                    time.sleep(backoff * attempt)
            out = pdf.copy()
            out["reply"] = reply if reply is not None else pd.Series([None] * len(pdf), dtype="string")
            out["error"] = err
            out["attempts"] = tries
            yield out

    return df.mapInPandas(run, schema)


# ----------------------------------------------------------------------------------------------
# Reading replies
# ----------------------------------------------------------------------------------------------

def _sample_from(value: Column) -> Column:
    def body(v):
        return let(object_keys(v), lambda keys: F.when(
            is_object(v) & has_key(v, "instruction", keys) & has_key(v, "output", keys),
            F.struct(text_of(v, "instruction").alias("instruction"), text_of(v, "output").alias("output"))))

    return let(value, body)


def parse_reply_strict(reply) -> Column:
    """reply -> ``struct<instruction, output>`` or null.

    Whole text as JSON first; only if it is not JSON at all: the text after a ```` ```json ````
    marker up to the next fence (without a closing fence the last character is lost, as in the
    original), then from the first ``{`` to the last ``}``. Both keys are required; extra keys are
    dropped; valid JSON without both keys gives null without trying the fallbacks."""
    c = col_(reply)
    whole = strict_json(c)
    p = F.locate(FENCE_JSON, c)
    start = p + len(FENCE_JSON)
    rest = c.substr(start, F.length(c) + 1)
    e = F.instr(rest, FENCE)
    fenced = ustrip(F.when(e > 0, rest.substr(F.lit(1), e - 1)).otherwise(c.substr(start, F.length(c) - start)))
    lb = F.locate("{", c)
    rb = F.length(c) - F.locate("}", F.reverse(c)) + 1
    braces = F.when((lb > 0) & (F.locate("}", c) > 0) & (rb >= lb), c.substr(lb, rb - lb + 1)).otherwise(F.lit(""))
    a = _sample_from(strict_json(fenced))
    b = _sample_from(strict_json(braces))
    fallback = F.coalesce(F.when(p > 0, a), b)
    return let(whole, lambda w: F.when(c.isNull(), F.lit(None)).when(w.isNotNull(), _sample_from(w)).otherwise(fallback))


def parse_reply_or_wrap(reply, source) -> Column:
    """JSON object with both keys -> kept, the whole object in ``sample`` (JSON text with all of its keys;
    ``n_keys`` counts them); other JSON -> null; not JSON -> ``instruction = "Question based on
    <source>"``, ``output = reply``."""
    c = col_(reply)

    def body(v):
        def with_keys(keys):
            keep = is_object(v) & has_key(v, "instruction", keys) & has_key(v, "output", keys)
            wrapped = F.struct(fill(WRAP_INSTRUCTION, source).alias("instruction"),
                               c.alias("output"), F.lit(2).alias("n_keys"),
                               F.to_json(F.struct(fill(WRAP_INSTRUCTION, source).alias("instruction"), c.alias("output"))).alias("sample"))
            kept = F.struct(text_of(v, "instruction").alias("instruction"), text_of(v, "output").alias("output"),
                            F.size(keys).alias("n_keys"), F.to_json(v).alias("sample"))
            return F.when(c.isNull() | (c == ""), F.lit(None)).when(v.isNull(), wrapped).when(keep, kept)

        return let(object_keys(v), with_keys)

    return let(strict_json(c), body)


def generation_summary(results: DataFrame) -> DataFrame:
    """samples made, failures and success flag (the error lines are ``generation_errors``)."""
    counts = results.agg(F.count_if(F.col("sample").isNotNull()).alias("samples"),
                         F.count_if(F.col("error").isNotNull()).alias("errors"))
    return counts.withColumn("success", F.col("samples") >= 1)


def generation_errors(results: DataFrame, index: str = "request_no") -> DataFrame:
    """every error as a row ``request_no, line`` (``Sample i: <text>``); all of them, as rows, because they
    grow with the requests."""
    return results.where(F.col("error").isNotNull()).select(index, fill(ERROR_LINE, index, "error").alias("line"))


def reply_content(provider, status, body) -> Column:
    """service reply -> text. Status other than 200 -> null. Chat services: first choice's
    message content (no ``choices`` -> ``""``, empty ``choices`` -> null); generate services: the
    ``response`` field (missing -> ``""``)."""
    b = col_(body)
    choices = F.get_json_object(b, "$.choices")
    chat = (F.when(choices.isNull(), F.lit(""))
            .when(F.get_json_object(b, "$.choices[0]").isNull(), F.lit(None))
            .otherwise(F.coalesce(F.get_json_object(b, "$.choices[0].message.content"), F.lit(""))))
    gen = F.coalesce(F.get_json_object(b, "$.response"), F.lit(""))
    return F.when(col_(status) != 200, F.lit(None)).when(col_(provider) == CLOUD_PROVIDER, chat).otherwise(gen)


def classify_status(provider, status, body, model) -> Column:
    """connection-test outcome text per provider and status; body cut to 100 characters."""
    s, p = col_(status), col_(provider)
    other = fill(STATUS_OTHER, s, F.substring(col_(body), 1, STATUS_BODY_CHARS))
    cloud = (F.when(s == 200, F.lit(STATUS_CLOUD_OK))
             .when(s == 401, F.lit(STATUS_BAD_KEY)).when(s == 402, F.lit(STATUS_NO_CREDIT)).otherwise(other))
    local = (F.when(s == 200, F.lit(STATUS_LOCAL_OK)).when(s == 404, fill(STATUS_NO_MODEL, model)).otherwise(other))
    return F.when(p == CLOUD_PROVIDER, cloud).otherwise(local)


def preview_samples(samples: DataFrame, order: str = "line_no", k: int = PREVIEW_SAMPLES) -> DataFrame:
    """total and the first ``k`` samples; output cut to 200 characters plus ``...`` always;
    missing fields -> ``N/A``."""
    total = samples.select(F.count(F.lit(1))).scalar()
    first = samples.orderBy(order).limit(k)
    return first.select(order, F.coalesce("instruction", F.lit(MISSING)).alias("instruction"),
                        F.concat(F.substring(F.coalesce("output", F.lit(MISSING)), 1, PREVIEW_OUTPUT_CHARS),
                                 F.lit(ELLIPSIS)).alias("output_preview"),
                        total.alias("total"))


def format_instruction(instruction, output) -> Column:
    """F16: ``### Instruction:\\n…\\n\\n### Response:\\n…``."""
    return fill(INSTRUCTION_FORMAT, instruction, output)


def truncate_tokens(text, n: int = SFT_MAX_TOKENS, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """token list cut to ``n``; default tokenizer splits at white space."""
    from ..functions.text import WS_CLASS

    toks = tokenizer(col_(text)) if tokenizer else F.filter(F.split(col_(text), WS_CLASS + "+", -1), lambda w: w != "")
    return F.slice(toks, 1, n)


def build_dialogs(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """one ``{"messages": [{role, content}, ...]}`` line per dialog, turns in order. A dialog
    is gathered into one row (it is one training sample)."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("_t"))
    msgs = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return g.select(key, F.to_json(F.struct(msgs.alias("messages"))).alias("dialog"))


def append_dialogs(dialogs: DataFrame, path: str) -> None:
    """add dialog lines (``dialog`` JSON text) to a JSONL set; earlier lines are kept."""
    dialogs.select("dialog").write.mode("append").text(path)
