"""Batch generation around a pluggable language model (LLM-3..9).

No model or network ships here: :func:`batch_generate` calls any client
``(prompts, params) -> replies`` inside ``mapInPandas`` (client built once
per partition, bounded batches, retries, errors kept in a column), and
:class:`StubClient` is a deterministic stand-in for tests.
"""

from __future__ import annotations

import hashlib
import json
import sys
import time
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize
from docloom.functions.replies import fenced_json_text, json_field, json_int, json_is_valid, labelled_field

# Default generation settings of the hosted-model backend.
HOSTED_DEFAULTS = {"temperature": "0.01", "max_tokens": "75", "top_p": "0.97", "n": "1", "stop": '["\\n","\\n\\n"]'}
# OpenAI-style setting names -> Hugging Face generate names.
RENAMES = {"n": "num_return_sequences", "frequency_penalty": "repetition_penalty",
           "presence_penalty": "diversity_penalty", "max_tokens": "max_new_tokens"}


# JSON types of settings that are not strings; ``stop`` holds a JSON list.
SETTING_TYPES = {"int": ("n", "best_of", "num_return_sequences", "max_tokens", "max_new_tokens", "top_k", "seed", "truncate"),
                 "double": ("temperature", "top_p", "typical_p", "frequency_penalty", "presence_penalty", "repetition_penalty",
                            "diversity_penalty"),
                 "boolean": ("do_sample", "details", "return_full_text", "watermark")}


def settings_json(params: Column) -> Column:
    """JSON object of a string map of settings, keys ascending, each value in
    the type its name has (numbers, booleans, ``stop`` as a list); others as strings."""
    def typed(k, v):
        """The value's JSON text if it is of the type that its name has, else null."""
        number = v.try_cast("double")
        finite = F.when(F.abs(number) <= F.lit(sys.float_info.max), number.cast("string"))            # NaN is above all numbers
        return (F.when(k.isin(*SETTING_TYPES["int"]), v.try_cast("int").cast("string"))
                .when(k.isin(*SETTING_TYPES["double"]), finite)
                .when(k.isin(*SETTING_TYPES["boolean"]), v.try_cast("boolean").cast("string")))

    def member(e):
        k, v = e["key"], e["value"]
        quoted = F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")         # escapes as JSON asks for
        return F.concat(F.lit('"'), k, F.lit('":'), F.when(v.isNull(), F.lit("null")).when(k == "stop", v).otherwise(
            F.coalesce(typed(k, v), quoted)))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.map_entries(params)), member), ","), F.lit("}"))


def _map_lit(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(str(v)))])


def overlay(defaults: Column, call: Column) -> Column:
    """Defaults overlaid by call values (call wins), no duplicate keys."""
    return F.map_zip_with(defaults, call, lambda k, a, b: F.coalesce(b, a))


def to_hf(params: Column) -> Column:
    """Rename OpenAI-style keys, ``repetition_penalty = 1 - frequency_penalty``,
    drop ``model``, keep the rest."""
    own = F.map_filter(params, lambda k, v: ~k.isin("model", *RENAMES))

    def rename(k):
        c = F.when(k == "n", F.lit(RENAMES["n"]))
        for src in ("frequency_penalty", "presence_penalty", "max_tokens"):
            c = c.when(k == src, F.lit(RENAMES[src]))
        return c

    renamed = F.map_from_entries(F.transform(F.filter(F.map_entries(params), lambda e: e["key"].isin(*RENAMES)), lambda e: F.struct(
        rename(e["key"]).alias("key"), F.when(e["key"] == "frequency_penalty", (F.lit(1.0) - e["value"].cast("double")).cast("string"))
        .otherwise(e["value"]).alias("value"))))
    # a setting given under both names: the one already in the target's spelling wins, a null too
    both = F.map_zip_with(F.transform_values(own, lambda k, v: F.struct(v.alias("v"))), renamed,
                          lambda k, a, b: F.when(a.isNotNull(), a["v"]).otherwise(b))
    return F.map_from_entries(F.sort_array(F.map_entries(both)))


def prompt_text(df: DataFrame, prompt_col: str) -> Column:
    """A message-list prompt contributes its first message's content."""
    dt = df.schema[prompt_col].dataType.simpleString()
    if dt.startswith("array<struct"):
        return F.element_at(F.col(prompt_col), 1)["content"]
    return F.col(prompt_col)


def build_requests(df: DataFrame, prompt_col: str = "prompt", params_col: str | None = "params",
                   defaults: dict | None = None, backend: str = "hosted", id_col: str = "request_id") -> DataFrame:
    """Prompt table + per-row setting maps -> (request_id, inputs, parameters, payload).

    ``hosted``: ``do_sample``/``details`` when n > 1, ``best_of`` = n, temperature
    floored at 0.1, then renamed. ``local``: defaults and call settings are
    renamed separately and overlaid; ``do_sample`` when the *call* asks for
    n > 1 or temperature > 0.1."""
    call = F.col(params_col) if params_col else F.create_map().cast("map<string,string>")
    call = F.coalesce(call, F.create_map().cast("map<string,string>"))
    # helper columns: what is used more than once is a column, else it would be computed again in each place
    rows = df.select(F.col(id_col).alias("request_id"), prompt_text(df, prompt_col).alias("inputs"), call.alias("_call"))
    if backend == "hosted":
        rows = rows.withColumn("_merged", overlay(_map_lit(HOSTED_DEFAULTS if defaults is None else defaults), F.col("_call")))
        rows = rows.withColumn("_n", F.coalesce(F.col("_merged")["n"].cast("int"), F.lit(1)))
        many = F.when(F.col("_n") > 1, "true").otherwise("false")
        flags = F.create_map(F.lit("do_sample"), many, F.lit("best_of"), F.col("_n").cast("string"), F.lit("details"), many)
        rows = rows.withColumn("_params", to_hf(overlay(flags, F.col("_merged"))))
        t = F.col("_params")["temperature"].cast("double")
        params = overlay(F.col("_params"), F.create_map(F.lit("temperature"), F.greatest(F.lit(0.1), F.coalesce(t, F.lit(0.1))).cast("string")))
    elif backend == "local":
        rows = rows.withColumn("_merged", overlay(to_hf(_map_lit(defaults or {})), to_hf(F.col("_call"))))
        sample = (F.coalesce(F.col("_call")["n"].cast("int"), F.lit(1)) > 1) | (
            F.coalesce(F.col("_call")["temperature"].cast("double"), F.lit(0.0)) > 0.1)
        params = F.when(sample, overlay(F.col("_merged"), F.create_map(F.lit("do_sample"), F.lit("true")))).otherwise(F.col("_merged"))
    else:
        raise ValueError(f"unknown backend {backend!r}")
    out = rows.select("request_id", "inputs", params.alias("parameters"), F.to_json(F.struct("inputs")).alias("_json"))
    inputs = F.col("_json")
    return out.select("request_id", "inputs", "parameters", F.concat(F.substring(inputs, F.lit(1), F.length(inputs) - 1),
                                              F.when(inputs == "{}", F.lit("")).otherwise(F.lit(",")), F.lit('"parameters":'),
                                              settings_json(F.col("parameters")), F.lit("}")).alias("payload"))


class StubClient:
    """Deterministic stand-in model: the reply is ``stub:`` + the first 8 hex
    of md5(prompt); with n > 1 extra sequences follow with a suffix."""

    def __init__(self, **_):
        pass

    def __call__(self, prompts: list[str], params: list[dict]) -> list[str]:
        out = []
        for p, kw in zip(prompts, params):
            h = hashlib.md5((p or "").encode("utf-8")).hexdigest()[:8]
            n = int(float((kw or {}).get("num_return_sequences", (kw or {}).get("n", 1)) or 1))
            doc = {"generated_text": f"stub:{h}"}
            if n > 1:
                doc["details"] = {"best_of_sequences": [{"generated_text": f"stub:{h}:{i}"} for i in range(1, n)]}
            out.append(json.dumps(doc))
        return out


def batch_generate(requests: DataFrame, client_factory: Callable[[], Callable] = StubClient, batch_size: int = 32,
                   retries: int = 2, backoff_s: float = 0.5) -> DataFrame:
    """(request_id, inputs, parameters) -> + (raw STRING, error STRING).

    The client is built once per partition; each bounded batch is one call;
    a failing batch is retried, then its rows get the error and NULL raw.
    Materialise the result before parsing so a retried Spark task does not
    repeat paid calls."""
    cols = requests.columns

    def run(batches):
        client = client_factory()
        for pdf in batches:
            raws, errs = [], []
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                params = [dict(p) if p is not None else {} for p in part["parameters"]]
                for attempt in range(retries + 1):
                    try:
                        r = list(client(part["inputs"].tolist(), params))
                        if len(r) != len(part):          # replies can't be told apart: none is used
                            raise ValueError(f"{len(r)} replies for {len(part)} prompts")
                        raws += r
                        errs += [None] * len(part)
                        break
                    except Exception as e:  # noqa: BLE001 - recorded per row
                        if attempt == retries:
                            raws += [None] * len(part)
                            errs += [repr(e)] * len(part)
                        else:
                            time.sleep(backoff_s * (2 ** attempt))
            out = pdf.copy()
            out["raw"] = raws
            out["error"] = errs
            yield out

    schema = requests.schema.add("raw", "string").add("error", "string")
    return requests.select(*cols).mapInPandas(run, schema)


COMPLETION_SCHEMA = "generated_text STRING, details STRUCT<best_of_sequences: ARRAY<STRUCT<generated_text: STRING>>>"


def parse_completions(df: DataFrame, raw_col: str = "raw", prompt_col: str | None = None, drop_prompt: bool = False,
                      id_col: str = "request_id") -> DataFrame:
    """JSON reply -> one row per choice ``(request_id, choice, text, error)``:
    ``generated_text`` then ``details.best_of_sequences[*]``. Unreadable
    JSON gives one row with NULL choice/text and an error (quarantine).
    ``drop_prompt`` cuts the echoed prompt when it is a true prefix."""
    parsed = df.select(id_col, *( [prompt_col] if prompt_col else []),
                       F.from_json(F.col(raw_col), COMPLETION_SCHEMA).alias("_j"), F.col(raw_col).alias("_raw"))
    ok = F.col("_j.generated_text").isNotNull()
    texts = F.concat(F.array(F.col("_j.generated_text")),
                     F.coalesce(F.transform(F.col("_j.details.best_of_sequences"), lambda x: x["generated_text"]),
                                F.array().cast("array<string>")))
    staged = parsed.select(id_col, *([prompt_col] if prompt_col else []),
                           F.when(ok, texts).otherwise(F.array(F.lit(None).cast("string"))).alias("_t"),
                           F.when(ok, F.lit(None)).otherwise(F.lit("invalid JSON response")).alias("error"))
    out = staged.select(id_col, *([prompt_col] if prompt_col else []), "error",
                        F.posexplode_outer("_t").alias("choice", "text"))
    out = out.withColumn("choice", F.when(F.col("error").isNull(), F.col("choice").cast("int")))
    if drop_prompt and prompt_col:
        p = F.col(prompt_col)
        out = out.withColumn("text", F.when(F.col("text").startswith(p), F.expr(f"substring(text, length({prompt_col}) + 1)"))
                             .otherwise(F.col("text")))
    return out.select(id_col, "choice", "text", "error")


def cache_key(payload: Column) -> Column:
    """Cache key = md5 of the JSON payload (settings included, URL excluded)."""
    return F.md5(payload)


def cached_generate(requests: DataFrame, cache: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Identical requests are answered once.

    ``requests(request_id, payload)``, ``cache(key, response)``,
    ``generate(df(key, payload)) -> df(key, response)``. Hits join the cache
    (one row a key, failed replies never count); misses are de-duplicated by
    key, generated once and written before they are used, so further actions
    on the result pay for nothing again. Returns ``(request_id, key, response,
    from_cache)``; :func:`append_cache` stores the new replies."""
    # written once: payloads are built by long expressions, and only those that are asked travel further than their key
    asked = materialize(requests.select("request_id", "payload", cache_key(F.col("payload")).alias("key")), "requests")
    r = asked.select("request_id", "key")
    # written first: Spark can't split a join where a key is hot if one side is an aggregate on that key
    known = materialize(cache.where(F.col("response").isNotNull()).groupBy("key").agg(F.min("response").alias("response")), "known-replies")
    hits = r.join(known, "key", "inner").select("request_id", "key", "response", F.lit(True).alias("from_cache"))
    misses = r.join(known.select("key"), "key", "left_anti")
    todo = asked.select("key", "payload").join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min("payload").alias("payload"))
    fresh = materialize(generate(todo).select("key", "response"), "replies")
    got = misses.join(fresh, "key", "left").select("request_id", "key", "response", F.lit(False).alias("from_cache"))
    return hits.unionByName(got)


def append_cache(result: DataFrame, path: str) -> None:
    """Append the freshly generated (key, response) rows of
    :func:`cached_generate` to the cache table (one row per key, no failures)."""
    fresh = result.where(~F.col("from_cache") & F.col("response").isNotNull()).groupBy("key").agg(F.min("response").alias("response"))
    fresh.write.mode("append").parquet(path)


def request_log(df: DataFrame, prompt_col: str = "inputs", response_col: str = "raw", kwargs_col: str = "parameters",
                raw_kwargs_col: str = "params") -> DataFrame:
    """Rows to append to the request log: prompt, response, merged and raw settings."""
    return df.select("request_id", F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"),
                     settings_json(F.col(kwargs_col)).alias("kwargs"), settings_json(F.col(raw_kwargs_col)).alias("raw_kwargs"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def parse_fenced_json(df: DataFrame, col: str, int_fields: tuple[str, ...] = (), str_fields: tuple[str, ...] = (),
                      ok_col: str = "json_ok") -> DataFrame:
    """Fenced JSON reply -> typed columns; ``json_ok`` false = quarantine."""
    j = fenced_json_text(col)
    out = df.withColumn("_json", j)
    out = out.withColumn(ok_col, F.coalesce(json_is_valid(F.col("_json")), F.lit(False)))
    for f in int_fields:
        out = out.withColumn(f, F.when(F.col(ok_col), json_int(F.col("_json"), f)))
    for f in str_fields:
        out = out.withColumn(f, F.when(F.col(ok_col), json_field(F.col("_json"), f)))
    return out.drop("_json")


def parse_labelled_field(df: DataFrame, col: str, label: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or label, labelled_field(col, label))
