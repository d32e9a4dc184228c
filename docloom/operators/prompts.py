"""Prompt rendering (LLM-1 signature prompts, LLM-2 few-shot prompts from specs).

A spec or signature is small configuration, so its static text is rendered
once in Python and each row contributes only its own fields via SQL string
functions (JVM-side, no UDF)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Signature:
    instruction: str
    inputs: list[tuple[str, str]]          # (field name, description)
    output: tuple[str, str]                # (field name, description)
    reasoning: bool = True                 # step-by-step slot before the output


def _label(name: str) -> str:
    return name[:1].upper() + name[1:]


def signature_header(sig: Signature) -> str:
    lines = [sig.instruction, "", "---", "", "Follow the following format.", ""]
    for name, desc in sig.inputs:
        lines.append(f"{_label(name)}: {desc or '${' + name + '}'}")
    if sig.reasoning:
        lines.append("Reasoning: Let's think step by step in order to ${produce the " + sig.output[0] + "}. We ...")
    lines.append(f"{_label(sig.output[0])}: {sig.output[1] or '${' + sig.output[0] + '}'}")
    lines += ["", "---", ""]
    return "\n".join(lines) + "\n"


def field_text(df: DataFrame, name: str) -> Column:
    """A row value as prompt text; list values become ``[i] «text»`` lines."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.ArrayType):
        items = F.transform(F.col(name), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] «"),
                                                               x.cast("string"), F.lit("»")))
        return F.coalesce(F.array_join(items, "\n"), F.lit("N/A"))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def render_signature_prompt(df: DataFrame, sig: Signature, out: str = "prompt") -> DataFrame:
    """Instruction + described fields + this row's inputs + the open slot."""
    parts: list[Column] = [F.lit(signature_header(sig))]
    for i, (name, _) in enumerate(sig.inputs):
        parts += [F.lit(("" if i == 0 else "\n") + f"{_label(name)}: "), field_text(df, name)]
    tail = "\nReasoning: Let's think step by step in order to" if sig.reasoning else f"\n{_label(sig.output[0])}:"
    parts.append(F.lit(tail))
    return df.withColumn(out, F.concat(*parts))


@dataclass
class PromptSpec:
    name: str
    instruction: str
    output_format_instruction: str = ""
    examples: list[dict] = field(default_factory=list)
    input_keys: list[str] = field(default_factory=list)
    output_key: str = "output"
    output_type: str = "str"
    language: str = "english"

    @classmethod
    def from_row(cls, row: dict) -> "PromptSpec":
        ex = [{k: _parse_maybe_json(v) for k, v in (e or {}).items()} for e in (row.get("examples") or [])]
        return cls(row["name"], row.get("instruction") or "", row.get("output_format_instruction") or "", ex,
                   list(row.get("input_keys") or []), row.get("output_key") or "output",
                   row.get("output_type") or "str", row.get("language") or "english")


def _parse_maybe_json(v):
    if isinstance(v, str) and v[:1] in "{[":
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def _value_text(v, output_type: str) -> str:
    if output_type == "json" and not isinstance(v, str):
        return "```" + json.dumps(v, ensure_ascii=False) + "```"
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def few_shot_header(spec: PromptSpec) -> str:
    parts = [spec.instruction.strip()]
    if spec.output_format_instruction:
        parts.append(spec.output_format_instruction.strip())
    if spec.examples:
        shots = []
        for e in spec.examples:
            lines = [f"{k}: {_value_text(e[k], 'str')}" for k in spec.input_keys if k in e]
            if spec.output_key in e:
                lines.append(f"{spec.output_key}: {_value_text(e[spec.output_key], spec.output_type)}")
            shots.append("\n".join(lines))
        parts.append("Examples:\n" + "\n\n".join(shots))
    return "\n".join(parts) + "\n\nYour actual task:\n\n"


def render_few_shot_prompt(df: DataFrame, spec: PromptSpec, out: str = "prompt") -> DataFrame:
    """Instruction, output format, examples, then this row's ``input_keys``
    and the open output key."""
    parts: list[Column] = [F.lit(few_shot_header(spec))]
    for k in spec.input_keys:
        parts += [F.lit(f"{k}: "), field_text(df, k), F.lit("\n")]
    parts.append(F.lit(f"{spec.output_key}: "))
    return df.withColumn(out, F.concat(*parts))
