"""Chat message shapes: one API's requests and replies in terms of the other's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import stop_reason

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
REQUEST = f"struct<model:string,max_tokens:bigint,system:string,messages:array<struct<role:string,content:{BLOCKS}>>,stop_sequences:array<string>,stream:boolean>"
REPLY = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
MESSAGE = "struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>"


def _message(role: Column, content: Column, call_id: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(role.alias("role"), content.alias("content"), (none if call_id is None else call_id).alias("tool_call_id"), (none if calls is None else calls).alias("tool_calls")).cast(MESSAGE)


def openai_messages(request: Column) -> Column:
    """request as REQUEST -> array of messages: the system text first, a user turn's tool results before its text, an assistant's tool uses as calls."""
    def turn(m: Column) -> Column:
        of = lambda kind: F.filter(m["content"], lambda b: b["type"] == kind)
        texts = F.filter(F.transform(of("text"), lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
        calls = F.transform(of("tool_use"), lambda b: F.struct(b["id"].alias("id"), F.lit("function").alias("type"), F.struct(b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments")).alias("function")))
        text = F.array_join(texts, "")
        assistant = F.array(_message(F.lit("assistant"), F.nullif(text, F.lit("")), None, F.when(F.size(calls) > 0, calls)))
        body = lambda b: F.concat(F.when(F.coalesce(b["is_error"], F.lit(False)), "Error: ").otherwise(""), F.coalesce(b["content"], F.lit("")))
        results = F.transform(of("tool_result"), lambda b: _message(F.lit("tool"), body(b), F.coalesce(b["tool_use_id"], F.lit(""))))
        user = F.when(F.size(texts) > 0, F.array(_message(F.lit("user"), F.array_join(texts, "\n\n")))).otherwise(F.array().cast(f"array<{MESSAGE}>"))
        empty = (text == "") & (F.size(calls) == 0)
        return F.when(m["role"] == "assistant", F.when(empty, F.array().cast(f"array<{MESSAGE}>")).otherwise(assistant)).otherwise(F.concat(results, user))
    system = F.when(F.coalesce(request["system"], F.lit("")) != "", F.array(_message(F.lit("system"), request["system"]))).otherwise(F.array().cast(f"array<{MESSAGE}>"))
    return F.concat(system, F.flatten(F.transform(request["messages"], turn)))


def max_tokens(request: Column, cap: int) -> Column:
    return F.least(F.coalesce(request["max_tokens"], F.lit(4096)), F.lit(cap))


def tool_choice(kind: Column, name: Column) -> Column:
    """any -> required, tool -> that function, none -> none, else nothing."""
    return F.when(kind == "any", "required").when(kind == "tool", F.to_json(F.struct(F.lit("function").alias("type"), F.struct(F.coalesce(name, F.lit("")).alias("name")).alias("function")))).when(kind == "none", "none")


def anthropic_blocks(reply: Column) -> Column:
    """reply as REPLY -> struct<blocks, stop_reason, input_tokens, output_tokens>; arguments that are no JSON object become {}."""
    message = reply["choices"][0]["message"]
    kind = "array<struct<type:string,text:string,id:string,name:string,input:string>>"
    text = F.when(F.coalesce(message["content"], F.lit("")) != "", F.array(F.struct(F.lit("text"), message["content"], F.lit(None), F.lit(None), F.lit(None))).cast(kind)).otherwise(F.array().cast(kind))
    arguments = lambda c: F.when(F.try_parse_json(c).isNotNull(), c).otherwise("{}")
    tools = F.transform(F.coalesce(message["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")), lambda c: F.struct(F.lit("tool_use"), F.lit(None), c["id"], c["function"]["name"], arguments(c["function"]["arguments"]))).cast(kind)
    both = F.concat(text, tools)
    blocks = F.when(F.size(both) > 0, both).otherwise(F.array(F.struct(F.lit("text"), F.lit(""), F.lit(None), F.lit(None), F.lit(None))).cast(kind))
    stop = F.when(F.size(tools) > 0, "tool_use").otherwise(stop_reason(reply["choices"][0]["finish_reason"]))
    return F.struct(blocks.alias("blocks"), stop.alias("stop_reason"), F.coalesce(reply["usage"]["prompt_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(reply["usage"]["completion_tokens"], F.lit(0)).alias("output_tokens"))


def usage_of(line: Column, *names: str) -> Column:
    """The last positive count under one of the names in a streamed line, null if none."""
    found = F.regexp_extract_all(line, F.lit(f'"(?:{"|".join(names)})"\\s*:\\s*([0-9]+)'), F.lit(1))
    return F.nullif(F.try_element_at(found, F.lit(-1)).cast("long"), F.lit(0))
