"""JSON values: usage of different providers, answers, previews, pointers, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


def keys_of(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.expr("cast(array() as array<string>)"))


def _truthy(value: Column) -> Column:
    return value.isNotNull() & ~value.isin("", "{}", "[]", "0", "false", "null")


def normal_usage(text: Column) -> Column:
    """input, output and cached tokens from any provider's usage JSON, unwrapping `tokens` and `total`."""
    inner = F.get_json_object(text, "$.tokens")
    one = F.when(_truthy(inner), inner).otherwise(text)
    total = F.get_json_object(one, "$.total")
    flat = F.try_parse_json(F.when(_truthy(total), total).otherwise(one))
    # Only numbers count: the schema text of a number has no quotes to cast away.
    def number(*names: str) -> Column:
        return F.coalesce(*[
            F.when(F.schema_of_variant(F.try_variant_get(flat, "$." + n, "variant")).isin("BIGINT", "DOUBLE", "BOOLEAN") |
                   F.startswith(F.schema_of_variant(F.try_variant_get(flat, "$." + n, "variant")), F.lit("DECIMAL")),
                   F.try_variant_get(flat, "$." + n, "bigint"))
            for n in names])

    details = F.coalesce(
        F.try_variant_get(flat, "$.prompt_tokens_details.cached_tokens", "bigint"),
        F.try_variant_get(flat, "$.input_tokens_details.cached_tokens", "bigint"))
    cached = number(*P.USAGE_CACHED)
    return F.struct(
        number(*P.USAGE_INPUT).alias("input"), number(*P.USAGE_OUTPUT).alias("output"),
        # A count of zero gives way to the details, as any empty value would.
        F.when(F.coalesce(cached, F.lit(0)) != 0, cached).otherwise(details).alias("cached"))


def fenced(text: Column) -> Column:
    """The content of the only fenced block, or null when there is none or several."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```"), F.lit(1))
    return F.when(F.size(blocks) == 1, F.get(blocks, F.lit(0)))


_INTEGER, _NUMBER = r"BIGINT", r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)"


def _problem(code: str, path: Column, rule: str, actual: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(rule).alias("rule"), preview(actual).alias("actual"))


def _no_problems() -> Column:
    return F.expr("cast(array() as array<struct<code:string,path:string,rule:string,actual:string>>)")


def _step(path: Column, key: Column) -> Column:
    return F.concat(path, pointer(F.array(key.cast("string"))))


def _typed(value: Column, kind: T.DataType, path: Column) -> Column:
    """Problems of a variant against a type, outer ones first: wrong types, missing fields, fields outside the schema."""
    seen, shown = F.schema_of_variant(value), F.to_json(value)
    if isinstance(kind, T.StructType):
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        keys = keys_of(shown)
        missing = F.transform(F.array_except(names, keys), lambda k: _problem("missing", _step(path, k), "required", shown))
        extra = F.transform(F.array_sort(F.array_except(keys, names)), lambda k: _problem("extra_forbidden", _step(path, k), "additionalProperties", shown))
        inner = []
        for f in kind.fields:
            child = F.try_variant_get(value, "$['" + f.name + "']", "variant")
            inner.append(F.when(child.isNotNull(), _typed(child, f.dataType, _step(path, F.lit(f.name)))).otherwise(_no_problems()))
        return F.when(F.startswith(seen, F.lit("OBJECT")), F.concat(missing, extra, *inner)).otherwise(F.array(_problem("type", path, "object", shown)))
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.flatten(F.transform(items, lambda v, i: _typed(v, kind.elementType, _step(path, i))))
        return F.when(F.startswith(seen, F.lit("ARRAY")), inner).otherwise(F.array(_problem("type", path, "array", shown)))
    rule, fits = {
        T.StringType: ("string", "STRING"), T.BooleanType: ("boolean", "BOOLEAN"), T.LongType: ("integer", _INTEGER), T.IntegerType: ("integer", _INTEGER),
        T.DoubleType: ("number", _NUMBER)}[type(kind)]
    return F.when(seen.rlike(f"^{fits}$"), _no_problems()).otherwise(F.array(_problem("type", path, rule, shown)))


def _candidate_problems(candidate: Column, schema: str) -> Column:
    value = F.try_parse_json(candidate)
    bad = F.array(_problem("JSON_SYNTAX", F.lit(""), "json", candidate))
    return F.when(value.isNull(), bad).otherwise(_typed(value, T.StructType.fromDDL(schema), F.lit("")))


def parse_result(text: Column, schema: str) -> Column:
    """A value of a closed schema (a DDL list of fields) from an answer: the single fenced block first, then the whole
    text; null if neither fits in every field and type."""
    def parsed(candidate: Column) -> Column:
        return F.when(F.size(_candidate_problems(candidate, schema)) == 0, F.from_json(candidate, schema))

    return F.coalesce(parsed(fenced(text)), parsed(text))


def schema_problems(text: Column, schema: str) -> Column:
    """Problems of an answer as (code, path, rule, actual): text that is no JSON, and what `_typed` finds at any depth."""
    return _candidate_problems(F.coalesce(fenced(text), text), schema)


def preview(text: Column, limit: int = P.PREVIEW_LENGTH) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("… [truncated]"))).otherwise(text)


def pointer(parts: Column) -> Column:
    """JSON pointer of a path."""
    escaped = F.transform(parts, lambda p: F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    return F.array_join(escaped, "")


def digest(**fields: Column) -> Column:
    """Hash of named values: fields sorted by name, nulls kept, as JSON. For equality inside this engine."""
    packed = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)


def result_text(protocol: Column, response: Column) -> Column:
    """(text, usage, truncated) of a provider's answer by protocol."""
    v = F.try_parse_json(response)

    def texts(path: str, schema: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, schema), F.expr(f"cast(array() as {schema})"))

    part = "array<struct<type:string,text:string,thought:boolean>>"
    claude = F.array_join(F.transform(F.filter(texts("$.content", part), lambda c: c["type"] == "text"), lambda c: c["text"]), "")
    gemini = F.array_join(F.transform(
        F.filter(texts("$.candidates[0].content.parts", part), lambda c: ~F.coalesce(c["thought"], F.lit(False))), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    output = texts("$.output", f"array<struct<type:string,content:{part}>>")
    messages = F.flatten(F.transform(F.filter(output, lambda o: o["type"] == "message"), lambda o: F.coalesce(o["content"], F.expr(f"cast(array() as {part})"))))
    answers = F.array_join(F.transform(F.filter(messages, lambda c: c["type"] == "output_text"), lambda c: c["text"]), "")
    one = lambda path: F.try_variant_get(v, path, "string")
    text = F.when(protocol == "anthropic", claude).when(protocol == "gemini", gemini).when(
        protocol == "chat_completions", one("$.choices[0].message.content")).otherwise(answers)
    finish = F.when(protocol == "anthropic", F.equal_null(one("$.stop_reason"), F.lit("end_turn"))).when(
        protocol == "gemini", F.equal_null(one("$.candidates[0].finishReason"), F.lit("STOP"))).when(
        protocol == "chat_completions", F.equal_null(one("$.choices[0].finish_reason"), F.lit("stop"))).otherwise(
        F.equal_null(one("$.status"), F.lit("completed")))
    usage = F.when(protocol == "gemini", one("$.usageMetadata")).otherwise(one("$.usage"))
    return F.struct(F.when(finish, text).alias("text"), F.when(finish, usage).alias("usage"), F.when(~finish, "TRUNCATED").alias("problem"))
