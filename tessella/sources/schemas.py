"""Schemas of the relations, stated once. Readers never infer."""

from __future__ import annotations

SYMBOL = "struct<name:string,kind:string,exported:boolean,line_start:int,line_end:int>"
IMPORT = "struct<source:string,type:string>"
COVERAGE = "struct<statements_total:int,statements_covered:int,branches_total:int,branches_covered:int,functions_total:int,functions_covered:int,lines_total:int,lines_covered:int>"
TASK = f"version int, file string, hash string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, coverage {COVERAGE}, language string, parse_method string, framework string, scanned_at string"
SYMBOL_REVIEW = "struct<name:string,kind:string,exported:boolean,line_start:int,line_end:int,correction:string,overengineering:string,utility:string,duplication:string,tests:string,documentation:string,confidence:int,detail:string,duplicate_target:struct<file:string,symbol:string,similarity:string>>"
ACTION = "struct<id:int,description:string,severity:string,effort:string,category:string,source:string,target_symbol:string,target_lines:string>"
REVIEW = f"version int, file string, is_generated boolean, skip_reason string, language string, parse_method string, verdict string, symbols array<{SYMBOL_REVIEW}>, actions array<{ACTION}>, best_practices struct<score:double,rules:array<struct<rule_id:int,rule_name:string,status:string,severity:string,detail:string>>>, deliberation struct<verdict_before:string,verdict_after:string,reclassified:int,actions_removed:int,reasoning:string>"
PROGRESS = "file string, hash string, status string, updated_at string, error string, axes array<string>"
LLM_CALL = "schemaVersion int, t bigint, provider string, model string, phase string, axis string, inputTokens bigint, outputTokens bigint, cacheReadTokens bigint, cacheCreationTokens bigint, costUsd double, durationMs double, attempt int, success boolean, retryReason string"
CARD = "id string, file string, name string, signature string, summary string, doc_summary string, key_concepts array<string>, behavioral_profile string, complexity int, called array<string>, last_indexed string, vector array<float>, nlp_vector array<float>, doc_vector array<float>, type string, source string"

#: Domains of the enumerations.
KINDS = ["function", "class", "method", "type", "constant", "variable", "enum", "hook"]
VERDICTS = {"correction": ["OK", "NEEDS_FIX", "ERROR"], "overengineering": ["LEAN", "OVER", "ACCEPTABLE"], "utility": ["USED", "DEAD", "LOW_VALUE"], "duplication": ["UNIQUE", "DUPLICATE"], "tests": ["GOOD", "WEAK", "NONE"], "documentation": ["DOCUMENTED", "PARTIAL", "UNDOCUMENTED"]}


def example(schema, hint: str = "text"):
    """A value that fits a Spark type: for prompts and fixtures."""
    from pyspark.sql import types as T

    if isinstance(schema, T.StructType):
        return {f.name: example(f.dataType, f.name) for f in schema.fields}
    if isinstance(schema, T.ArrayType):
        return [example(schema.elementType, hint)]
    if isinstance(schema, T.MapType):
        return {"key": example(schema.valueType, hint)}
    if isinstance(schema, T.BooleanType):
        return True
    if isinstance(schema, T.IntegralType):
        return 1
    return 0.5 if isinstance(schema, T.FractionalType) else hint
