"""Reading the JSON that a language model returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

# Method types that are kept; anything else becomes null.
METHOD_TYPES = ["model", "technique", "framework"]

ENTITY_LIST = "array<struct<name:string,attr:string>>"


def parse_json_object(raw: Column) -> Column:
    """Variant of the JSON in a model answer, null when there is none.

    Code fences around it are removed; failing that, the text from the first
    opening to the last closing brace is tried.
    """
    text = strip(raw)
    text = F.regexp_replace(text, r"\A```(?:json)?\s*", "")
    text = strip(F.regexp_replace(text, r"\s*```\z", ""))
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(inner))


def _variants(data: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(data, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def _named(data: Column, key: str, name_key: str, attr: str) -> Column:
    def entry(item: Column) -> Column:
        return F.struct(
            strip(F.try_variant_get(item, f"$.{name_key}", "string")).alias("name"),
            F.try_variant_get(item, f"$.{attr}", "string").alias("attr"),
        )

    return F.filter(F.transform(_variants(data, key), entry), lambda e: e["name"] != "")


def _strings(data: Column, key: str) -> Column:
    texts = F.filter(_variants(data, key), lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(texts, lambda x: strip(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def parse_extraction(raw: Column) -> Column:
    """Struct of methods, datasets (name, attr) and tasks, topics (strings).

    Malformed entries drop out, names are stripped, empty names drop out.  Null
    when the answer holds no JSON object.
    """
    data = parse_json_object(raw)
    methods = F.transform(
        _named(data, "methods", "method_name", "method_type"),
        lambda m: F.struct(
            m["name"].alias("name"), F.when(m["attr"].isin(METHOD_TYPES), m["attr"]).alias("attr")
        ),
    )
    is_object = F.schema_of_variant(data).startswith("OBJECT")
    return F.when(
        is_object,
        F.struct(
            methods.alias("methods"),
            _named(data, "datasets", "dataset_name", "task_type").alias("datasets"),
            _strings(data, "tasks").alias("tasks"),
            _strings(data, "topics").alias("topics"),
        ),
    )


def extraction_prompt(title: Column, text: Column) -> Column:
    """Request for the JSON that ``parse_extraction`` reads."""
    return F.concat(
        F.lit("List the entities this paper names, as one JSON object and nothing else.\n\nTitle: "),
        F.coalesce(title, F.lit("")),
        F.lit("\nText: "),
        text,
        F.lit(
            '\n\nKeys: "methods" is a list of {"method_name", "method_type"} with type model, technique, framework'
            ' or null; "datasets" is a list of {"dataset_name", "task_type"}; "tasks" and "topics" are lists of'
            " strings. Use canonical spellings, only what the text mentions, and empty lists otherwise."
        ),
    )
