"""Text column builders: number formats, JSON text, keys and statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunelake.constants import (
    AGGREGATE_MARKERS,
    CHAT_END,
    CHAT_START,
    FEATURE_NAMES,
    METRIC_NAMES,
    PREDICATE_MARKERS,
)

EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
STATEMENT_BREAK = r"[;\n]+"


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)` with the value computed once, however often `build` uses it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def strip(text: Column) -> Column:
    """Text without white space at both ends, Unicode spaces and line ends included."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def float_text(x: Column) -> Column:
    """Shortest text of a double in the spelling of JSON files: 12.0, 0.001, 1e-05."""
    size = F.abs(x)
    java = x.cast("string")
    whole = F.concat(x.try_cast("decimal(20,0)").cast("string"), F.lit(".0"))
    plain = F.regexp_replace(java.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("NaN"))
        .when((size < 1e16) & (x == F.floor(x)), whole)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def two_decimals(x: Column) -> Column:
    """Value rounded to two decimals from its exact binary value, ties to even."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit("")).cast("double")


def humanize_metric(v: Column) -> Column:
    """Counter as a word below 1, two truncated decimals, thousands or millions."""
    return (
        F.when((v > 0) & (v < 0.3333), F.lit("low"))
        .when((v > 0) & (v < 0.66667), F.lit("middle"))
        .when((v > 0) & (v < 1), F.lit("high"))
        .when((v > 0) & (v < 1000), float_text((v * 100).cast("long") / F.lit(100.0)))
        .when(v < 1000000, F.concat((v / 1000).cast("long").cast("string"), F.lit("k")))
        .when(
            v >= 1000000,
            F.concat(float_text((v / 100000).cast("long") / F.lit(10.0)), F.lit(" million")),
        )
    )


def humanize_cost(c: Column) -> Column:
    """Plan cost with one decimal, in thousands or in millions; 1000 itself stays as it is."""
    return (
        F.when(c < 1000, F.replace(F.format_number(c, 1), F.lit(","), F.lit("")))
        .when((c > 1000) & (c < 1000000), F.concat((c / 1000).cast("long").cast("string"), F.lit("k")))
        .when(c >= 1000000, F.concat((c / 1000000).cast("long").cast("string"), F.lit(" million")))
        .otherwise(float_text(c))
    )


def metrics_text(values: Column) -> Column:
    """`name: value; ` for each of the 14 counters of an array."""
    names = F.array(*[F.lit(f"{n}: ") for n in METRIC_NAMES])
    parts = F.zip_with(names, values, lambda n, v: F.concat(n, humanize_metric(v), F.lit("; ")))
    return F.array_join(parts, "")


def feature_text(size: Column, ratios: list[Column]) -> Column:
    """`name: value; ` for the six workload features, ratios with two decimals."""
    values = [size.cast("string")] + [float_text(two_decimals(r)) for r in ratios]
    parts = [F.concat(F.lit(f"{n}: "), v, F.lit("; ")) for n, v in zip(FEATURE_NAMES, values)]
    return F.concat(*parts)


def json_object_text(*lines: Column) -> Column:
    """Indented JSON object from `"name": value` lines (texts or arrays of them); null lines are left out."""
    text = F.concat(F.lit("{\n  "), F.concat_ws(",\n  ", *lines), F.lit("\n}"))
    return F.replace(text, F.lit("{\n  \n}"), F.lit("{}"))


def json_line(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), text)


def json_string(text: Column) -> Column:
    """A label as JSON string; labels hold no characters that need escapes."""
    return F.concat(F.lit('"'), text, F.lit('"'))


def metrics_json(values: Column) -> Column:
    """The 14 counters of an array as an indented JSON object."""
    names = F.array(*[F.lit(f'"{n}": ') for n in METRIC_NAMES])
    return json_object_text(F.zip_with(names, values, lambda n, v: F.concat(n, float_text(v))))


def metrics_map(values: Column) -> Column:
    """Counter map from the list form; null unless all 14 values are there."""
    names = F.array(*[F.lit(n) for n in METRIC_NAMES])
    return F.when(F.size(values) == len(METRIC_NAMES), F.map_from_arrays(names, values))


def extract_json_object(text: Column) -> Column:
    """String map parsed from the first `{` to the last `}`; null if it is not one object.

    The text is parsed inside an array so that trailing data is noticed, and of
    repeated keys the last one counts.
    """
    parsed = F.from_json(
        F.concat(F.lit("["), F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("]")),
        "array<map<string,string>>",
        {"allowSingleQuotes": "false"},
    )

    def put(done, entry):
        rest = F.map_filter(done, lambda k, _: k != entry["key"])
        return F.map_concat(rest, F.create_map(entry["key"], entry["value"]))

    def only(objects):
        found = F.get(objects, F.lit(0))
        names = F.map_keys(found)
        empty = F.create_map().cast("map<string,string>")
        last_wins = F.aggregate(F.map_entries(found), empty, put)
        unique = F.size(F.array_distinct(names)) == F.size(names)
        return F.when(F.size(objects) == 1, F.when(unique, found).otherwise(last_wins))

    return bind(parsed, only)


def workload_database(path: Column) -> Column:
    """Second last part of a workload path; paths of fewer than three parts have none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2))


def workload_name(path: Column) -> Column:
    """Last part of a workload path without its format suffixes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.xml$|\.wg$|_smac_output$", "")


def strip_prompt(text: Column, prompt: Column) -> Column:
    """Answer without the echoed prompt in front of it."""
    rest = F.substring(text, F.length(prompt) + 1, F.length(text))
    return strip(F.when(F.startswith(text, prompt), rest).otherwise(text))


def chat_prompt(system: Column, instruction: Column, content: Column) -> Column:
    """Chat template: optional system block, user block, opened assistant block."""
    system_block = F.concat(F.lit(f"{CHAT_START}system\n"), system, F.lit(f"{CHAT_END}\n"))
    has_system = system.isNotNull() & (system != "")
    return F.concat(
        F.when(has_system, system_block).otherwise(F.lit("")),
        F.lit(f"{CHAT_START}user\n"),
        F.coalesce(instruction, F.lit("")),
        F.lit("\n"),
        F.coalesce(content, F.lit("")),
        F.lit(f"{CHAT_END}\n{CHAT_START}assistant\n"),
    )


def chat_turn(role: Column, content: Column) -> Column:
    """One turn of a conversation as a block of the chat template."""
    return F.concat(F.lit(CHAT_START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(f"{CHAT_END}\n"))


def replay_statements(text: Column) -> Column:
    """Statements for replay: breaks at `;` and line ends, a final empty piece is dropped."""

    def closed(pieces):
        ends_empty = F.element_at(pieces, -1) == ""
        kept = F.slice(pieces, 1, F.size(pieces) - F.when(ends_empty, 1).otherwise(0))
        return F.transform(kept, lambda s: F.concat(s, F.lit(";")))

    return bind(F.split(text, STATEMENT_BREAK, -1), closed)


def semicolon_statements(text: Column) -> Column:
    """Non-blank statements split at `;` only, stripped."""
    return F.filter(F.transform(F.split(text, ";", -1), strip), lambda s: s != "")


def line_statements(text: Column) -> Column:
    """One statement per line; blank lines and `--` or `#` comments are skipped."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    kept = F.filter(lines, is_statement)
    return F.transform(kept, lambda s: F.regexp_replace(s, ";$", ""))


def is_statement(line: Column) -> Column:
    return (line != "") & ~F.startswith(line, F.lit("--")) & ~F.startswith(line, F.lit("#"))


def has_aggregate(statement: Column) -> Column:
    found = F.lit(False)
    for marker in AGGREGATE_MARKERS:
        found = found | F.contains(statement, F.lit(marker))
    return found


def predicate_count(statement: Column) -> Column:
    total = F.lit(0)
    for marker in PREDICATE_MARKERS:
        total = total + F.regexp_count(statement, F.lit(marker))
    return total
