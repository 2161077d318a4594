"""Typed rules over JSON documents: a value's type counts as much as the value, so true, 1 and "1" differ."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Spark calls the types of JSON values.
KINDS = {
    "integer": r"^BIGINT$",
    "number": r"^(?:BIGINT|DOUBLE|DECIMAL\(.*\))$",
    "boolean": r"^BOOLEAN$",
    "string": r"^STRING$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
    "null": r"^VOID$",
}


class Rule(NamedTuple):
    """What must stand at a path: of a kind, and within what else is given."""

    name: str
    path: str
    kind: str
    equals: object = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    optional: bool = False


def _holds(value: Column, rule: Rule) -> Column:
    """Whether a value of the right kind is what the rule wants."""
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    size = F.size(F.try_variant_get(value, "$", "array<variant>")) if rule.kind == "array" else number
    wanted = F.lit(True)
    if rule.equals is not None:
        own = F.try_variant_get(value, "$", "boolean") if rule.kind == "boolean" else number if rule.kind in ("integer", "number") else text
        wanted = wanted & (own == F.lit(rule.equals))
    if rule.low is not None:
        wanted = wanted & (size >= rule.low)
    if rule.high is not None:
        wanted = wanted & (size <= rule.high)
    if rule.pattern is not None:
        wanted = wanted & text.rlike(rule.pattern)
    return F.coalesce(wanted, F.lit(False))


def findings(
    docs: DataFrame,
    key: str,
    json: str,
    rules: Sequence[Rule],
    arithmetic: Mapping[str, tuple[Sequence[str], Callable[..., Column]]] | None = None,
) -> DataFrame:
    """(key, rule, problem) of every document and rule that don't fit: missing, type or value; "document", unreadable of what is no JSON.

    `arithmetic`: by name, paths of numbers and a condition over them as doubles (values of another type don't count as
    numbers: problem type). A size of an array is tested by low and high. All rules are tested in one pass over the documents.
    """
    parsed = docs.select(key, F.try_parse_json(json).alias("_v"))

    def of(path: str) -> Column:
        return F.try_variant_get("_v", path, "variant")

    def kind(value: Column) -> Column:
        return F.schema_of_variant(value)

    tests = []
    for r in rules:
        value = of(r.path)
        absent = F.lit(None).cast("string") if r.optional else F.lit("missing")
        problem = F.when(value.isNull(), absent).when(~kind(value).rlike(KINDS[r.kind]), "type").when(~_holds(value, r), "value")
        tests.append((r.name, problem))
    for name, (paths, condition) in (arithmetic or {}).items():
        values = [of(p) for p in paths]
        absent = typed = F.lit(False)
        for v in values:
            absent, typed = absent | v.isNull(), typed | ~F.coalesce(kind(v), F.lit("")).rlike(KINDS["number"])
        met = F.coalesce(condition(*[F.try_variant_get(v, "$", "double") for v in values]), F.lit(False))
        tests.append((name, F.when(absent, "missing").when(typed, "type").when(~met, "value")))
    each = [F.struct(F.lit(n).alias("rule"), p.alias("problem")) for n, p in tests]
    unread = F.array(F.struct(F.lit("document").alias("rule"), F.lit("unreadable").alias("problem")))
    all_ = F.when(F.col("_v").isNull(), unread).otherwise(F.filter(F.array(*each), lambda t: t["problem"].isNotNull()))
    return parsed.select(key, F.explode(all_).alias("t")).select(key, "t.rule", "t.problem")
