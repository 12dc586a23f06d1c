"""A rule language over metric columns, compiled to boolean columns and reasons.

A rule is a tree of comparisons under AND and OR. A comparison with a missing metric is false. A row fails a rule if the tree is false, or,
with filter_if_pass, if it is true; a rule without conditions passes. Rules come from JSON or from the builder:
Rule("short").check("words").at_least(5).or_().check("score").above(0.5).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _metric(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


@dataclass
class Check:
    metric: str
    operator: str
    threshold: float

    def column(self, columns: Sequence[str]) -> Column:
        if self.metric not in columns:
            return F.lit(False)
        return F.coalesce(COMPARE[self.operator](_metric(self.metric), F.lit(float(self.threshold))), F.lit(False))

    def messages(self, columns: Sequence[str]) -> list[Column]:
        if self.metric not in columns:
            return []
        said = F.format_string(f"{self.metric.replace('%', '%%')} {self.operator} {self.threshold:g} (actual: %.4f)", _metric(self.metric))
        return [F.when(_metric(self.metric).isNotNull() & ~self.column(columns), said)]

    def to_json(self) -> dict:
        return {"metric": self.metric, "operator": self.operator, "threshold": self.threshold}


@dataclass
class Group:
    logic: str = "AND"
    conditions: list = field(default_factory=list)

    def column(self, columns: Sequence[str]) -> Column:
        if not self.conditions:
            return F.lit(True)
        out = self.conditions[0].column(columns)
        for c in self.conditions[1:]:
            out = out & c.column(columns) if self.logic == "AND" else out | c.column(columns)
        return out

    def messages(self, columns: Sequence[str]) -> list[Column]:
        return [m for c in self.conditions for m in c.messages(columns)]

    def to_json(self) -> dict:
        return {"group": {"logic": self.logic, "conditions": [c.to_json() for c in self.conditions]}}


class Rule:
    """A named rule; the last of and_() and or_() holds for all of its own conditions, groups give precedence."""

    def __init__(self, name: str, description: str = "", logic: str = "AND", filter_if_pass: bool = False, conditions: Sequence = ()) -> None:
        self.name, self.description, self.filter_if_pass = name, description, filter_if_pass
        self.root, self._metric = Group(logic, list(conditions)), ""

    def check(self, metric: str) -> Rule:
        self._metric = metric
        return self

    def _add(self, operator: str, threshold: float) -> Rule:
        self.root.conditions.append(Check(self._metric, operator, threshold))
        return self

    def above(self, t: float) -> Rule:
        return self._add(">", t)

    def at_least(self, t: float) -> Rule:
        return self._add(">=", t)

    def below(self, t: float) -> Rule:
        return self._add("<", t)

    def at_most(self, t: float) -> Rule:
        return self._add("<=", t)

    def equal_to(self, t: float) -> Rule:
        return self._add("==", t)

    def not_equal_to(self, t: float) -> Rule:
        return self._add("!=", t)

    def and_(self) -> Rule:
        self.root.logic = "AND"
        return self

    def or_(self) -> Rule:
        self.root.logic = "OR"
        return self

    def group(self, group: Group) -> Rule:
        self.root.conditions.append(group)
        return self

    def fails(self, columns: Sequence[str]) -> Column:
        if not self.root.conditions:
            return F.lit(False)
        passed = self.root.column(columns)
        return passed if self.filter_if_pass else ~passed

    def reason(self, columns: Sequence[str]) -> Column:
        """Null for a row that passes, else the rule's name and what failed."""
        said = F.concat_ws("; ", *self.root.messages(columns)) if self.root.messages(columns) and not self.filter_if_pass else F.lit("")
        return F.when(self.fails(columns), F.when(said == "", F.lit(self.name)).otherwise(F.concat(F.lit(self.name + ": "), said)))

    def to_json(self) -> dict:
        return {"name": self.name, "description": self.description, "logic": self.root.logic, "filter_if_pass": self.filter_if_pass, "conditions": [c.to_json() for c in self.root.conditions]}


def _condition(d: dict):  # noqa: ANN202
    if "group" in d:
        g = d["group"]
        return Group(g.get("logic", "AND").upper(), [_condition(c) for c in g["conditions"]])
    if d.get("metric") is None or d.get("operator") not in COMPARE or d.get("threshold") is None:  # a threshold of 0 is one
        raise ValueError(f"not a condition: {d}")
    return Check(d["metric"], d["operator"], float(d["threshold"]))


def load_rules(text: str) -> list[Rule]:
    return [Rule(d["name"], d.get("description", ""), d.get("logic", "AND").upper(), bool(d.get("filter_if_pass", False)), [_condition(c) for c in d.get("conditions", [])]) for d in json.loads(text)]


def default_rules() -> list[Rule]:
    """Least scores of relevance and factuality."""
    least = {"summac": 0.0, "bertscore-f1": 0.75, "factcc": 0.5, "alignscore": 0.15, "bleurt": 0.15}
    return [Rule(f"{m} at least {t:g}").check(m).at_least(t) for m, t in least.items()]


def evaluate(rows: DataFrame, rules: Sequence[Rule], out: str = "reasons") -> DataFrame:
    """rows with an array of the reasons of all rules that they fail."""
    return rows.withColumn(out, F.filter(F.array(*[r.reason(rows.columns) for r in rules]), lambda x: x.isNotNull()))


def passing(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    out = F.lit(False)
    for r in rules:
        out = out | r.fails(rows.columns)
    return rows.filter(~out)


def filter_by_scores(samples: DataFrame, scores: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """samples without those of whose key a scores row fails; keys name the row, so both tables may hold others."""
    failed = evaluate(scores, rules).filter(F.size("reasons") > 0).select(*keys).distinct()
    on = [samples[k].eqNullSafe(failed[k]) for k in keys]
    return samples.join(failed, on, "left_anti")


def report(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: rows, rows that fail it, rows that pass, in one pass."""
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(r.fails(rows.columns)).alias(f"_{i}") for i, r in enumerate(rules)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col("n").alias("initial"), F.col(f"_{i}").alias("removed"), (F.col("n") - F.col(f"_{i}")).alias("kept")) for i, r in enumerate(rules)])).alias("x")).select("x.*")


def drop_problem_samples(rows: DataFrame, key: Sequence[str], text: str, is_original: Column) -> DataFrame:
    """Rows of samples whose original, or any variant, is a mismatch or a placeholder go."""
    from readgrain.functions.text import is_problem

    bad = rows.filter(is_problem(F.col(text))).select(*key, is_original.alias("_o"))
    out = rows.join(bad.filter("_o").select(*key).distinct(), list(key), "left_anti")
    return out.join(bad.filter("NOT _o").select(*key).distinct(), list(key), "left_anti")


def parse_exclusions(items: Sequence[str]) -> tuple[list[tuple[str | None, str]], list[tuple[str, str, int, int]]]:
    """`id`, `dataset:id` and `dataset:id:g,v` to whole samples and single variants."""
    samples, variants = [], []
    for x in items:
        parts = x.split(":")
        if len(parts) == 1:
            samples.append((None, parts[0]))
        elif len(parts) == 2:
            samples.append((parts[0], parts[1]))
        else:
            g, v = parts[2].split(",")
            variants.append((parts[0], parts[1], int(g), int(v)))
    return samples, variants
