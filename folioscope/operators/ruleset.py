"""Rule catalog and rulesets. A ruleset is a handful of values on the driver; as a table it has one row a rule."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed


class RulesetError(ValueError):
    pass


@dataclass
class RuleConfig:
    enabled: bool
    severity: str
    options: dict[str, float]
    applies_to: tuple[str, ...] | None


@dataclass
class Ruleset:
    id: str = "default"
    name: str = "default"
    version: int = 1
    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.WEIGHTS))
    rules: dict[str, RuleConfig] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for rule, (_, _, severity, options, applies_to, _, _) in fixed.RULES.items():
            self.rules.setdefault(rule, RuleConfig(True, severity, dict(options), applies_to))

    def number(self, rule: str, option: str) -> float:
        """The option's value; one that isn't a number gives way to the catalog's."""
        value = self.rules[rule].options.get(option)
        return value if isinstance(value, int | float) and not isinstance(value, bool) else fixed.RULES[rule][3][option]

    def on(self, rule: str) -> bool:
        return self.rules[rule].enabled


def resolve(given: dict) -> Ruleset:
    """A ruleset from its overrides: id, name, version, weights, rules {id: enabled, severity, options, appliesTo}.

    Options are laid over the catalog's one by one; appliesTo replaces the catalog's."""
    for key in ("id", "name", "version"):
        if key not in given:
            raise RulesetError(f"a ruleset needs {key}")
    weights = {**fixed.WEIGHTS, **given["weights"]} if given.get("weights") else dict(fixed.WEIGHTS)
    if set(weights) != set(fixed.AXES) or abs(sum(weights.values()) - 1) > fixed.WEIGHT_TOLERANCE:
        raise RulesetError("the weights of the axes must sum to 1")
    out = Ruleset(given["id"], given["name"], int(given["version"]), weights)
    for rule, over in (given.get("rules") or {}).items():
        if rule not in fixed.RULES:
            raise RulesetError(f"no rule {rule}")
        config = copy.deepcopy(out.rules[rule])
        if over.get("severity") not in (None, *fixed.SEVERITIES):
            raise RulesetError(f"{rule}: no severity {over['severity']}")
        config.enabled = over.get("enabled", config.enabled)
        config.severity = over.get("severity") or config.severity
        config.options |= over.get("options") or {}
        if "appliesTo" in over:
            config.applies_to = None if over["appliesTo"] == "all" else tuple(over["appliesTo"])
        out.rules[rule] = config
    return out


def from_yaml(text: str) -> Ruleset:
    import yaml

    return resolve(yaml.safe_load(text))


def rule_table(spark: SparkSession, ruleset: Ruleset | None = None) -> DataFrame:
    """One row for each rule of the catalog as the ruleset has it: 31 rows."""
    ruleset = ruleset or Ruleset()
    rows = [
        (ruleset.id, ruleset.version, rule, name, axis, severity, model, query, c.enabled, c.severity, {k: float(v) for k, v in c.options.items() if isinstance(v, int | float)}, list(c.applies_to) if c.applies_to else None)
        for rule, (name, axis, severity, _, _, model, query) in fixed.RULES.items()
        for c in [ruleset.rules[rule]]
    ]
    return spark.createDataFrame(
        rows,
        "ruleset_id string, version int, rule_id string, name string, axis string, default_severity string, llm boolean, deterministic boolean, enabled boolean, severity string, options map<string,double>, applies_to array<string>",
    )


def rules_evaluated(ruleset: Ruleset, doc_type: str, with_model: bool) -> int:
    """Rules of queries that are on and apply to the type, and those of a model if one is asked."""
    applies = lambda r: ruleset.rules[r].applies_to is None or doc_type in ruleset.rules[r].applies_to
    found = [r for r in fixed.RULES if ruleset.on(r) and applies(r)]
    return sum(fixed.RULES[r][6] for r in found) + (sum(fixed.RULES[r][5] for r in found) if with_model else 0)
