"""The scanner chain over a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions.fixed import RULES
from textweir.functions.names import fresh

from . import injection, pii, policy


@dataclass(frozen=True)
class ScanConfig:
    """What the chain does. The preset's threshold outranks `strictness` and its default PII
    action holds for all types, as in the screened behaviour; `strict` follows the documentation
    instead: strictness and the preset's actions by type count."""

    preset: str | None = None
    #: Column with the name of each row's preset, whose threshold then counts.
    preset_col: str | None = None
    threshold: float | None = None
    strictness: str = "medium"
    custom_patterns: Sequence[str] = ()
    injection: bool = True
    pii: bool = True
    pii_action: str | None = None
    pii_types: Mapping[str, str] = field(default_factory=dict)
    allowed_types: Sequence[str] = ()
    tools: policy.ToolPolicy | None = None
    early_exit: bool = True
    strict: bool = False

    def injection_threshold(self) -> float:
        if self.threshold is not None:
            return self.threshold
        if self.strict and self.preset is None:
            return injection.resolve_threshold(None, self.strictness)
        return policy.preset(self.preset).threshold

    def pii_by_type(self) -> dict[str, str]:
        if not self.strict:
            return dict(self.pii_types)
        keys = {"email": "email", "phone": "phone", "credit_card": "creditCard", "iban": "iban"}
        return {t: policy.pii_action(self.preset, k) for t, k in keys.items()} | dict(self.pii_types)


class Finding(NamedTuple):
    """What a scanner has found in a text, as one column that is computed once, and how decision,
    violations and sanitized text are read from it; what is not selected is not made."""

    found: Column
    read: Callable[[Column, Column], tuple[Column, Column, Column]]


#: A scanner: from the text so far and the context columns to a finding, or at once to (decision,
#: violations, sanitized).
Scanner = Callable[[Column, Mapping[str, Column]], Finding | tuple[Column, Column, Column]]


def heuristic_scanner(config: ScanConfig) -> Scanner:
    rules = (*RULES, *injection.custom_rules(config.custom_patterns))

    def scan(text: Column, context: Mapping[str, Column]):
        limit = context["threshold"] if config.preset_col and config.threshold is None else F.lit(config.injection_threshold())
        found = F.struct(injection.hits(text, rules).alias("hits"), injection.structural_score(text).alias("structure"), limit.alias("limit"))

        def read(f: Column, text: Column):
            score = F.when(f.isNotNull(), injection.score_of(f["hits"], f["structure"], rules))
            return injection.decide(score, f["limit"]), injection.violations(f["hits"], f["limit"], rules), text

        return Finding(found, read)

    return scan


def pii_scanner(config: ScanConfig) -> Scanner:
    default = config.pii_action or policy.pii_action(config.preset)
    types = config.pii_by_type()

    def scan(text: Column, context: Mapping[str, Column]):
        found = pii.active(pii.detect(text), config.allowed_types)

        def read(f: Column, text: Column):
            return pii.decide(f, default, types), pii.violations(f, default, types), pii.sanitize(text, f, default, types)

        return Finding(found, read)

    return scan


def tool_scanner(config: ScanConfig) -> Scanner:
    def scan(text: Column, context: Mapping[str, Column]):
        found = policy.tool_violations(context["tools"], context["agent_id"], config.tools)
        return Finding(found, lambda f, text: (F.when(f.isNotNull(), policy.tool_decision(f)), f, text))

    return scan


def scanners(config: ScanConfig) -> list[tuple[str, Scanner]]:
    """heuristic, then pii, then tool_policy if there is a policy."""
    out = []
    if config.injection:
        out.append(("heuristic", heuristic_scanner(config)))
    if config.pii:
        out.append(("pii", pii_scanner(config)))
    if config.tools is not None:
        out.append(("tool_policy", tool_scanner(config)))
    return out


def worst(a: Column, b: Column) -> Column:
    """The graver of two decisions; a null one does not count."""
    either = lambda d: F.coalesce((a == d) | (b == d), a == d, b == d)
    return F.when(either("block"), "block").when(either("warn"), "warn").when(either("allow"), "allow")


def scan(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig | None = None,
    agent_col: str | None = None,
    tools_col: str | None = None,
    extra: Sequence[tuple[str, Scanner]] = (),
) -> DataFrame:
    """Adds decision, safe, sanitized, violations and scanners_run.

    Scanners run in order, each on the text that the one before left; with early exit none runs
    after a block, so a row that the first one blocks keeps its raw text. A null text has a null
    decision and is not safe. No shuffle: all of it is a projection. Input columns named like the
    added ones are replaced, all others stay.
    """
    config = config or ScanConfig()
    agent = F.col(agent_col) if agent_col else F.lit(None).cast("string")
    tools = F.col(tools_col) if tools_col else F.array().cast("array<struct<name:string,server_id:string>>")
    context = {"agent_id": agent, "tools": tools}
    if config.preset_col:
        context["threshold"] = policy.threshold_of(F.col(config.preset_col))
    none = F.array().cast(injection.NO_VIOLATIONS)
    text, decision, violations, run, step = fresh(df, "_text", "_decision", "_violations", "_run", "_step")
    state = df.withColumns(
        {
            text: F.col(text_col),
            decision: F.when(F.col(text_col).isNotNull(), "allow"),
            violations: none,
            run: F.array().cast("array<string>"),
        }
    )
    for name, scanner in [*scanners(config), *extra]:
        finding = scanner(F.col(text), context)
        if not isinstance(finding, Finding):
            made = F.struct(finding[0].alias("decision"), finding[1].alias("violations"), finding[2].alias("text"))
            finding = Finding(made, lambda f, _: (f["decision"], f["violations"], f["text"]))
        on = (F.col(decision) != "block") if config.early_exit else F.col(decision).isNotNull()
        # A generator binds what was found, so that it is found once, whatever is read from it.
        state = state.select("*", F.explode(F.array(F.when(on, finding.found))).alias(step))
        new_decision, new_violations, new_text = finding.read(F.col(step), F.col(text))
        state = state.withColumns(
            {
                text: F.coalesce(F.when(F.col(step).isNotNull(), new_text), F.col(text)),
                decision: worst(F.col(decision), new_decision),
                violations: F.concat(violations, F.coalesce(new_violations, none)),
                run: F.when(F.col(step).isNotNull(), F.array_append(run, name)).otherwise(F.col(run)),
            }
        ).drop(step)
    return state.withColumns(
        {
            "decision": F.col(decision),
            "safe": F.coalesce(F.col(decision) == "allow", F.lit(False)),
            "sanitized": F.col(text),
            "violations": F.col(violations),
            "scanners_run": F.col(run),
        }
    ).drop(text, decision, violations, run)


def scanner_of(config: ScanConfig) -> Callable[[DataFrame], DataFrame]:
    """A reusable scan for DataFrame.transform()."""
    return lambda df: scan(df, config=config)
