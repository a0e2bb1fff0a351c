"""Rules that constraints name: a response in, a pass or fail out.

A constraint carries a list of ``struct(kind, arg)``. Each kind is registered by the
author of the job, as a column expression or as a Python function. Text that arrives as
data is never executed; a pattern that does is run by an automaton. A rule passes only with a clear true: unknown kinds, NULL, errors
and timeouts fail.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.cloudpickle import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.operators.patterns import patterns_match
from turnloom.operators.verifiers import ask

# Fixed value: seconds a Python rule may take.
TIME_LIMIT = 10.0


def _packed(rules: dict[str, Callable]) -> bytes:
    """The rules as bytes; functions go with what they use where that can be pickled, so that a
    helper need not import the modules they stand in."""
    modules = {sys.modules[rule.__module__] for rule in rules.values() if getattr(rule, "__module__", None) in sys.modules}
    own = [m for m in modules if m.__name__ not in ("__main__", *cloudpickle.list_registry_pickle_by_value())]
    for module in own:
        cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(rules)
    except Exception:
        pass
    finally:
        for module in own:
            cloudpickle.unregister_pickle_by_value(module)
    return cloudpickle.dumps(rules)


def rule_passes(
    function: Callable, response: str, placeholder: str | None, seconds: float | None = TIME_LIMIT
) -> bool:
    """Does a Python rule pass? It is given the arguments it names and no others."""
    rules = _packed({"": function})
    return ask(rules, seconds, [("", response, placeholder)])[0]


@dataclass
class RuleBook:
    """Registered rules by kind."""

    native: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    python: dict[str, Callable] = field(default_factory=dict)
    patterns: set[str] = field(default_factory=set)
    seconds: float | None = TIME_LIMIT

    def column(self, kind: str, rule: Callable[[Column, Column], Column]) -> RuleBook:
        """Register a rule built from column functions of the response and the argument.

        Such a rule should turn bad arguments into NULL (``try_cast`` and the like).
        """
        self.native[kind] = rule
        return self

    def function(self, kind: str, rule: Callable) -> RuleBook:
        """Register a Python function of ``response`` and, if it wants one, ``placeholder``; it may
        be a coroutine function."""
        self.python[kind] = rule
        return self

    def matching(self, kind: str) -> RuleBook:
        """Register a kind whose argument is a pattern that must match somewhere in the response."""
        self.patterns.add(kind)
        return self

    def verdict(self, kind: Column, response: Column, arg: Column) -> Column:
        """The verdict of one column rule; Python rules and patterns count as passed here."""
        result = F.lit(False)
        if self.python or self.patterns:
            result = F.when(kind.isin(*self.python, *self.patterns), True).otherwise(result)
        for name, rule in self.native.items():
            passed = F.coalesce(rule(response, arg), F.lit(False))
            result = F.when(kind == name, passed).otherwise(result)
        return F.coalesce(result, F.lit(False))

    def all_hold(self, response: Column, rules: Column, placeholder: Column) -> Column:
        """Do all rules of a constraint hold? No rules do. ``placeholder`` replaces the
        rules' own argument unless it is NULL."""
        held = F.forall(
            rules,
            lambda r: self.verdict(r["kind"], response, F.coalesce(placeholder, r["arg"])),
        )
        held = F.coalesce(held, F.lit(True))
        if self.patterns:
            held &= self._patterns_hold(response, rules, placeholder)
        return held & self._functions_hold(response, rules, placeholder) if self.python else held

    def _patterns_hold(self, response: Column, rules: Column, placeholder: Column) -> Column:
        """The patterns of each row, in Arrow batches; other rows send only NULLs."""
        wanted = F.filter(rules, lambda r: r["kind"].isin(*self.patterns))
        asked = F.size(wanted) > 0
        args = F.transform(wanted, lambda r: F.coalesce(placeholder, r["arg"]))
        return patterns_match(F.when(asked, response), F.when(asked, args))

    def _functions_hold(self, response: Column, rules: Column, placeholder: Column) -> Column:
        """The Python rules of each row, a batch at a time; other rows send only NULLs."""
        packed, seconds = _packed(self.python), self.seconds
        wanted = F.filter(rules, lambda r: r["kind"].isin(*self.python))
        asked = F.size(wanted) > 0
        questions = F.transform(
            wanted, lambda r: F.struct(r["kind"].alias("kind"), F.coalesce(placeholder, r["arg"]).alias("arg"))
        )

        @F.arrow_udf("boolean")
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, lists in batches:
                asked = [
                    (row, (q["kind"], text, q["arg"]))
                    for row, (text, wanted) in enumerate(zip(texts.to_pylist(), lists.to_pylist()))
                    for q in wanted or ()
                ]
                verdicts = ask(packed, seconds, [question for _, question in asked])
                held = [True] * len(texts)
                for (row, _), passed in zip(asked, verdicts):
                    held[row] &= passed
                yield pa.array(held, pa.bool_())

        return run(F.when(asked, response), F.when(asked, questions))
