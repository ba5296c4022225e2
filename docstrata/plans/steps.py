"""The step language of the planner: parse, check against a schema, and run over a graph.

A plan is text of ``StepN: ...`` and ``ActionN: Op(...)`` lines.  ``Retrieval`` looks up edges or
properties, ``Output`` returns an alias, ``Math`` and ``Deduce`` are given functions; no text of a
plan is ever executed as code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = ("Retrieval", "Math", "Deduce", "Output")
DEDUCTIONS = ("judgement", "entailment", "extract", "choice", "multiChoice")


@dataclass(frozen=True)
class Step:
    number: int
    text: str
    operator: str
    arguments: str


@dataclass(frozen=True)
class Slot:
    """``s=alias:Type[name]``, with type and name optional."""

    role: str
    alias: str
    kind: str | None
    name: str | None


@dataclass
class Schema:
    """Types with their properties and, by relation, the type that it leads to."""

    properties: dict[str, set[str]]
    relations: dict[str, dict[str, str]]

    def predicates(self, kind: str) -> set[str]:
        return self.properties.get(kind, set()) | set(self.relations.get(kind, {}))


def parse_schema(text: str) -> Schema:
    """Types, properties and relations from indented schema text: ``Name(label): EntityType``, then ``properties:`` and ``relations:``."""
    schema, kind, part = Schema({}, {}), "", ""
    for line in text.splitlines():
        head = re.match(r"(\w+)\([^)]*\):\s*\w+", line)
        entry = re.match(r"\s+(\w+)\([^)]*\):\s*(\w+)", line)
        section = re.match(r"\s+(properties|relations):\s*$", line)
        if head:
            kind, part = head.group(1), ""
            schema.properties[kind], schema.relations[kind] = set(), {}
        elif section:
            part = section.group(1)
        elif entry and kind and part == "properties":
            schema.properties[kind].add(entry.group(1))
        elif entry and kind and part == "relations":
            schema.relations[kind][entry.group(1)] = entry.group(2)
    return schema


# Kinds of types, and the basic types that anything may lead to.
KINDS = ("EntityType", "ConceptType", "EventType", "StandardType")
BASIC = ("Text", "Integer", "Float")
SECTIONS = "desc|properties|relations|hypernymPredicate|regular|spreadable|autoRelate"
DETAILS = "desc|properties|constraint|rule|index"


def schema_faults(text: str) -> list[str]:
    """Lines that are indented or written otherwise than schema text is, types of unknown kinds, entries that lead to types which aren't defined.

    Types stand at the margin, sections such as ``relations:`` four or five spaces in, entries eight
    and their details twelve; a ``namespace`` line may stand at the margin.
    """
    entry, section = r"(\w+)\([^)]*\)\s*:\s*(\w+)", rf"(?:{SECTIONS})\s*:.*"
    shapes = {0: entry, 4: section, 5: section, 8: entry, 12: rf"(?:{DETAILS})\s*:.*"}
    faults, kinds, leads = [], {}, []
    for n, line in enumerate(text.splitlines(), 1):
        body, depth = line.strip(), len(line) - len(line.lstrip())
        if not body or (depth == 0 and re.fullmatch(r"namespace\s+\w+", body)):
            continue
        if depth not in shapes:
            faults.append(f"line {n}: indented by {depth}")
        elif not (found := re.fullmatch(shapes[depth], body)):
            faults.append(f"line {n}: not understood: {body}")
        elif depth == 0:
            kinds[found[1]] = found[2]
        elif depth == 8:
            leads.append((n, found[1], found[2]))
    faults += [f"{name} is of unknown kind {kind}" for name, kind in kinds.items() if kind not in KINDS]
    return faults + [f"line {n}: {name} leads to unknown type {to}" for n, name, to in leads if to not in kinds and to not in BASIC]


def parse_plan(text: str) -> list[Step]:
    steps, told = [], {}
    for line in text.splitlines():
        if found := re.match(r"\s*Step\s*(\d+)\s*:\s*(.*\S)", line):
            told[int(found.group(1))] = found.group(2)
        elif found := re.match(r"\s*Action\s*(\d+)\s*:\s*(\w+)\((.*)\)\s*$", line):
            n = int(found.group(1))
            steps.append(Step(n, told.get(n, ""), found.group(2), found.group(3)))
    return steps


def slots(arguments: str) -> list[Slot]:
    return [Slot(m[1], m[2], m[3], m[4]) for m in re.finditer(r"\b([spo])=(\w+)(?::(\w+))?(?:\[`?([^\]`]*)`?\])?", arguments)]


#: What an alias holds that stands for a property's values.
VALUE = "a value"


def _led_to(schema: Schema, kind: str | None, predicate: str) -> set[str] | None:
    """The types of objects that a predicate leads to from ``kind``, or from any type that has it; None if none does."""
    kinds = [kind] if kind else [*schema.properties]
    found = {schema.relations.get(k, {}).get(predicate, VALUE) for k in kinds if predicate in schema.predicates(k)}
    return found or None


def _typed(step: Step, schema: Schema, kinds: dict[str, str | None]) -> tuple[list[str], str | None, str, str | None]:
    """Faults of a retrieval, and the types of its subject and object with its predicate; ``kinds`` are those of aliases so far."""
    own = {s.role: s for s in slots(step.arguments)}
    s, o, predicate = own["s"], own["o"], own["p"].kind or own["p"].alias
    faults = [f"{x.alias} is {kinds[x.alias]}, not {x.kind}" for x in (s, o) if x.kind and kinds.get(x.alias) and kinds[x.alias] != x.kind]
    subject = s.kind or kinds.get(s.alias)
    if subject == VALUE:
        return [*faults, f"{s.alias} holds values, which have no {predicate}"], subject, predicate, None
    target = _led_to(schema, subject, predicate)
    if target is None:
        return [*faults, f"{predicate} isn't declared on {subject or 'any type'}"], subject, predicate, None
    given = o.kind or kinds.get(o.alias)
    if given and given not in target and given not in BASIC:
        faults.append(f"{predicate} leads to {' or '.join(sorted(target))}, not {given}")
    one = next(iter(target)) if len(target) == 1 else None
    return faults, subject, predicate, one or given


def plan_faults(plan: str, schema: Schema) -> list[str]:
    """Unknown operators, aliases used before they exist, predicates that their subject's type doesn't have, and types that don't agree.

    An alias keeps the type that it was given or that a relation led it to.
    """
    faults: list[str] = []
    kinds: dict[str, str | None] = {}
    known: set[str] = set()
    for step in parse_plan(plan):
        where = f"Action{step.number}"
        if step.operator not in OPERATORS:
            faults.append(f"{where}: unknown operator {step.operator}")
        if step.operator == "Retrieval":
            own = {s.role: s for s in slots(step.arguments)}
            if set(own) != {"s", "p", "o"}:
                faults.append(f"{where}: needs s, p and o")
                continue
            if own["s"].alias not in known and own["s"].name is None and own["o"].name is None:
                faults.append(f"{where}: {own['s'].alias} is used before it exists")
            wrong, subject, _, target = _typed(step, schema, kinds)
            faults += [f"{where}: {x}" for x in wrong]
            kinds |= {alias: kind for alias, kind in ((own["s"].alias, subject), (own["o"].alias, target)) if kind}
            known |= {own["s"].alias, own["p"].alias, own["o"].alias}
        elif step.operator == "Deduce":
            op = re.search(r"op=(\w+)", step.arguments)
            if not op or op.group(1) not in DEDUCTIONS:
                faults.append(f"{where}: unknown deduction")
        if step.operator in ("Output", "Math", "Deduce"):
            used = re.findall(r"`?\b([a-z]+\d+)\b`?", re.sub(r"target=.*|(?:op|->)=?\w+", "", step.arguments))
            faults += [f"{where}: {a} is used before it exists" for a in used if a not in known]
        if made := re.search(r"->\s*`?(\w+)", step.arguments):
            known.add(made.group(1))
    return faults


def _nodes_of(nodes: DataFrame, slot: Slot, kind: str | None) -> DataFrame:
    """Ids of the nodes with a slot's name and type."""
    named = nodes.filter(F.col("name") == slot.name) if slot.name else nodes
    return (named.filter(F.col("label") == kind) if kind else named).select(F.col("id").alias("value"))


def run_plan(plan: str, schema: Schema, nodes: DataFrame, edges: DataFrame, deduce: Mapping[str, Callable] | None = None) -> dict[str, DataFrame]:
    """The output aliases of a plan as DataFrames of values; a plan with faults is refused.

    ``nodes(id, name, label, properties)`` and ``edges(src, label, dst)``; each retrieval is a join
    chain over all of an alias's values at once.  A retrieval keeps, of its subject and its object
    alike, the values that have a partner: names and types narrow an alias, and one that is bound
    already keeps what it has in common.
    """
    if faults := plan_faults(plan, schema):
        raise ValueError("; ".join(faults))
    values: dict[str, DataFrame] = {}
    kinds: dict[str, str | None] = {}
    out: dict[str, DataFrame] = {}
    for step in parse_plan(plan):
        if step.operator == "Retrieval":
            own = {s.role: s for s in slots(step.arguments)}
            s, o = own["s"], own["o"]
            _, kind, predicate, target = _typed(step, schema, kinds)
            subject = _nodes_of(nodes, s, kind) if s.alias not in values or s.name or s.kind else None
            as_value = target == VALUE or (target in BASIC and predicate not in schema.relations.get(kind or "", {}))
            if as_value:
                found = nodes.select(F.col("id").alias("s"), F.element_at("properties", F.lit(predicate)).alias("o")).filter("o is not null")
                found = found.filter(F.col("o") == o.name) if o.name else found
            else:
                found = edges.filter(F.col("label") == predicate).select(F.col("src").alias("s"), F.col("dst").alias("o"))
                if o.name or target:
                    found = found.join(_nodes_of(nodes, o, target).withColumnRenamed("value", "o"), "o", "left_semi")
            for side, narrow in (("s", subject), ("s", values.get(s.alias)), ("o", values.get(o.alias))):
                if narrow is not None:
                    found = found.join(narrow.withColumnRenamed("value", side), side, "left_semi")
            values[s.alias] = found.select(F.col("s").alias("value")).distinct()
            values[o.alias] = found.select(F.col("o").alias("value")).distinct()
            kinds |= {alias: k for alias, k in ((s.alias, kind), (o.alias, target)) if k}
        elif step.operator == "Output":
            for alias in re.findall(r"\w+", step.arguments):
                out[alias] = values[alias]
        elif deduce and step.operator in deduce:
            alias = re.search(r"->\s*`?(\w+)", step.arguments)
            values[alias.group(1) if alias else f"d{step.number}"] = deduce[step.operator](step, values)
    return out


@dataclass
class EvidenceState:
    """What an iterative solver has covered, misses and can't support; coverage only grows."""

    covered: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    unsupported: tuple[str, ...] = ()
    conflicts: tuple[str, ...] = ()

    def updated(self, covered=(), missing=(), unsupported=(), conflicts=()) -> EvidenceState:
        return EvidenceState(tuple(dict.fromkeys([*self.covered, *covered])), tuple(missing), tuple(unsupported), tuple(conflicts))

    def status(self) -> str:
        if self.conflicts:
            return "conflict"
        if not self.missing and self.covered:
            return "sufficient"
        return "insufficient" if self.missing else "unknown"


def iterate(question: str, plan, execute, update, limit: int = 5) -> EvidenceState:
    """Plan, execute and update until the evidence suffices; a conflict is verified first, and ``limit`` rounds end it."""
    state = EvidenceState()
    for _ in range(limit):
        task = ("verify", state.conflicts[0]) if state.conflicts else plan(question, state)
        state = state.updated(**update(state, execute(task)))
        if state.status() == "sufficient":
            break
    return state
