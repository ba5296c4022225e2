"""Model replies decoded into VARIANT values, with tolerance and typed rejects; nothing of a reply is ever executed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _unfenced(text: Column) -> Column:
    """What stands between the first pair of code fences, or all of it."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n?(.*?)```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(text))


def balanced(text: Column) -> Column:
    """The first value in brackets, from its opening bracket to the one that closes it; null if none closes. Brackets in strings don't count."""
    tail = F.regexp_extract(text, r"(?s)[\[{].*", 0)
    # Brackets, strings (an open one up to the end) and what is between them; together they are the whole tail.
    tokens = F.regexp_extract_all(tail, F.lit(r'(?s)[\[{\]}]|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[^\[{\]}"]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("closed"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
        return F.when(s["closed"], s).otherwise(F.struct((s["at"] + F.length(t)).alias("at"), depth.alias("depth"), (depth == 0).alias("closed")))

    end = F.aggregate(tokens, start, step, lambda s: F.when(s["closed"], s["at"]))
    return F.when(end > 0, F.substring(tail, F.lit(1), end))


def decoded(reply: Column | str) -> Column:
    """``struct(value VARIANT, status)``: ``parsed`` as it stands or between fences, ``recovered`` from the first closed brackets, ``rejected``, or ``empty``."""
    text = _unfenced(col(reply))
    whole = F.try_parse_json(text)
    part = F.try_parse_json(balanced(text))
    blank = col(reply).isNull() | (F.trim(col(reply)) == "")
    value = F.when(~blank, F.coalesce(whole, part))
    status = F.when(blank, "empty").when(whole.isNotNull(), "parsed").when(part.isNotNull(), "recovered").otherwise("rejected")
    return F.struct(value.alias("value"), status.alias("status"))


def listed(value: Column, key: str) -> Column:
    """The list under ``output.key``, ``key`` or ``output``, or the value itself, as an array of VARIANT; null if there is no list."""
    places = (f"$.output.{key}", f"$.{key}", "$.output", "$")
    return F.coalesce(*(F.try_variant_get(value, p, "array<variant>") for p in places))


def _text(value: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(value, path, "string")), F.lit(""))


def entities(value: Column) -> Column:
    """``struct(name, category, official_name, fault)`` of each listed entity; one that is no object or has no name has a fault."""

    def one(e: Column) -> Column:
        whole = F.schema_of_variant(e)
        name = F.when(whole.startswith("OBJECT"), _text(e, "$.name"))
        fault = F.when(~whole.startswith("OBJECT"), "not an object").when(name.isNull(), "no name")
        return F.struct(name.alias("name"), F.when(name.isNotNull(), _text(e, "$.category")).alias("category"), F.when(name.isNotNull(), _text(e, "$.official_name")).alias("official_name"), fault.alias("fault"))

    return F.transform(listed(value, "named_entities"), one)


def standardised(value: Column, asked: Column) -> Column:
    """``struct(name, official_name)`` of the entities in a reply, and of those ``asked`` for (an array of names) that it leaves out, under their own names."""
    found = F.filter(entities(value), lambda e: e["fault"].isNull())
    told = F.transform(found, lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["official_name"], e["name"]).alias("official_name")))
    told = F.coalesce(told, F.array().cast("array<struct<name:string,official_name:string>>"))
    names = F.transform(told, lambda e: e["name"])
    left = F.transform(F.array_except(asked, names), lambda n: F.struct(n.alias("name"), n.alias("official_name")))
    return F.concat(told, F.coalesce(left, F.array().cast("array<struct<name:string,official_name:string>>")))


def triples(value: Column) -> Column:
    """``struct(s, p, o, fault)`` of each listed triple, which may be a list of three or an object with subject, predicate and object."""

    def one(t: Column) -> Column:
        is_list = F.schema_of_variant(t).startswith("ARRAY")
        s, p, o = (F.when(is_list, _text(t, f"$[{k}]")).otherwise(_text(t, f"$.{name}")) for k, name in enumerate(("subject", "predicate", "object")))
        extra = F.when(is_list, F.size(F.try_variant_get(t, "$", "array<variant>")) != 3)
        fault = F.when(extra, "not three").when(s.isNull() | p.isNull() | o.isNull(), "incomplete")
        return F.struct(*(F.when(fault.isNull(), x).alias(n) for n, x in (("s", s), ("p", p), ("o", o))), fault.alias("fault"))

    return F.transform(listed(value, "triples"), one)
