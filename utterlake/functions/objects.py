"""JSON objects inside other text, found by a pattern of balanced braces, or by folds over the signs that open, close and quote where
they nest deeper than it goes; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalise import ENTITY

_STRICT = {"allowSingleQuotes": "false"}
#: How deep braces may nest for the pattern.
DEPTH = 12


def _inner(depth: int) -> str:
    """What may stand in an object before its closing brace, without giving back: other signs, quoted text, and objects to a depth."""
    nested = rf"|\{{{_inner(depth - 1)}\}}" if depth else ""
    return rf'(?:[^{{}}"]++|"(?:[^"\\]++|\\.)*+"{nested})*+'


#: An object to its closing brace, and the braces of one that goes deeper. Patterns need (?s).
BALANCED = rf"\{{{_inner(DEPTH - 1)}\}}"
_DEEPER = "".join(rf"\{{{_inner(k)}" for k in range(DEPTH - 1, -1, -1)) + r"\{"
NO_ENTITIES = f"array<{ENTITY}>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fields(text: Column) -> Column:
    """The fields of a text that starts with a JSON object, as text; null for any other text."""
    return F.from_json(text, "map<string,string>", _STRICT)


def is_object(text: Column) -> Column:
    """Whether a text as a whole is a JSON object.

    The reader stops behind the first value, so the text is read inside an array and inside an object: what comes after a first object
    can close one of them early, but not both.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT)
    held = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "map<string,string>", _STRICT)
    bare = stripped(text)
    return F.coalesce(bare.startswith("{") & bare.endswith("}") & (F.size(listed) == 1) & held.isNotNull(), F.lit(False))


def _last(m: Column, is_name: Callable[[Column], Column]) -> Column:
    """struct(v) of the last field whose name fits; null where none does."""
    return F.try_element_at(F.transform(F.filter(F.map_entries(m), lambda e: is_name(e["key"])), lambda e: F.struct(e["value"].alias("v"))), F.lit(-1))


def value(m: Column, name: str) -> Column:
    """A field as text: empty where there is none; a JSON null is None."""
    return bound(_last(m, _named(name)), lambda found: F.when(found.isNotNull(), F.coalesce(found["v"], F.lit("None"))).otherwise(F.lit("")))


def value_any_case(m: Column, *names: str) -> Column:
    """The field of the first of these names there is, else of the first of them there is in any case; of equal names the last; null where there is none."""
    return F.coalesce(*[_last(m, _named(n)) for n in names], *[_last(m, _loosely(n)) for n in names])["v"]


def _named(name: str) -> Callable[[Column], Column]:
    return lambda k: k == name


def _loosely(name: str) -> Callable[[Column], Column]:
    return lambda k: F.lower(F.trim(k)) == name


def typed_entities(text: Column) -> Column:
    """Entities of a JSON array in their own case: type, and the first of filler, filter and value that is not null; other forms have an empty type."""
    objects = F.filter(F.from_json(F.when(F.ltrim(text).startswith("["), text), "array<string>"), lambda x: x.startswith("{"))
    filler = lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("filler", "filter", "value")], F.lit(""))
    found = F.transform(F.filter(F.transform(objects, fields), lambda m: m.isNotNull()), lambda m: F.struct(stripped(value(m, "type")).alias("type"), filler(m).alias("filler")))
    return F.coalesce(found, F.array().cast(NO_ENTITIES))


def _closing(pieces: Column, at: Column) -> Column:
    """The piece that closes the object opened by the piece at (from 1); null where none does."""
    start = F.struct(F.lit(0).alias("done"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), at.cast("int").alias("k"))

    def step(s: Column, piece: Column) -> Column:
        sign = F.substring(piece, 1, 1)
        free = ~s["quoted"] & ~s["escaped"]
        depth = s["depth"] + F.when(free & (sign == "{"), 1).when(free & (sign == "}"), -1).otherwise(0)
        quoted = F.when(~s["escaped"] & (sign == '"'), ~s["quoted"]).otherwise(s["quoted"])
        escaped = s["quoted"] & ~s["escaped"] & (piece == "\\")
        done = F.when(free & (sign == "}") & (depth == 0), s["k"]).otherwise(F.lit(0))
        return F.when(s["done"] > 0, s).otherwise(F.struct(done.alias("done"), depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), (s["k"] + 1).alias("k")))

    return F.nullif(F.aggregate(F.slice(pieces, at, F.size(pieces)), start, step, lambda s: s["done"]), F.lit(0))


def signs(text: Column) -> Column:
    """The text cut before each {, }, quote and backslash."""
    return F.split(text, r'(?=[{}"\\])')


def opened(pieces: Column) -> Column:
    """Which pieces open an object."""
    return F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.get(pieces, k - 1).startswith("{"))


def object_at(pieces: Column, at: Column) -> Column:
    """The text of the object that the piece at opens, to its closing brace; null where it is not closed."""
    return bound(_closing(pieces, at), lambda end: F.when(end.isNotNull(), F.concat(F.array_join(F.slice(pieces, at, F.greatest(end - at, F.lit(0))), ""), F.lit("}"))))


def _deep(text: Column) -> Column:
    """Whether braces nest too deep for the pattern; only a text of that many braces is looked at."""
    return (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) > DEPTH) & text.rlike(f"(?s){_DEEPER}")


def _at_braces(text: Column) -> Column:
    """The object that each brace of a text opens, as text; empty where none closes it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?:(?=({BALANCED}))|)\{{"), F.lit(1))


def object_fields(text: Column) -> Column:
    """The fields of a text that as a whole is a JSON object, as text; null for any other text."""
    whole = lambda t: F.when(_deep(t), is_object(t)).otherwise(t.rlike(rf"(?s)\A{BALANCED}\z"))
    return bound(stripped(text), lambda t: F.when(t.startswith("{") & t.endswith("}") & whole(t), fields(t)))


def _first(text: Column, kind: str, read: Callable[[Column], Column]) -> Column:
    """What read gives of the first object of a text for which it isn't null; each brace is looked at until one is found."""
    none = F.lit(None).cast(kind)

    def look(pieces: Column) -> Column:
        return F.aggregate(opened(pieces), none, lambda acc, at: F.when(acc.isNotNull(), acc).otherwise(read(object_at(pieces, at))))

    def near(t: Column) -> Column:
        rest = F.aggregate(_at_braces(t), none, lambda acc, o: F.when(acc.isNotNull() | (o == ""), acc).otherwise(read(o)))
        return bound(F.regexp_extract(t, f"(?s)({BALANCED})", 1), lambda o: F.when(o != "", F.coalesce(read(o), rest)))

    return bound(text, lambda t: F.when(_deep(t), bound(signs(t), look)).when(t.contains("{"), near(t)))


def first_object(text: Column) -> Column:
    """The first JSON object that starts at a brace of the text, as text; null without one."""
    return _first(text, "string", lambda o: bound(o, lambda o: F.when(fields(o).isNotNull(), o)))


def first_fields(text: Column) -> Column:
    """The fields of the first JSON object that starts at a brace of the text, as text; null without one."""
    return _first(text, "map<string,string>", fields)


def objects(text: Column) -> Column:
    """array<struct<at, object>>: each brace that opens, with the number of characters before it, and the text to its closing brace or null."""
    return bound(signs(text), lambda pieces: F.transform(opened(pieces), lambda k: F.struct(F.length(F.array_join(F.slice(pieces, F.lit(1), k - 1), "")).alias("at"), object_at(pieces, k).alias("object"))))


def objects_apart(text: Column) -> Column:
    """The objects of a text that lie in none before them, as texts."""
    return F.when(_deep(text), apart(objects(text))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s){BALANCED}"), F.lit(0)))


def objects_after(text: Column, mark: str) -> Column:
    """For each place of the mark (a pattern), the object of the first brace behind it; null or empty where none closes it."""

    def by_place(parts: Column, marks: Column, braces: Column) -> Column:
        size = lambda xs, k: F.length(F.array_join(F.slice(xs, F.lit(1), k + 1), ""))
        return F.transform(marks, lambda _, k: bound(size(parts, k) + size(marks, k), lambda end: F.get(F.filter(braces, lambda b: b["at"] >= end), F.lit(0))["object"]))

    slow = bound(F.struct(F.split(text, mark).alias("parts"), F.regexp_extract_all(text, F.lit(mark), F.lit(0)).alias("marks"), objects(text).alias("braces")), lambda x: by_place(x["parts"], x["marks"], x["braces"]))
    return F.when(_deep(text), slow).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s){mark}(?:(?=[^{{]*+({BALANCED}))|)"), F.lit(1)))


def apart(found: Column) -> Column:
    """Of objects(text) those that lie in none before them, as texts."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept"))
    taken = lambda s, o: F.when(o["object"].isNull() | (o["at"] < s["end"]), s).otherwise(F.struct((o["at"] + F.length(o["object"])).alias("end"), F.concat(s["kept"], F.array(o["object"])).alias("kept")))
    return F.aggregate(found, start, taken, lambda s: s["kept"])
