"""Reading labels, candidates and reasons out of generated text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .normalise import ENTITY, clean, col, free_names, split_intent, standard_entities, weak_intent
from .objects import bound, fields, first_fields, is_object, object_fields, objects_after, objects_apart, stripped, typed_entities, value, value_any_case

LABEL = f"struct<scenario:string,action:string,entities:array<{ENTITY}>>"
NONE = F.array


def _object(text: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)


def _label(text: Column, default: str) -> Column:
    """Label of a JSON object; null where it is no object."""

    def label(m: Column) -> Column:
        field = lambda k: F.coalesce(F.nullif(clean(F.try_element_at(m, F.lit(k))), F.lit("")), F.lit(default))
        return F.when(m.isNotNull(), F.struct(field("scenario").alias("scenario"), field("action").alias("action"), standard_entities(F.try_element_at(m, F.lit("entities"))).alias("entities")))

    return bound(F.from_json(text, "map<string,string>"), label)


def extract_json(c: str | Column, default: str = "none") -> Column:
    """Label from the first { to the last }; where that is no JSON, quoted or else loose scenario and action, without entities.

    Without both braces there is nothing to read, and all fields have the default.
    """
    text = F.coalesce(col(c), F.lit(""))
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    part = F.substr(text, first, F.greatest(last - first + 1, F.lit(0)))
    none = F.array().cast(f"array<{ENTITY}>")
    pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, rf'"{k}":\s*"([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"{k}[^\p{{L}}\p{{N}}_]+([a-zA-Z_]+)", 1), F.lit("")), F.lit(default))
    loose = F.struct(pick("scenario").alias("scenario"), pick("action").alias("action"), none.alias("entities"))
    nothing = F.struct(F.lit(default).alias("scenario"), F.lit(default).alias("action"), none.alias("entities"))
    read = bound(part, lambda t: F.when(is_object(t), _label(t, default)))
    return F.when(~text.contains("{") | ~text.contains("}"), nothing).otherwise(F.coalesce(read, loose))


def fenced(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))


def parse_j(c: str | Column) -> Column:
    """Label after the last J:, fenced or else in the outermost braces; null without one."""
    tail = F.element_at(F.split(F.coalesce(col(c), F.lit("")), r"J\s*[:：]"), -1)
    return _label(F.coalesce(fenced(tail), _object(tail)), "")


#: Heads before a label, in the order they are looked for, and the fields an object may be wrapped in.
HEADS = ("J", "SLU", "FINAL", "Output")
WRAPPERS = ("final", "Final", "j", "J", "output", "prediction", "result")


def _tail(text: Column) -> Column:
    """What follows the first head of the first kind that stands at the start of a line; empty without one."""
    pattern = lambda head: rf"(?is)(?:^|\n)\s*{head}\s*[:：]\s*(.+)$"
    options = [F.when(text.rlike(pattern(h)), stripped(F.regexp_extract(text, pattern(h), 1))) for h in HEADS]
    return F.coalesce(*options, F.lit(""))


def _readings(text: Column) -> Column:
    """The fenced part or else the text, and the text, each also with doubled braces made single; blank ones hold nothing, and each is there once."""
    fence = lambda t, p: F.when(t.rlike(p), F.regexp_extract(t, p, 1))
    inner = F.when(text.contains("```"), F.coalesce(fence(text, r"(?s)```json\s*(.*?)\s*```"), fence(text, r"(?s)```\s*(.*?)\s*```"))).otherwise(F.lit(None))
    both = F.array_compact(F.array(inner, text))
    return F.array_distinct(F.flatten(F.transform(both, lambda t: F.array(t, F.replace(F.replace(t, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))))))


def _first_read(text: Column) -> Column:
    """The fields of the first object of the readings of a text; null without one."""
    read = lambda t: F.aggregate(_readings(t), F.lit(None).cast("map<string,string>"), lambda acc, r: F.when(acc.isNotNull(), acc).otherwise(first_fields(r)))
    return F.when(text.contains("{"), bound(stripped(text), read))


def _predicted(text: Column) -> Column:
    """P3's label; null where no object is found."""
    found = F.coalesce(bound(_tail(text), _first_read), _first_read(text))

    def inside(m: Column, key: Column) -> Column:
        return F.coalesce(object_fields(F.try_element_at(m, key)), m)

    def label(m: Column) -> Column:
        own = F.struct(F.coalesce(value_any_case(m, "scenario"), F.lit("")).alias("s"), F.coalesce(value_any_case(m, "action"), F.lit("")).alias("a"))
        return bound(own, lambda x: bound(F.when((x["s"] == "") & (x["a"] == ""), parted(m)).otherwise(x), lambda y: F.struct(stripped(y["s"]).alias("scenario"), stripped(y["a"]).alias("action"), typed_entities(value_any_case(m, "entities", "slots")).alias("entities"))))

    def parted(m: Column) -> Column:
        def at_sign(intent: Column) -> Column:
            split = intent.contains("_")
            return F.struct(F.when(split, F.substring_index(intent, "_", 1)).otherwise(F.lit("")).alias("s"), F.when(split, F.regexp_replace(intent, "^[^_]*_", "")).otherwise(intent).alias("a"))

        return bound(stripped(F.coalesce(value_any_case(m, "intent"), F.lit(""))), at_sign)

    return bound(F.aggregate(F.array(*map(F.lit, WRAPPERS)), found, inside), lambda m: F.when(m.isNotNull(), label(m)))


def parse_prediction_label(c: str | Column, default: str = "error") -> Column:
    """Label of the first JSON object after the first J, SLU, FINAL or Output head (of the first kind there is), or else in the text.

    Fences and doubled braces don't matter; wrappers are opened one in another; names of fields may be in any case, and slots stands in
    for entities. An intent is split at its first _ where there is neither scenario nor action. Blank fields stay blank; only a text
    without an object has the default.
    """
    nothing = F.struct(F.lit(default).alias("scenario"), F.lit(default).alias("action"), F.array().cast(f"array<{ENTITY}>").alias("entities"))
    return bound(F.coalesce(col(c), F.lit("")), lambda text: F.coalesce(_predicted(text), nothing))


#: What counts as no label.
MISSING = ("", "error", "err", "unknown", "none", "null", "n/a", "na")
_FINAL = r"(?i)\bfinal(?:_prediction)?\b\s*[:=]\s*"


def missing(c: Column) -> Column:
    return F.lower(stripped(F.coalesce(c, F.lit("")))).isin(*MISSING)


def _parted(intent: Column) -> tuple[Column, Column]:
    """Scenario and action of an intent, at its first _, else at its first :, else all action."""
    i = stripped(intent)
    at = lambda sign: (stripped(F.substring_index(i, sign, 1)), stripped(F.regexp_replace(i, f"^[^{sign}]*{sign}", "")))
    (s1, a1), (s2, a2) = at("_"), at(":")
    return F.when(i.contains("_"), s1).when(i.contains(":"), s2).otherwise(F.lit("")), F.when(i.contains("_"), a1).when(i.contains(":"), a2).otherwise(i)


def _filled(scenario: Column, action: Column, intent: Column, entities: Column) -> Column:
    """A label whose missing scenario or action comes from the intent."""

    def whole(x: Column) -> Column:
        s, a = _parted(x["i"])
        either = lambda own, other: F.when(missing(own), bound(other, lambda o: F.when(o != "", o).otherwise(own))).otherwise(own)
        return F.struct(either(x["s"], s).alias("scenario"), either(x["a"], a).alias("action"), x["e"].alias("entities"))

    return bound(F.struct(scenario.alias("s"), action.alias("a"), intent.alias("i"), entities.alias("e")), whole)


def _own_label(m: Column) -> Column:
    """Label of an object's fields; null where all of it is empty."""
    label = _filled(stripped(value(m, "scenario")), stripped(value(m, "action")), value(m, "intent"), typed_entities(F.try_element_at(m, F.lit("entities"))))
    return bound(F.when(m.isNotNull(), label), lambda x: F.when((x["scenario"] != "") | (x["action"] != "") | (F.size(x["entities"]) > 0), x))


def _option(m: Column, where: str, own: str) -> Column:
    """struct(label, method) of the first that an object's fields give of: its final, its final_prediction, its own; null without a label."""
    entry = lambda label, name: bound(label, lambda x: F.when(x.isNotNull(), F.struct(x.alias("label"), F.lit(name).alias("method"))))
    inner = lambda m, k: bound(object_fields(F.try_element_at(m, F.lit(k))), _own_label)
    options = lambda m: F.coalesce(entry(inner(m, "final"), f"{where}_final"), entry(inner(m, "final_prediction"), f"{where}_final_prediction"), entry(_own_label(m), own))
    return bound(m, lambda m: F.when(m.isNotNull(), options(m)))


def _pattern_label(text: Column) -> Column:
    """Scenario and action of the last quoted or bare assignments after the last final, or in the whole text."""
    mark = r"(?i)\bfinal(?:_prediction)?\b"
    part = F.when(text.rlike(mark), F.regexp_extract(text, r"(?is).*\bfinal(?:_prediction)?\b(.*)", 1)).otherwise(text)

    def last(part: Column, k: str) -> Column:
        kinds = (rf'"{k}"\s*[:=]\s*"([^"]+)"', rf"'{k}'\s*[:=]\s*'([^']+)'", rf"{k}\s*[:=]\s*([A-Za-z0-9_:-]+)")
        return F.coalesce(*[F.nullif(stripped(F.try_element_at(F.regexp_extract_all(part, F.lit(f"(?is){p}"), F.lit(1)), F.lit(-1))), F.lit("")) for p in kinds], F.lit(""))

    return bound(part, lambda p: _filled(last(p, "scenario"), last(p, "action"), last(p, "intent"), F.array().cast(f"array<{ENTITY}>")))


def _final(text: Column) -> Column:
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    inner = F.when(text.contains("```") & text.rlike(fence), stripped(F.regexp_extract(text, fence, 1))).otherwise(stripped(text))
    return bound(inner, lambda t: _chosen(text, t))


def _first(objects: Column, option: Callable[[Column], Column]) -> Column:
    """The first struct(label, method) that one of the objects gives, the last first; the others behind it are not read."""
    none = F.lit(None).cast(f"struct<label:{LABEL},method:string>")
    return F.aggregate(F.reverse(objects), none, lambda acc, o: F.when(acc.isNotNull(), acc).otherwise(option(o)))


def _chosen(raw: Column, text: Column) -> Column:
    entry = lambda label: F.when(label.isNotNull(), F.struct(label.alias("label"), F.lit("final_keyword_object").alias("method")))
    named = _first(objects_after(text, _FINAL), lambda o: bound(bound(fields(o), _own_label), entry))
    quoted = F.when(text.startswith('"') & text.endswith('"'), stripped(F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x")))
    whole = _option(object_fields(F.coalesce(quoted, text)), "top_level", "top_level")
    inner = _first(objects_apart(text), lambda o: _option(fields(o), "embedded", "embedded_object"))
    none = F.lit(None).cast(f"struct<label:{LABEL},method:string>")
    first = F.coalesce(F.when(text.contains("{"), named).otherwise(none), whole, F.when(text.contains("{"), inner).otherwise(none))
    nothing = F.struct(F.struct(F.lit("").alias("scenario"), F.lit("").alias("action"), F.array().cast(f"array<{ENTITY}>").alias("entities")).alias("label"), F.lit("not_found").alias("method"))

    def patched(x: Column) -> Column:
        def merge(p: Column) -> Column:
            fill = lambda k: F.when(missing(x["label"][k]) & ~missing(p[k]), p[k]).otherwise(x["label"][k])
            return F.struct(F.struct(fill("scenario").alias("scenario"), fill("action").alias("action"), x["label"]["entities"].alias("entities")).alias("label"), x["method"].alias("method"))

        return F.when(missing(x["label"]["scenario"]) | missing(x["label"]["action"]), bound(_pattern_label(raw), merge)).otherwise(x)

    return bound(F.coalesce(first, nothing), patched)


def extract_final(c: str | Column) -> Column:
    """struct(label, method): the first of these that gives a scenario, action or entities, with all its own fields.

    final_keyword_object: the object after the last `final:` or `final_prediction =` that has one; top_level_final,
    top_level_final_prediction, top_level: the text as a whole; embedded_final, embedded_final_prediction, embedded_object: objects in
    it, the last first; not_found. A missing or error-like scenario or action is then filled from the last `name = value` patterns.
    """
    return bound(F.coalesce(col(c), F.lit("")), _final)


def information(label: Column) -> Column:
    """How many of scenario, action and entities a label has."""
    return (clean(label["scenario"]) != "").cast("int") + (clean(label["action"]) != "").cast("int") + (F.size(label["entities"]) > 0).cast("int")


def recover_predictions(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """P5: the most informative label that is read from the text fields or from the whole row as JSON, the first of equals.

    The row's own scenario, action and entities fill what that label lacks. changed: any of the three is another now; recovered: there
    was neither scenario nor action before, and is now; unresolved: one of the two is missing or error-like still.
    """
    none = F.array().cast(f"array<{ENTITY}>")
    own = F.struct(stripped(clean("scenario")).alias("scenario"), stripped(clean("action")).alias("action"), F.coalesce("entities", none).alias("entities"))
    read = lambda text: bound(parse_prediction_label(text), lambda x: F.when((F.lower(x["scenario"]) != "error") | (F.lower(x["action"]) != "error") | (F.size(x["entities"]) > 0), x))
    parsed = F.filter(F.array(*[read(F.nullif(stripped(clean(c)), F.lit(""))) for c in texts], read(F.to_json(F.struct(*df.columns)))), lambda x: x.isNotNull())
    best = F.array_max(F.transform(parsed, lambda x, k: F.struct(information(x).alias("score"), (-k).alias("order"), x.alias("label"))))["label"]

    def merged(row: Column) -> Column:
        o, b = row["own"], row["best"]
        text = lambda k: F.coalesce(F.nullif(b[k], F.lit("")), o[k]).alias(k)
        return F.struct(text("scenario"), text("action"), F.when(F.size(b["entities"]) > 0, b["entities"]).otherwise(o["entities"]).alias("entities"))

    own_, new_ = free_names(df, "own", "new")
    found = df.withColumn(own_, own).withColumn(new_, bound(F.struct(F.col(own_).alias("own"), best.alias("best")), merged))
    o, x = F.col(own_), F.col(new_)
    return found.select(
        *[c for c in df.columns if c not in ("scenario", "action", "entities")], x["scenario"].alias("scenario"), x["action"].alias("action"), x["entities"].alias("entities"), (o != x).alias("changed"),
        ((o["scenario"] == "") & (o["action"] == "") & ((x["scenario"] != "") | (x["action"] != ""))).alias("recovered"), (missing(x["scenario"]) | missing(x["action"])).alias("unresolved"),
    )


RECOVERY = ("changed", "recovered", "unresolved")


def recovery_stats(recovered: DataFrame) -> DataFrame:
    """P5's counts, where the rows themselves are not wanted."""
    return recovered.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in RECOVERY])


def observed_recovery(recovered: DataFrame, name: str = "recovery") -> tuple[DataFrame, Observation]:
    """P5's rows, and its counts as an observation that is filled by the one job which reads or writes the rows."""
    seen = Observation(name)
    return recovered.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c)).alias(c) for c in RECOVERY]), seen


def prefixed_line(c: str | Column, letter: str) -> Column:
    """What follows the first `letter:` (ASCII or full-width colon) at the start of a line."""
    return F.trim(F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"(?im)^[ \t]*{letter}[ \t]*[:：][ \t]*(.*)$", 1))


def extract_crj(c: str | Column) -> Column:
    """struct(c, r, j, valid): the last C line that has an R line and, after that, a J line below it, with the first such lines.

    Other lines may stand between; only `:` is a colon here; valid says whether there are such lines, which may be empty behind it.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x.rlike("^[CRJ]:"))
    none = F.lit(None).cast("string")
    # From the last line up: the first J line below, the first R line below with the J line below that, and what is found.
    start = F.struct(none.alias("j"), none.alias("r"), none.alias("rj"), F.lit(None).cast("struct<c:string,r:string,j:string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        kind, body = F.substring(x, 1, 1), F.trim(F.regexp_replace(x, r"^[CRJ]:\s*", ""))
        state = lambda j, r, rj, found: F.struct(j.alias("j"), r.alias("r"), rj.alias("rj"), found.alias("found"))
        whole = F.struct(body.alias("c"), s["r"].alias("r"), s["rj"].alias("j"))
        return (
            F.when(s["found"].isNotNull() | ((kind == "C") & s["rj"].isNull()), s).when(kind == "J", state(body, s["r"], s["rj"], s["found"]))
            .when(kind == "R", state(s["j"], body, s["j"], s["found"])).otherwise(state(s["j"], s["r"], s["rj"], whole))
        )

    part = lambda x, k: F.coalesce(x[k], F.lit("")).alias(k)
    return bound(F.aggregate(F.reverse(lines), start, step, lambda s: s["found"]), lambda x: F.struct(part(x, "c"), part(x, "r"), part(x, "j"), x.isNotNull().alias("valid")))


#: Heads of the parts of a C line; the first that fits goes.
INTENT_HEADS = ("intent candidates:", "intent candidate:", "intent:", "intents:")
SLOT_HEADS = ("slot candidates:", "slot candidate:", "slots:", "slot:")


def _headless(part: Column, heads: Sequence[str]) -> Column:
    return stripped(F.regexp_replace(stripped(part), f"(?i)^(?:{'|'.join(heads)})", ""))


def _items(part: Column) -> Column:
    return F.filter(F.transform(F.split(part, r"\|"), stripped), lambda x: x != "")


def _second(line: Column) -> Column:
    """What follows the first ; of a line."""
    return stripped(F.regexp_replace(F.when(line.contains(";"), line), r"(?s)^[^;]*;", ""))


def intent_candidates(line: str | Column, distinct: bool = True) -> Column:
    """Intent candidates of what follows C: up to the first ;. distinct: each once, and without none; else only without (none)."""
    found = F.transform(_items(_headless(F.substring_index(clean(line), ";", 1), INTENT_HEADS)), weak_intent)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("", "(none)", "none"))) if distinct else F.filter(found, lambda x: ~x.isin("", "(none)"))


def slot_candidates(line: str | Column, distinct: bool = True) -> Column:
    """Slot candidates in lower case, without their values, of what follows the first ;, or else of the whole line."""
    text = clean(line)
    part = F.regexp_replace(_headless(F.coalesce(F.nullif(_second(text), F.lit("")), text), SLOT_HEADS), r"\([^)]*\)", "")
    found = F.filter(F.transform(_items(part), F.lower), lambda x: ~x.isin("(none)", "none"))
    return F.array_distinct(found) if distinct else found


def _c_block(text: Column) -> Column:
    """The first C line and the lines after it to a blank or another head, in one line; a text that only speaks of intent candidates is whole; null without either."""
    lines = F.split(text, r"\R")
    head = r"^\s*[cC]\s*[:：]\s*(.*)$"
    at = F.array_position(F.transform(lines, lambda x: x.rlike(head)), True).cast("int")
    rest = F.transform(F.slice(lines, at + 1, F.size(lines)), stripped)
    stop = F.array_position(F.transform(rest, lambda x: (x == "") | x.rlike(r"^\s*[cCrRjJ]\s*[:：]")), True).cast("int")
    own = stripped(F.regexp_extract(F.get(lines, at - 1), head, 1))
    block = F.array_join(F.filter(F.concat(F.array(own), F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest)))), lambda x: x != ""), " ")
    return F.when(at > 0, block).when(text.rlike(r"(?i)\bintent\s*candidates?\b"), stripped(text))


def _strong(name: Column) -> Column:
    """A name in lower case, without quotes and brackets around it, other signs and spaces as single _."""
    bare = F.regexp_replace(F.lower(stripped(name)), r"^[`\"'\[\](){}]+|[`\"'\[\](){}]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _block_candidates(block: Column) -> Column:
    names = lambda items: F.array_distinct(F.filter(F.transform(items, _strong), lambda x: x.contains("_")))
    part = F.get(F.split(block, r"(?i)\n\s*[rj]\s*[:：]"), F.lit(0))
    part = F.get(F.split(F.get(F.split(part, r"(?i);\s*slot\s*candidates?\s*[:：]"), F.lit(0)), r"(?i)\bslot\s*candidates?\s*[:：]"), F.lit(0))
    part = F.regexp_replace(part, r"(?i)^\s*(?:intent\s*candidates?|intents?)\s*[:：\-]?\s*", "")
    listed = names(F.transform(F.split(part, r"[|,;\n]+"), lambda x: F.regexp_replace(stripped(x), r"^\s*\d+\s*[).:\-]?\s*", "")))
    loose = names(F.regexp_extract_all(part, F.lit(r"[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+"), F.lit(0)))
    return F.when(F.size(listed) > 0, listed).otherwise(loose)


def c_block_candidates(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """has_c, and the candidates of the C block of the field that gives the most, the first of equals.

    Candidates are strongly normalised names with a _ in them, without numbers before them; where the block lists none, all
    identifiers with _ or - in it.
    """
    of = lambda c: bound(_c_block(F.coalesce(F.col(c), F.lit(""))), lambda block: F.when(block.isNotNull(), _block_candidates(block)))
    found = F.filter(F.transform(F.array(*[of(c) for c in texts]), lambda x, k: F.struct(F.size(x).alias("n"), (-k).alias("order"), x.alias("found"))), lambda x: x["found"].isNotNull())
    best = F.array_max(found)["found"]
    return df.withColumns({"has_c": best.isNotNull(), "candidates": F.coalesce(best, F.array().cast("array<string>"))})


def rationale_pairs(line: str | Column) -> Column:
    """P10: (label, reason) of an R line `label!reason; …`; a part without ! is a label with an empty reason."""
    parts = F.filter(F.transform(F.split(F.nullif(clean(line), F.lit("(none)")), ";"), stripped), lambda x: x != "")
    pair = lambda x: F.struct(stripped(F.substring_index(x, "!", 1)).alias("label"), F.when(x.contains("!"), stripped(F.regexp_replace(x, "(?s)^[^!]*!", ""))).otherwise(F.lit("")).alias("reason"))
    return F.coalesce(F.transform(parts, pair), F.array().cast("array<struct<label:string,reason:string>>"))


def _tidy(candidate: Column) -> Column:
    """A candidate without quotes and heads, colons and spaces as single _, in its own case; empty where only a head is left."""
    bare = F.regexp_replace(stripped(candidate), "^[`'\" ]+|[`'\" ]+$", "")
    bare = F.regexp_replace(bare, r"(?i)^\s*(?:intent\s*candidates?|intents?)\s*[:：\-]?\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r":|\s+", "_"), r"(?i)^(?:intent_?candidates?|intents?)_+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "_+", "_"), "^[_ ]+|[_ ]+$", "")
    return F.when(F.lower(bare).isin("intent", "intents", "intentcandidate", "intentcandidates"), F.lit("")).otherwise(bare)


def sanitize_c_line(line: str | Column) -> Column:
    """A line that starts with C:, with tidy intent candidates, each once in any case, and its slot part as it is; other lines stay."""
    whole = F.coalesce(col(line), F.lit(""))
    body = stripped(F.substr(whole, F.lit(3)))
    tidy = F.filter(F.transform(_items(_headless(F.substring_index(body, ";", 1), INTENT_HEADS)), _tidy), lambda x: x != "")
    once = F.aggregate(tidy, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    slots = F.coalesce(_headless(_second(body), ("slot candidates:", "slot candidate:", "slot:", "slots:")), F.lit(""))
    again = bound(once, lambda names: F.concat(F.lit("C: Intent candidates: "), F.when(F.size(names) > 0, F.array_join(names, " | ")).otherwise(F.lit("(none)")), F.when(slots != "", F.concat(F.lit("; Slot candidates: "), slots)).otherwise(F.lit(""))))
    return F.when(~whole.startswith("C:"), whole).when(body == "", F.lit("C: (none)")).otherwise(again)


def reorder_candidates(candidates: str | Column, vocabulary: Sequence[str]) -> Column:
    """Candidates in the vocabulary's order, unknown ones last in their own."""
    ranks = F.create_map(*[x for k, v in enumerate(vocabulary) for x in (F.lit(v), F.lit(k))])
    ranked = F.transform(col(candidates), lambda x, i: F.struct(F.coalesce(F.try_element_at(ranks, x), F.lit(len(vocabulary)) + i).alias("rank"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def extract_answer_json(c: str | Column) -> Column:
    """JSON text: fenced as json; else after the first Answer:, its outermost braces or all of it; else the outermost braces; else the text."""
    text = stripped(F.coalesce(col(c), F.lit("")))
    fence, braces = r"(?s)```json\s*(.*?)\s*```", r"(?s)(\{.*\})"
    outer = lambda t: F.when(t.rlike(braces), F.regexp_extract(t, braces, 1)).otherwise(t)
    answer = stripped(F.regexp_replace(text, r"(?s)^.*?Answer:", ""))
    return F.when(text.rlike(fence), stripped(F.regexp_extract(text, fence, 1))).when(text.contains("Answer:"), outer(answer)).otherwise(outer(text))


def format_output(df: DataFrame, column: str, mode: str = "CRJ") -> DataFrame:
    """The text again as lines of the mode, and whether all of them were there with a label in J."""
    label = parse_j(column)
    parts = {"C": prefixed_line(column, "C"), "R": prefixed_line(column, "R"), "J": F.when(label.isNotNull(), F.to_json(label)).otherwise(F.lit("{}"))}
    ok = label.isNotNull()
    for letter in mode.replace("J", ""):
        ok = ok & (parts[letter] != "")
    return df.withColumns({"formatted": F.concat_ws("\n", *[F.concat(F.lit(f"{x}: "), parts[x]) for x in mode]), "format_ok": ok})


def parse_metrics(c: str | Column) -> Column:
    """Map of `name=number` in a log line; of a repeated name the last."""
    pattern = r"([A-Za-z_][\w/.]*)=(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    names, values = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(1)), F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(2))
    zipped = F.arrays_zip(names.alias("k"), F.transform(values, lambda v: v.cast("double")).alias("v"))
    last = F.filter(zipped, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def validate_topk(df: DataFrame, k: int, candidates: str = "topk", allowed: str = "allowed", reference: str = "reference") -> DataFrame:
    """Why a top-k list is wrong: count, duplicate, outside, missing_reference; ok otherwise."""
    c = F.col(candidates)
    reason = F.when(F.size(c) != k, "count").when(F.size(F.array_distinct(c)) != k, "duplicate").when(F.size(F.array_except(c, F.col(allowed))) > 0, "outside").when(~F.array_contains(c, F.col(reference)), "missing_reference").otherwise("ok")
    return df.withColumns({"reason": reason, "valid": reason == "ok"})


def validate_elimination(df: DataFrame, first: str = "stage1", second: str = "stage2", reference: str = "reference") -> DataFrame:
    """P15, two stages: the second list comes from the first, is shorter, and either holds the reference."""
    a, b = F.col(first), F.col(second)
    reason = F.when(F.size(F.array_except(b, a)) > 0, "not_subset").when(F.size(b) >= F.size(a), "not_shorter").when(~F.array_contains(a, F.col(reference)), "lost_in_first").when(~F.array_contains(b, F.col(reference)), "lost_in_second").otherwise("ok")
    return df.withColumns({"reason": reason, "valid": reason == "ok"})


def complete_final(df: DataFrame, fallback: str = "unknown") -> DataFrame:
    """Intent from final_intent, else the first of topk that has one, else the fallback; scenario and action from it."""
    named = F.get(F.filter("topk", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    intent = F.coalesce(F.nullif(weak_intent("final_intent"), F.lit("")), F.nullif(weak_intent(named), F.lit("")), weak_intent(F.lit(fallback)))
    s, a = split_intent(intent)
    return df.withColumns({"intent": intent, "scenario": s, "action": a})


#: ARPAbet phones, without stress.
PHONES = "AA|AE|AH|AO|AW|AY|B|CH|D|DH|EH|ER|EY|F|G|HH|IH|IY|JH|K|L|M|N|NG|OW|OY|P|R|S|SH|T|TH|UH|UW|V|W|Y|Z|ZH"


def scrub_phones(c: str | Column) -> Column:
    """Text without phone symbols and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"\b(?:{PHONES})\b", ""), r"\s+", " "))
