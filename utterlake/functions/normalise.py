"""Normalising labels, spans and identifiers (N1-N15), as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = "struct<type:string,filler:string>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """Trimmed text; null is empty."""
    return F.coalesce(F.trim(col(c).cast("string")), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ behind it as it takes to be no column of df."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def first_of(*columns: str | Column) -> Column:
    """The first that is neither null nor blank, else empty."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in columns], F.lit(""))


def squeezed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(clean(c), r"\s+", " "))


def span_filler(tokens: str | Column, span: str | Column, mode: str = "indexed") -> Column:
    """Text of a span of tokens array<struct<surface>>.

    indexed: each index, lower case, those out of range left out; cased: the same in its own case; range: from the first index to the last.
    """
    t, s = col(tokens), col(span)
    if mode == "range":
        low, high = F.element_at(s, 1), F.least(F.element_at(s, -1), F.size(t) - 1)
        part = F.slice(t, low + 1, F.greatest(high - low + 1, F.lit(0)))
        return F.when((F.size(s) == 0) | (low < 0) | (low >= F.size(t)), F.lit("")).otherwise(F.array_join(F.transform(part, lambda x: x["surface"]), " "))
    inside = F.filter(s, lambda i: (i >= 0) & (i < F.size(t)))
    words = F.transform(inside, lambda i: F.get(t, i)["surface"])
    return F.array_join(F.transform(words, F.lower) if mode == "indexed" else words, " ")


def _gold(df: DataFrame, mode: str) -> DataFrame:
    found = F.transform(F.coalesce("entities", F.array().cast("array<struct<type:string,span:array<int>>>")), lambda e: F.struct(e["type"].alias("type"), span_filler("tokens", e["span"], mode).alias("filler")))
    return df.withColumn("entities", found)


def gold_by_file(df: DataFrame, mode: str = "indexed", pos: str = "pos") -> DataFrame:
    """One gold row for each recording's file with its error rates; of files that repeat, the last."""
    rows = _gold(df, mode).select("*", F.posexplode("recordings").alias("recording_pos", "recording"))
    rows = rows.select("slurp_id", "sentence", "scenario", "action", "entities", F.col("recording.file").alias("file"), F.col("recording.wer").alias("wer"), F.col("recording.ent_wer").alias("ent_wer"), F.struct(pos, "recording_pos").alias("at"))
    return rows.groupBy("file").agg(F.max_by(F.struct("slurp_id", "sentence", "scenario", "action", "entities", "wer", "ent_wer"), "at").alias("r")).select("file", "r.*")


def gold_by_id(df: DataFrame, mode: str = "indexed", pos: str = "pos") -> DataFrame:
    """One gold row for each utterance; of identifiers that repeat, the last."""
    rows = _gold(df, mode)
    return rows.groupBy(F.col("slurp_id").cast("string").alias("slurp_id")).agg(F.max_by(F.struct("sentence", "scenario", "action", "entities"), pos).alias("r")).select("slurp_id", "r.*")


def _runs(tokens: Column, kinds: Column, starts: Column) -> Column:
    """Entities from token labels: kinds is the type of each token or null outside, starts whether a new entity begins there."""
    rows = F.arrays_zip(tokens.alias("w"), kinds.alias("k"), starts.alias("s"))
    empty = F.array().cast(f"array<struct<type:string,filler:string,open:boolean>>")  # noqa: F541
    entry = lambda t, f: F.struct(t.alias("type"), f.alias("filler"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        closed = F.transform(acc, lambda e: F.struct(e["type"].alias("type"), e["filler"].alias("filler"), F.lit(False).alias("open")))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(entry(last["type"], F.concat_ws(" ", last["filler"], x["w"]))))
        goes_on = (F.size(acc) > 0) & last["open"] & (last["type"] == x["k"]) & ~x["s"]
        return F.when(x["k"].isNull(), closed).when(goes_on, grown).otherwise(F.concat(closed, F.array(entry(x["k"], x["w"]))))

    found = F.aggregate(rows, empty, step)
    return F.transform(found, lambda e: F.struct(e["type"].alias("type"), e["filler"].alias("filler")))


def bio_spans(tokens: str | Column, labels: str | Column) -> Column:
    """Entities of B-/I- (or B_/I_) tags; an I- without its B- opens one; O and Other are outside."""
    n = F.least(F.size(col(tokens)), F.size(col(labels)))
    tags = F.slice(F.transform(col(labels), clean), 1, n)
    kind = lambda x: F.when(x.rlike("^[BI][-_].+"), F.regexp_replace(x, "^[BI][-_]", ""))
    return _runs(F.slice(col(tokens), 1, n), F.transform(tags, kind), F.transform(tags, lambda x: x.rlike("^B[-_]")))


def label_runs(tokens: str | Column, labels: str | Column) -> Column:
    """Entities of runs of one label; O, Other and blank labels are outside."""
    n = F.least(F.size(col(tokens)), F.size(col(labels)))
    tags = F.slice(F.transform(col(labels), clean), 1, n)
    kind = lambda x: F.when(~F.lower(x).isin("o", "other", ""), x)
    return _runs(F.slice(col(tokens), 1, n), F.transform(tags, kind), F.transform(tags, lambda x: F.lit(False)))


def weak_intent(c: str | Column) -> Column:
    return F.replace(clean(c), F.lit(":"), F.lit("_"))


def normalize_intent(c: str | Column, level: str = "weak") -> Column:
    """Weak: trimmed, : to _; strong: also lower case, brackets and quotes off, the rest of signs to single _; clean: prefixes off first."""
    if level == "weak":
        return weak_intent(c)
    text = clean(c)
    if level == "clean":
        text = F.trim(F.regexp_replace(text, r"(?i)^(?:C\s*[:：]\s*)?(?:intent\s+candidates?\s*[:：]\s*)?", ""))
    text = F.regexp_replace(F.lower(text), r"[\[\](){}<>\"'`“”‘’]", "")
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def split_intent(c: str | Column) -> tuple[Column, Column]:
    """Scenario and action of an intent, parted at the first _; without one it is all action."""
    i = weak_intent(c)
    has = F.instr(i, "_") > 0
    return F.when(has, F.substring_index(i, "_", 1)).otherwise(F.lit("")), F.when(has, F.regexp_replace(i, "^[^_]*_", "")).otherwise(i)


def normalize_entities(entities: str | Column) -> Column:
    """Type in lower case, filler in lower case with single spaces."""
    return F.transform(col(entities), lambda e: F.struct(F.lower(clean(e["type"])).alias("type"), F.lower(squeezed(e["filler"])).alias("filler")))


def standard_entities(text: str | Column) -> Column:
    """JSON entities, typed ({"type": …, "filler": …}, filter and value standing in for filler) or compact ({type: filler}), in lower case; what is no object is dropped."""
    objects = F.filter(F.from_json(col(text), "array<string>"), lambda x: F.trim(x).startswith("{"))
    alias = lambda m: first_of(F.try_element_at(m, F.lit("filler")), F.try_element_at(m, F.lit("filter")), F.try_element_at(m, F.lit("value")))

    def one(x: Column) -> Column:
        m = F.from_json(x, "map<string,string>")
        typed = F.array(F.struct(F.lower(clean(F.try_element_at(m, F.lit("type")))).alias("type"), F.lower(alias(m)).alias("filler")))
        compact = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(clean(e["key"])).alias("type"), F.lower(clean(e["value"])).alias("filler")))
        return F.when(F.map_contains_key(m, "type"), typed).otherwise(compact)

    return F.coalesce(F.flatten(F.transform(objects, one)), F.array().cast(f"array<{ENTITY}>"))


def _entity(df: DataFrame, entities: Column, kind: T.DataType) -> Column:
    """Entities with the first of filler, filter and value that is not null, else the words of their span in lower case."""
    names = kind.elementType.names if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []
    words = lambda e: F.filter(F.transform(F.filter(e["span"], lambda i: (i >= 0) & (i < F.size("tokens"))), lambda i: F.lower(F.get("tokens", i.cast("int"))["surface"])), lambda w: w != "")
    spanned = "span" in names and "tokens" in df.columns

    def one(e: Column) -> Column:
        options = [e[k] for k in ("filler", "filter", "value") if k in names] + ([F.when(F.size(e["span"]) > 0, F.array_join(words(e), " "))] if spanned else [])
        return F.struct(clean(e["type"]).alias("type"), F.coalesce(*options, F.lit("")).alias("filler"))

    none = F.array().cast(f"array<{ENTITY}>")
    return F.coalesce(F.transform(entities, one), none) if names else none


def label_from_record(df: DataFrame) -> DataFrame:
    """Label struct of records(final, scenario, action, intent, entities): what `final` has, and where there is none the record's own.

    Gaps in scenario and action are filled from the same place's intent. Entities may name their words by a span of tokens.
    """
    schema = df.schema
    inner = schema["final"].dataType if "final" in df.columns else T.StructType()

    def label(field, names: list[str], kinds: dict[str, T.DataType]) -> Column:
        text = lambda n: clean(field(n)) if n in names else F.lit("")
        s, a = split_intent(text("intent"))
        entities = _entity(df, field("entities"), kinds["entities"]) if "entities" in names else F.array().cast(f"array<{ENTITY}>")
        return F.struct(first_of(text("scenario"), s).alias("scenario"), first_of(text("action"), a).alias("action"), entities.alias("entities"))

    own = label(F.col, df.columns, {f.name: f.dataType for f in schema})
    if not len(inner):
        return df.withColumn("label", own)
    final = label(lambda n: F.col("final")[n], inner.names, {f.name: f.dataType for f in inner})
    given = F.coalesce(*[F.when(F.col("final")[n].isNotNull(), F.lit(True)) for n in inner.names], F.lit(False))
    return df.withColumn("label", F.when(given, final).otherwise(own))


def split_massive_intent(scenario: str | Column, intent: str | Column) -> tuple[Column, Column]:
    """Scenario and action of an intent that may start with the scenario."""
    s, i = clean(scenario), weak_intent(intent)
    head, tail = split_intent(i)
    prefix = F.concat(s, F.lit("_"))
    own = F.when((s != "") & i.startswith(prefix), F.substr(i, F.length(prefix) + 1)).when(s == "", tail).otherwise(i)
    return F.when(s != "", s).otherwise(head), own


def normalize_massive_id(c: str | Column, config: str = "") -> Column:
    """Identifier without quotes around it and without `massive-<language>-<region>-` before it, with - or _ alike; others stay."""
    text = F.regexp_replace(clean(c), r"^[\"'` ]+|[\"'` ]+$", "")
    patterns = (r"^massive-[^-]+-[^-]+-(.+)$", r"^massive_[^_]+_[^_]+_(.+)$", r"^massive-[^-]+_[^-]+-(.+)$", r"^massive_[^_]+-[^_]+_(.+)$")
    found = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns], text)
    if config:
        found = F.when(text.startswith(f"massive-{config}-"), F.substr(text, F.lit(len(config) + 10))).otherwise(found)
    return F.trim(found)


def to_utterances(df: DataFrame, config: str, numeric_id: bool = False) -> DataFrame:
    """Utterances of BIO records(id, utt, scenario_str, intent_str, tokens, labels, path)."""
    digits = F.regexp_extract_all("id", F.lit(r"(\d+)"))
    key = F.try_element_at(digits, F.lit(-1)).cast("bigint") if numeric_id else F.concat(F.lit(f"massive-{config}-"), clean("id"))
    s, a = split_massive_intent("scenario_str", "intent_str")
    name = F.element_at(F.split(clean("path"), "/"), -1)
    recordings = F.when(clean("path") == "", F.array().cast("array<struct<file:string>>")).otherwise(F.array(F.struct(name.alias("file"))))
    return df.select(key.alias("slurp_id"), F.col("utt").alias("sentence"), s.alias("scenario"), a.alias("action"), F.concat_ws("_", s, a).alias("intent"), F.transform("tokens", lambda t: F.struct(t.alias("surface"))).alias("tokens"), bio_spans("tokens", "labels").alias("entities"), recordings.alias("recordings"))


#: What UTF-8 read as Latin-1 or Windows-1252 shows, each of which counts.
MARKERS = ("Ã", "Â", "â€", "â€™", "â€œ", "â€\x9d", "ã\x81", "ã\x82", "ã\x83", "ð\x9f", "\ufffd")
#: Only texts with one of the marks that a repair can take away may get better.
MARKED = "[ÃÂ\\u0080-\\u009F]|â€"
_CONTROLS, _C1 = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), re.compile(r"[\x80-\x9f]")
_JAPANESE, _LATIN = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]"), re.compile(r"[A-Za-z]")


def _damage(text: str, language: str) -> int:
    """How damaged a text looks: marks of wrong decoding, control characters, and Japanese signs in another language."""
    marks = 4 * (sum(text.count(m) for m in MARKERS) + len(_C1.findall(text))) + 6 * text.count("\ufffd") + 2 * len(_CONTROLS.findall(text))
    if language in ("", "ja"):
        return marks
    return marks + len(_JAPANESE.findall(text)) * (5 if _LATIN.search(text) else 3)


def _repair(text: str, language: str) -> str:
    readings = found = {text: 0}
    for turn in (1, 2):
        again = {}
        for t in readings:
            for coding in ("latin-1", "cp1252"):
                try:
                    again.setdefault(t.encode(coding).decode("utf-8"), turn)
                except UnicodeError:
                    pass
        readings = {t: turn for t in again if t not in found}
        found = found | readings
    return min(found, key=lambda t: (_damage(t, language), abs(len(t) - len(text))))


def fix_mojibake(df: DataFrame, column: str, locale: str | None = None) -> DataFrame:
    """UTF-8 that was read as Latin-1 or Windows-1252 is put right, up to two rounds, where the result looks less damaged.

    Of equally damaged readings, that nearest in length stays, so one without a gain changes nothing. locale names a column such as
    fr-FR: Japanese signs count as damage in languages but ja; null or no locale: they don't. Rows without the marks don't reach Python.
    """

    @F.pandas_udf("string")
    def repaired(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([None if t is None else _repair(t, n) for t, n in zip(texts, languages)], dtype="object")

    marked = F.coalesce(F.col(column).rlike(MARKED), F.lit(False))
    language = F.lower(F.substring_index(clean(locale), "-", 1)) if locale else F.lit("")
    return df.where(marked).withColumn(column, repaired(F.col(column), language)).unionByName(df.where(~marked))


def _given(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(c) for c in names if c in df.columns]


def _fields(df: DataFrame, name: str, texts: bool = True) -> Column | None:
    """The fields of a struct column, or of a column of JSON objects; null where it has none."""
    if name not in df.columns:
        return None
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.from_json(F.trim(name), "map<string,string>") if texts else None
    return F.from_json(F.to_json(name), "map<string,string>")


def _meta(df: DataFrame, keys: tuple[str, ...], texts: bool) -> list[Column]:
    """What meta, the rationale's JSON and that one's meta say under the keys."""
    meta, rationale = _fields(df, "meta", texts), _fields(df, "rationale_text")
    inner = None if rationale is None else F.from_json(F.try_element_at(rationale, F.lit("meta")), "map<string,string>")
    of = lambda m, names: [] if m is None else [F.try_element_at(m, F.lit(k)) for k in names]
    return of(meta, keys) + of(rationale, keys if texts else keys[:1]) + of(inner, keys)


def sample_id(df: DataFrame, columns: tuple[str, ...] = ("id", "slurp_id", "uid", "uuid"), pos: str = "pos") -> DataFrame:
    """The first identifier that is there, in the columns, in the struct meta, or in the JSON of rationale_text and its meta; else row_<position>."""
    return df.withColumn("sample_id", first_of(*_given(df, *columns), *_meta(df, ("id", "slurp_id"), False), F.concat(F.lit("row_"), F.col(pos).cast("string"))))


#: How a text names a file.
FILE_PATTERNS = (r'"filename"\s*:\s*"([^"]+)"', r'\\"filename\\"\s*:\s*\\"([^\\"]+)\\"', r"'filename'\s*:\s*'([^']+)'", r"""filename\s*[:=]\s*["']([^"']+)["']""", r"(audio-[A-Za-z0-9_-]+\.(?:flac|wav|mp3|m4a|ogg))")


def sample_file(df: DataFrame, columns: tuple[str, ...] = ("filename", "file", "audio_filename", "audio_file"), user_text: str = "user_text") -> DataFrame:
    """The first file name that is there: in the columns, in meta (a struct or JSON), in the JSON of rationale_text and its meta, in
    the first of recordings and audios; else one that a text names: rationale_text, rationale, meta, the user's text, the whole row."""
    lists = [F.get("recordings", F.lit(0))["file"]] * ("recordings" in df.columns) + [F.get("audios", F.lit(0))] * ("audios" in df.columns)
    texts = [c if isinstance(df.schema[c].dataType, T.StringType) else F.to_json(c) for c in ("rationale_text", "rationale", "meta", user_text) if c in df.columns]
    texts = [F.coalesce(col(t), F.lit("")) for t in (*texts, F.to_json(F.struct(*df.columns)))]
    named = [first_of(*[F.regexp_extract(t, p, 1) for p in FILE_PATTERNS]) for t in texts]
    return df.withColumn("sample_file", first_of(*_given(df, *columns), *_meta(df, ("filename", "file"), True), *lists, *named))


def conversation_pair(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The first user and the first assistant text of each conversation."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col(turn)))
    return turns.groupBy(key).agg(first("user").alias("user_text"), first("assistant").alias("assistant_text"))


def bullet_candidates(c: str | Column, most: int = 10) -> Column:
    """Bulleted or numbered lines of two words or more, without the bullet, with or without a blank after it."""
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\R"), lambda x: F.regexp_extract(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^(?:[-*]|\d+[.)])\s*(.+)$", 1))
    return F.slice(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 2), 1, most)


def select_input_text(df: DataFrame, use_asr: bool = True) -> DataFrame:
    """The first of asr_hypotheses, which are texts or structs with a text, transcript, hypothesis or value, and may be empty;
    without use_asr the sentence or else the text. source says which: asr_1best or gold_transcript. Blanks of any kind around a text go."""
    bare = lambda c: F.regexp_replace(c.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    if not use_asr:
        return df.withColumns({"input_text": first_of(*map(bare, _given(df, "sentence", "text"))), "source": F.lit("gold_transcript")})
    first, kind = F.get("asr_hypotheses", F.lit(0)), df.schema["asr_hypotheses"].dataType.elementType
    found = first_of(*[bare(first[k]) for k in ("text", "transcript", "hypothesis", "value") if k in kind.names]) if isinstance(kind, T.StructType) else first_of(bare(first))
    return df.withColumns({"input_text": found, "source": F.lit("asr_1best")})
