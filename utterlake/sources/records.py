"""JSON records of large files, cut apart by structure instead of by lines.

A file is read in pieces that end at each }, which Spark splits by byte ranges like lines. Whether a piece starts inside a string,
and how deep it starts, are sums over the pieces before it: inside a range by a window, over ranges by one row for each. JSON
strings hold no raw line breaks, so a line break ends a broken string. A piece that ends at the depth of records ends one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.objects import bound, fields, is_object
from .scratch import settled

WRAPPERS = ("data", "items", "records", "examples")
#: A string without escapes, closed or cut off by a line break or the end; a field whose value is no container.
_STRING = r'"[^"\n]*+(?:"|(?=\n)|$)'
_PLAIN = r'\s*"(?:[^"\\]|\\.)*"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^\s"{}\[\],]+)\s*,'
#: How a file may start: an array, a wrapped array, an object of objects.
HEADS = {"array": r"^\s*\[", "wrapper": rf"^\s*\{{(?:{_PLAIN})*\s*\"(?:{'|'.join(WRAPPERS)})\"\s*:\s*\[", "map": r'^\s*\{(?=\s*"(?:[^"\\]|\\.)*"\s*:\s*\{)'}


def _since_reset(rows: DataFrame, by: Sequence[str], order: str, value: Column, reset: Column, name: str) -> DataFrame:
    """name_end: sum of value from the last row with reset on, that one included, in each group; name_open: whether there was none."""
    w = W.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__resets", F.sum(reset.cast("long")).over(w))
    return marked.withColumn(f"{name}_end", F.sum(value).over(W.partitionBy(*by, "__resets").orderBy(order))).withColumn(f"{name}_open", F.col("__resets") == 0).drop("__resets")


def _carried(rows: DataFrame, value: Column, reset: Column, name: str) -> DataFrame:
    """name_start and name_end of each piece of rows(file, block, pos): sums of value since the last reset, over ranges too."""
    by = ["file", "block"]
    inside = _since_reset(rows, by, "pos", value, reset, name).withColumn(f"{name}_start", F.lag(f"{name}_end").over(W.partitionBy(*by).orderBy("pos")))
    inside = settled(inside.withColumn(f"{name}_before", F.coalesce(F.lag(f"{name}_open").over(W.partitionBy(*by).orderBy("pos")), F.lit(True))), "records")
    last = inside.groupBy(*by).agg(F.max_by(F.struct(F.col(f"{name}_end").alias("v"), F.col(f"{name}_open").alias("open")), "pos").alias("last"))
    summed = _since_reset(last, ["file"], "block", F.col("last.v"), ~F.col("last.open"), "carry")
    carry = summed.withColumn("carry", F.coalesce(F.lag("carry_end").over(W.partitionBy("file").orderBy("block")), F.lit(0))).select(*by, "carry")
    out = inside.join(carry, by)
    start = F.coalesce(f"{name}_start", F.lit(0)) + F.when(F.col(f"{name}_before"), F.col("carry")).otherwise(F.lit(0))
    end = F.col(f"{name}_end") + F.when(F.col(f"{name}_open"), F.col("carry")).otherwise(F.lit(0))
    return out.withColumns({f"{name}_start": start, f"{name}_end": end}).drop("carry", f"{name}_open", f"{name}_before")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _balance(text: Column) -> Column:
    """How much deeper a text without strings leads."""
    return _count(text, "{[") - _count(text, "}]")


def _seen(plain: Column, quoted: bool) -> Column:
    """How much deeper a piece without escapes leads, whether a line starts a value anew, and how much deeper it leads from there on."""

    def numbers(bare: Column) -> Column:
        anew = bare.contains("\n") & bare.rlike(r"\n[{\[]")
        deeper = _balance(bare)
        return F.struct(deeper.alias("delta"), anew.alias("anew"), F.when(anew, _balance(F.element_at(F.split(bare, r"\n(?=[{\[])"), -1))).otherwise(deeper).alias("left"))

    return bound(F.regexp_replace(F.concat(F.lit('"'), plain) if quoted else plain, _STRING, ""), numbers)


def pieces_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, block, pos, text: what lies between two } of a file, in order of pos in a byte range that starts at block."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))


def objects_of(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The text of each object at the depth of records, by form of the file:

    an array; one object with the array under one of WRAPPERS, behind plain fields at most; one object of objects, none of whose own
    fields is one of the keys; and else objects one after another, where a line that starts with { or [ starts anew. Only numbers
    about the pieces go through windows; their texts are shuffled to their number, and again to their record.
    """
    rows, at = pieces_of(spark, path), ["file", "block", "pos"]
    heads = rows.groupBy("file").agg(F.min_by("text", F.struct("block", "pos")).alias("head"), F.min(F.struct("block", "pos")).alias("first"))
    form = F.when(F.col("head").rlike(HEADS["wrapper"]), "wrapper").when(F.col("head").rlike(HEADS["array"]), "array").when(F.col("head").rlike(HEADS["map"]), "map").otherwise("stream")
    named = F.regexp_extract("head", r'^\s*\{\s*"([^"\\]*)"', 1).isin(list(keys))
    heads = heads.select("file", form.alias("form"), ((form == "map") & named).alias("named"))
    own = F.regexp_extract("text", r"(?s)^([^{]*)", 1).rlike(f'"(?:{"|".join(map(_quoted, keys))})"\\s*:')
    plain = F.when(F.col("text").contains("\\"), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))  # escapes stand in strings only
    stats = rows.select(*at, plain.alias("plain"), own.alias("own")).select(
        *at, "own", F.col("plain").contains("\n").alias("broken"), F.when(F.col("plain").contains("\n"), _count(F.substring_index("plain", "\n", -1), '"')).otherwise(_count(F.col("plain"), '"')).alias("quotes"),
        _seen(F.col("plain"), False).alias("free"), _seen(F.col("plain"), True).alias("held"),
    )
    quoted = _carried(stats, F.col("quotes"), F.col("broken"), "quote").join(heads, "file")
    inside, ends_inside = F.col("quote_start") % 2 == 1, F.col("quote_end") % 2 == 1
    quoted = quoted.withColumn("seen", F.when(inside, F.col("held")).otherwise(F.col("free")))
    anew = (F.col("form") == "stream") & F.col("seen.anew")
    delta = F.when(anew, F.col("seen.left")).otherwise(F.col("seen.delta")) - F.when(ends_inside, 0).otherwise(1)
    deep = _carried(quoted.select(*at, "form", "named", (F.col("own") & ~inside).alias("own"), ends_inside.alias("ends_inside"), delta.alias("delta"), anew.alias("anew")), F.col("delta"), F.col("anew"), "depth")
    # An object of objects with a field of a record beside them is a record itself, as are objects that follow each other.
    files = deep.groupBy("file").agg(F.max(F.col("named") | ((F.col("form") == "map") & (F.col("depth_start") == 1) & F.col("own"))).alias("single"), F.count_if((F.col("depth_end") == 0) & ~F.col("ends_inside")).alias("tops"))
    deep = deep.join(files, "file")
    alone = ~F.col("single") & (F.col("tops") <= 1)
    level = F.when((F.col("form") == "wrapper") & alone, 2).when((F.col("form") == "array") | ((F.col("form") == "map") & alone), 1).otherwise(0)
    ends = deep.select(*at, "form", level.alias("level"), ((F.col("depth_end") == level) & ~F.col("ends_inside")).cast("long").alias("e"))
    numbered = _carried(ends, F.col("e"), F.lit(False), "record").select(*at, "form", "level", "e", F.col("record_start").alias("record"))
    whole = numbered.join(rows, at).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "pos", "text"))).alias("parts"), F.max("form").alias("form"), F.max("level").alias("level"), F.max("e").alias("e")).where("e = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    joined = whole.select("record", "form", "level", text.alias("text"))
    headless = F.when(F.col("level") == 2, F.regexp_replace("text", HEADS["wrapper"], "")).when(F.col("form") == "array", F.regexp_replace("text", HEADS["array"], "")).otherwise(F.regexp_replace("text", HEADS["map"], ""))
    part = F.when((F.col("level") > 0) & (F.col("record") == 0), headless).when(F.col("form") == "stream", F.element_at(F.split("text", r"\n(?=[{\[])"), -1)).otherwise(F.col("text"))
    opened = F.regexp_replace("part", r'^[^{"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^{"]*+)*+(?=\{)', "")
    return joined.withColumn("part", part).select(F.when(opened.startswith("{"), opened).otherwise(F.regexp_replace("part", r"^[^{]*", "")).alias("text"))


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in name)


def _records(text: Column, keys: Sequence[str], more: int) -> Column:
    """The record itself, or the records under a wrapper or in an object of objects, so many levels down."""
    none = F.array().cast("array<string>")

    def walk(m: Column) -> Column:
        like = F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, keys)))
        if not more:
            return F.when(like, F.array(text)).otherwise(none)
        lists = F.coalesce(*[F.from_json(F.try_element_at(m, F.lit(w)), "array<string>") for w in WRAPPERS])
        inner = F.coalesce(lists, F.map_values(m))
        return F.when(like, F.array(text)).otherwise(F.flatten(F.transform(F.filter(inner, is_object), lambda x: _records(x, keys, more - 1))))

    return F.coalesce(bound(F.when(is_object(text), fields(text)), walk), none)


def read_records(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, keys: Sequence[str] | None = None) -> DataFrame:
    """Records (objects with one of the keys, by default the schema's names) of files in any of the forms of objects_of.

    One file of any size is read by many tasks; only a record is held as one text. Objects that are no records are looked into for
    wrapped records and records by name. What is no JSON is left out.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    found = objects_of(spark, path, list(keys or schema.names)).select(F.explode(_records(F.col("text"), list(keys or schema.names), 2)).alias("value"))
    return found.select(F.from_json("value", schema).alias("r")).select("r.*")
