"""One narrow table of facts for all kinds of conditions.

A fact is (file_id, kind, key, text, number, extra, offset). What the columns hold:

string      text, offset; key `symbol` marks names of imports and exports
symbol      key import, export or function; text the name without prefixes
encoded     key the encodings, joined by commas; text
basename    text
raw, hex    text the content; bytes as Latin-1 characters for hex
kv          key the path, text a value at it, number its items or keys; key "" for every file with data
metrics     key the field, number
section     key the permissions, text the name, number the length, extra the entropy, offset the start
syscall     key the architecture, text the name, number
structure   key the feature
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import text as T

COLUMNS = {"file_id": None, "kind": "string", "key": "string", "text": "string", "number": "double", "extra": "double", "offset": "bigint"}


def _facts(df: DataFrame, kind: Column | str, **given: Column | str) -> DataFrame:
    """Rows of one kind; columns not given are null."""
    columns = [F.col("file_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind")]
    for name in list(COLUMNS)[2:]:
        value = given.get(name)
        value = F.lit(None) if value is None else F.col(value) if isinstance(value, str) else value
        columns.append(value.cast(COLUMNS[name]).alias(name))
    return df.select(*columns)


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def string_facts(strings: DataFrame) -> DataFrame:
    """From strings(file_id, value[, offset])."""
    return _facts(strings, "string", text="value", offset="offset" if "offset" in strings.columns else None)


def content_facts(files: DataFrame, binary: bool = False) -> DataFrame:
    """The whole content of files(file_id, text), once more as bytes if asked for."""
    raw = _facts(files, "raw", text="text")
    return raw.unionByName(_facts(files, "hex", text=F.decode(F.col("text").cast("binary"), "ISO-8859-1"))) if binary else raw


def basename_facts(files: DataFrame) -> DataFrame:
    return _facts(files, "basename", text=F.substring_index("path", "/", -1))


def symbol_facts(symbols: DataFrame) -> DataFrame:
    """From symbols(file_id, symbol, kind); the names of imports and exports are strings too."""
    named = symbols.select("file_id", F.col("kind").alias("_kind"), T.normalize_symbol(F.col("symbol")).alias("_name"))
    fact = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    own, string = fact("symbol", F.col("_kind")), fact("string", F.lit("symbol"))
    # One pass for both, as the symbols may come from a join.
    both = F.when(F.col("_kind").isin("import", "export"), F.array(own, string)).otherwise(F.array(own))
    each = named.select("file_id", "_name", F.explode(both).alias("f"))
    return _facts(each.select("file_id", F.col("f.kind").alias("_kind"), F.col("f.key").alias("_key"), "_name"), F.col("_kind"), key="_key", text="_name")


def encoded_facts(strings: DataFrame) -> DataFrame:
    """From strings(file_id, value, encoding_chain[, offset]); plain strings are left out."""
    decoded = strings.where(F.size("encoding_chain") > 0)
    return _facts(decoded, "encoded", key=F.array_join("encoding_chain", ","), text="value", offset="offset" if "offset" in strings.columns else None)


def metric_facts(metrics_long: DataFrame) -> DataFrame:
    """From metrics(file_id, field, value)."""
    return _facts(metrics_long, "metrics", key="field", number="value")


def section_facts(sections: DataFrame) -> DataFrame:
    return _facts(sections, "section", key="permissions", text="name", number="size", extra="entropy", offset="start")


def syscall_facts(syscalls: DataFrame) -> DataFrame:
    return _facts(syscalls.withColumn("_number", F.col("number")), "syscall", key="arch", text="name", number="_number")


def structure_facts(structure: DataFrame) -> DataFrame:
    """From structure(file_id, feature_id)."""
    return _facts(structure, "structure", key="feature_id")


def path_steps(path: str) -> list[str]:
    """`a.b[0].c[*]` as `a`, `.b`, `[0]`, `.c`, `[*]`."""
    out, part = [], ""
    for sign in path:
        if sign in ".[" and part:
            out.append(part)
            part = ""
        part += sign
    return [*out, part] if part else out


ITEMS, FIELDS, KV_FACTS = "array<variant>", "map<string,variant>", "array<struct<key:string,v:variant,own:boolean>>"


def _step(value: Column, step: str) -> Column:
    """The value one step below a parsed value."""
    if step.startswith("["):
        return F.try_variant_get(value, f"${step}", "variant")
    name = step.removeprefix(".")
    plain = re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name)  # other names are no path of a parsed value
    return F.try_variant_get(value, f"$.{name}", "variant") if plain else F.element_at(F.try_variant_get(value, "$", FIELDS), F.lit(name))


def _present(values: Column) -> Column:
    """Some parsed values without the nulls, which are no values."""
    return F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v))


def _items(value: Column) -> Column:
    """The items of a parsed array, null for what is none."""
    return F.try_variant_get(value, "$", ITEMS)


def _kv_fact(path: Column, value: Column, own: bool) -> Column:
    """A value found at a path: that of the path itself, or an item of it."""
    return F.struct(path.alias("key"), value.alias("v"), F.lit(own).alias("own"))


def _kv_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _kv_number(value: Column, own: Column) -> Column:
    """The items or keys of a path's own value; an item of it counts nothing."""
    fields, items = F.try_variant_get(value, "$", FIELDS), _items(value)
    return F.when(own & items.isNotNull(), F.size(items)).when(own & fields.isNotNull(), F.size(fields))


def kv_facts(data: DataFrame, paths: list[str]) -> DataFrame:
    """Values at the given paths of data(file_id, json), each text read and parsed once.

    The steps of the catalog's paths are taken in the row, those that paths have in common
    once, and one explode makes the facts. `[*]` stands for every place of an array, `[n]`
    for one. What a path without `[*]` leads to is one value, whose expressions Spark
    compiles; else it is an array of values. Elements of an array at a path are values of
    it too; a null is no value, and text that does not parse has none.
    """
    tasks = max(data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism)
    # Parsing costs more than a shuffle of the texts, whose scan may have few row groups.
    rows = data.select("file_id", "json").repartition(tasks).select("file_id", F.try_parse_json("json").alias("v"))
    at, several = {"": "v"}, set()
    steps = {"".join(some): some for path in paths if (some := path_steps(path))}
    levels: dict[int, dict[str, tuple[str, str]]] = {}
    for some in steps.values():
        for depth in range(1, len(some) + 1):
            levels.setdefault(depth, {})["".join(some[:depth])] = ("".join(some[: depth - 1]), some[depth - 1])
    none = F.array().cast(ITEMS)
    for depth in sorted(levels):
        new = {}
        for i, place in enumerate(sorted(levels[depth])):
            above, step = levels[depth][place]
            value, column = F.col(at[above]), f"_at{len(at) + i}"
            if above in several:
                below = F.flatten(F.transform(value, lambda v: F.coalesce(_items(v), none))) if step == "[*]" else F.transform(value, lambda v: _step(v, step))
            else:
                below = F.coalesce(_items(value), none) if step == "[*]" else _step(value, step)
            if above in several or step == "[*]":
                several.add(place)
                new[place] = (column, _present(below))
            else:
                new[place] = (column, F.when(~F.is_variant_null(below), below))
        rows = rows.withColumns(dict(new.values()))
        at |= {place: column for place, (column, _) in new.items()}
    own = [F.array(*[_kv_fact(F.lit(place), F.col(at[place]), True) for place in sorted(steps) if place not in several]).cast(KV_FACTS)]
    own += [F.transform(at[place], lambda v: _kv_fact(F.lit(place), v, True)) for place in sorted(several & {*steps})]
    root = F.when(F.col("v").isNotNull(), F.array(_kv_fact(F.lit(""), F.lit(None).cast("variant"), False))).otherwise(F.array().cast(KV_FACTS))
    rows = rows.select("file_id", root.alias("_root"), F.filter(F.concat(*own), lambda f: f["v"].isNotNull()).alias("_own"))
    items = F.flatten(F.transform("_own", lambda f: F.transform(_present(F.coalesce(_items(f["v"]), none)), lambda v: _kv_fact(f["key"], v, False))))
    # As a column of its own it is compiled, which it would not be inside of `explode`; what a value
    # says is taken behind that, so a condition on a path takes it for the facts of that path alone.
    whole = rows.select("file_id", F.concat("_root", "_own", items).alias("_every"))
    facts = whole.select("file_id", F.explode_outer("_every").alias("f")).where("f is not null").select("file_id", F.col("f.key").alias("_key"), F.col("f.v").alias("v"), F.col("f.own").alias("own"))
    return _facts(facts, "kv", key="_key", text=_kv_text(F.col("v")), number=_kv_number(F.col("v"), F.col("own")))
