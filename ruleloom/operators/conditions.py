"""Conditions as rows: every kind is matched against one fact table by one keyed join.

A condition is known by the hash of what it says, so equal conditions of several rules are
one row and are evaluated once; rules, exclusions, downgrades and composites refer to it by
that id. A fact is (file_id, kind, key, text, number, extra, offset); see `facts`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import net, text as T
from ruleloom.operators import matching, predicates as P
from ruleloom.session import cut_lineage, local_table

# Fields by kind: `key` is a kv path, a metric, a structural feature or the sections to compare with;
# `names` are system calls, encodings or required imports, `others` architectures or suspicious
# imports; `n_*` bound a metric, size, length, ratio or count, `e_*` the entropy of a section or the
# length of counted strings. `low` to `high` are byte offsets, from the end if negative, of the
# file or of `section`; `at` is one offset.
CONDITION = (
    "struct<kind:string,how:string,pattern:string,case_insensitive:boolean,external_ip:boolean,key:string,names:array<string>,"
    "others:array<string>,numbers:array<bigint>,exists:boolean,n_min:double,n_max:double,e_min:double,e_max:double,"
    "readable:boolean,writable:boolean,executable:boolean,section:string,at:bigint,low:bigint,high:bigint,"
    "exceptions:array<struct<how:string,pattern:string>>>"
)
FIELDS = tuple(part.split(":")[0] for part in (
    "kind how pattern case_insensitive external_ip key names others numbers exists n_min n_max e_min e_max readable writable "
    "executable section at low high exceptions").split())  # fmt: skip
CONDS_SCHEMA = f"rule_id string, clause string, idx int, ref_id string, condition {CONDITION}"

TEXT_KINDS = ("string", "symbol", "encoded", "basename", "raw", "hex", "section")
COUNTED_KINDS = ("string_count", "exports_count", "section_ratio", "import_combination")
KEYED_KINDS = ("kv", "metrics", "structure", "syscall")
KINDS = (*TEXT_KINDS, *KEYED_KINDS, *COUNTED_KINDS)
HOWS = ("exact", "substr", "regex", "word")
# So few text conditions are cheaper to test on every fact than to look up by grams.
MAX_DIRECT = 64
PREFIX = "cond::"
ROOT = "root::"


def condition(**fields) -> dict:
    """A condition with all its fields; those not given are null."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"a condition has no {', '.join(sorted(unknown))}")
    return {name: fields.get(name) for name in FIELDS}


def _canonical() -> Column:
    """What a condition says, the same however it is written down."""
    c = lambda name: F.col(f"condition.{name}")
    folds = F.coalesce(c("case_insensitive"), F.lit(False))
    plain = {
        "pattern": F.when(folds & c("how").isin("exact", "substr", "word"), F.lower(c("pattern"))).otherwise(c("pattern")),
        "case_insensitive": F.when(folds, True),
        "external_ip": F.when(c("external_ip"), True),
        **{name: F.array_sort(F.array_distinct(c(name))) for name in ("names", "others", "numbers", "exceptions")},
    }
    return F.struct(*[plain.get(name, c(name)).alias(name) for name in FIELDS])


def named(conds: DataFrame) -> DataFrame:
    """Conditions of rules with `ref_id` set for those that stand inline: the hash of what they say."""
    said = _canonical()
    mine = F.concat(F.lit(PREFIX), F.substring(F.sha2(F.to_json(said), 256), 1, 32))
    inline = F.col("condition").isNotNull()
    return conds.select("rule_id", "clause", "idx", F.when(inline, mine).otherwise(F.col("ref_id")).alias("ref_id"), F.when(inline, said).alias("condition"))


def distinct_conditions(*tables: DataFrame) -> list[dict]:
    """The different inline conditions of some named tables, one row each; an unknown kind is an error."""
    every = reduce(DataFrame.unionByName, [t.where("condition is not null").select("ref_id", "condition") for t in tables])
    rows = every.groupBy(F.col("ref_id").alias("cond_id")).agg(F.first("condition").alias("condition")).collect()
    out = [{"cond_id": r["cond_id"], **r["condition"].asDict(recursive=True)} for r in sorted(rows, key=lambda r: r["cond_id"])]
    odd = sorted({str(c["kind"]) for c in out} - set(KINDS))
    if odd:
        raise ValueError(f"unknown kind of condition: {', '.join(odd)}; known are {', '.join(KINDS)}")
    wrong = sorted({str(c["how"]) for c in out if c["how"] is not None and c["how"] not in HOWS})
    if wrong:
        raise ValueError(f"unknown matcher: {', '.join(wrong)}; known are {', '.join(HOWS)}")
    return out


def _regex(c: dict) -> str | None:
    """Regex, word and byte patterns as one kind of regex, None for the others."""
    if c["kind"] == "hex":
        return P.hex_pattern(c["pattern"])
    body = {"regex": c["pattern"], "word": rf"\b\Q{c['pattern']}\E\b"}.get(c["how"])
    return body if body is None or not c["case_insensitive"] else "(?i)" + body


def _hex_literal(pattern: str) -> str | None:
    """The longest run of fixed bytes."""
    runs, run = [], ""
    for part in pattern.split():
        if len(part) == 2 and part != "??":
            run += chr(int(part, 16))
        else:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=len)
    return best if len(best) >= 3 else None


def _text_anchor(c: dict, direct: bool) -> tuple[str, str]:
    """(mark, text): what a fact must hold for a condition on its text.

    `=` and `~` stand for the text and its lower case, `.` and `,` for grams of them,
    and `!` for a test that is run on every fact of the kind.
    """
    folds = bool(c["case_insensitive"])
    if direct or (c["kind"] != "hex" and c["how"] is None):
        return "!", c["cond_id"]
    if c["how"] == "exact" and c["kind"] != "hex":
        return ("~", c["pattern"].lower()) if folds else ("=", c["pattern"])
    if c["how"] in ("substr", "word") and c["kind"] != "hex":
        return ((",", c["pattern"].lower()) if folds else (".", c["pattern"])) if c["pattern"] else ("!", c["cond_id"])
    literal = _hex_literal(c["pattern"]) if c["kind"] == "hex" else matching.required_literal(_regex(c))
    return (".", literal) if literal else ("!", c["cond_id"])


def _anchors(conds: list[dict]) -> list[tuple[dict, str]]:
    """(condition, key) pairs. A fact that holds the key is tested; the keys of a condition exclude each other."""
    texts = [c for c in conds if c["kind"] in TEXT_KINDS]
    marked = [_text_anchor(c, len(texts) <= MAX_DIRECT) for c in texts]
    grams = matching.rarest_grams([{"pattern": text} for _, text in marked])
    out = [(c, f"{c['kind']}{mark}{gram if mark in '.,' else text}") for c, (mark, text), gram in zip(texts, marked, grams)]
    for c in conds:
        if c["kind"] in ("kv", "metrics", "structure"):
            out.append((c, f"{c['kind']}@{c['key']}"))
        elif c["kind"] == "syscall":
            names, numbers = c["names"] or [], c["numbers"] or []
            keys = [f"syscall@{n}" for n in names] or [f"syscall#{n}" for n in numbers] or ["syscall*"]
            out += [(c, key) for key in dict.fromkeys(keys)]
    return out


def _in_row(value: Column, c: dict, regex: str | None) -> Column:
    """A condition's test of its pattern; what holds no address cannot hold an external one."""
    folds = bool(c["case_insensitive"])
    if c["kind"] != "hex" and c["how"] == "word" and c["pattern"]:
        return matching.word_tested(value, c["pattern"], regex, folds)
    if regex is not None:
        return value.rlike(regex) if c["kind"] == "hex" else matching.tested(value, regex)
    test = P.matcher(value, case_insensitive=folds, **({c["how"]: c["pattern"]} if c["how"] else {}))
    return matching.holds_address(value) & test if c["external_ip"] else test


def _probes(anchors: list[tuple[dict, str]]) -> tuple[Column, Column]:
    """The keys a fact holds, of those that some condition asks for, and a test that facts with a key pass."""
    kind, value, low = F.col("kind"), F.col("text"), F.lower("text")
    none = F.array().cast("array<string>")
    asked: dict[str, set[str]] = {}
    lengths: dict[tuple[str, str], set[int]] = {}
    tests = []
    for c, key in anchors:
        mark = key[len(c["kind"])]
        asked.setdefault(mark, set()).add(c["kind"])
        if mark in ".,":
            lengths.setdefault((c["kind"], mark), set()).add(len(key) - len(c["kind"]) - 1)
        if mark == "!":
            regex = _regex(c)
            test = _in_row(value, c, regex)
            tests.append(F.when((kind == c["kind"]) & test, F.lit(key)))
    probes = []
    for mark, form in (("=", value), ("~", low)):
        if mark in asked:
            probes.append(F.when(kind.isin(*sorted(asked[mark])), F.array(F.concat(kind, F.lit(mark), form))))
    for (name, mark), some in sorted(lengths.items()):
        form = value if mark == "." else low
        for k in sorted(some):
            probes.append(F.when(kind == name, _behind(name + mark, matching.grams(form, k))))
    if "@" in asked:
        keys = F.when(kind == "structure", _prefixes(F.col("key"))).when(kind == "syscall", F.array("text")).otherwise(F.array("key"))
        probes.append(F.when(kind.isin(*KEYED_KINDS), F.transform(keys, lambda k: F.concat(kind, F.lit("@"), k))))
    if "#" in asked:
        probes.append(F.when(kind == "syscall", F.array(F.concat(F.lit("syscall#"), F.col("number").cast("bigint").cast("string")))))
    if "*" in asked:
        probes.append(F.when(kind == "syscall", F.array(F.lit("syscall*"))))
    if tests:
        probes.append(F.array_compact(F.array(*tests)))
    keyed = sorted(set().union(*[kinds for mark, kinds in asked.items() if mark != "!"]))
    asked_for = [F.when(kind.isin(*keyed), F.lit(""))] if keyed else []
    keys = F.array_compact(F.concat(*[F.coalesce(p, none) for p in probes])) if probes else none
    return keys, matching.some([*asked_for, *tests]) if probes else F.lit(False)


def _behind(mark: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(mark), g))


def _prefixes(path: Column) -> Column:
    """A path and all paths above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


ANCHOR_SCHEMA = (
    "_key string, cond_id string, kind string, how string, regex string, pattern string, case_insensitive boolean, external_ip boolean, "
    "names array<string>, others array<string>, numbers array<bigint>, exists boolean, n_min double, n_max double, e_min double, e_max double, "
    "readable boolean, writable boolean, executable boolean, section string, at bigint, low bigint, high bigint, "
    "exceptions array<struct<how:string,pattern:string>>"
)


def _catalog(spark, anchors: list[tuple[dict, str]]) -> DataFrame:
    names = [part.split()[0] for part in ANCHOR_SCHEMA.split(", ")]
    rows = []
    for c, key in anchors:
        row = {**c, "_key": key, "regex": _regex(c), "pattern": _folded(c), "case_insensitive": bool(c["case_insensitive"])}
        rows.append([row[name] for name in names])
    return local_table(spark, rows, ANCHOR_SCHEMA)


def _bounded(value: Column, low: Column, high: Column) -> Column:
    inside = (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
    return (low.isNull() & high.isNull()) | F.coalesce(inside, F.lit(False))


def _matches() -> Column:
    """The condition's own test, for a fact that holds its key."""
    c = lambda name: F.col(f"c.{name}")
    value, regex = F.col("text"), c("regex")
    form = F.when(c("case_insensitive"), F.lower(value)).otherwise(value)
    text = (
        F.when(regex.isNotNull(), F.regexp(value, regex))
        .when(c("how") == "exact", form == c("pattern"))
        .when(c("how") == "substr", form.contains(c("pattern")))
        .otherwise(F.lit(True))
    )
    # Exceptions and addresses look at what was matched.
    hit = F.when(regex.isNotNull(), F.regexp_substr(value, regex)).otherwise(value)
    excepted = F.exists(
        F.coalesce(c("exceptions"), F.array().cast("array<struct<how:string,pattern:string>>")),
        lambda e: F.when(e["how"] == "exact", F.lower(hit) == F.lower(e["pattern"]))
        .when(e["how"] == "substr", F.lower(hit).contains(F.lower(e["pattern"])))
        .otherwise(F.regexp(hit, e["pattern"])),
    )
    public = ~F.coalesce(c("external_ip"), F.lit(False)) | (hit.rlike(K.IP_RE) & net.contains_external_ip(hit))
    permission = lambda flag, letter: c(flag).isNull() | F.coalesce(F.col("key").contains(letter) == c(flag), F.lit(False))
    section = (
        _bounded(F.col("number"), c("n_min"), c("n_max")) & _bounded(F.col("extra"), c("e_min"), c("e_max"))
        & permission("readable", "r") & permission("writable", "w") & permission("executable", "x")
    )
    listed = lambda name, test: c(name).isNull() | (F.size(c(name)) == 0) | test
    syscall = (
        listed("names", F.array_contains(c("names"), value)) & listed("numbers", F.array_contains(c("numbers"), F.col("number").cast("bigint")))
        & listed("others", F.exists(c("others"), lambda a: F.lower("key").contains(F.lower(a))))
    )
    chain = listed("names", F.arrays_overlap(F.split("key", ","), c("names")))
    sized = c("n_min").isNotNull() | c("n_max").isNotNull()
    by_kind = (
        F.when(c("kind") == "section", text & section)
        .when(c("kind") == "syscall", syscall)
        .when(c("kind") == "encoded", text & chain)
        .when(c("kind") == "metrics", _bounded(F.col("number"), c("n_min"), c("n_max")))
        .when(c("kind") == "kv", F.when(sized, F.col("number").isNotNull() & _bounded(F.col("number"), c("n_min"), c("n_max"))).otherwise(text))
        .when(c("kind") == "structure", F.lit(True))
        .when(c("kind") == "string", text & (c("e_min").isNull() | (F.octet_length(value) >= c("e_min"))))
        .otherwise(text)
    )
    return F.coalesce(by_kind, F.lit(False)) & ~F.coalesce(excepted, F.lit(False)) & public


def _slice(text: Column, low: Column, high: Column) -> Column:
    """The content between two byte offsets; a character that is cut stays in part."""
    return F.substr(text.cast("binary"), (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).cast("string")


def _places(wanted: list[str] | None, sections: DataFrame | None, hits: DataFrame) -> DataFrame:
    """Hits with `_b`, where the section that their condition names lies; `wanted` are all those named, if they are known."""
    none = F.lit(None).cast("bigint")
    if sections is None or wanted == []:
        return hits.withColumn("_b", F.struct(none.alias("lo"), none.alias("hi")))
    name = F.col("c.section")
    bounds = F.struct(F.col("start").alias("lo"), F.col("end").alias("hi"))
    aliases = P.section_aliases(sections.sparkSession)
    if wanted is not None and len(wanted) <= MAX_DIRECT:
        # A row a file, so that hits meet it where they meet their file.
        first: dict[tuple[str, str], int] = {(w, w): 0 for w in wanted}
        for r in aliases.where(F.col("wanted").isin(wanted)).collect():
            first[r["wanted"], r["name"]] = min(r["prio"], first.get((r["wanted"], r["name"]), r["prio"]))
        prio = lambda w: reduce(lambda out, x: out.when(F.col("name") == x[0], x[1]), [(n, p) for (own, n), p in first.items() if own == w], F.when(F.lit(False), 0))
        some = sections.where(F.col("name").isin(sorted({n for _, n in first}))).select("file_id", "name", "start", "end")
        by_file = some.groupBy("file_id").agg(*[F.min_by(bounds, F.when(prio(w).isNotNull(), F.struct(prio(w), "start", "end"))).alias(f"_b{i}") for i, w in enumerate(wanted)])
        mine = reduce(lambda out, iw: out.when(name == iw[1], F.col(f"_b{iw[0]}")), enumerate(wanted), F.when(F.lit(False), F.col("_b0")))
        return hits.join(by_file.hint("shuffle_hash"), "file_id", "left").withColumn("_b", mine)
    own = sections.select("file_id", F.col("name").alias("wanted"), F.lit(0).alias("prio"), "start", "end")
    by_name = sections.join(F.broadcast(aliases), "name").select("file_id", "wanted", "prio", "start", "end").unionByName(own)
    first = by_name.groupBy("file_id", "wanted").agg(F.min_by(bounds, F.struct("prio", "start", "end")).alias("_b"))
    return hits.withColumn("wanted", name).join(first, ["file_id", "wanted"], "left").drop("wanted")


def _placed(hits: DataFrame, files: DataFrame, sections: DataFrame | None, content: Column, free: Column, wanted: list[str] | None = None) -> DataFrame:
    """Hits whose fact lies where the condition says; imports and exports (`free`) lie nowhere and pass.

    A place in a section is relative to the section a name means, and to the file else.
    Adds `_lo` and `_hi`, to which `content` is to be cut, and `_anywhere`.
    """
    c = lambda name: F.col(f"c.{name}")
    bounds = _places(wanted, sections, hits.join(files.select("file_id", F.col("size_bytes").alias("_size")).hint("shuffle_hash"), "file_id"))
    inside = c("section").isNotNull()
    base = F.when(inside, F.col("_b.lo")).otherwise(F.lit(0))
    size = F.when(inside, F.col("_b.hi") - F.col("_b.lo")).otherwise(F.col("_size"))
    start = F.coalesce(c("at"), c("low"), F.lit(0))
    lo = base + P.absolute(start, size)
    end = F.when(c("at").isNotNull(), P.absolute(c("at"), size) + 1).otherwise(F.when(c("high").isNotNull(), P.absolute(c("high"), size)).otherwise(size))
    hi = base + F.least(end, size)
    anywhere = c("section").isNull() & c("at").isNull() & c("low").isNull() & c("high").isNull()
    in_range = (F.col("offset") >= lo) & (F.col("offset") < hi)
    return bounds.withColumns({"_lo": lo, "_hi": hi, "_anywhere": anywhere}).where(anywhere | free | (content & F.col("_lo").isNotNull()) | F.coalesce(in_range, F.lit(False)))


def _is_placed(c: dict) -> bool:
    return any(c[name] is not None for name in ("section", "at", "low", "high"))


def _times() -> Column:
    """How often a condition holds in one fact: occurrences in content, else once."""
    c = lambda name: F.col(f"c.{name}")
    value = F.col("_text")
    folded = F.when(c("case_insensitive"), F.lower(value)).otherwise(value)
    counted = (
        F.when(c("regex").isNotNull(), F.regexp_count(value, c("regex")).cast("bigint"))
        .when(c("how") == "exact", (folded == c("pattern")).cast("bigint"))
        .otherwise(T.count_literal(folded, c("pattern")))
    )
    return F.when(F.col("kind").isin("raw", "hex") & c("pattern").isNotNull(), counted).otherwise(F.lit(1).cast("bigint"))


def _or_false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _in_bounds(value: Column, low: float | None, high: float | None) -> Column:
    tests = [t for t, bound in ((value >= F.lit(low), low), (value <= F.lit(high), high)) if bound is not None]
    return _or_false(reduce(Column.__and__, tests)) if tests else F.lit(True)


def _key_test(c: dict) -> Column:
    """Whether a fact of a keyed kind has the key of a condition."""
    key = F.col("key")
    if c["kind"] == "structure":
        return (key == f"{c['key']}") | key.startswith(f"{c['key']}/")
    return F.lit(True) if c["kind"] == "syscall" else key == f"{c['key']}"


def _written_out(c: dict) -> tuple[Column, Column]:
    """(test, rest): what a fact of its kind must pass for a condition, as constants that Spark compiles.

    `rest` looks at what was matched and is for the facts that pass `test`.
    """
    value, number, regex = F.col("text"), F.col("number"), _regex(c)
    if c["how"] in ("exact", "substr") and c["kind"] != "hex" and c["pattern"] is None:
        text = F.lit(False)
    else:
        text = _in_row(value, c, regex)
    bounds = _in_bounds(number, c["n_min"], c["n_max"])
    kind = c["kind"]
    if kind == "section":
        flags = [_or_false(F.col("key").contains(letter) == c[flag]) for flag, letter in (("readable", "r"), ("writable", "w"), ("executable", "x")) if c[flag] is not None]
        text = reduce(Column.__and__, [bounds, _in_bounds(F.col("extra"), c["e_min"], c["e_max"]), *flags, text])
    elif kind == "syscall":
        tests = [F.lit(True)]
        if c["names"]:
            tests.append(value.isin(*c["names"]))
        if c["numbers"]:
            tests.append(number.cast("bigint").isin(*c["numbers"]))
        if c["others"]:
            tests.append(reduce(Column.__or__, [_or_false(F.lower("key").contains(a.lower())) for a in c["others"] if a is not None] or [F.lit(False)]))
        text = reduce(Column.__and__, tests)
    elif kind == "encoded" and c["names"]:
        text = F.arrays_overlap(F.split("key", ","), F.array(*map(F.lit, c["names"]))) & text
    elif kind == "metrics":
        text = bounds
    elif kind == "kv" and (c["n_min"] is not None or c["n_max"] is not None):
        text = number.isNotNull() & bounds
    elif kind == "structure":
        text = F.lit(True)
    elif kind == "string" and c["e_min"] is not None:
        text = (F.octet_length(value) >= F.lit(c["e_min"])) & text
    if kind in KEYED_KINDS:
        text = _key_test(c) & text
    hit = value if regex is None else F.regexp_substr(value, F.lit(regex))
    rest = []
    for e in c["exceptions"] or []:
        low, pattern = F.lower(hit), e["pattern"]
        if pattern is not None:
            rest.append(~_or_false(low == F.lower(F.lit(pattern)) if e["how"] == "exact" else low.contains(F.lower(F.lit(pattern))) if e["how"] == "substr" else F.regexp(hit, F.lit(pattern))))
    if c["external_ip"]:
        rest.append(matching.holds_address(hit) & net.contains_external_ip(hit))
    return _or_false(text), _or_false(reduce(Column.__and__, rest)) if rest else F.lit(True)


def _folded(c: dict) -> str | None:
    """The pattern as it is compared with lower case."""
    return c["pattern"].lower() if c["pattern"] is not None and c["case_insensitive"] and c["how"] in ("exact", "substr") else c["pattern"]


def _times_of(c: dict, value: Column) -> Column:
    """`_times` of one condition."""
    if c["kind"] not in ("raw", "hex") or c["pattern"] is None:
        return F.lit(1).cast("bigint")
    regex = _regex(c)
    form = F.lower(value) if c["case_insensitive"] else value
    if regex is not None:
        return F.regexp_count(value, F.lit(regex)).cast("bigint")
    return (form == _folded(c)).cast("bigint") if c["how"] == "exact" else T.count_literal(form, F.lit(_folded(c)))


def _head(c: dict) -> Column:
    """The bytes of content that a placed condition can look at, without knowing the file's size."""
    data = F.col("text").cast("binary")
    ends = [c["at"] + 1] if c["at"] is not None else [c["high"]]
    if c["section"] is not None or ends[0] is None or ends[0] < 1 or (c["low"] or 0) < 0:
        return data
    return F.substr(data, F.lit(1), F.lit(min(ends[0], 2**31 - 1)))


def _by_condition(conds: list[dict], i: Column, of) -> Column:
    """What `of` says of the condition with the number `i`."""
    return reduce(lambda out, ic: out.when(i == ic[0], of(ic[1])), enumerate(conds), F.when(F.lit(False), of(conds[0])))


def _summed(hits: DataFrame, sampled: bool, *keys: str) -> DataFrame:
    """Hits of each key; without samples, which are strings, Spark sums them up without sorting."""
    if sampled:
        return hits.groupBy(*keys).agg(F.sum("n").alias("hits"), F.min("sample").alias("sample"))
    return hits.groupBy(*keys).agg(F.sum("n").alias("hits")).withColumn("sample", F.lit(None).cast("string"))


def _written_hits(files: DataFrame, facts: DataFrame, conds: list[dict], sections: DataFrame | None, sampled: bool) -> DataFrame:
    """`_direct_hits` of few conditions, whose tests are written out.

    Facts that pass no test are dropped by compiled tests; the others leave one narrow row
    for each condition they meet, which carries content only where it is to be cut later.
    """
    kind = F.col("kind")
    pairs = [_written_out(c) for c in conds]
    asked = matching.some([F.when((kind == c["kind"]) & test, F.lit(True)) for c, (test, _) in zip(conds, pairs)])
    placed = [c for c in conds if _is_placed(c)]
    cells: dict[str, list[Column]] = {}
    for i, (c, (test, rest)) in enumerate(zip(conds, pairs)):
        content = c["kind"] in ("raw", "hex")
        cut = c["kind"] == "raw" and _is_placed(c)
        sample = F.lit(_regex(c) or _folded(c)) if content and c["pattern"] is not None else F.lit(_regex(c)) if content else F.coalesce("text", "key")
        fields = [F.lit(i).alias("i"), (F.lit(1).cast("bigint") if cut else _times_of(c, F.col("text"))).alias("n")]
        fields += [sample.cast("string").alias("sample")] if sampled else []
        if placed:
            lies = _is_placed(c)
            fields += [
                (F.col("offset") if lies else F.lit(None).cast("bigint")).alias("offset"),
                (_or_false(F.col("key") == "symbol") if lies and c["kind"] == "string" else F.lit(False)).alias("free"),
                (_head(c) if cut else F.lit(None).cast("binary")).alias("head"),
            ]
        cells.setdefault(c["kind"], []).append(F.when(test & rest, F.struct(*fields)))
    by_kind = reduce(lambda out, some: out.when(kind == some[0], F.array(*some[1])), list(cells.items())[1:], F.when(kind == conds[0]["kind"], F.array(*cells[conds[0]["kind"]])))
    held = facts.where(asked).select("file_id", by_kind.alias("_held"))
    # Not `explode`, which would test the array once more before it.
    each = held.select("file_id", F.explode_outer("_held").alias("h")).where("h.n > 0").select("file_id", "h.*")
    i, cond_id = F.col("i"), F.element_at(F.array(*[F.lit(c["cond_id"]) for c in conds]), F.col("i") + 1).alias("cond_id")
    if not placed:
        return _summed(each, sampled, "file_id", "i").select("file_id", cond_id, "hits", "sample")
    none = F.lit(None)
    place = lambda c: F.struct(*[(none if c[name] is None else F.lit(c[name])).cast(kind).alias(name) for name, kind in (("section", "string"), ("at", "bigint"), ("low", "bigint"), ("high", "bigint"))])
    cut = [j for j, c in enumerate(conds) if c["kind"] == "raw" and _is_placed(c)]
    content = i.isin(cut) if cut else F.lit(False)
    wanted = sorted({c["section"] for c in placed if c["section"] is not None})
    found = _placed(each.withColumn("c", _by_condition(conds, i, place)), files, sections, content, F.col("free"), wanted)
    if cut:
        text = F.substr("head", (F.col("_lo") + 1).cast("int"), F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)).cast("int")).cast("string")
        found = found.withColumn("_text", F.when(content, text)).withColumn("n", F.when(content, F.col("n") * _by_condition(conds, i, lambda c: _times_of(c, F.col("_text")))).otherwise(F.col("n"))).where("n > 0")
    return _summed(found, sampled, "file_id", "i").select("file_id", cond_id, "hits", "sample")


def _direct_hits(files: DataFrame, facts: DataFrame, conds: list[dict], sections: DataFrame | None, sampled: bool = True) -> DataFrame:
    """(file_id, cond_id, hits, sample): written out tests of few conditions, else one keyed join of facts and conditions."""
    return (_written_hits if len(conds) <= MAX_DIRECT else _keyed_hits)(files, facts, conds, sections, sampled)


def _keyed_hits(files: DataFrame, facts: DataFrame, conds: list[dict], sections: DataFrame | None, sampled: bool) -> DataFrame:
    """`_direct_hits` by one keyed join of facts and conditions."""
    anchors = _anchors(conds)
    fields = F.struct(*[p.split()[0] for p in ANCHOR_SCHEMA.split(", ")[1:]]).alias("c")
    in_row = [key == f"{c['kind']}!{c['cond_id']}" for c, key in anchors]
    tested, keyed = ([a for a, t in zip(anchors, in_row) if t is which] for which in (True, False))
    # Tests in the row are so many a pass; the keyed conditions ride along with the first.
    chunks = [tested[i : i + matching.TESTS_A_PASS] for i in range(0, len(tested), matching.TESTS_A_PASS)] or [[]]
    passes = []
    for some in [keyed + chunks[0], *chunks[1:]]:
        rows = facts.where(F.col("kind").isin(*sorted({c["kind"] for c, _ in some})))
        catalog = F.broadcast(_catalog(facts.sparkSession, some)).select("_key", fields)
        keys, asked = _probes(some)
        passes.append(rows.where(asked).withColumn("_key", F.explode(keys)).join(catalog, "_key").where(_matches()))
    found = reduce(DataFrame.unionByName, passes)
    if any(map(_is_placed, conds)):
        raw = F.col("kind") == "raw"
        found = _placed(found, files, sections, raw, (F.col("kind") == "string") & (F.col("key") == "symbol"))
        # Content is cut to the place.
        found = found.withColumn("_text", F.when(raw & ~F.col("_anywhere"), _slice(F.col("text"), F.col("_lo"), F.col("_hi"))).otherwise(F.col("text")))
    else:
        found = found.withColumn("_text", F.col("text"))
    content = F.col("kind").isin("raw", "hex")
    sample = F.when(content, F.coalesce("c.regex", "c.pattern")).otherwise(F.coalesce("text", "key"))
    counted = found.select("file_id", F.col("c.cond_id").alias("cond_id"), _times().alias("n"), sample.alias("sample")).where("n > 0")
    return _summed(counted, sampled, "file_id", "cond_id").select("file_id", "cond_id", "hits", "sample")


def _complement(hits: DataFrame, roots: DataFrame, conds: list[dict]) -> DataFrame:
    """Hits of `exists: false`: files with structured data (`roots`) and nothing at the path."""
    absent = [c["cond_id"] for c in conds]
    pairs = roots.select("file_id").distinct().withColumn("cond_id", F.explode(F.array(*map(F.lit, absent))))
    return pairs.join(hits, ["file_id", "cond_id"], "left_anti").select("file_id", "cond_id", F.lit(1).cast("bigint").alias("hits"), F.lit(None).cast("string").alias("sample"))


def _one_hit(df: DataFrame, sample: Column) -> DataFrame:
    return df.select("file_id", "cond_id", F.lit(1).cast("bigint").alias("hits"), sample.cast("string").alias("sample"))


def _counts(files: DataFrame, counted: DataFrame, conds: list[dict]) -> DataFrame:
    """Files whose count (file_id, cond_id, n) is in the bounds of its condition; no row counts 0."""
    bounds = local_table(files.sparkSession, [(c["cond_id"], c["n_min"], c["n_max"]) for c in conds], "cond_id string, n_min double, n_max double")
    zero = [c["cond_id"] for c in conds if (c["n_min"] or 0) <= 0]
    ok = _bounded(F.col("n").cast("double"), F.col("n_min"), F.col("n_max"))
    found = _one_hit(counted.join(F.broadcast(bounds), "cond_id").where(ok), F.col("n"))
    if zero:
        pairs = files.select("file_id", F.explode(F.array(*map(F.lit, zero))).alias("cond_id"))
        found = found.unionByName(_one_hit(pairs.join(counted, ["file_id", "cond_id"], "left_anti"), F.lit("0")))
    return found


def _ratios(facts: DataFrame, conds: list[dict]) -> DataFrame:
    """Files whose matching sections have a share of all bytes, or of other sections', in bounds."""
    number, sums, out = F.col("number"), [], []
    for i, c in enumerate(conds):
        base = c["key"] or "total"
        matched = lambda p: F.when(F.col("text").rlike(p), number) if p is not None else F.lit(None).cast("double")
        sums += [F.sum(matched(c["pattern"])).alias(f"_part{i}"), F.sum(number if base == "total" else matched(base)).alias(f"_whole{i}")]
        ratio = F.col(f"_part{i}") / F.nullif(F.col(f"_whole{i}"), F.lit(0.0))
        out.append(F.when(ratio.isNotNull() & _in_bounds(ratio, c["n_min"], c["n_max"]), F.lit(c["cond_id"])))
    shares = facts.where("kind = 'section'").groupBy("file_id").agg(*sums)
    return _one_hit(_each_held(shares, out, F.lit(None).cast("string")), F.col("_of"))


def _each_held(sums: DataFrame, conds: list[Column], of: Column) -> DataFrame:
    """(file_id, cond_id, _of): a row for each of some conditions that is not null in a row of sums."""
    held = sums.select("file_id", of.alias("_of"), F.array(*conds).alias("_conds"))
    return held.select("file_id", "_of", F.explode_outer(F.array_compact("_conds")).alias("cond_id")).where("cond_id is not null")


def _name_sums(facts: DataFrame, conds: list[dict]) -> DataFrame:
    """Of every file with imports or exports their numbers, and what `_combinations` asks of the imports."""
    imported = F.col("key") == "import"
    test = lambda p: imported & _or_false(F.col("text").rlike(p) if p is not None else F.lit(False))
    sums = [F.count_if(imported).alias("_imports"), F.count_if(F.col("key") == "export").alias("n")]
    for i, c in enumerate(conds):
        sums += [F.max(test(p)).alias(f"_met{i}_{j}") for j, p in enumerate(c["names"] or [])]
        odd = [test(p).cast("bigint") for p in c["others"] or []]
        sums.append(F.sum(reduce(Column.__add__, odd, F.lit(0).cast("bigint"))).alias(f"_odd{i}"))
    return facts.where("kind = 'symbol' and key in ('import', 'export')").groupBy("file_id").agg(*sums)


def _combinations(sums: DataFrame, conds: list[dict]) -> DataFrame:
    """Files importing every required pattern, enough suspicious ones (n_min) and not too many in all (n_max)."""
    out = []
    for i, c in enumerate(conds):
        tests = [F.col(f"_met{i}_{j}") for j, _ in enumerate(c["names"] or [])]
        tests += [F.col(f"_odd{i}") >= F.lit(c["n_min"])] if c["n_min"] is not None else []
        tests += [F.col("_imports") <= F.lit(c["n_max"])] if c["n_max"] is not None else []
        out.append(F.when(reduce(Column.__and__, tests, F.lit(True)), F.lit(c["cond_id"])))
    return _one_hit(_each_held(sums.where("_imports > 0"), out, F.col("_imports")), F.col("_of"))


# So many conditions that sum up facts of a file are columns of one aggregation.
SUMS_A_PASS = 16


def condition_hits(files: DataFrame, facts: DataFrame, conds: list[dict], sections: DataFrame | None = None, sampled: bool = True) -> DataFrame:
    """(file_id, cond_id, hits, sample): how often each condition holds in each file.

    `files`: file_id, size_bytes. `conds` as `distinct_conditions` returns them. Kinds on
    text, keys and numbers meet the facts in one join; counts, ratios and combinations
    aggregate what they need. Conditions that hold nowhere have no row. All of it is written
    once, so it can be read several times. Unless `sampled`, a sample may be null.
    """
    kind = lambda *names: [c for c in conds if c["kind"] in names]
    parts, hits = [], None
    counted = [{**c, "kind": "string"} for c in kind("string_count")]
    joined = kind(*TEXT_KINDS, *KEYED_KINDS) + counted
    if joined:
        absent = [c for c in kind("kv") if c["exists"] is False]
        features = kind("structure")
        # Every file with structured data has a fact with an empty key.
        roots = [{**condition(kind="kv", key=""), "cond_id": ROOT}] if absent else []
        hits = cut_lineage(_direct_hits(files, facts, joined + roots, sections, sampled))  # read by several parts
        special = {c["cond_id"] for c in (*counted, *features, *absent, *roots)}
        of = lambda some: hits.where(F.col("cond_id").isin([c["cond_id"] for c in some]))
        if absent:
            parts.append(_complement(of(absent), of(roots), absent))
        if counted:
            parts.append(_counts(files, of(counted).withColumnRenamed("hits", "n"), counted))
        if features:
            least = local_table(facts.sparkSession, [(c["cond_id"], int(c["n_min"] or 1)) for c in features], "cond_id string, least bigint")
            parts.append(of(features).join(F.broadcast(least), "cond_id").where("hits >= least").select("file_id", "cond_id", "hits", "sample"))
        hits = hits.where(~F.col("cond_id").isin(sorted(special))) if special else hits
    exports, mixed, shares = kind("exports_count"), kind("import_combination"), kind("section_ratio")
    chunks = [mixed[i : i + SUMS_A_PASS] for i in range(0, len(mixed), SUMS_A_PASS)] or ([[]] if exports else [])
    for i, some in enumerate(chunks):
        sums = _name_sums(facts, some)
        sums = cut_lineage(sums) if exports and i == 0 else sums  # read for both
        if some:
            parts.append(_combinations(sums, some))
        if exports and i == 0:
            each = sums.where("n > 0").select("file_id", "n", F.explode(F.array(*[F.lit(c["cond_id"]) for c in exports])).alias("cond_id"))
            parts.append(_counts(files, each, exports))
    parts += [_ratios(facts, shares[i : i + SUMS_A_PASS]) for i in range(0, len(shares), SUMS_A_PASS)]
    if parts:
        more = cut_lineage(reduce(DataFrame.unionByName, parts))
        return more if hits is None else hits.unionByName(more)
    if hits is None:
        return files.select("file_id", F.lit("").alias("cond_id"), F.lit(0).cast("bigint").alias("hits"), F.lit("").alias("sample")).limit(0)
    return hits
