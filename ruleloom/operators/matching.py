"""Joining values with pattern tables: exact, literal and regex, without nested loops."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.session import local_table

# Pattern tables up to this many rows are sent to every task; larger ones are joined by
# shuffling grams, so no result depends on the bound.
MAX_BROADCAST_PATTERNS = 200_000
GRAM = 4
# Regexes without a literal that are tested in one pass over the values.
TESTS_A_PASS = 200


def is_small(df: DataFrame, bound: int = MAX_BROADCAST_PATTERNS) -> bool:
    """Whether a table has at most `bound` rows, reading no more than needed to tell."""
    return df.limit(bound + 1).count() <= bound


def exact_hits(
    values: DataFrame, patterns: DataFrame, case_insensitive: bool = False, column: str = "value"
) -> DataFrame:
    """Rows whose value equals a pattern: a hash join on the (lowered) text."""
    fold = F.lower if case_insensitive else (lambda c: F.col(c) if isinstance(c, str) else c)
    p = patterns.withColumn("_key", fold(F.col("pattern")))
    v = values.withColumn("_key", fold(F.col(column)))
    if is_small(patterns):
        p = F.broadcast(p)
    return v.join(p, "_key").drop("_key")


def grams(value: Column, k: int) -> Column:
    """Distinct runs of k characters, read as k shifted lists of chunks in linear time."""
    chunks = [
        F.regexp_extract_all(F.substr(value, F.lit(i + 1)), F.lit("(?s).{%d}" % k), F.lit(0))
        for i in range(k)
    ]
    return F.array_distinct(F.flatten(F.array(*chunks)))


def anchored(patterns: DataFrame) -> DataFrame:
    """Each pattern with one of its grams: the one fewest patterns share.

    Patterns shorter than a gram are their own gram.
    """
    n = F.char_length("pattern")
    longest = F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1)))
    spelled = patterns.withColumn("_gram", F.explode(longest)).withColumn(
        "_gram", F.substr("pattern", F.col("_gram"), F.least(n, F.lit(GRAM)))
    )
    shared = spelled.groupBy("_gram").agg(F.count("*").alias("_shared"))
    best = W.partitionBy(*patterns.columns).orderBy("_shared", "_gram")
    return (
        spelled.join(shared, "_gram")
        .withColumn("_pick", F.row_number().over(best))
        .filter(F.col("_pick") == 1)
        .drop("_pick", "_shared")
        .withColumn("_k", F.char_length("_gram"))
    )


def small_rows(df: DataFrame, bound: int = MAX_BROADCAST_PATTERNS) -> list | None:
    """The rows of a table of at most `bound` rows, else None."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def literal_hits(values: DataFrame, patterns: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Pairs (values row, patterns row) where the value contains the pattern.

    `patterns` holds rule_id, pattern and any further columns; `keys` identifies a row of
    `values`. A value meets only patterns whose anchor gram it holds, an equi-join, and
    the containment test then decides. Empty patterns match nothing.
    """
    usable = patterns.filter(F.col("pattern") != "")
    rows = small_rows(usable)
    if rows is not None:
        # A pattern table under the bound sits in every task, so the text stays where it is.
        schema = ", ".join(f"`{n}` {t}" for n, t in usable.dtypes)
        anchors = local_table(values.sparkSession, [(*r, g) for r, g in zip(rows, rarest_grams(rows))], schema + ", _gram string")
        lengths = sorted({min(len(r["pattern"]), GRAM) for r in rows})
        if not lengths:
            nothing = [F.lit(None).cast(t).alias(n) for n, t in usable.dtypes]
            return values.filter(F.lit(False)).select(*values.columns, *nothing)
        probe = F.array_distinct(F.flatten(F.array(*[grams(F.col(column), k) for k in lengths])))
        return (
            values.withColumn("_gram", F.explode(probe))
            .join(F.broadcast(anchors), "_gram")
            .filter(F.col(column).contains(F.col("pattern")))
            .drop("_gram")
        )
    # Too many patterns to send: find candidate keys by shuffled grams, then fetch the text.
    anchors = anchored(usable)
    probe = F.array_distinct(F.flatten(F.array(*[grams(F.col(column), k) for k in range(1, GRAM + 1)])))
    # Equal rows of `values` share their keys: each key is a candidate once, and meets all of its rows again.
    candidates = values.select(*keys, F.explode(probe).alias("_gram")).distinct().join(anchors, "_gram").drop("_gram", "_k")
    return candidates.join(values, keys).filter(F.col(column).contains(F.col("pattern")))


def rarest_grams(rows: list) -> list[str]:
    """The driver's form of `anchored` for a pattern table under the bound."""
    spelled = [
        sorted({p[i : i + GRAM] for i in range(max(len(p) - GRAM + 1, 1))}) for p in (r["pattern"] for r in rows)
    ]
    shared = Counter(g for gs in spelled for g in gs)
    return [min(gs, key=lambda g: (shared[g], g)) for gs in spelled]


def regex_literal(regex: Column) -> Column:
    """Leading literal of a regex, null when it has fewer than three characters.

    A start or word anchor before it is skipped. A last character under `*`, `?` or `{`
    may be absent, so it is not part of the literal; a pattern with a choice has none.
    """
    head = r"^(?:\^|\\b)?((?:[A-Za-z0-9_/ -]|\\[.*+?\[\](){}|^$\\/-])*)"
    lead = F.regexp_extract(regex, head, 1)
    rest = F.substr(regex, F.char_length(F.regexp_extract(regex, head, 0)) + 1)
    trimmed = F.when(rest.rlike(r"^[*?{]"), F.regexp_replace(lead, r"(?s)\\?.\z", "")).otherwise(lead)
    plain = F.regexp_replace(trimmed, r"\\(.)", "$1")
    return F.when((F.char_length(plain) >= 3) & ~regex.contains("|") & ~regex.rlike(r"\(\?"), plain)


def required_literal(regex: str, least: int = 3) -> str | None:
    """The longest run of plain characters that every match contains, if it has so many.

    Only what stands outside of groups and classes counts, and a choice outside of them
    leaves nothing that every match has.
    """
    if "(?" in regex or "\\Q" in regex:
        return None
    runs, run, i, depth = [], "", 0, 0
    while i < len(regex):
        c = regex[i]
        plain = None
        if c == "\\":
            i += 1
            plain = regex[i] if i < len(regex) and not regex[i].isalnum() else None
        elif c == "[":
            i += 1
            first = i + (regex[i : i + 1] == "^")
            while i < len(regex) and (regex[i] != "]" or i == first):
                i += 2 if regex[i] == "\\" else 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return None
        elif c == "{":
            i = max(i, regex.find("}", i))
        elif c not in "|.^$*+?":
            plain = c
        if depth == 0 and c in "*?{":
            run = run[:-1]
        if plain is not None and depth == 0:
            run += plain
        else:
            runs.append(run)
            run = ""
        i += 1
    best = max([*runs, run], key=len)
    return best if len(best) >= least else None


def least_length(regex: str) -> int:
    """A number of characters that every match has at least; 0 where that is not plain to see.

    Groups count for nothing, and a choice outside of them, a class in a class or an
    unusual escape leaves nothing.
    """
    if "(?" in regex or "\\Q" in regex:
        return 0
    total, last, i, depth = 0, 0, 0, 0
    while i < len(regex):
        c = regex[i]
        width = None
        if c == "\\":
            i += 1
            kind = regex[i : i + 1]
            if kind.isalnum() and kind not in "dDwWsSntrbB":
                return 0
            width = 0 if kind in ("b", "B", "") else 1
        elif c == "[":
            i += 1
            first = i + (regex[i : i + 1] == "^")
            while i < len(regex) and (regex[i] != "]" or i == first):
                if regex[i] == "[":
                    return 0
                i += 2 if regex[i] == "\\" else 1
            width = 1
        elif c in "()":
            depth += 1 if c == "(" else -1
            width = 0
        elif c == "|" and depth == 0:
            return 0
        elif c in "*?":
            total, last = total - last, 0
        elif c == "{":
            end = regex.find("}", i)
            low = regex[i + 1 : end].split(",")[0]
            if end < 0 or not low.isdecimal():
                return 0
            total, last, i = total - last + last * int(low), last * int(low), end
        elif c not in "|^$+":
            width = 1
        if width is not None:
            last = width if depth == 0 else 0
            total += last
        i += 1
    return total


def may_match(value: Column, regex: str) -> Column | None:
    """A cheap test that every value with a match passes, None if there is none.

    It looks at bytes alone, so a short word costs no regex.
    """
    n = least_length(regex)
    if n == 0:
        return None
    literal = required_literal(regex, 1)
    long_enough = F.octet_length(value) >= n
    return long_enough if literal is None else long_enough & value.contains(literal)


def tested(value: Column, regex: str) -> Column:
    """Whether a value has a match of the regex, where the cheap test does not rule it out."""
    plain = regex.removeprefix("(?i)")
    cheap = may_match(value, plain) if plain == regex else F.octet_length(value) >= least_length(plain)
    return value.rlike(regex) if cheap is None else cheap & value.rlike(regex)


def word_tested(value: Column, word: str, regex: str, case_insensitive: bool) -> Column:
    """Whether a value has a word; `regex` is that of the word."""
    if "\\E" in word:  # ends the quotation early
        return value.rlike(regex)
    if not case_insensitive:
        return value.contains(word) & value.rlike(regex)
    # Lower case of other letters depends on what stands beside them.
    return F.lower(value).contains(word.lower()) & value.rlike(regex) if word.isascii() else value.rlike(regex)


def holds_address(value: Column) -> Column:
    """Whether a value has four numbers with dots between them."""
    return (F.octet_length(value) >= 7) & value.contains(".") & value.rlike(K.IP_RE)


def some(tests: list[Column]) -> Column:
    """Whether any of some columns is not null.

    Filtering an array of them is not compiled, so rows that no test holds for are dropped
    by this before it.
    """
    return F.coalesce(*tests).isNotNull()


def regex_hits(values: DataFrame, patterns: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Pairs where the value matches the regex in `pattern`.

    Regexes with a literal that every match holds, at their head or inside, go through
    the gram join and are verified. The rest are tested in the row, so many a pass; their
    number is that of the catalog.
    """
    extra = patterns.columns
    split = patterns.withColumns({"_regex": F.col("pattern"), "pattern": regex_literal(F.col("pattern"))})
    rest = split.filter(F.col("pattern").isNull()).select(*[F.col("_regex").alias("pattern") if c == "pattern" else c for c in extra]).collect()
    inner = [(r, literal) for r in rest if (literal := required_literal(r["pattern"]))]
    rows = [r for r in rest if not required_literal(r["pattern"])]
    led = split.filter(F.col("pattern").isNotNull())
    if inner:
        types = dict(patterns.dtypes)
        schema = ", ".join(f"`{n}` {types[n]}" for n in extra)
        inside = local_table(values.sparkSession, [(*r, literal) for r, literal in inner], schema + ", _literal string")
        led = led.unionByName(inside.withColumn("_regex", F.col("pattern")).withColumn("pattern", F.col("_literal")).drop("_literal"))
    found = literal_hits(values, led, keys, column)
    found = found.filter(F.regexp(F.col(column), F.col("_regex"))).withColumn("pattern", F.col("_regex"))
    found = found.select(*values.columns, *extra)
    for i in range(0, len(rows), TESTS_A_PASS):
        tests = [F.when(F.col(column).rlike(r["pattern"]), F.struct(*[F.lit(r[c]).alias(c) for c in extra])) for r in rows[i : i + TESTS_A_PASS]]
        tested = values.withColumn("_hit", F.explode(F.array_compact(F.array(*tests))))
        found = found.unionByName(tested.select(*values.columns, *[F.col(f"_hit.{c}").alias(c) for c in extra]))
    return found


def applicable(files: DataFrame, rule_types: DataFrame) -> DataFrame:
    """(file, rule) pairs by file type; a rule for `all` applies to every type.

    A universal rule becomes one row for each type that files have, and files join on
    their type.
    """
    universal = F.lit("all")
    types = files.select(universal.alias("file_type"), F.col("file_type").alias("_own")).filter("_own is not null").distinct()
    every = rule_types.filter(F.col("file_type") == "all").select("rule_id", "file_type").distinct()
    every = every.join(F.broadcast(types) if is_small(types) else types, "file_type").select("rule_id", F.col("_own").alias("file_type"))
    pairs = rule_types.filter(F.col("file_type") != "all").select("rule_id", "file_type").unionByName(every).distinct()
    return files.join(F.broadcast(pairs) if is_small(pairs) else pairs, "file_type")


def applicable_counts(files: DataFrame, rule_types: DataFrame) -> DataFrame:
    """(file_id, n_rules, first_rule): how many rules apply to a file, and the least of them.

    Files of one type share their rules: rules meet the types, are counted there, and files
    join the counts of their type, so no file is paired with each of its rules.
    """
    by_type = applicable(files.select("file_type").distinct(), rule_types).groupBy("file_type")
    counted = by_type.agg(F.count("*").alias("n_rules"), F.min("rule_id").alias("first_rule"))
    each = files.join(F.broadcast(counted) if is_small(counted) else counted, "file_type")
    return each.groupBy("file_id").agg(F.sum("n_rules").alias("n_rules"), F.min("first_rule").alias("first_rule"))


def resolve_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `target_id` for every id a reference stands for.

    An exact id wins. Otherwise a bare name matches ids ending in it after `::` or `/`,
    and a directory matches the ids under it; an id with `::` only matches exactly. All
    three are equi-joins, against each id's own name and its directories.
    """
    exact = refs.join(known.select(F.col("rule_id").alias("target_id")).distinct(), F.col("ref_id") == F.col("target_id"))
    open_refs = refs.filter(~F.col("ref_id").contains("::")).join(
        exact.select("ref_id").distinct(), "ref_id", "left_anti"
    )
    target = F.col("rule_id")
    name = known.select(target.alias("target_id"), F.regexp_extract(target, "(?:::|/)((?:(?!::|/).)*)$", 1).alias("ref_id"))
    by_name = open_refs.filter(~F.col("ref_id").contains("/")).join(name.distinct(), "ref_id")
    cuts = F.split(F.regexp_replace(target, "::", "/"), "/")
    dirs = known.select(
        target.alias("target_id"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1)))).alias("_n"),
        cuts.alias("_cuts"),
    ).select("target_id", F.array_join(F.slice("_cuts", F.lit(1), F.col("_n")), "/").alias("ref_id"))
    by_directory = open_refs.filter(F.col("ref_id").contains("/")).join(dirs.distinct(), "ref_id").filter(
        F.col("target_id").startswith(F.concat("ref_id", F.lit("::")))
        | F.col("target_id").startswith(F.concat("ref_id", F.lit("/")))
    )
    cols = [*refs.columns, "target_id"]
    return exact.select(*cols).unionByName(by_name.select(*cols)).unionByName(by_directory.select(*cols))
