"""Atomic rule scan: every matcher family as one join, then the count and type gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import net, text as T
from ruleloom.operators import composites, conditions as C, matching, predicates as P
from ruleloom.session import cut_lineage, local_table

# So few rules are cheaper to test on every value than to look up by the grams it holds.
MAX_DIRECT_RULES = 64
# So many rules are matched in one pass over the values; a larger catalog takes more passes.
MAX_COMBINED_RULES = 20_000

RULE_SCHEMA = (
    "rule_id string, crit int, conf double, ctype string, how string, pattern string, "
    "case_insensitive boolean, for_types array<string>, size_min bigint, size_max bigint, "
    "count_min bigint, count_max bigint, per_kb_min double, per_kb_max double"
)


def as_regex(how: Column, pattern: Column, case_insensitive: Column) -> Column:
    """Regex and word matchers as one kind of pattern, null for the others."""
    word = F.concat(F.lit(r"\b\Q"), pattern, F.lit(r"\E\b"))
    body = F.when(how == "word", word).when(how == "regex", pattern)
    return F.when(case_insensitive, F.concat(F.lit("(?i)"), body)).otherwise(body)


def _marked(mark: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(mark), g))


def _direct_test(value: Column, rule) -> Column:
    """One rule as a test of one value."""
    if rule["how"] == "external_ip":
        return matching.holds_address(value) & net.contains_external_ip(value)
    if rule["how"] == "word" and rule["regex"] is not None:
        return matching.word_tested(value, rule["pattern"], rule["regex"], rule["case_insensitive"])
    if rule["regex"] is not None:
        return matching.tested(value, rule["regex"])
    return P.matcher(value, case_insensitive=rule["case_insensitive"], **{rule["how"]: rule["pattern"]})


def _anchor_keys(rows: list, direct: bool) -> list[tuple]:
    """(rule, matcher, pattern, regex, key) per rule; the key says what a value must hold.

    `=` and `~` stand for the value and its lower case, `.` and `,` for grams of them,
    and `!` for a test that is run on every value.
    """
    literals = []
    for r in rows:
        literal = None if r["how"] != "regex" else r["literal"] or matching.required_literal(r["regex"])
        if direct:
            literals.append(("!", r["rule_id"]))
        elif r["how"] == "exact":
            literals.append(("~" if r["case_insensitive"] else "=", r["pattern"]))
        elif r["how"] in ("substr", "word"):
            literals.append(("," if r["case_insensitive"] else ".", r["pattern"]))
        else:
            literals.append(("." if literal else "!", literal or r["rule_id"]))
    folded = [(mark, text.lower() if mark in "~," else text) for mark, text in literals]
    grams = matching.rarest_grams([{"pattern": text} for _, text in folded])
    out = []
    for r, (mark, text), gram in zip(rows, folded, grams):
        pattern = r["pattern"]
        if r["how"] in ("exact", "substr") and r["case_insensitive"]:
            pattern = pattern.lower()
        out.append((r["rule_id"], r["how"], r["case_insensitive"], pattern, r["regex"], mark + (gram if mark in ".," else text)))
    return out


def _one_pass(values: DataFrame, rows: list, anchors: list[tuple], column: str) -> DataFrame:
    """Pairs (values row, rule) for some rules in one pass over the values.

    Each value is exploded into the keys it holds and meets the rules by an equi-join
    with the broadcast catalog; the rule's own test then decides.
    """
    catalog = local_table(
        values.sparkSession, anchors,
        "rule_id string, how string, case_insensitive boolean, pattern string, regex string, _key string",
    )
    value, low = F.col(column), F.lower(column)
    marks = {a[5][0] for a in anchors}
    probes = []
    for mark, form in (("=", value), ("~", low)):
        if mark in marks:
            probes.append(F.array(F.concat(F.lit(mark), form)))
    for mark, form in ((".", value), (",", low)):
        for k in sorted({len(a[5]) - 1 for a in anchors if a[5][0] == mark}):
            probes.append(_marked(mark, matching.grams(form, k)))
    tests = [F.when(_direct_test(value, r), F.lit(a[5])) for r, a in zip(rows, anchors) if a[5][0] == "!"]
    if tests and not probes:
        values = values.where(matching.some(tests))
    if tests:
        probes.append(F.array_compact(F.array(*tests)))
    keys = F.concat(*probes) if probes else F.array().cast("array<string>")
    verified = (
        F.col("_key").rlike("^[=~!]")
        | ((F.col("how") == "substr") & F.when(F.col("case_insensitive"), low).otherwise(value).contains(F.col("pattern")))
        | (F.col("regex").isNotNull() & F.regexp(value, F.col("regex")))
    )
    return values.withColumn("_key", F.explode(keys)).join(F.broadcast(catalog), "_key").filter(verified).drop("_key")


def hits_of(values: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """Pairs (values row, rule) for rules of every matcher.

    The catalog is read on the driver. It is cut into passes of a bounded number of rules
    to send and of tests in the row, which changes nothing but the number of passes.
    """
    regex = as_regex(F.col("how"), F.col("pattern"), F.col("case_insensitive"))
    rows = rules.select(
        "rule_id", "how", "pattern", "case_insensitive", regex.alias("regex"),
        F.when(F.col("how") == "regex", matching.regex_literal(regex)).alias("literal"),
    ).collect()
    pairs = list(zip(rows, _anchor_keys(rows, len(rows) <= MAX_DIRECT_RULES)))
    tested = [p for p in pairs if p[1][5][0] == "!"]
    keyed = [p for p in pairs if p[1][5][0] != "!"]
    size = max(1, MAX_COMBINED_RULES)
    passes = [keyed[i : i + size] for i in range(0, len(keyed), size)]
    chunks = [tested[i : i + matching.TESTS_A_PASS] for i in range(0, len(tested), matching.TESTS_A_PASS)]
    if passes and chunks:  # the first tests ride along
        passes[-1] = passes[-1] + chunks.pop(0)
    found = [_one_pass(values, [r for r, _ in p], [a for _, a in p], column) for p in [*passes, *chunks] or [[]]]
    return reduce(lambda a, b: a.unionByName(b), found)


def string_hits(strings: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id, hits, sample) for rules on string facts."""
    found = hits_of(strings.select("file_id", "value"), rules, "value")
    return found.groupBy("file_id", "rule_id").agg(F.count("*").alias("hits"), F.min("value").alias("sample"))


def raw_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, rule_id, hits, sample) for rules on whole content; one row per pair."""
    text = F.col("text")
    found = hits_of(files.select("file_id", "text"), rules, "text")
    folded = F.when(F.col("case_insensitive"), F.lower(text)).otherwise(text)
    hits = F.coalesce(F.regexp_count(text, F.col("regex")).cast("bigint"), T.count_literal(folded, F.col("pattern")))
    return found.select("file_id", "rule_id", hits.alias("hits"), F.coalesce("regex", "pattern").alias("sample"))


def atomic_findings(files: DataFrame, strings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings(file_id, rule_id, crit, conf, hits, sample) of atomic rules on strings and content.

    A rule of another kind is an error; `catalog_findings` takes all of them.
    """
    other = rules.filter(~F.col("ctype").isin("string", "raw") | F.col("ctype").isNull()).select("rule_id", "ctype").first()
    if other is not None:
        raise ValueError(f"{other['rule_id']} has a condition of kind {other['ctype']}; only string and raw are scanned here")
    hits = string_hits(strings, rules.filter(F.col("ctype") == "string")).unionByName(
        raw_hits(files, rules.filter(F.col("ctype") == "raw"))
    )
    gate = rules.drop("how", "pattern", "ctype", "case_insensitive")
    judged = hits.join(gate, "rule_id").join(files.select("file_id", "file_type", "size_bytes"), "file_id")
    return judged.filter(_gated()).select("file_id", "rule_id", "crit", "conf", "hits", "sample")


def _gated() -> Column:
    """File types, size, count and density of a rule, on a row of its hits in a file."""
    c = F.col
    per_kb = c("hits") / F.nullif(c("size_bytes") / 1024.0, F.lit(0.0))
    return (
        (F.array_contains("for_types", "all") | F.array_contains(c("for_types"), c("file_type")))
        & P.size_ok(c("size_bytes"), c("size_min"), c("size_max"))
        & (c("hits") >= F.coalesce("count_min", F.lit(1)))
        & (c("count_max").isNull() | (c("hits") <= c("count_max")))
        & (c("per_kb_min").isNull() | (c("size_bytes") == 0) | (per_kb >= c("per_kb_min")))
        & (c("per_kb_max").isNull() | (c("size_bytes") == 0) | (per_kb <= c("per_kb_max")))
    )


CATALOG_SCHEMA = (
    "rule_id string, crit int, conf double, for_types array<string>, platforms array<string>, size_min bigint, size_max bigint, "
    "count_min bigint, count_max bigint, per_kb_min double, per_kb_max double"
)
COMPOSITE_SCHEMA = (
    "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, platforms array<string>, "
    "size_min bigint, size_max bigint"
)
IF = "if"


def _modified(files: DataFrame, hits: DataFrame, passed: DataFrame, rules: DataFrame, conds: DataFrame) -> DataFrame:
    """Candidates (file_id, rule_id, crit, …) that no `unless` holds back, downgraded where told.

    Such a rule is a composite of its own condition; both look at the conditions that hold
    in the file and at the rules that passed their gates.
    """
    changed = conds.where(F.col("clause") != IF).select("rule_id").distinct()
    mine = passed.join(F.broadcast(changed), "rule_id", "left_semi")
    free = passed.join(F.broadcast(changed), "rule_id", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    own = rules.join(F.broadcast(changed), "rule_id", "left_semi")
    as_composites = own.select(
        "rule_id", "crit", "conf", none("int").alias("needs"), none("int").alias("near_lines"), none("int").alias("near_bytes"),
        F.array(F.lit("all")).alias("for_types"), none("bigint").alias("size_min"), none("bigint").alias("size_max"),
    )
    gate = F.concat(F.lit("gate::"), "rule_id")
    clauses = conds.where(F.col("clause") != IF).select("rule_id", "clause", "idx", "ref_id").unionByName(own.select("rule_id", F.lit("all").alias("clause"), F.lit(0).alias("idx"), gate.alias("ref_id")))
    seen = hits.select("file_id", F.col("cond_id").alias("rule_id")).unionByName(passed.select("file_id", "rule_id")).unionByName(mine.select("file_id", gate.alias("rule_id")))
    places = seen.withColumns({"line_no": none("bigint"), "offset": none("bigint")})
    told = composites.evaluate_composites(files, seen, places, as_composites, clauses, max_rounds=1)
    kept = mine.drop("crit").join(told.select("file_id", "rule_id", "crit"), ["file_id", "rule_id"])
    return free.unionByName(kept.select(*free.columns))


def catalog_findings(
    files: DataFrame, facts: DataFrame, rules: DataFrame, conds: DataFrame, sections: DataFrame | None = None,
    platforms: tuple[str, ...] = ("all",), more: DataFrame | None = None, sampled: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(findings, condition hits) of a catalog of atomic rules with conditions of every kind.

    `files`: file_id, file_type, size_bytes. `rules` as CATALOG_SCHEMA; `conds` holds for
    each rule one condition of clause `if`, and any of `unless`, `down_all`, `down_any` and
    `down_none`, inline or by the id of an atomic rule. `more` are the named conditions of
    composites, which are evaluated with them: equal ones once. A rule whose condition is
    another rule (`if` with a ref_id) is derived from the findings of the others. Unless
    `sampled`, findings may have no sample.
    """
    named = C.named(conds)
    wanted = C.distinct_conditions(*[t for t in (named, more) if t is not None])
    files = cut_lineage(files.select("file_id", "file_type", "size_bytes"))  # read by every step
    hits = C.condition_hits(files, facts, wanted, sections, sampled)
    mine = F.col("platforms")
    fits = mine.isNull() | (F.size(mine) == 0) | P.platform_ok(mine, F.array(*map(F.lit, platforms)))
    usable = cut_lineage(rules.where(fits))
    own = named.where(F.col("clause") == IF).select("rule_id", "ref_id")
    sized = F.broadcast(own.join(usable, "rule_id"))
    judged = hits.join(sized, F.col("cond_id") == F.col("ref_id")).join(files.hint("shuffle_hash"), "file_id").where(_gated())
    passed = judged.select("file_id", "rule_id", "crit", "conf", "hits", "sample")
    if named.where(F.col("clause") != IF).limit(1).count():
        passed = cut_lineage(passed)
        passed = _modified(files, hits, passed, usable, named)
    derived = named.where((F.col("clause") == IF) & ~F.col("ref_id").startswith(C.PREFIX)).select("rule_id", "ref_id").join(usable, "rule_id")
    if derived.limit(1).count():
        passed = cut_lineage(passed)
        late = composites.derived_findings(passed, derived.select("rule_id", "ref_id", "crit", "count_min"))
        gates = F.broadcast(derived.drop("ref_id", "crit", "count_min").withColumn("count_min", F.lit(None).cast("bigint")))
        ok = late.join(gates, "rule_id").join(files.hint("shuffle_hash"), "file_id").where(_gated())
        passed = passed.unionByName(ok.select("file_id", "rule_id", "crit", "conf", "hits", F.lit(None).cast("string").alias("sample")))
    return passed, hits


def catalog_report(
    files: DataFrame, facts: DataFrame, rules: DataFrame, conds: DataFrame, composite_rules: DataFrame, composite_conds: DataFrame,
    sections: DataFrame | None = None, platforms: tuple[str, ...] = ("all",), evidence: DataFrame | None = None, with_refs: bool = False,
) -> DataFrame:
    """All findings (file_id, rule_id, crit, conf) of a catalog: atomic rules, then composites.

    Conditions of composites may stand inline in every clause; they hold where they have a
    hit. `evidence` (file_id, rule_id, line_no, offset) is for rules with proximity.
    """
    inline = C.named(composite_conds)
    atomic, hits = catalog_findings(files, facts, rules, conds, sections, platforms, inline, sampled=False)
    atomic = cut_lineage(atomic)
    keep = ["file_id", "rule_id", "crit", "conf"]
    held = hits.select("file_id", F.col("cond_id").alias("rule_id")).join(F.broadcast(inline.select(F.col("ref_id").alias("rule_id")).distinct()), "rule_id", "left_semi")
    seen = atomic.select("file_id", "rule_id").unionByName(held.select("file_id", "rule_id"))
    none = F.lit(None).cast("bigint")
    places = evidence if evidence is not None else seen.withColumns({"line_no": none, "offset": none})
    combined = composites.evaluate_composites(files.select("file_id", "file_type", "size_bytes"), seen, places, composite_rules, inline, with_refs, platforms=platforms)
    if with_refs:
        atomic, keep = atomic.withColumn("trait_refs", F.array().cast("array<string>")), [*keep, "trait_refs"]
    return atomic.select(keep).unionByName(combined.select(keep))
