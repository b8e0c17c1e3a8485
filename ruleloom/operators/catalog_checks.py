"""Quality checks over a rule catalog.

Checks that compare rules group or equi-join on what two rules must share; where a group
can be large they report the group's first rule and size, never its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids, text as T
from ruleloom.operators import matching
from ruleloom.session import local_table

SEARCHED = ("string", "raw", "symbol", "encoded")
MATCHERS = ("exact", "substr", "regex", "word")


def patterns(rules: DataFrame) -> DataFrame:
    """One row per matcher of a rule: (…, how, pattern)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("how"), F.col(m).alias("pattern")) for m in MATCHERS])
    found = F.filter(pairs, lambda p: p["pattern"].isNotNull())
    return rules.select("rule_id", "crit", "ctype", "for_types", "case_insensitive", F.inline(found))


def alternatives(rules: DataFrame) -> DataFrame:
    """Alternatives of regexes that have a choice."""
    choice = patterns(rules).filter((F.col("how") == "regex") & F.col("pattern").contains("|"))
    return choice.select("rule_id", "crit", "for_types", F.explode(F.array_distinct(F.split("pattern", r"\|"))).alias("alt"))


def types_overlap(a: Column, b: Column) -> Column:
    return F.array_contains(a, "all") | F.array_contains(b, "all") | F.arrays_overlap(a, b)


def _union_types() -> Column:
    return F.array_distinct(F.flatten(F.collect_set("for_types")))


def groups(df: DataFrame, keys: list[str | Column], detail: str) -> DataFrame:
    """Groups of two or more rules, as their first rule, their last and their number."""
    return (
        df.groupBy(*keys)
        .agg(F.min("rule_id").alias("rule_id"), F.max("rule_id").alias("other_id"), F.count_distinct("rule_id").alias("n"))
        .filter(F.col("n") > 1)
        .select("rule_id", "other_id", "n", F.lit(detail).alias("detail"))
    )


# -- duplicates ------------------------------------------------------------------------------

IDENTITY = ("ctype", "exact", "substr", "regex", "word", "case_insensitive", "ref_id", "metric_field",
            "size_min", "size_max", "count_min", "count_max", "platforms", "n_not", "n_unless")


def identical_rules(rules: DataFrame) -> DataFrame:
    key = F.sha2(F.to_json(F.struct(*IDENTITY, F.array_sort("for_types").alias("for_types")), {"ignoreNullFields": "false"}), 256)
    return groups(rules, [key], "identical")


def for_only_duplicates(rules: DataFrame) -> DataFrame:
    """Rules that differ in their file types only."""
    key = F.sha2(F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"}), 256)
    varied = rules.withColumn("_key", key)
    several = varied.groupBy("_key").agg(F.count_distinct(F.array_sort("for_types")).alias("_t")).filter(F.col("_t") > 1)
    return groups(varied.join(several, "_key"), ["_key"], "for only")


def normalized(pattern: Column) -> Column:
    """A pattern without anchors and word edges, in lower case."""
    return F.lower(F.regexp_replace(pattern, r"^(\^|\\b)|(\$|\\b)$", ""))


def same_pattern(rules: DataFrame) -> DataFrame:
    """Equal normalised patterns whose rules share a file type."""
    p = patterns(rules).withColumn("norm", normalized(F.col("pattern")))
    typed = p.select("norm", "rule_id", F.explode("for_types").alias("t")).distinct()
    per_type = typed.groupBy("norm", "t").agg(F.count("*").alias("c"))
    shared = per_type.groupBy("norm").agg(F.max("c").alias("c"), F.bool_or(F.col("t") == "all").alias("everywhere"))
    grouped = p.groupBy("norm").agg(F.min("rule_id").alias("rule_id"), F.count_distinct("rule_id").alias("n"))
    return grouped.join(shared, "norm").filter((F.col("n") > 1) & ((F.col("c") > 1) | F.col("everywhere"))).select("norm", "rule_id", "n")


def _literal_index(rules: DataFrame) -> DataFrame:
    """Each literal once: the first rule that holds it and all types it applies to."""
    literals = patterns(rules).filter(F.col("how") != "regex")
    return literals.groupBy("pattern").agg(F.min("rule_id").alias("other_id"), _union_types().alias("other_types"))


def alternative_is_literal(rules: DataFrame) -> DataFrame:
    joined = alternatives(rules).join(_literal_index(rules), F.col("alt") == F.col("pattern"))
    return joined.filter(types_overlap(F.col("for_types"), F.col("other_types"))).select("rule_id", "alt", "other_id")


def shared_alternatives(rules: DataFrame) -> DataFrame:
    shared = alternatives(rules).groupBy("alt").agg(F.min("rule_id").alias("rule_id"), F.count_distinct("rule_id").alias("n"))
    return shared.filter(F.col("n") > 1)


def regex_should_be_exact(rules: DataFrame) -> DataFrame:
    return patterns(rules).filter((F.col("how") == "regex") & F.col("pattern").rlike(r"^\^[A-Za-z0-9_-]+\$$")).select("rule_id", "pattern")


def same_pattern_other_kind(rules: DataFrame) -> DataFrame:
    kinds = patterns(rules).groupBy("pattern").agg(F.min("rule_id").alias("rule_id"), F.count_distinct("ctype").alias("n"))
    return kinds.filter(F.col("n") > 1)


def exact_covered_by_substr(rules: DataFrame) -> DataFrame:
    p = patterns(rules)
    wide = p.filter(F.col("how") == "substr").groupBy("pattern", "ctype").agg(F.min("rule_id").alias("other_id"))
    return p.filter(F.col("how") == "exact").join(wide, ["pattern", "ctype"]).filter(F.col("rule_id") != F.col("other_id")).select("rule_id", "pattern", "other_id")


def covered_ignoring_case(rules: DataFrame) -> DataFrame:
    """Case-sensitive literals that a case-insensitive one of the same kind covers."""
    p = patterns(rules).filter(F.col("how") != "regex").withColumn("low", F.lower("pattern"))
    loose = p.filter("case_insensitive").groupBy("low", "how", "ctype").agg(F.min("rule_id").alias("other_id"))
    return p.filter("NOT case_insensitive").join(loose, ["low", "how", "ctype"]).select("rule_id", "pattern", "other_id")


def regex_contains_literal(rules: DataFrame, min_length: int = 5) -> DataFrame:
    """Regexes whose text holds a literal of another rule, found by shared grams."""
    p = patterns(rules)
    regexes = p.filter(F.col("how") == "regex").select(F.col("rule_id").alias("regex_rule"), F.col("pattern").alias("regex"))
    literals = p.filter((F.col("how") != "regex") & (F.char_length("pattern") >= min_length))
    index = literals.groupBy("pattern").agg(F.min("rule_id").alias("rule_id"))
    hits = matching.literal_hits(regexes, index, ["regex_rule"], "regex")
    return hits.select(F.col("regex_rule").alias("rule_id"), "pattern", F.col("rule_id").alias("other_id"))


def alternative_subsets(rules: DataFrame) -> DataFrame:
    """Regexes whose alternatives are all among another's, with the first such other.

    Candidates share the alternative fewest regexes have.
    """
    sets = alternatives(rules).groupBy("rule_id").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    rows = sets.select("rule_id", "alts", F.explode("alts").alias("alt"))
    counted = rows.join(rows.groupBy("alt").agg(F.count("*").alias("_n")), "alt")
    anchor = counted.groupBy("rule_id", "alts").agg(F.min_by("alt", F.struct("_n", "alt")).alias("alt"))
    wider = rows.select(F.col("rule_id").alias("other_id"), F.col("alts").alias("other"), "alt")
    # Equal sets are one candidate, so a popular set does not multiply.
    wider = wider.groupBy("alt", "other").agg(F.min("other_id").alias("other_id"))
    within = (F.size("alts") < F.size("other")) & (F.size(F.array_except("alts", "other")) == 0)
    return anchor.join(wider, "alt").filter(within).groupBy("rule_id").agg(F.min("other_id").alias("other_id"))


def literal_classes(same: DataFrame) -> DataFrame:
    """(crit, pattern, other_id, _class, n): literals matched by the same patterns are one class of n.

    `same` holds (pattern, crit, value, other_id) where a pattern matches a value. A class has
    a row for each of its patterns, with the least other rule of that criticality.
    """
    met = F.array_sort(F.collect_set(F.struct("crit", "pattern")))
    each = same.groupBy("value").agg(met.alias("_met"), F.collect_set(F.struct("crit", "other_id")).alias("_ids"))
    each = each.select("_met", "_ids", F.sha2(F.to_json("_met"), 256).alias("_class"))
    sized = each.groupBy("_class").agg(F.first("_met").alias("_met"), F.count("*").alias("n"))
    least = each.select("_class", F.inline("_ids")).groupBy("_class", "crit").agg(F.min("other_id").alias("other_id"))
    return sized.select("_class", "n", F.inline("_met")).join(least, ["_class", "crit"]).select("crit", "pattern", "other_id", "_class", "n")


def regex_matches_literal(rules: DataFrame) -> DataFrame:
    """Regexes that match a literal of the same criticality; one other rule each.

    A choice is tested one alternative at a time, so each has its own literal head.
    """
    p = patterns(rules)
    literals = p.filter(F.col("how").isin("exact", "substr")).groupBy("pattern", "crit").agg(F.min("rule_id").alias("other_id"))
    values = literals.select(F.col("pattern").alias("value"), F.col("crit").alias("other_crit"), "other_id")
    regexes = p.filter(F.col("how") == "regex").select("rule_id", "crit", F.explode(F.split("pattern", r"\|")).alias("pattern"))
    hits = matching.regex_hits(values, regexes.select("pattern", "crit").distinct(), ["value", "other_crit"])
    same = hits.filter(F.col("crit") == F.col("other_crit")).select("pattern", "crit", "value", "other_id")
    # Regexes with the same alternatives and literals that the same alternatives match meet once.
    alternatives_of = F.array_sort(F.collect_set(F.struct("crit", "pattern")))
    sets = regexes.groupBy("rule_id").agg(alternatives_of.alias("_alts")).select("rule_id", "_alts", F.sha2(F.to_json("_alts"), 256).alias("_set"))
    members = sets.select("_set", "_alts").dropDuplicates(["_set"]).select("_set", F.inline("_alts"))
    met = members.join(literal_classes(same), ["crit", "pattern"]).groupBy("_set", "_class").agg(F.min("other_id").alias("other_id"), F.max("n").alias("n"))
    return sets.join(met.groupBy("_set").agg(F.min("other_id").alias("other_id"), F.sum("n").alias("n")), "_set").select("rule_id", "other_id", "n")


def string_and_raw(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter(F.col("ctype").isin("string", "raw"))
    both = p.groupBy("pattern", "how", "crit").agg(F.min("rule_id").alias("rule_id"), F.count_distinct("ctype").alias("n"))
    return both.filter(F.col("n") == 2).select("pattern", "how", "crit", "rule_id")


def case_merge_candidates(rules: DataFrame) -> DataFrame:
    """Patterns that differ only in the case of their first letter."""
    p = patterns(rules).filter((F.col("how") != "regex") & (F.char_length("pattern") > 1))
    folded = F.concat(F.lower(F.substr("pattern", F.lit(1), F.lit(1))), F.substr("pattern", F.lit(2)))
    merged = p.groupBy("ctype", "how", folded.alias("folded")).agg(F.min("rule_id").alias("rule_id"), F.count_distinct("pattern").alias("n"))
    return merged.filter(F.col("n") > 1)


def basename_duplicates(rules: DataFrame) -> DataFrame:
    return groups(patterns(rules).filter(F.col("ctype") == "basename"), ["pattern", "how"], "basename")


# -- composites ----------------------------------------------------------------------------------


def inline_conditions(conds: DataFrame) -> DataFrame:
    return conds.filter(F.col("clause").isin("all", "any", "none") & F.col("ref_id").isNull()).select("rule_id", "clause", "ctype")


def _ref_directory() -> Column:
    return F.when(F.col("ref_id").contains("::"), F.substring_index("ref_id", "::", 1))


def redundant_any_refs(conds: DataFrame, at_least: int = 4) -> DataFrame:
    """Rules whose `any` names many rules of one other directory."""
    refs = conds.filter(F.col("clause") == "any").withColumn("dir", _ref_directory())
    outside = refs.filter(
        F.col("dir").isNotNull() & (F.col("dir") != ids.rule_directory(F.col("rule_id"))) & ~F.col("dir").startswith("metadata/")
    )
    return outside.groupBy("rule_id", "dir").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def clause_counts(conds: DataFrame) -> DataFrame:
    names = ("all", "any", "none", "unless")
    return conds.groupBy("rule_id").agg(*[F.count_if(F.col("clause") == c).alias(f"n_{c}") for c in names])


def single_item_clauses(rules: DataFrame, conds: DataFrame) -> DataFrame:
    counts = clause_counts(conds).filter((F.col("n_none") == 0) & (F.col("n_unless") == 0) & (F.col("n_any") + F.col("n_all") == 1))
    plain = rules.filter(~F.col("has_downgrade")).select("rule_id")
    only = conds.filter(F.col("clause").isin("all", "any") & F.col("ref_id").contains("::"))
    return only.join(counts, "rule_id", "left_semi").join(plain, "rule_id", "left_semi").select("rule_id", "clause", "ref_id")


def overlapping_conditions(conds: DataFrame) -> DataFrame:
    """A directory next to a rule of that directory in one clause."""
    mine = conds.filter(F.col("clause").isin("all", "any") & F.col("ref_id").isNotNull())
    dirs = mine.filter(~F.col("ref_id").contains("::")).select("rule_id", "clause", F.col("ref_id").alias("dir")).distinct()
    return mine.withColumn("dir", _ref_directory()).join(dirs, ["rule_id", "clause", "dir"]).select("rule_id", "clause", "dir", "ref_id")


def impossible_needs(rules: DataFrame, conds: DataFrame) -> DataFrame:
    sized = rules.join(clause_counts(conds), "rule_id").filter(F.col("n_any") > 0)
    return sized.filter(F.col("needs") > F.col("n_any")).select("rule_id", "needs", "n_any")


def impossible_sizes(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("size_min") > F.col("size_max")).select("rule_id", "size_min", "size_max")


def impossible_counts(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("count_min") > F.col("count_max")).select("rule_id", "count_min", "count_max")


def empty_clauses(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """Rules whose only clause is given but empty."""
    filled = conds.filter(F.col("clause").isin("all", "any", "none")).select("rule_id").distinct()
    return rules.filter(F.col("empty_clause").isNotNull()).join(filled, "rule_id", "left_anti").select("rule_id", "empty_clause")


def missing_patterns(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("ctype").isin(*SEARCHED) & F.coalesce(*MATCHERS).isNull()).select("rule_id", "ctype")


def _unmodified() -> Column:
    filters = [F.col(c).isNull() for c in ("count_min", "count_max", "size_min", "size_max")]
    plain = filters[0]
    for f in filters[1:]:
        plain = plain & f
    return plain & (F.coalesce("n_not", F.lit(0)) == 0) & (F.coalesce("n_unless", F.lit(0)) == 0) & ~F.col("has_downgrade")


def pure_aliases(rules: DataFrame) -> DataFrame:
    """Rules that stand for another of the same criticality and add nothing."""
    target = rules.select(F.col("rule_id").alias("ref_id"), F.col("crit").alias("_crit"))
    alias = rules.filter((F.col("ctype") == "trait") & (F.col("ref_id") != F.col("rule_id")) & _unmodified())
    return alias.join(target, "ref_id").filter(F.col("crit") == F.col("_crit")).select("rule_id", "ref_id")


def redundant_needs_one(rules: DataFrame, conds: DataFrame) -> DataFrame:
    only_any = clause_counts(conds).filter((F.col("n_any") > 0) & (F.col("n_all") == 0) & (F.col("n_none") == 0))
    return rules.filter(F.col("needs") == 1).join(only_any, "rule_id", "left_semi").select("rule_id")


def short_patterns_unnarrowed(rules: DataFrame) -> DataFrame:
    """Raw patterns of up to three characters that no count or file type narrows."""
    counted = (F.col("count_min") >= 2) | F.col("count_max").isNotNull()
    wide = F.array_contains("for_types", "all") | (F.size("for_types") > 3)
    short = F.octet_length("substr") <= 3
    return rules.filter((F.col("ctype") == "raw") & ~F.coalesce(counted, F.lit(False)) & wide & short).select("rule_id", "substr")


# -- taxonomy --------------------------------------------------------------------------------------


def hostile_capabilities(rules: DataFrame) -> DataFrame:
    return rules.filter((ids.rule_tier(F.col("rule_id")) == "micro-behaviors") & (F.col("crit") == K.HOSTILE)).select("rule_id")


def inert_objectives(rules: DataFrame) -> DataFrame:
    return rules.filter((ids.rule_tier(F.col("rule_id")) == "objectives") & (F.col("crit") == K.INERT)).select("rule_id")


def capability_to_objective(conds: DataFrame) -> DataFrame:
    up = (ids.rule_tier(F.col("rule_id")) == "micro-behaviors") & (ids.rule_tier(F.col("ref_id")) == "objectives")
    return conds.filter((F.col("clause") != "unless") & up).select("rule_id", "ref_id")


def misplaced_malware(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("rule_id").rlike("^(objectives|micro-behaviors)/malware/")).select("rule_id")


def directories(rules: DataFrame) -> DataFrame:
    return rules.select(F.substring_index("rule_id", "::", 1).alias("dir")).distinct()


def _first_segment_in(dirs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    listed = F.array(*map(F.lit, names))
    found = F.filter(F.split("dir", "/"), lambda s: F.array_contains(listed, F.lower(s)))
    return dirs.filter(F.size(found) > 0).select("dir", F.get(found, 0).alias("segment"))


def platform_directories(dirs: DataFrame) -> DataFrame:
    skipped = F.col("dir").startswith("metadata/format/") | F.col("dir").contains("/interpreter/")
    return _first_segment_in(dirs.filter(~skipped), K.PLATFORM_DIRECTORY_NAMES)


def banned_segments(dirs: DataFrame) -> DataFrame:
    return _first_segment_in(dirs, K.BANNED_SEGMENTS)


def shared_second_level(dirs: DataFrame) -> DataFrame:
    parts = F.split("dir", "/")
    named = dirs.filter(F.get(parts, 0).isin(*K.SECOND_LEVEL_NAMESPACES) & (F.size(parts) >= 2))
    grouped = named.groupBy(F.get(parts, 1).alias("second")).agg(F.array_sort(F.collect_set(F.get(parts, 0))).alias("namespaces"))
    return grouped.filter(F.size("namespaces") > 1).select("second", F.array_join("namespaces", ",").alias("namespaces"))


def wrong_depth(dirs: DataFrame) -> DataFrame:
    """Directories of the two main tiers with other than three or four levels below."""
    n = F.size(F.split("dir", "/")) - 1
    main = dirs.filter(F.col("dir").rlike("^(micro-behaviors|objectives)/"))
    verdict = F.when((n < 3) & ~F.col("dir").startswith("micro-behaviors/dylib/"), "shallow").when(n > 4, "deep")
    return main.select("dir", n.alias("depth"), verdict.alias("verdict")).filter(F.col("verdict").isNotNull())


def invalid_ids(rules: DataFrame) -> DataFrame:
    bad = F.regexp_extract(ids.local_name(F.col("rule_id")), "[^A-Za-z0-9_-]", 0)
    return rules.select("rule_id", bad.alias("character")).filter(F.col("character") != "")


def repeated_segments(dirs: DataFrame) -> DataFrame:
    """Directories where a segment repeats its parent, with the first such segment."""
    low = F.split(F.lower("dir"), "/")
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(low) - 2, F.lit(0))),
        lambda i: F.struct(F.get(low, i).alias("p"), F.get(low, i + 1).alias("c"), F.get(F.split("dir", "/"), i + 1).alias("s")),
    )

    def repeats(x: Column) -> Column:
        p, c = x["p"], x["c"]
        stem = lambda w: F.regexp_replace(w, "s+$", "")
        long = (F.char_length(p) >= 3) & (F.char_length(c) >= 3)
        return (p == c) | (long & ((stem(p) == stem(c)) | p.startswith(c) | c.startswith(p)))

    found = F.filter(pairs, lambda x: x["c"].isNotNull() & repeats(x))
    excepted = T.starts_with_any(F.col("dir"), K.PARENT_REPEAT_EXCEPTIONS)
    return dirs.filter((F.size(found) > 0) & ~excepted).select("dir", F.get(found, 0)["s"].alias("segment"))


def oversized_directories(rules: DataFrame, limit: int = K.MAX_RULES_PER_DIRECTORY) -> DataFrame:
    sizes = rules.groupBy(ids.rule_directory(F.col("rule_id")).alias("dir")).agg(F.count("*").alias("n"))
    return sizes.filter(F.col("n") > limit)


# -- references and fields -----------------------------------------------------------------------------


def dangling_references(conds: DataFrame, known: DataFrame) -> DataFrame:
    """References that stand for no rule."""
    refs = conds.filter(F.col("ref_id").isNotNull()).select("ref_id").distinct()
    resolved = matching.resolve_references(refs, known).select("ref_id").distinct()
    missing = refs.join(resolved, "ref_id", "left_anti")
    return conds.join(missing, "ref_id", "left_semi").groupBy("ref_id").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("n"))


def unknown_metrics(rules: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """Metric fields that do not exist, with the nearest one within three edits."""
    names = local_table(rules.sparkSession, [(v,) for v in valid], "valid string")
    used = rules.filter(F.col("metric_field").isNotNull()).groupBy("metric_field").agg(F.min("rule_id").alias("rule_id"))
    unknown = used.join(F.broadcast(names), F.col("metric_field") == F.col("valid"), "left_anti")
    nearest = F.filter(
        F.array(*[F.struct(F.levenshtein("metric_field", F.lit(v)).alias("d"), F.lit(v).alias("v")) for v in valid]),
        lambda x: x["d"] <= 3,
    )
    return unknown.select("metric_field", "rule_id", F.array_min(nearest)["v"].alias("suggestion"))


def conf_out_of_range(rules: DataFrame) -> DataFrame:
    return rules.filter(~F.col("conf").between(0.0, 1.0)).select("rule_id", "conf")


def poor_descriptions(rules: DataFrame) -> DataFrame:
    n = F.char_length(F.trim(F.coalesce("descr", F.lit(""))))
    return rules.filter(n < 5).select("rule_id", F.when(n == 0, "empty").otherwise("short").alias("detail"))


def unusable_criticality(rules: DataFrame) -> DataFrame:
    return rules.filter(F.lower("raw_crit") == "filtered").select("rule_id", "raw_crit")


def empty_exception_lists(rules: DataFrame) -> DataFrame:
    lists = F.array(F.when(F.col("n_not") == 0, "not"), F.when(F.col("n_unless") == 0, "unless"))
    return rules.select("rule_id", F.explode(F.array_compact(lists)).alias("list"))


def several_matchers(rules: DataFrame) -> DataFrame:
    given = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in MATCHERS]))
    return rules.filter(F.size(given) > 1).select("rule_id", F.array_join(given, ",").alias("matchers"))


def case_flag_without_letters(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter((F.col("ctype") == "string") & (F.col("how") != "regex") & F.col("case_insensitive"))
    return p.filter(~F.col("pattern").rlike(r"\p{L}")).select("rule_id", "pattern")


def short_ignoring_case(rules: DataFrame) -> DataFrame:
    """Short alphabetic patterns that ignore case: three letters, or four on many types."""
    p = patterns(rules).filter(F.col("ctype").isin("string", "raw") & (F.col("how") != "regex") & F.col("case_insensitive"))
    n = F.octet_length("pattern")
    return p.filter(F.col("pattern").rlike(r"^\p{L}+$") & ((n <= 3) | ((n == 4) & (F.size("for_types") > 2)))).select("rule_id", "pattern")


def empty_patterns(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter(F.col("ctype").isin("string", "raw", "symbol"))
    return p.filter(F.trim("pattern") == "").select("rule_id", "how")


def overly_short_patterns(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter(F.col("ctype").isin("string", "symbol") & ((F.col("ctype") == "symbol") | ~F.col("case_insensitive")))
    floor = F.when(F.col("how") == "exact", 2).when(F.col("how") == "substr", 3).when(F.col("how") == "word", 2)
    return p.filter(F.octet_length("pattern") < floor).select("rule_id", "how", "pattern")


def literal_regexes(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter(F.col("ctype").isin("string", "raw", "symbol") & (F.col("how") == "regex"))
    return p.filter(~F.col("pattern").rlike(K.REGEX_META_RE)).select("rule_id", "pattern")


def word_edge_regexes(rules: DataFrame) -> DataFrame:
    p = patterns(rules).filter(F.col("ctype").isin("string", "raw") & (F.col("how") == "regex"))
    return p.filter(F.col("pattern").rlike(r"^\\b[\p{L}0-9_-]+\\b$")).select("rule_id", "pattern")


def internal_references(conds: DataFrame) -> DataFrame:
    mine = conds.filter(F.col("clause").isin("all", "any", "none"))
    return mine.filter(F.col("ref_id").startswith("metadata/internal/")).select("rule_id", "ref_id")


def idle_composites(rules: DataFrame, conds: DataFrame, atomic: DataFrame) -> DataFrame:
    """Composites of one reference with the criticality and file types of their target."""
    single = single_item_clauses(rules, conds)
    own = rules.select("rule_id", "crit", F.array_sort("for_types").alias("t"))
    target = atomic.select(F.col("rule_id").alias("ref_id"), F.col("crit").alias("_crit"), F.array_sort("for_types").alias("_t"))
    same = single.join(own, "rule_id").join(target, "ref_id").filter((F.col("crit") == F.col("_crit")) & (F.col("t") == F.col("_t")))
    return same.select("rule_id", "ref_id")
