"""Rule catalog preparation: defaults, type and platform expansion, ids, short forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids

CONCRETE_TYPES = tuple(sorted(K.TYPE_ALIASES))


def _default_text(raw: Column, default: Column) -> Column:
    """The rule's value, else the file's; the word none unsets it."""
    chosen = F.coalesce(raw, default)
    return F.when(F.lower(chosen) != "none", chosen)


def with_rule_defaults(rules: DataFrame, defaults: DataFrame, atomic: bool) -> DataFrame:
    """Fill what a rule leaves open from its source file's defaults.

    `defaults` holds one row per source file. Atomic rules cannot be hostile.
    """
    d = defaults.select("source_file", *[F.col(c).alias(f"d_{c}") for c in defaults.columns if c != "source_file"])
    crit = F.coalesce(
        F.when(F.lower("crit") == "none", K.INERT),
        F.when(F.col("crit").isNotNull(), F.coalesce(ids.parse_crit(F.col("crit")), F.lit(K.INERT))),
        ids.parse_crit(F.col("d_crit")),
        F.lit(K.INERT),
    )
    if atomic:
        crit = F.least(crit, F.lit(K.SUSPICIOUS))
    return rules.join(d, "source_file", "left").select(
        "rule_id",
        "source_file",
        crit.alias("crit"),
        F.coalesce("conf", "d_conf", F.lit(1.0)).alias("conf"),
        _default_text(F.col("mbc"), F.col("d_mbc")).alias("mbc"),
        _default_text(F.col("attack"), F.col("d_attack")).alias("attack"),
        F.coalesce(_default_text(F.col("for_types"), F.col("d_for_types")), F.lit("all")).alias("for_types"),
        F.coalesce(_default_text(F.col("platforms"), F.col("d_platforms")), F.lit("all")).alias("platforms"),
    )


def _type_lookup() -> Column:
    """A fixed map of every accepted name to the types it stands for."""
    names: dict[str, tuple[str, ...]] = dict(K.TYPE_GROUPS)
    for kind, aliases in K.TYPE_ALIASES.items():
        names.update({alias: (kind,) for alias in aliases})
    pairs = [F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in names.items() for x in kv]
    return F.create_map(*pairs)


def expand_file_types(spec: Column) -> Column:
    """Sorted types of a comma list with groups, aliases and -x or !x exclusions.

    The map is a constant, so the expansion runs in the row and needs no join.
    """
    lookup = _type_lookup()
    none = F.array().cast("array<string>")
    concrete = F.array(*map(F.lit, CONCRETE_TYPES))
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.lower(F.trim(p))), lambda p: p != "")
    out = F.filter(parts, lambda p: p.rlike("^[!-]"))
    kept = F.filter(parts, lambda p: ~p.rlike("^[!-]"))
    bare = F.transform(out, lambda p: F.substr(p, F.lit(2)))

    def resolve(names: Column) -> Column:
        return F.array_distinct(
            F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(lookup, n), none)))
        )

    everything = F.exists(kept, lambda n: n.isin("all", "*"))
    included = resolve(kept)
    excluded = F.when(F.exists(bare, lambda n: n.isin("all", "*")), concrete).otherwise(resolve(bare))
    base = F.when(everything | ((F.size(included) == 0) & (F.size(excluded) > 0)), concrete).otherwise(included)
    return F.when(everything & (F.size(excluded) == 0), F.array(F.lit("all"))).otherwise(
        F.array_sort(F.array_except(base, excluded))
    )


def expand_platforms(spec: Column) -> Column:
    named = F.transform(F.split(spec, ","), lambda p: F.lower(F.trim(p)))
    return F.filter(named, lambda p: p.isin(*K.PLATFORMS))


def prefixed_id(directory: Column, name: Column) -> Column:
    """A bare name gets its directory; ids and directories are kept."""
    bare = ~name.contains("::") & ~name.contains("/")
    return F.when(bare, F.concat(directory, F.lit("::"), name)).otherwise(name)


def from_short_form(simple: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbol-to-capability rows as one-condition composites with their conditions."""
    rules = simple.select(
        F.col("capability").alias("rule_id"),
        F.lit("composite").alias("kind"),
        F.lit(K.INERT).alias("crit"),
        F.coalesce("conf", F.lit(1.0)).alias("conf"),
        expand_file_types(F.coalesce("for_types", F.lit("all"))).alias("for_types"),
        expand_platforms(F.coalesce("platforms", F.lit("all"))).alias("platforms"),
    )
    conds = simple.select(
        F.col("capability").alias("rule_id"),
        F.lit("all").alias("clause"),
        F.lit(0).alias("idx"),
        F.lit("symbol").alias("ctype"),
        F.col("symbol").alias("exact"),
    )
    return rules, conds


def literal_regex_to_substr(conds: DataFrame) -> DataFrame:
    """A regex without metacharacters becomes a substring matcher."""
    literal = (
        F.col("ctype").isin("string", "raw", "symbol", "basename")
        & F.col("substr").isNull()
        & (F.col("regex") != "")
        & ~F.col("regex").rlike(K.REGEX_META_RE)
    )
    literal = F.coalesce(literal, F.lit(False))
    return conds.withColumns(
        {
            "substr": F.when(literal, F.col("regex")).otherwise(F.col("substr")),
            "regex": F.when(~literal, F.col("regex")),
        }
    )
