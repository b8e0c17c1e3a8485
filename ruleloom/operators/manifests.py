"""Package and extension manifests: checks over a table of JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import net, text as T
from ruleloom.operators.extract import SCRIPT_FACTS
from ruleloom.operators.joins import permission_risks, typosquats

DEPENDENCY_MAPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def _field(path: str) -> Column:
    return F.get_json_object("json", "$." + path)


def _map_entries(path: str) -> Column:
    return F.map_entries(F.from_json(_field(path), "map<string,string>"))


def scripts(manifests: DataFrame) -> DataFrame:
    """(file_id, hook, script) rows."""
    rows = manifests.select("file_id", F.explode(_map_entries("scripts")).alias("e"))
    return rows.select("file_id", F.col("e.key").alias("hook"), F.col("e.value").alias("script"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """(file_id, name, version) rows of all four dependency maps."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(*[F.coalesce(_map_entries(m), none) for m in DEPENDENCY_MAPS])
    rows = manifests.select("file_id", F.explode(entries).alias("e"))
    return rows.select("file_id", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def script_strings(script_rows: DataFrame) -> DataFrame:
    """Addresses and paths named in scripts, as typed strings."""
    parts = []
    for kind, hits in SCRIPT_FACTS.items():
        parts.append(F.transform(hits(F.col("script")), _typed(kind)))
    rows = script_rows.select("file_id", F.concat(F.lit("scripts."), "hook").alias("section"), F.explode(F.concat(*parts)).alias("s"))
    return rows.select("file_id", "section", "s.value", "s.string_type")


def _typed(kind: str):
    def typed(value: Column) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("string_type"))

    return typed


def script_findings(script_rows: DataFrame) -> DataFrame:
    """(file_id, hook, rule_id, crit, conf) for what scripts do."""
    s = F.col("script")

    def hit(test: Column, rule_id: str, crit: int, conf: float) -> Column:
        return F.when(test, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(crit).alias("crit"), F.lit(conf).alias("conf")))

    checks = [hit(T.contains_any(s, parts), rule, crit, conf) for rule, parts, crit, conf in K.SCRIPT_CHECKS]
    checks.append(hit(s.contains("curl") & s.contains("@/"), "exfiltration/file-upload", K.HOSTILE, 0.95))
    dropper = T.contains_any(s, K.DOWNLOADERS) & s.contains("&&") & T.contains_any(s, K.INTERPRETER_PARTS)
    checks.append(hit(dropper, "command-and-control/dropper/download-execute", K.HOSTILE, 0.95))
    odd_host = F.exists(F.regexp_extract_all(s, F.lit(K.SCRIPT_URL_RE), F.lit(0)), net.is_suspicious_domain)
    checks.append(hit(odd_host, "command-and-control/suspicious-domain", K.SUSPICIOUS, 0.8))
    rows = script_rows.select("file_id", "hook", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return rows.select("file_id", "hook", "f.rule_id", "f.crit", "f.conf")


def is_odd_name(name: Column) -> Column:
    """Names made to look like known packages, or long runs of letters with many digits."""
    lookalike = T.contains_any(name, K.ODD_NAME_PARTS) & ~name.isin(*K.LEGITIMATE_NAMES)
    random = (T.count_regex(name, "[0-9]") > 3) & (F.octet_length(name) > 10) & ~name.rlike("[A-Z]")
    return lookalike | random


def _findings(df: DataFrame, checks: list[tuple[Column, str | Column, int | Column]]) -> DataFrame:
    """(file_id, rule_id, crit) for each check that holds."""
    made = [
        F.when(
            test,
            F.struct(
                (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"),
                (F.lit(crit) if isinstance(crit, int) else crit).alias("crit"),
            ),
        )
        for test, rule, crit in checks
    ]
    return df.select("file_id", F.explode(F.array_compact(F.array(*made))).alias("f")).select("file_id", "f.*")


def metadata_findings(manifests: DataFrame) -> DataFrame:
    """Missing author, odd name, and a first version that runs at install."""
    author, named = _field("author"), F.coalesce(_field("author.name"), F.lit(""))
    plain = F.when(author.startswith("{"), named).otherwise(author)
    hooks = F.coalesce(F.map_keys(F.from_json(_field("scripts"), "map<string,string>")), F.array().cast("array<string>"))
    new_hooks = F.arrays_overlap(hooks, F.array(*map(F.lit, K.NEW_PACKAGE_HOOKS)))
    return _findings(
        manifests,
        [
            (author.isNull() | (F.trim(plain) == ""), "supply-chain/missing-author", K.NOTABLE),
            (is_odd_name(_field("name")), "supply-chain/suspicious-name", K.SUSPICIOUS),
            ((_field("version") == "1.0.0") & new_hooks, "supply-chain/new-package-with-hooks", K.NOTABLE),
        ],
    )


def dependency_findings(deps: DataFrame) -> DataFrame:
    """(file_id, name, rule_id, crit) for odd dependencies."""
    v = F.col("version")
    git = v.startswith("git://") | v.startswith("git+") | v.contains("github.com")
    checks = [
        (git, "supply-chain/git-dependency", K.NOTABLE),
        (v.startswith("file:"), "supply-chain/local-dependency", K.NOTABLE),
        (is_odd_name(F.col("name")), "supply-chain/suspicious-package", K.SUSPICIOUS),
    ]
    keyed = deps.withColumn("file_id", F.struct("file_id", "name"))
    plain = _findings(keyed, checks).select("file_id.file_id", "file_id.name", "rule_id", "crit")
    squats = typosquats(deps).select(
        "file_id", "name", F.lit("supply-chain/typosquat").alias("rule_id"), F.lit(K.SUSPICIOUS).alias("crit")
    )
    return plain.unionByName(squats)


def install_hooks(script_rows: DataFrame) -> DataFrame:
    """Hooks that run at install; long or networked ones are suspicious."""
    s = F.col("script")
    heavy = (F.octet_length(s) > 50) | T.contains_any(s, ("node ", "curl", "wget", "http"))
    return script_rows.filter(F.col("hook").isin(*K.INSTALL_HOOKS)).select(
        "file_id",
        F.concat(F.lit("supply-chain/install-hook/"), "hook").alias("rule_id"),
        F.when(heavy, K.SUSPICIOUS).otherwise(K.NOTABLE).alias("crit"),
    )


# -- browser extensions ----------------------------------------------------------------------

PREFIX = "supply-chain/chrome-ext/"


def _strings(path: str) -> Column:
    return F.coalesce(F.from_json(_field(path), "array<string>"), F.array().cast("array<string>"))


SCRIPT_SCHEMA = "array<struct<matches:array<string>,all_frames:boolean,run_at:string>>"


def _content_scripts() -> Column:
    return F.coalesce(F.from_json(_field("content_scripts"), SCRIPT_SCHEMA), F.array().cast(SCRIPT_SCHEMA))


def manifest_version(manifests: DataFrame) -> DataFrame:
    v = _field("manifest_version")
    return _findings(
        manifests, [(v == "2", PREFIX + "manifest-v2", K.NOTABLE), (v == "3", PREFIX + "manifest-v3", K.INERT)]
    )


def permission_findings(manifests: DataFrame) -> DataFrame:
    """One finding per risky permission and one for extensions that ask for too much."""
    asked = manifests.select("file_id", F.explode(_strings("permissions")).alias("permission"))
    risky = permission_risks(asked)
    level = F.when(F.col("risk") == "medium", K.NOTABLE).otherwise(K.SUSPICIOUS)
    each = risky.filter(F.col("risk") != "low").select(
        "file_id", F.concat(F.lit(PREFIX + "permission-"), "risk", F.lit("/"), "permission").alias("rule_id"), level.alias("crit")
    )
    counts = risky.groupBy("file_id").agg(
        F.count_if(F.col("risk") == "critical").alias("critical"), F.count_if(F.col("risk") == "high").alias("high")
    )
    over = counts.filter((F.col("critical") >= 1) | (F.col("high") >= 3)).select(
        "file_id", F.lit(PREFIX + "overprivileged").alias("rule_id"), F.lit(K.SUSPICIOUS).alias("crit")
    )
    return each.distinct().unionByName(over)


def host_findings(manifests: DataFrame) -> DataFrame:
    """Access to all sites, to shops, and to one brand under many domains."""
    hosts, unique = _strings("host_permissions"), F.array_distinct(_strings("host_permissions"))
    matches = F.flatten(F.transform(_content_scripts(), lambda c: F.coalesce(c["matches"], F.array().cast("array<string>"))))
    everywhere = F.exists(F.concat(hosts, matches), lambda h: (h == "<all_urls>") | h.contains("*://*/"))
    shops = F.size(F.filter(hosts, lambda h: T.contains_any(F.lower(h), K.SHOPPING_DOMAINS)))
    brands = F.array_distinct(
        F.transform(
            F.filter(unique, lambda h: h.contains(".")),
            lambda h: F.replace(F.replace(F.element_at(F.split(h, r"\."), -2), F.lit("*://"), F.lit("")), F.lit("*"), F.lit("")),
        )
    )
    return _findings(
        manifests,
        [
            (everywhere, PREFIX + "host-all-urls", K.SUSPICIOUS),
            (shops >= 3, PREFIX + "targets-shopping", K.NOTABLE),
            ((F.size(unique) >= 10) & (F.size(brands) <= 3), PREFIX + "global-tld-access", K.NOTABLE),
        ],
    )


def content_script_findings(manifests: DataFrame) -> DataFrame:
    scripts_ = _content_scripts()
    return _findings(
        manifests,
        [
            (F.exists(scripts_, lambda c: F.coalesce(c["all_frames"], F.lit(False))), PREFIX + "content-script-all-frames", K.NOTABLE),
            (F.exists(scripts_, lambda c: F.equal_null(c["run_at"], F.lit("document_start"))), PREFIX + "content-script-early", K.NOTABLE),
        ],
    )


def exposure_findings(manifests: DataFrame) -> DataFrame:
    resources = F.coalesce(F.json_array_length(_field("web_accessible_resources")), F.lit(0))
    return _findings(
        manifests,
        [
            (_field("externally_connectable").isNotNull(), PREFIX + "externally-connectable", K.NOTABLE),
            (resources > 0, PREFIX + "web-accessible-resources", K.INERT),
            (_field("background.persistent") == "true", PREFIX + "persistent-background", K.NOTABLE),
        ],
    )


def update_url_findings(manifests: DataFrame) -> DataFrame:
    url = _field("update_url")
    return _findings(
        manifests, [(~url.contains("clients2.google.com"), PREFIX + "external-update-url", K.SUSPICIOUS)]
    )


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select("file_id", "rule_id", "crit") for p in parts])
