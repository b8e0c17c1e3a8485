"""A large rule catalog with every kind of defect, derived from parts and orders.

The derivation is plain SQL both engines read the same way; only the checks differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.plans.registry import view
from ruleloom.sources.tables import read_table


def choose(key: str, values) -> str:
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    cases = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {cases} END)"


def tenth(key: str, by: int = 10) -> str:
    return f"CAST(floor({key} / {by}.0) AS BIGINT)"


DIRECTORIES = (
    "micro-behaviors/net/http/client", "micro-behaviors/fs/file/write", "objectives/exfil/http/post", "objectives/malware/stealer/browser",
    "micro-behaviors/python/import/os", "micro-behaviors/net/utils/misc", "objectives/impact/wipe/wiper", "cap/comm/x", "obj/comm/y",
    "known/tools/z", "meta/tools", "micro-behaviors/dylib/a", "metadata/format/python", "metadata/internal/imported", "micro-behaviors/a",
    "objectives/x/y/z/w/v", "well-known/tool/interpreter/python", "micro-behaviors/shell/shells/run", "objectives/anti-analysis/debug/check",
)
TYPES = ("python", "all", "python,shell", "elf,pe,macho,so", "javascript,python,ruby,php")
METRICS = ("text.total_lines", "text.totl_lines", "strings.totl", "nope.nothing", "functions.total")
VALID_METRICS = ("text.total_lines", "text.avg_line_length", "strings.total", "functions.total", "imports.total")


def dir_of(k: str) -> str:
    return f"({choose(k, DIRECTORIES)} || CASE WHEN {k} % 2 = 0 THEN '/s' || ({k} % 40) ELSE '' END)"


def id_of(k: str) -> str:
    name = f"CASE WHEN {k} % 13 = 0 THEN 'bad name!' || {k} WHEN {k} % 17 = 0 THEN 'x.y' || {k} ELSE 'r' || {k} END"
    return f"({dir_of(k)} || '::' || {name})"


K = "p_partkey"
PATTERN = (
    f"CASE WHEN {K} % 29 = 0 THEN ' ' WHEN {K} % 23 = 0 THEN '12345' WHEN {K} % 11 = 0 THEN substr(p_name, 1, 2) "
    f"WHEN {K} % 7 = 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) WHEN {K} % 37 = 0 THEN substr(p_name, 1, 4) WHEN {K} % 5 = 0 THEN p_name "
    f"ELSE p_name || ' ' || ({K} % 200) END"
)
REGEX = (
    f"CASE {K} % 6 WHEN 0 THEN '^' || replace(p_name, ' ', '_') || '$' WHEN 1 THEN replace(p_name, ' ', '|') || CASE WHEN {tenth(K, 60)} % 2 = 1 THEN '|n' || ({K} % 50) ELSE '' END "
    f"WHEN 2 THEN chr(92) || 'b' || substr(p_name, 1, 3) || chr(92) || 'b' WHEN 3 THEN p_name || ' ' || ({K} % 200) "
    f"WHEN 4 THEN p_name || '.*x' ELSE 'token|' || replace(p_name, ' ', '|') END"
)
HOW = choose(tenth(K), ("exact", "substr", "regex", "word", "none", "two"))
CTYPE = choose(K, ("string", "raw", "symbol", "string", "basename", "hex", "string", "trait", "metrics", "section"))
ATOMIC = f"""
SELECT {id_of(K)} AS rule_id, 'atomic' AS kind, CAST({K} % 4 AS INT) AS crit, p_size / 40.0e0 AS conf,
  CASE {K} % 5 WHEN 0 THEN '' WHEN 1 THEN ' abc ' WHEN 2 THEN p_name WHEN 3 THEN NULL ELSE p_name || ' does things' END AS descr,
  {choose(tenth(K, 7), TYPES)} AS types, {choose(K, ('linux', 'all', 'linux,macos'))} AS platforms,
  CASE WHEN {K} % 10 = 0 THEN 100 * ({K} % 7) END AS size_min, CASE WHEN {K} % 10 = 0 THEN 300 END AS size_max,
  CASE WHEN {K} % 9 = 0 THEN {K} % 5 END AS count_min, CASE WHEN {K} % 9 = 0 THEN 2 END AS count_max,
  CASE {K} % 14 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS n_not, CASE {K} % 15 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS n_unless,
  {K} % 19 = 0 AS has_downgrade, {choose(K, ('notable', 'hostile', 'filtered', 'inert', 'filtered'))} AS raw_crit,
  ctype, ref_id, metric_field, case_insensitive,
  CASE WHEN searched AND how IN ('exact', 'two') THEN pattern END AS exact, CASE WHEN searched AND how IN ('substr', 'two') THEN pattern END AS substr,
  CASE WHEN searched AND how = 'regex' THEN rx END AS regex, CASE WHEN searched AND how = 'word' AND ctype <> 'symbol' THEN pattern END AS word
FROM (SELECT *, {CTYPE} AS ctype, {HOW} AS how, {PATTERN} AS pattern, {REGEX} AS rx, {K} % 4 = 1 AS case_insensitive,
        {CTYPE} NOT IN ('trait', 'metrics', 'section') AS searched,
        CASE WHEN {CTYPE} = 'trait' AND {K} > 4 THEN {id_of(f'({K} - CASE WHEN {K} % 20 = 7 THEN 4 ELSE 1 END)')} END AS ref_id,
        CASE WHEN {CTYPE} = 'metrics' THEN {choose(tenth(K), METRICS)} END AS metric_field
      FROM {{part}}) p"""
O = "o_orderkey"
COMPOSITE = f"""
SELECT {choose(O, DIRECTORIES)} || '::c' || {O} AS rule_id, CAST({O} % 4 AS INT) AS crit, 1.0e0 AS conf,
  CAST(CASE {O} % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 END AS INT) AS needs, {choose(O, TYPES)} AS types,
  CASE WHEN {O} % 21 = 0 THEN 500 END AS size_min, CASE WHEN {O} % 21 = 0 THEN 100 * ({O} % 9) END AS size_max,
  CASE {O} % 31 WHEN 0 THEN 'all' WHEN 1 THEN 'any' END AS empty_clause, {O} % 19 = 0 AS has_downgrade
FROM {{orders}}"""
L = "l_partkey"
PICKED = f"(({L} + l_suppkey) % 6)"
CONDS = f"""
SELECT DISTINCT {choose('l_orderkey', DIRECTORIES)} || '::c' || l_orderkey AS rule_id,
  {choose('l_linenumber', ('all', 'any', 'any', 'none', 'unless', 'all', 'any'))} AS clause, {L} AS idx,
  CASE WHEN {PICKED} = 5 THEN 'string' ELSE 'trait' END AS ctype,
  CASE WHEN {PICKED} <= 2 THEN {id_of(L)} WHEN {PICKED} = 3 THEN {dir_of(L)} WHEN {PICKED} = 4 THEN 'missing/dir::x' || {L} END AS ref_id
FROM {{lineitem}}"""


# The rows of CONDS: numbers are made distinct and names are written out behind that. A
# name is null for a key whose remainder is negative, so such keys are alike before it.
_NAMED = "CASE WHEN {0} % 19 >= 0 THEN {0} END"
CONDS_ROWS = f"""
SELECT {choose('o', DIRECTORIES)} || '::c' || o AS rule_id, clause, idx, CASE WHEN kind = 3 THEN 'string' ELSE 'trait' END AS ctype,
  CASE kind WHEN 0 THEN {id_of('idx')} WHEN 1 THEN {dir_of('idx')} WHEN 2 THEN 'missing/dir::x' || idx END AS ref_id
FROM (SELECT DISTINCT {_NAMED.format('l_orderkey')} AS o, {choose('l_linenumber', ('all', 'any', 'any', 'none', 'unless', 'all', 'any'))} AS clause, {L} AS idx,
        CASE WHEN {PICKED} = 5 THEN 3 WHEN {PICKED} = 4 THEN 2 WHEN {L} % 19 < 0 THEN NULL WHEN {PICKED} <= 2 THEN 0 WHEN {PICKED} = 3 THEN 1 END AS kind
      FROM {{lineitem}})"""


def _arrays(df: DataFrame) -> DataFrame:
    out = df.withColumn("for_types", F.split("types", ","))
    return out.withColumn("platforms", F.split("platforms", ",")) if "platforms" in df.columns else out


def atomic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark.sql(ATOMIC, part=read_table(spark, sf_dir, "part")))


def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark.sql(COMPOSITE, orders=read_table(spark, sf_dir, "orders")))


def composite_conds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONDS_ROWS, lineitem=read_table(spark, sf_dir, "lineitem"))


view("atomic", ATOMIC.format(part="part"))
view("composite", COMPOSITE.format(orders="orders"))
view("conds", CONDS.format(lineitem="lineitem"))
view("patterns", """
SELECT rule_id, crit, ctype, types, case_insensitive, how, pattern FROM (
  SELECT *, unnest(['exact', 'substr', 'regex', 'word']) AS how, unnest([exact, substr, regex, word]) AS pattern FROM atomic) WHERE pattern IS NOT NULL""", "atomic")
view("alternatives", """
SELECT DISTINCT rule_id, types, crit, unnest(string_split(pattern, '|')) AS alt FROM patterns WHERE how = 'regex' AND contains(pattern, '|')""", "patterns")
view("directories", """
SELECT DISTINCT split_part(rule_id, '::', 1) AS dir FROM atomic UNION SELECT DISTINCT split_part(rule_id, '::', 1) FROM composite""", "atomic", "composite")
view("all_rules", "SELECT rule_id, crit FROM atomic UNION ALL SELECT rule_id, crit FROM composite", "atomic", "composite")
