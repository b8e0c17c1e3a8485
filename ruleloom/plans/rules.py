"""The rule catalog the scan queries use, and findings with volume to combine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.session import local_table
from ruleloom.plans.registry import view
from ruleloom.plans.tables import FILE_TYPES, pick, sql_pick
from ruleloom.sources.tables import read_table

DIRECTORIES = (
    "micro-behaviors/net/http", "micro-behaviors/fs/write", "micro-behaviors/crypto/hash", "objectives/discovery/host",
)


def base_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atomic finding per line item: 40 rules in four directories."""
    li = read_table(spark, sf_dir, "lineitem")
    r = F.col("l_partkey") % 40
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        F.concat(pick(F.floor(r / 10), DIRECTORIES), F.lit("::r"), r).alias("rule_id"),
        (F.col("l_suppkey") % 4).cast("int").alias("crit"),
        F.round(F.col("l_discount") * 10, 2).alias("conf"),
        (F.col("l_linenumber").cast("bigint") * 10 + F.col("l_suppkey") % 10).alias("line_no"),
        F.pmod(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31, F.lit(458752)).alias("offset"),
        F.concat(F.lit("v"), "l_partkey").alias("value"),
        F.col("l_linenumber").alias("seq"),
    )


view("base_findings", f"""
SELECT l_orderkey AS file_id, {sql_pick('(l_partkey % 40) // 10', DIRECTORIES)} || '::r' || (l_partkey % 40) AS rule_id,
       CAST(l_suppkey % 4 AS INTEGER) AS crit, round(l_discount * 10, 2) AS conf,
       CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS line_no,
       (l_partkey * 7919 + l_suppkey * 31) % 458752 AS "offset", 'v' || l_partkey AS value, l_linenumber AS seq
FROM lineitem""")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        pick(F.col("o_orderkey"), FILE_TYPES).alias("file_type"),
        F.col("o_totalprice").cast("bigint").alias("size_bytes"),
    )


view("order_files", f"""
SELECT o_orderkey AS file_id, {sql_pick('o_orderkey', FILE_TYPES)} AS file_type,
       CAST(trunc(o_totalprice) AS BIGINT) AS size_bytes FROM orders""")

# id, criticality, confidence and clauses; a clause not given is absent.
COMPOSITES = (
    dict(id="objectives/exfil/http::upload", crit=3, conf=0.8, all=["micro-behaviors/net/http", "micro-behaviors/fs/write"]),
    dict(id="objectives/exfil/http::any-of", crit=2, conf=0.7, any=["r1", "r2", "r13", "r25", "r36"]),
    dict(id="objectives/exfil/http::two-of", crit=2, conf=0.9, needs=2,
         any=["micro-behaviors/net/http", "micro-behaviors/fs/write", "micro-behaviors/crypto/hash"]),
    dict(id="objectives/impact/a::combo", crit=3, conf=0.6, all=["micro-behaviors/crypto/hash"],
         any=["r1", "r3", "r5", "r7", "objectives/discovery/host"], needs=1),
    dict(id="objectives/impact/a::near-lines", crit=2, conf=0.5, all=["micro-behaviors/net/http"], needs=2, near_lines=12),
    dict(id="objectives/impact/a::near-bytes", crit=2, conf=0.5, needs=2, near_bytes=60000,
         any=["micro-behaviors/net/http", "micro-behaviors/fs/write", "micro-behaviors/crypto/hash"]),
    dict(id="objectives/clean/x::quiet", crit=1, conf=0.4, none=["micro-behaviors/net/http", "r35"]),
    dict(id="objectives/impact/b::guarded", crit=3, conf=0.9, all=["micro-behaviors/fs/write"], none=["objectives/discovery/host"]),
    dict(id="objectives/impact/b::unless", crit=2, conf=0.9, all=["micro-behaviors/fs/write"],
         unless=["r25", "objectives/exfil/http::upload"]),
    dict(id="well-known/x/y::chain", crit=3, conf=1.0, all=["objectives/exfil/http::upload", "objectives/impact/a::combo"],
         down_any=["objectives/discovery/host"]),
    dict(id="well-known/x/y::second", crit=3, conf=1.0, any=["well-known/x/y::chain", "objectives/impact/a::near-lines"],
         down_all=["micro-behaviors/crypto/hash", "r1"], down_any=["micro-behaviors/net/http"]),
    dict(id="well-known/x/z::ghost", crit=3, conf=1.0, all=["micro-behaviors/none/such::id"]),
    dict(id="well-known/x/z::gated", crit=2, conf=0.3, all=["micro-behaviors/net/http"], for_types=["python", "shell"],
         size_min=100000, size_max=300000, down_none=["micro-behaviors/fs/write"]),
    dict(id="well-known/x/z::inherits", crit=2, conf=0.3, all=["objectives/exfil/http::upload"], needs=3, near_lines=25),
)
CLAUSES = ("all", "any", "none", "unless", "down_all", "down_any", "down_none")
RULE_SCHEMA = (
    "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, "
    "for_types array<string>, size_min bigint, size_max bigint"
)


def composite_rules(spark: SparkSession, only: tuple[str, ...] | None = None) -> DataFrame:
    rows = [
        (c["id"], c["crit"], c["conf"], c.get("needs"), c.get("near_lines"), c.get("near_bytes"),
         c.get("for_types", ["all"]), c.get("size_min"), c.get("size_max"))
        for c in COMPOSITES if only is None or c["id"] in only
    ]
    return local_table(spark, rows, RULE_SCHEMA)


def composite_conds(spark: SparkSession, only: tuple[str, ...] | None = None) -> DataFrame:
    rows = [
        (c["id"], clause, i, ref)
        for c in COMPOSITES if only is None or c["id"] in only
        for clause in CLAUSES for i, ref in enumerate(c.get(clause, []))
    ]
    return local_table(spark, rows, "rule_id string, clause string, idx int, ref_id string")


# -- check SQL for the catalog, written rule by rule -------------------------------------


def sql_ref(ref: str, column: str = "rule_id") -> str:
    """Whether an id is what a reference stands for."""
    if "::" in ref:
        return f"{column} = '{ref}'"
    if "/" in ref:
        return f"(starts_with({column}, '{ref}::') OR starts_with({column}, '{ref}/'))"
    return f"(ends_with({column}, '::{ref}') OR ends_with({column}, '/{ref}'))"


def _count(refs: list[str], table: str) -> str:
    parts = " + ".join(f"max(({sql_ref(r)})::INT)" for r in refs)
    return f"(SELECT file_id, {parts} AS n FROM {table} GROUP BY file_id)"


def _near(rule: dict, table: str) -> str:
    refs = " OR ".join(sql_ref(r) for r in [*rule.get("all", []), *rule.get("any", [])])
    column, span = ("line_no", rule["near_lines"]) if rule.get("near_lines") is not None else ('"offset"', rule["near_bytes"])
    return (f"SELECT file_id FROM (SELECT file_id, count(*) OVER (PARTITION BY file_id ORDER BY {column} "
            f"RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING) AS n FROM {table} WHERE {refs}) "
            f"GROUP BY file_id HAVING max(n) >= {max(rule.get('needs') or 1, 1)}")


def sql_fires(rule: dict, table: str, evidence: str) -> str:
    """Files a composite holds for, given a table of what was found before it."""
    tests = []
    if rule.get("all"):
        tests.append(f"file_id IN (SELECT file_id FROM {_count(rule['all'], table)} WHERE n = {len(rule['all'])})")
    if rule.get("any"):
        tests.append(f"file_id IN (SELECT file_id FROM {_count(rule['any'], table)} WHERE n >= {rule.get('needs') or 1})")
    for clause in ("none", "unless"):
        if rule.get(clause):
            tests.append(f"file_id NOT IN (SELECT file_id FROM {table} WHERE {' OR '.join(sql_ref(r) for r in rule[clause])})")
    if rule.get("near_lines") is not None or rule.get("near_bytes") is not None:
        tests.append(f"file_id IN ({_near(rule, evidence)})")
    if "for_types" in rule:
        tests.append("file_type IN (" + ", ".join(f"'{t}'" for t in rule["for_types"]) + ")")
    if "size_min" in rule:
        tests.append(f"size_bytes BETWEEN {rule['size_min']} AND {rule['size_max']}")
    return f"SELECT file_id FROM order_files WHERE {' AND '.join(tests)}"


def sql_downgraded(rule: dict, table: str) -> str:
    if rule.get("down_all"):
        return f"file_id IN (SELECT file_id FROM {_count(rule['down_all'], table)} WHERE n = {len(rule['down_all'])})"
    for clause, word in (("down_any", "IN"), ("down_none", "NOT IN")):
        if rule.get(clause):
            return f"file_id {word} (SELECT file_id FROM {table} WHERE {' OR '.join(sql_ref(r) for r in rule[clause])})"
    return "FALSE"


BY_ID = {c["id"]: c for c in COMPOSITES}
# `unless` holds a rule back by what earlier rounds found, so it fires in the first.
SECOND = ("well-known/x/y::chain", "well-known/x/z::inherits")
THIRD = ("well-known/x/y::second",)
LAST = tuple(c["id"] for c in COMPOSITES if c.get("none"))
FIRST = tuple(c["id"] for c in COMPOSITES if c["id"] not in SECOND + THIRD + LAST)


def _stage(names: tuple[str, ...], found: str) -> str:
    return " UNION ALL ".join(
        f"SELECT file_id, '{n}' AS rule_id FROM ({sql_fires(BY_ID[n], found, 'ev_' + found)})" for n in names
    )


view("found0", "SELECT DISTINCT file_id, rule_id FROM base_findings", "base_findings")
view("ev_found0", 'SELECT file_id, rule_id, line_no, "offset" FROM base_findings', "base_findings")
view("fired1", _stage(FIRST, "found0"), "found0", "ev_found0", "order_files")
view("found1", "SELECT * FROM found0 UNION ALL SELECT * FROM fired1", "found0", "fired1")
# Evidence a fired composite hands on: here only `upload` and the near rules are referred to.
_PASSED = ("objectives/exfil/http::upload", "objectives/impact/a::near-lines", "objectives/impact/a::combo")
view("ev_found1", 'SELECT * FROM ev_found0 UNION ALL ' + " UNION ALL ".join(
    f"""SELECT file_id, '{n}', line_no, "offset" FROM ev_found0 JOIN (SELECT file_id FROM fired1 WHERE rule_id = '{n}') USING (file_id)
    WHERE {' OR '.join(sql_ref(r) for r in [*BY_ID[n].get('all', []), *BY_ID[n].get('any', [])])}""" for n in _PASSED),
     "ev_found0", "fired1")
view("fired2", _stage(SECOND, "found1"), "found1", "ev_found1", "order_files")
view("found2", "SELECT * FROM found1 UNION ALL SELECT * FROM fired2", "found1", "fired2")
view("ev_found2", "SELECT * FROM ev_found1", "ev_found1")
view("fired3", _stage(THIRD, "found2"), "found2", "ev_found2", "order_files")
view("found3", "SELECT * FROM found2 UNION ALL SELECT * FROM fired3", "found2", "fired3")
view("ev_found3", "SELECT * FROM ev_found2", "ev_found2")
view("fired4", _stage(LAST, "found3"), "found3", "ev_found3", "order_files")
view("found4", "SELECT * FROM found3 UNION ALL SELECT * FROM fired4", "found3", "fired4")
view("composite_findings", " UNION ALL ".join(f"""
SELECT file_id, '{c['id']}' AS rule_id,
       CASE WHEN {sql_downgraded(c, 'found4')} THEN greatest({c['crit']} - 1, 0) ELSE {c['crit']} END AS crit,
       CAST({1.0 if c.get('near_lines') is not None or c.get('near_bytes') is not None else c['conf']} AS DOUBLE) AS conf
FROM found4 WHERE rule_id = '{c['id']}'""" for c in COMPOSITES), "found4")
