"""A catalog with every kind of condition and modifier, scanned over one corpus of mixed files.

Documents are text files, orders binaries with symbols and sections, events structured files
and users traces; each rule stands beside the SQL of its hits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.operators import facts as FA
from ruleloom.operators import scan
from ruleloom.operators.conditions import CONDS_SCHEMA, KINDS, condition
from ruleloom.operators.extract import flatten_metrics
from ruleloom.plans.q_extract import payloads, q
from ruleloom.plans.q_predicates import FEATURES, kv_docs, sql_has_public, token_strings
from ruleloom.plans.registry import query, view
from ruleloom.plans.tables import FILE_TYPES, files, located, pick, sections, sql_list, sql_pick, symbols, syscalls
from ruleloom.session import local_table
from ruleloom.sources.tables import read_table

# -- the corpus ----------------------------------------------------------------------------

USER_SIZE = 4096


def _tagged(df, tag: str):
    return df.withColumn("file_id", F.concat(F.lit(tag), F.col("file_id").cast("string")))


def corpus_files(spark, sf_dir):
    """Every file of the corpus: file_id, file_type, size_bytes."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"), pick(F.col("o_orderkey"), FILE_TYPES).alias("file_type"), F.col("o_totalprice").cast("bigint").alias("size_bytes")
    )
    data = kv_docs(spark, sf_dir).select("file_id", F.lit("json").alias("file_type"), F.octet_length("json").cast("bigint").alias("size_bytes"))
    users = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.lit("trace").alias("file_type"), F.lit(USER_SIZE).cast("bigint").alias("size_bytes")).distinct()
    text = files(spark, sf_dir).select("file_id", "file_type", "size_bytes")
    return FA.together(*[_tagged(df, tag) for df, tag in ((text, "d"), (orders, "o"), (data, "e"), (users, "u"))])


KV_PATHS = ("meta.kind", "deps[*].name", "deps[0].name", "tags", "extra", "deps")


def corpus_facts(spark, sf_dir, kinds: set[str]):
    """One fact table of the whole corpus, with the facts that the given kinds of conditions read."""
    doc = files(spark, sf_dir)
    sized = lambda: flatten_metrics(doc.select("file_id", "size_bytes", F.size(T.text_lines(F.col("text"))).alias("total_lines")), "text")
    features = lambda: read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), pick(F.col("l_partkey"), FEATURES).alias("feature_id"))
    names = {"symbol", "string", "string_count", "exports_count", "import_combination"}
    parts = (
        ("d", {"string", "string_count"}, lambda: FA.string_facts(token_strings(spark, sf_dir))),
        ("d", {"raw", "hex"}, lambda: FA.content_facts(doc, binary="hex" in kinds)),
        ("d", {"basename"}, lambda: FA.basename_facts(doc)),
        ("d", {"metrics"}, lambda: FA.metric_facts(sized())),
        ("d", {"encoded"}, lambda: FA.encoded_facts(payloads(spark, sf_dir).withColumnRenamed("chain", "encoding_chain"))),
        ("o", names, lambda: FA.symbol_facts(symbols(spark, sf_dir))),
        ("o", {"string", "string_count"}, lambda: FA.string_facts(located(spark, sf_dir))),
        ("o", {"section", "section_ratio"}, lambda: FA.section_facts(sections(spark, sf_dir))),
        ("o", {"structure"}, lambda: FA.structure_facts(features())),
        ("u", {"syscall"}, lambda: FA.syscall_facts(syscalls(spark, sf_dir))),
        ("e", {"kv"}, lambda: FA.kv_facts(kv_docs(spark, sf_dir), list(KV_PATHS))),
    )
    return FA.together(*[_tagged(make(), tag) for tag, reads, make in parts if reads & kinds])


def corpus_sections(spark, sf_dir):
    return _tagged(sections(spark, sf_dir), "o")


view("x_files", f"""
SELECT 'd' || file_id AS file_id, file_type, size_bytes FROM files
UNION ALL SELECT 'o' || o_orderkey, {sql_pick('o_orderkey', FILE_TYPES)}, CAST(trunc(o_totalprice) AS BIGINT) FROM orders
UNION ALL SELECT 'e' || file_id, 'json', strlen(json) FROM kv_docs
UNION ALL SELECT DISTINCT 'u' || user_id, 'trace', {USER_SIZE} FROM events""", "files", "kv_docs")
view("x_names", """
SELECT 'o' || file_id AS file_id, kind, regexp_replace(symbol, '^(sym\\.imp\\.)*(sym\\.)*(fcn\\.)*_*', '') AS value FROM symbols""", "symbols")
view("x_strings", """
SELECT 'd' || file_id AS file_id, value, NULL::BIGINT AS "offset" FROM doc_tokens
UNION ALL SELECT 'o' || file_id, value, "offset" FROM located
UNION ALL SELECT file_id, value, NULL FROM x_names WHERE kind IN ('import', 'export')""", "doc_tokens", "located", "x_names")
view("x_sections", """SELECT 'o' || file_id AS file_id, name, "start", "end", size, entropy, permissions FROM sections""", "sections")
view("x_text", """
SELECT 'o' || file_id AS file_id, arg_min("start", (CASE name WHEN '.text' THEN 1 ELSE 2 END, "start", "end")) AS lo,
  arg_min("end", (CASE name WHEN '.text' THEN 1 ELSE 2 END, "start", "end")) AS hi
FROM sections WHERE name IN ('.text', '__text') GROUP BY 1""", "sections")
view("x_features", f"SELECT 'o' || l_orderkey AS file_id, {sql_pick('l_partkey', FEATURES)} AS f FROM lineitem")
view("x_kv", "SELECT 'e' || file_id AS file_id, json FROM kv_docs", "kv_docs")

# -- conditions, each with the SQL of its hits (file_id, hits, sample) -------------------------

_COUNTED = "SELECT file_id, count(*) AS hits, min({}) AS sample FROM {} WHERE {} GROUP BY 1"
_ONE = "SELECT file_id, 1 AS hits, {} AS sample FROM {}"


def _strings(test: str) -> str:
    return _COUNTED.format("value", "x_strings", test)


# name: (fields, SQL)
CONDITIONS = {
    "address": (dict(kind="string", external_ip=True), _strings(sql_has_public("value"))),
    "mail": (
        dict(kind="string", how="regex", pattern=K.EMAIL_RE, exceptions=[dict(how="substr", pattern="MAIL1."), dict(how="exact", pattern="x@y.zz")]),
        # Exceptions look at what the pattern matched.
        _strings(f"regexp_matches(value, {q(K.EMAIL_RE)}) AND NOT contains(lower(regexp_extract(value, {q(K.EMAIL_RE)})), 'mail1.') AND lower(regexp_extract(value, {q(K.EMAIL_RE)})) <> 'x@y.zz'"),
    ),
    "token": (dict(kind="string", how="exact", pattern="TOKEN", case_insensitive=True), _strings("lower(value) = 'token'")),
    "ring-string": (dict(kind="string", how="substr", pattern="ring"), _strings("contains(value, 'ring')")),
    "front": (dict(kind="string", how="substr", pattern="small", low=0, high=90000), _strings("""contains(value, 'small') AND ("offset" < least(90000, (SELECT size_bytes FROM x_files f WHERE f.file_id = x_strings.file_id)) OR file_id || value IN (SELECT file_id || value FROM x_names WHERE kind IN ('import', 'export')))""")),
    "in-text": (
        dict(kind="string", how="regex", pattern="^[a-m][a-z]+ ", section="text", low=1000, high=-500),
        """SELECT file_id, count(*) AS hits, min(value) AS sample FROM x_strings JOIN x_text USING (file_id)
           WHERE regexp_matches(value, '^[a-m][a-z]+ ') AND "offset" >= lo + 1000 AND "offset" < lo + greatest(hi - lo - 500, 0) GROUP BY 1""",
    ),
    "license": (dict(kind="raw", how="regex", pattern="licen[sc]ed? under", case_insensitive=True), "SELECT 'd' || file_id AS file_id, len(regexp_extract_all(text, '(?i)licen[sc]ed? under')) AS hits, '(?i)licen[sc]ed? under' AS sample FROM files WHERE regexp_matches(text, '(?i)licen[sc]ed? under')"),
    "marks": (dict(kind="raw", how="substr", pattern="###"), "SELECT 'd' || file_id AS file_id, (strlen(text) - strlen(replace(text, '###', ''))) // 3 AS hits, '###' AS sample FROM files WHERE contains(text, '###')"),
    "opening": (
        dict(kind="raw", how="substr", pattern="the", low=0, high=60),
        """SELECT file_id, hits, 'the' AS sample FROM (SELECT 'd' || file_id AS file_id, len(regexp_extract_all(substr(hex(encode(text)), 1, 120), '^(..)*?746865')) AS h,
           (strlen(head) - strlen(replace(head, '746865', ''))) // 6 AS hits FROM (SELECT *, regexp_replace(substr(hex(encode(text)), 1, 120), '(..)', '\\1 ', 'g') AS spaced, replace(regexp_replace(substr(hex(encode(text)), 1, 120), '(..)', '\\1 ', 'g'), '74 68 65', '746865') AS head FROM files)) WHERE hits > 0""",
    ),
    "bytes": (dict(kind="hex", pattern="54 68 65 [1-3] 61 6E 64"), "SELECT 'd' || file_id AS file_id, len(regexp_extract_all(text, '(?s)The.{1,3}and')) AS hits, NULL AS sample FROM files WHERE FALSE"),
    "symbol": (dict(kind="symbol", how="regex", pattern="^(red|blue)_[a-m]", exceptions=[dict(how="substr", pattern="BOLT")]), _COUNTED.format("value", "x_names", "regexp_matches(value, '^(red|blue)_[a-m]')")),
    "hidden": (
        dict(kind="encoded", names=["hex"], how="substr", pattern="import"),
        "SELECT 'd' || file_id AS file_id, count(*) AS hits, min(value) AS sample FROM payloads_sql WHERE contains(chain, 'hex') AND contains(value, 'import') GROUP BY 1",
    ),
    "click": (dict(kind="kv", key="meta.kind", how="exact", pattern="CLICK", case_insensitive=True), _ONE.format("'click'", "x_kv WHERE json_extract_string(json, '$.meta.kind') = 'click'")),
    "dependency": (dict(kind="kv", key="deps[*].name", how="exact", pattern="d3"), "SELECT file_id, len(list_filter(json_extract_string(json, '$.deps[*].name'), lambda x: x = 'd3')) AS hits, 'd3' AS sample FROM x_kv WHERE list_contains(json_extract_string(json, '$.deps[*].name'), 'd3')"),
    "first": (dict(kind="kv", key="deps[0].name", how="regex", pattern="^d[0-2]$"), _ONE.format("json_extract_string(json, '$.deps[0].name')", "x_kv WHERE regexp_matches(json_extract_string(json, '$.deps[0].name'), '^d[0-2]$')")),
    "tagged": (dict(kind="kv", key="tags", how="exact", pattern="u4"), _ONE.format("'u4'", "x_kv WHERE json_extract_string(json, '$.tags[1]') = 'u4'")),
    "plain": (dict(kind="kv", key="extra", exists=False), _ONE.format("NULL", "x_kv WHERE json_extract(json, '$.extra') IS NULL")),
    "large": (dict(kind="kv", key="extra", n_min=2.0, n_max=3.0), _ONE.format("""'{"a":1,"b":2}'""", "x_kv WHERE json_extract(json, '$.extra') IS NOT NULL")),
    "named": (dict(kind="basename", how="regex", pattern="^DOC_[0-9]*7\\.", case_insensitive=True), "SELECT 'd' || file_id AS file_id, 1 AS hits, basename AS sample FROM files WHERE regexp_matches(basename, '^doc_[0-9]*7\\.')"),
    "long": (dict(kind="metrics", key="text.size_bytes", n_min=2000.0, n_max=4000.0), "SELECT 'd' || file_id AS file_id, 1 AS hits, 'text.size_bytes' AS sample FROM files WHERE size_bytes BETWEEN 2000 AND 4000"),
    "code": (
        dict(kind="section", how="substr", pattern="text", n_min=5000.0, n_max=40000.0, e_min=2.0, readable=True, writable=False),
        _COUNTED.format("name", "x_sections", "contains(name, 'text') AND size BETWEEN 5000 AND 40000 AND entropy >= 2 AND contains(permissions, 'r') AND NOT contains(permissions, 'w')"),
    ),
    "share": (
        dict(kind="section_ratio", pattern="^(\\.text|__text)$", n_min=0.3, n_max=0.8),
        "SELECT file_id, 1 AS hits, NULL AS sample FROM x_sections GROUP BY 1 HAVING sum(size) FILTER (WHERE name IN ('.text', '__text')) / sum(size) BETWEEN 0.3 AND 0.8",
    ),
    "exports": (dict(kind="exports_count", n_max=3.0), "SELECT f.file_id, 1 AS hits, CAST(count(value) AS VARCHAR) AS sample FROM x_files f LEFT JOIN (SELECT * FROM x_names WHERE kind = 'export') s USING (file_id) GROUP BY 1 HAVING count(value) <= 3"),
    "few-long": (
        dict(kind="string_count", how="regex", pattern="^[a-z]+$", e_min=18.0, n_min=1.0, n_max=6.0),
        "SELECT file_id, 1 AS hits, CAST(count(*) AS VARCHAR) AS sample FROM x_strings WHERE strlen(value) >= 18 AND regexp_matches(value, '^[a-z]+$') GROUP BY 1 HAVING count(*) <= 6",
    ),
    "combination": (
        dict(kind="import_combination", names=["(red|blue)", "gear"], others=["widget", "(ring|bolt)$"], n_min=1.0, n_max=6.0),
        """SELECT file_id, 1 AS hits, CAST(count(*) AS VARCHAR) AS sample FROM x_names WHERE kind = 'import' GROUP BY 1
           HAVING bool_or(regexp_matches(value, '(red|blue)')) AND bool_or(regexp_matches(value, 'gear')) AND sum(regexp_matches(value, 'widget')::INT + regexp_matches(value, '(ring|bolt)$')::INT) >= 1 AND count(*) <= 6""",
    ),
    "call": (dict(kind="syscall", names=["click", "error"], numbers=[3, 7, 42, 69], others=["ARM"]), "SELECT 'u' || file_id AS file_id, count(*) AS hits, min(name) AS sample FROM syscalls WHERE name IN ('click', 'error') AND number IN (3, 7, 42, 69) AND contains(lower(arch), 'arm') GROUP BY 1"),
    "structure": (dict(kind="structure", key="binary/section", n_min=2.0), "SELECT file_id, count(*) AS hits, min(f) AS sample FROM x_features WHERE f = 'binary/section' OR starts_with(f, 'binary/section/') GROUP BY 1 HAVING count(*) >= 2"),
}
# What the check finds in another way than by one regex.
_SQL = {name: sql for name, (_, sql) in CONDITIONS.items()}
_SQL["symbol"] = _COUNTED.format("value", "x_names", "regexp_matches(value, '^(red|blue)_[a-m]') AND NOT contains(lower(regexp_extract(value, '^(red|blue)_[a-m]')), 'bolt')")
_SQL["front"] = """SELECT file_id, count(*) AS hits, min(value) AS sample FROM (
  SELECT f.file_id, value FROM located l JOIN x_files f ON f.file_id = 'o' || l.file_id WHERE "offset" < least(90000, size_bytes)
  UNION ALL SELECT file_id, value FROM x_names WHERE kind IN ('import', 'export')) WHERE contains(value, 'small') GROUP BY 1"""
_SQL["opening"] = """SELECT file_id, (length(head) - length(replace(head, 'the', ''))) // 3 AS hits, 'the' AS sample FROM (
  SELECT 'd' || file_id AS file_id, list_reduce(list_transform(range(0, 60), lambda i: CASE substr(hex(encode(text)), 2 * i + 1, 2) WHEN '74' THEN 't' WHEN '68' THEN 'h' WHEN '65' THEN 'e' ELSE '.' END), lambda a, b: a || b) AS head
  FROM files WHERE text <> '') WHERE contains(head, 'the')"""
_SQL["bytes"] = """SELECT 'd' || file_id AS file_id, len(regexp_extract_all(latin, '(?s)The.{1,3}and')) AS hits, '(?s)\\x54\\x68\\x65.{1,3}\\x61\\x6E\\x64' AS sample FROM (
  SELECT file_id, regexp_replace(text, '[^\\x00-\\x7F]', '..', 'g') AS latin FROM files) WHERE hits > 0"""

# -- atomic rules -------------------------------------------------------------------------------

# rule id: (crit, conf, condition, gates, other clauses: names of conditions or ids of rules)
ATOMIC = {
    "micro-behaviors/net/address::public": (1, 0.8, "address", {}, {}),
    "micro-behaviors/net/address::mail": (1, 0.7, "mail", {}, {"down_any": ["marks", "license"]}),
    "micro-behaviors/data/secret::token": (2, 0.5, "token", dict(for_types=["en", "de"]), {"unless": ["license"]}),
    "micro-behaviors/data/text::ring": (0, 0.3, "ring-string", dict(count_min=2, count_max=9), {}),
    "micro-behaviors/data/text::front": (1, 0.4, "front", dict(platforms=["linux", "macos"]), {}),
    "micro-behaviors/data/text::windows-only": (1, 0.4, "front", dict(platforms=["windows"]), {}),
    "micro-behaviors/data/text::in-text": (1, 0.6, "in-text", {}, {"unless": ["micro-behaviors/bin/code::share", "combination"]}),
    "micro-behaviors/legal/license::any": (1, 1.0, "license", {}, {}),
    "micro-behaviors/text/noise::dense": (2, 0.5, "marks", dict(per_kb_min=1.0), {"down_all": ["long", "opening"], "down_any": ["named"]}),
    "micro-behaviors/text/noise::opening": (0, 0.5, "opening", dict(size_min=500, size_max=9000), {}),
    "micro-behaviors/text/bytes::the-and": (1, 0.9, "bytes", {}, {"down_none": ["marks"]}),
    "micro-behaviors/bin/name::colour": (1, 0.7, "symbol", dict(for_types=["elf", "pe", "macho"]), {}),
    "micro-behaviors/data/encoded::import": (3, 0.9, "hidden", {}, {}),
    "micro-behaviors/data/kv::click": (1, 0.9, "click", {}, {"unless": ["plain", "first"]}),
    "micro-behaviors/data/kv::dependency": (2, 0.9, "dependency", dict(count_min=1), {"down_any": ["tagged"]}),
    "micro-behaviors/data/kv::large": (1, 0.9, "large", {}, {}),
    "micro-behaviors/data/kv::plain": (0, 0.2, "plain", {}, {}),
    "micro-behaviors/file/name::seven": (0, 0.2, "named", {}, {}),
    "micro-behaviors/file/size::middle": (0, 0.2, "long", {}, {}),
    "micro-behaviors/bin/code::section": (1, 0.6, "code", {}, {}),
    "micro-behaviors/bin/code::share": (2, 0.6, "share", {}, {}),
    "micro-behaviors/bin/code::few-exports": (0, 0.6, "exports", dict(for_types=["elf", "so"]), {}),
    "micro-behaviors/bin/code::few-strings": (0, 0.6, "few-long", {}, {}),
    "micro-behaviors/bin/import::mix": (3, 0.6, "combination", {}, {}),
    "micro-behaviors/os/call::click": (2, 0.6, "call", dict(count_max=4), {}),
    "micro-behaviors/bin/structure::sections": (1, 0.6, "structure", {}, {}),
    "well-known/d::calls": (2, 0.9, "@micro-behaviors/os/call", dict(count_min=2), {}),
}
PLATFORMS = ("linux", "android")

def _ref(name: str, rule: str, clause: str, i: int) -> tuple:
    inline = name in CONDITIONS
    return (rule, clause, i, None if inline else name.lstrip("@"), condition(**CONDITIONS[name][0]) if inline else None)


def atomic_rules(spark, only: tuple[str, ...] | None = None):
    rows = [
        (rid, crit, conf, g.get("for_types", ["all"]), g.get("platforms", ["all"]), *[g.get(k) for k in ("size_min", "size_max", "count_min", "count_max", "per_kb_min", "per_kb_max")])
        for rid, (crit, conf, _, g, _) in ATOMIC.items() if only is None or rid in only
    ]
    return local_table(spark, rows, scan.CATALOG_SCHEMA)


def atomic_conds(spark, only: tuple[str, ...] | None = None):
    mine = {rid: spec for rid, spec in ATOMIC.items() if only is None or rid in only}
    rows = [_ref(name, rid, scan.IF, 0) for rid, (_, _, name, _, _) in mine.items()]
    rows += [_ref(name, rid, clause, i) for rid, (*_, more) in mine.items() for clause, names in more.items() for i, name in enumerate(names)]
    return local_table(spark, rows, CONDS_SCHEMA)


for _name, _body in _SQL.items():
    _needs = "x_files x_names x_strings x_sections x_text x_features x_kv files located syscalls payloads_sql".split()
    view(f"c_{_name.replace('-', '_')}", f"SELECT file_id, CAST(hits AS BIGINT) AS hits, CAST(sample AS VARCHAR) AS sample FROM ({_body})", *[n for n in _needs if n in _body])


def _cond(name: str) -> str:
    return f"c_{name.replace('-', '_')}"


def _holds(name: str) -> str:
    """Files a condition holds for, or that a rule passed its gates in."""
    if name in CONDITIONS:
        return f"SELECT file_id FROM {_cond(name)}"
    return f"SELECT file_id FROM x_gated WHERE rule_id = '{name}'"


def _sql_gated(rid: str, spec: tuple, hits: str) -> str:
    crit, conf, _, g, _ = spec
    tests = [f"hits >= {g.get('count_min') or 1}"]
    if "for_types" in g:
        tests.append(f"list_contains({sql_list(g['for_types'])}, file_type)")
    for field, test in (("size_min", "size_bytes >= {}"), ("size_max", "size_bytes <= {}"), ("count_max", "hits <= {}"), ("per_kb_min", "hits / (size_bytes / 1024.0) >= {}")):
        if field in g:
            tests.append(test.format(g[field]))
    if "platforms" in g and not {"all", *PLATFORMS} & {*g["platforms"]}:
        tests.append("FALSE")
    return f"SELECT file_id, '{rid}' AS rule_id, {crit} AS crit, CAST({conf} AS DOUBLE) AS conf, hits, sample FROM ({hits}) JOIN x_files USING (file_id) WHERE {' AND '.join(tests)}"


_plain = {rid: spec for rid, spec in ATOMIC.items() if spec[2] in CONDITIONS}
view("x_gated", " UNION ALL ".join(_sql_gated(rid, spec, f"SELECT * FROM {_cond(spec[2])}") for rid, spec in _plain.items()), "x_files", *sorted({_cond(spec[2]) for spec in _plain.values()}))


def _sql_told(rid: str, spec: tuple) -> str:
    more = spec[4]
    crit = "crit"
    if "down_all" in more:
        crit = f"CASE WHEN {' AND '.join(f'file_id IN ({_holds(n)})' for n in more['down_all'])} THEN greatest(crit - 1, 0) ELSE crit END"
    elif "down_any" in more:
        crit = f"CASE WHEN {' OR '.join(f'file_id IN ({_holds(n)})' for n in more['down_any'])} THEN greatest(crit - 1, 0) ELSE crit END"
    elif "down_none" in more:
        crit = f"CASE WHEN {' AND '.join(f'file_id NOT IN ({_holds(n)})' for n in more['down_none'])} THEN greatest(crit - 1, 0) ELSE crit END"
    tests = [f"rule_id = '{rid}'", *[f"file_id NOT IN ({_holds(n)})" for n in more.get("unless", [])]]
    return f"SELECT file_id, rule_id, CAST({crit} AS INTEGER) AS crit, conf, hits, sample FROM x_gated WHERE {' AND '.join(tests)}"


_needed = sorted({_cond(n) for *_, more in ATOMIC.values() for names in more.values() for n in names if n in CONDITIONS})
view("x_told", " UNION ALL ".join(_sql_told(rid, spec) for rid, spec in _plain.items()), "x_gated", *_needed)
_derived = {rid: spec for rid, spec in ATOMIC.items() if spec[2] not in CONDITIONS}
view("x_atomic", "SELECT * FROM x_told UNION ALL " + " UNION ALL ".join(
    _sql_gated(rid, spec, f"SELECT file_id, CAST(sum(hits) AS BIGINT) AS hits, NULL AS sample FROM x_told WHERE starts_with(rule_id, '{spec[2].lstrip('@')}::') GROUP BY 1") for rid, spec in _derived.items()), "x_told", "x_files")


@query("agg8_catalog_scan", "SELECT file_id, rule_id, crit, conf, hits, sample FROM x_atomic", "x_atomic")
def catalog_scan(spark, sf_dir):
    """Atomic rules of every kind, with every modifier, over the whole corpus."""
    found, _ = scan.catalog_findings(corpus_files(spark, sf_dir), corpus_facts(spark, sf_dir, set(KINDS)), atomic_rules(spark), atomic_conds(spark), corpus_sections(spark, sf_dir), PLATFORMS)
    return found.select("file_id", "rule_id", F.col("crit").cast("int").alias("crit"), "conf", "hits", "sample")


# -- composites with inline conditions in every clause ---------------------------------------------

COMPOSITES = {
    "objectives/a/in::all": dict(crit=3, conf=0.8, all=["mail", "token"]),
    "objectives/a/in::any": dict(crit=2, conf=0.7, any=["click", "micro-behaviors/os/call", "hidden"]),
    "objectives/a/in::needs": dict(crit=2, conf=0.7, needs=2, any=["address", "mail", "marks", "micro-behaviors/legal/license::any"]),
    "objectives/a/in::none": dict(crit=1, conf=0.4, all=["dependency"], none=["tagged", "large"]),
    "objectives/a/in::only-none": dict(crit=0, conf=0.4, none=["exports", "plain", "micro-behaviors/file/size::middle"], for_types=["elf", "json", "en"]),
    "objectives/a/in::unless": dict(crit=2, conf=0.4, all=["code"], any=["share", "structure"], unless=["combination", "micro-behaviors/data/text::front"]),
    "objectives/a/in::downgraded": dict(crit=3, conf=0.4, all=["ring-string", "micro-behaviors/bin/code"], down_any=["in-text", "combination"]),
    "objectives/a/in::chained": dict(crit=3, conf=0.4, any=["objectives/a/in::all", "objectives/a/in::unless"], down_none=["marks", "share"]),
    "objectives/a/in::linux": dict(crit=1, conf=0.9, all=["structure", "code"], platforms=["linux"], size_min=50000),
    "objectives/a/in::windows": dict(crit=1, conf=0.9, all=["structure", "code"], platforms=["windows"]),
}
CLAUSES = ("all", "any", "none", "unless", "down_all", "down_any", "down_none")


def composite_rules(spark, only: tuple[str, ...] | None = None):
    rows = [
        (rid, c["crit"], c["conf"], c.get("needs"), None, None, c.get("for_types", ["all"]), c.get("platforms", ["all"]), c.get("size_min"), None)
        for rid, c in COMPOSITES.items() if only is None or rid in only
    ]
    return local_table(spark, rows, scan.COMPOSITE_SCHEMA)


def composite_conds(spark, only: tuple[str, ...] | None = None):
    rows = [_ref(name, rid, clause, i) for rid, c in COMPOSITES.items() if only is None or rid in only for clause in CLAUSES for i, name in enumerate(c.get(clause, []))]
    return local_table(spark, rows, CONDS_SCHEMA)


def _sql_met(name: str, table: str) -> str:
    if name in CONDITIONS:
        return f"file_id IN (SELECT file_id FROM {_cond(name)})"
    test = f"rule_id = '{name}'" if "::" in name else f"starts_with(rule_id, '{name}::')"
    return f"file_id IN (SELECT file_id FROM {table} WHERE {test})"


def _sql_composite(rid: str, c: dict, table: str) -> str:
    tests = [_sql_met(n, table) for n in c.get("all", [])]
    if c.get("any"):
        tests.append("(" + " + ".join(f"({_sql_met(n, table)})::INT" for n in c["any"]) + f") >= {c.get('needs') or 1}")
    tests += [f"NOT {_sql_met(n, table)}" for n in (*c.get("none", []), *c.get("unless", []))]
    if "for_types" in c:
        tests.append(f"list_contains({sql_list(c['for_types'])}, file_type)")
    if "size_min" in c:
        tests.append(f"size_bytes >= {c['size_min']}")
    if "platforms" in c and not {"all", *PLATFORMS} & {*c["platforms"]}:
        tests.append("FALSE")
    return f"SELECT file_id, '{rid}' AS rule_id FROM x_files WHERE {' AND '.join(tests)}"


_every = sorted(_cond(n) for n in CONDITIONS)
_first = [r for r in COMPOSITES if r != "objectives/a/in::chained"]
view("x_found0", "SELECT DISTINCT file_id, rule_id FROM x_atomic", "x_atomic")
view("x_fired1", " UNION ALL ".join(_sql_composite(r, COMPOSITES[r], "x_found0") for r in _first), "x_found0", "x_files", *_every)
view("x_found1", "SELECT * FROM x_found0 UNION ALL SELECT * FROM x_fired1", "x_found0", "x_fired1")
view("x_fired", "SELECT * FROM x_fired1 UNION ALL " + _sql_composite("objectives/a/in::chained", COMPOSITES["objectives/a/in::chained"], "x_found1"), "x_fired1", "x_found1", "x_files", *_every)
view("x_found2", "SELECT * FROM x_found0 UNION ALL SELECT * FROM x_fired", "x_found0", "x_fired")


def _sql_crit(c: dict) -> str:
    for clause, word, join in (("down_any", "", " OR "), ("down_none", "NOT ", " AND ")):
        if clause in c:
            tests = join.join(word + _sql_met(n, "x_found2") for n in c[clause])
            return f"CASE WHEN {tests} THEN greatest({c['crit']} - 1, 0) ELSE {c['crit']} END"
    return str(c["crit"])


view("x_composite", " UNION ALL ".join(
    f"SELECT file_id, rule_id, CAST({_sql_crit(c)} AS INTEGER) AS crit, CAST({c['conf']} AS DOUBLE) AS conf FROM x_fired WHERE rule_id = '{rid}'" for rid, c in COMPOSITES.items()),
     "x_fired", "x_found2", *_every)


def _reachable(names: list[str]) -> tuple[tuple[str, ...], set[str]]:
    """Atomic rules that some composites refer to, however far, and the kinds of all conditions on the way."""
    rules, kinds, open_ = set(), set(), list(names)
    while open_:
        name = open_.pop().lstrip("@")
        if name in CONDITIONS:
            kinds.add(CONDITIONS[name][0]["kind"])
        for rid, (_, _, own, _, more) in ATOMIC.items():
            if rid not in rules and (rid == name or rid.startswith(name + "::")):
                rules.add(rid)
                open_ += [own, *(n for some in more.values() for n in some)]
    return tuple(sorted(rules)), kinds


def _inline(spark, sf_dir, *names: str):
    """All findings; with names, of these composites and the atomic rules they refer to."""
    only = tuple(f"objectives/a/in::{n}" for n in names) or None
    rules, kinds = (None, set(KINDS)) if only is None else _reachable([n for r in only for c in CLAUSES for n in COMPOSITES[r].get(c, [])])
    return scan.catalog_report(
        corpus_files(spark, sf_dir), corpus_facts(spark, sf_dir, kinds), atomic_rules(spark, rules), atomic_conds(spark, rules), composite_rules(spark, only), composite_conds(spark, only),
        corpus_sections(spark, sf_dir), PLATFORMS,
    )


def _composites_of(spark, sf_dir, *names: str):
    return _inline(spark, sf_dir, *names).where(F.col("rule_id").startswith("objectives/a/in::")).select("file_id", "rule_id", F.col("crit").cast("int").alias("crit"), "conf")


def _sql_of(*names: str) -> str:
    return "SELECT file_id, rule_id, crit, conf FROM x_composite WHERE rule_id IN (" + ", ".join(f"'objectives/a/in::{n}'" for n in names) + ")"


@query("agg1_inline_all", _sql_of("all", "linux", "windows"), "x_composite")
def inline_all(spark, sf_dir):
    """`all` of inline conditions, one shared by two rules, with a platform gate."""
    return _composites_of(spark, sf_dir, "all", "linux", "windows")


@query("agg2_inline_any", _sql_of("any"), "x_composite")
def inline_any(spark, sf_dir):
    return _composites_of(spark, sf_dir, "any")


@query("agg3_inline_needs", _sql_of("needs"), "x_composite")
def inline_needs(spark, sf_dir):
    return _composites_of(spark, sf_dir, "needs")


@query("agg4_inline_none", _sql_of("none", "only-none"), "x_composite")
def inline_none(spark, sf_dir):
    return _composites_of(spark, sf_dir, "none", "only-none")


@query("agg5_inline_rules", _sql_of(*[r.rsplit("::", 1)[1] for r in COMPOSITES]), "x_composite")
def inline_rules(spark, sf_dir):
    """Inline conditions in every clause, chains of rules, exclusions and downgrades."""
    return _composites_of(spark, sf_dir)


@query("scan_catalog_report", """
SELECT file_id, count(*) FILTER (WHERE crit = 3) AS hostile, count(*) FILTER (WHERE crit = 2) AS suspicious, count(*) FILTER (WHERE crit = 1) AS notable, max(crit) AS max_crit
FROM (SELECT file_id, rule_id, crit FROM x_atomic UNION ALL SELECT file_id, rule_id, crit FROM x_composite) GROUP BY 1""", "x_atomic x_composite")
def catalog_report(spark, sf_dir):
    """The whole catalog: counts by severity of every file with a finding."""
    of = lambda level: F.count_if(F.col("crit") == level)
    return _inline(spark, sf_dir).groupBy("file_id").agg(of(3).alias("hostile"), of(2).alias("suspicious"), of(1).alias("notable"), F.max("crit").cast("int").alias("max_crit"))
