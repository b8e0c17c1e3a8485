"""Operators on small tables, against values worked out by hand or by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import net, text as T
from ruleloom.operators import catalog_checks, composites, containers, decode, diff, extract, graph, joins, matching, metrics, precision, predicates, scan, windows
from ruleloom.session import local_table
from ruleloom.sources import catalog, files


def values(spark, rows, column="value"):
    return local_table(spark, [(r,) for r in rows], f"{column} string")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_external_ip(spark):
    cases = {"8.8.8.8": True, "10.1.1.9": False, "172.20.4.5": False, "1.2.3.4": False, "9.0.0.7": False, "93.184.216.34": True,
             "93.184.1.1": False, "093.184.216.34": False, "256.4.5.6": False, "203.0.113.9": False, "224.5.6.7": False}
    got = {r["value"]: r["ok"] for r in values(spark, cases).select("value", net.is_external_ip(F.col("value")).alias("ok")).collect()}
    assert got == cases


def test_entropy_and_lines(spark):
    df = values(spark, ["aabb", "", "abcd"]).select("value", T.char_entropy(F.col("value")).alias("e"))
    assert {r["value"]: round(r["e"], 6) for r in df.collect()} == {"aabb": 1.0, "": 0.0, "abcd": 2.0}
    lines = values(spark, ["a\r\nb\n", "a\n\n", "", "x"]).select(T.text_lines(F.col("value")).alias("l"))
    assert column(lines, "l") == [["a", "b"], ["a", ""], [], ["x"]]


def test_type_expansion(spark):
    specs = {"all": ["all"], "py,js": ["javascript", "python"], "scripts,-sh,-py": None, "all,-all": [], "bogus": []}
    got = {r["value"]: r["t"] for r in values(spark, specs).select("value", catalog.expand_file_types(F.col("value")).alias("t")).collect()}
    assert "shell" not in got["scripts,-sh,-py"] and "ruby" in got["scripts,-sh,-py"]
    assert all(got[k] == v for k, v in specs.items() if v is not None)


def test_hex_patterns(spark):
    df = spark.createDataFrame([(bytearray(b"\x00MZ\x01\x02PE\x90"),), (bytearray(b"MZPE"),)], "content binary")
    got = df.select(predicates.hex_hits(F.col("content"), "4D 5A [1-2] 50 ??").alias("h"))
    assert column(got, "h") == [["4D5A0102504 5".replace(" ", "")], []]


def test_utf16_and_class_files(spark):
    rows = [(bytearray("é x".encode("utf-16")),), (bytearray(b"\xfe\xff" + "é x".encode("utf-16-be")),), (bytearray("é x".encode()),)]
    df = spark.createDataFrame(rows, "content binary").select(files.normalized_text(F.col("content")).alias("t"))
    assert column(df, "t") == ["é x"] * 3
    kinds = spark.createDataFrame(
        [("a.bin", bytearray.fromhex("CAFEBABE00000034")), ("a.bin", bytearray.fromhex("CAFEBABE00000002")), ("a.py", bytearray(b"x"))],
        "path string, content binary",
    ).select(files.type_from_content(F.col("path"), F.col("content")).alias("k"))
    assert column(kinds, "k") == ["javaclass", "macho", "python"]


def test_quoted_spans_use_byte_offsets(spark):
    df = local_table(spark, [(1, "é \"a b\" 'c\\'d' \"\"")], "file_id bigint, text string")
    got = {(r["value"], r["offset"]) for r in extract.quoted_strings(df).collect()}
    assert got == {("a b", 4), ("c\\'d", 10)}


def test_comments_skip_strings(spark):
    df = local_table(spark, [(1, 'x = "// no"; // yes\n/* two\nlines */')], "file_id bigint, text string")
    assert sorted(column(extract.comments(df, "text", "c"), "comment")) == [" two\nlines ", " yes"]


def test_decode_layers_in_order(spark):
    import base64

    inner = b"import os  # a payload of some length"
    twice = base64.b64encode(base64.b64encode(inner)).decode()
    df = local_table(spark, [(1, 0, twice), (2, 0, "plain text only")], "file_id bigint, offset bigint, value string")
    got = decode.payloads(df).collect()
    assert [(r["file_id"], r["chain"], r["value"]) for r in got] == [(1, ["base64", "base64"], inner.decode())]


PATTERNS = ["abc", "bcd", "zz", "q", "hello world", "lo w", "ñandú"]
TEXTS = ["xxabcdxx", "hello world", "no match", "zz", "qqq", "el ñandú corre", ""]


def brute():
    return {(t, p) for t in TEXTS for p in PATTERNS if p in t}


@pytest.mark.parametrize("bound", [200_000, 2])
def test_literal_hits_small_and_large(spark, monkeypatch, bound):
    original = matching.small_rows
    monkeypatch.setattr(matching, "small_rows", lambda df, b=bound: original(df, bound))
    patterns = local_table(spark, [(f"r{i}", p) for i, p in enumerate(PATTERNS)], "rule_id string, pattern string")
    hits = matching.literal_hits(values(spark, TEXTS), patterns, ["value"])
    assert {(r["value"], r["pattern"]) for r in hits.collect()} == brute()


def test_regex_literals(spark):
    cases = {"^token=[0-9]+": "token", "abc*d": None, "abcd?e": "abc", r"a\.b\.c+": "a.b.c", "(x|y)abc": None, "a|bcd": None, r"\bword\b": "word"}
    got = {r["value"]: r["l"] for r in values(spark, cases).select("value", matching.regex_literal(F.col("value")).alias("l")).collect()}
    assert got == cases


@pytest.mark.parametrize("direct,combined,tests", [(64, 20_000, 200), (0, 20_000, 200), (0, 0, 1)])
def test_scan_paths_agree(spark, monkeypatch, direct, combined, tests):
    monkeypatch.setattr(scan, "MAX_DIRECT_RULES", direct)
    monkeypatch.setattr(scan, "MAX_COMBINED_RULES", combined)
    monkeypatch.setattr(matching, "TESTS_A_PASS", tests)
    none = [None] * 6
    make = lambda name, ctype, how, pattern, folded, low=None, high=None: (name, 1, 1.0, ctype, how, pattern, folded, ["all"], None, None, low, high, None, None)
    rules = [
        ("exact", 1, 1.0, "string", "exact", "abc", False, ["all"], *none), ("folded", 1, 1.0, "string", "exact", "ABC", True, ["all"], *none),
        ("part", 1, 1.0, "string", "substr", "bc", False, ["all"], *none), ("regex", 1, 1.0, "string", "regex", "^ab+c$", False, ["all"], *none),
        ("word", 1, 1.0, "string", "word", "two", False, ["all"], *none), ("ip", 1, 1.0, "string", "external_ip", None, False, ["all"], *none),
        make("inner", "string", "regex", "[a-z]+ two", False), make("part-folded", "string", "substr", "BC", True), make("headless", "string", "regex", "^[a-c]{3}$", False),
    ]
    facts = local_table(spark, [(1, "abc"), (1, "ABC"), (1, "abbc"), (2, "one two"), (2, "twofold"), (3, "at 93.184.216.34"), (3, "10.0.0.8"), *[(4, "abc")] * 3], "file_id bigint, value string")
    got = {(r["file_id"], r["rule_id"], r["hits"]) for r in scan.string_hits(facts, local_table(spark, rules, scan.RULE_SCHEMA)).collect()}
    assert got == {(1, "exact", 1), (1, "folded", 2), (1, "part", 2), (1, "part-folded", 3), (1, "regex", 2), (1, "headless", 1), (2, "word", 1), (2, "inner", 1), (3, "ip", 1),
                   *((4, r, 3) for r in ("exact", "folded", "part", "part-folded", "regex", "headless"))}
    raw = [make("mail", "raw", "substr", "MAIL", True), make("mails", "raw", "substr", "mail", False, 2), make("few", "raw", "regex", "ma[a-z]+", False, None, 1), make("say", "raw", "word", "say", True)]
    texts = local_table(spark, [(1, "Mail, mail and MAIL", "text", 19), (2, "say mail", "text", 8)], "file_id bigint, text string, file_type string, size_bytes bigint")
    found = scan.atomic_findings(texts, facts, local_table(spark, raw, scan.RULE_SCHEMA))
    assert {(r["file_id"], r["rule_id"], r["hits"]) for r in found.collect()} == {(1, "mail", 3), (1, "few", 1), (2, "mail", 1), (2, "few", 1), (2, "say", 1)}


def test_many_regexes_without_a_head(spark):
    rows = ["x1 yy q", "zz 22 abc5", "abc77", "none of them", "abc5", "abc5"]
    rules = [(f"r{i}", f"[a-z]+{i}$") for i in range(700)] + [(f"s{i}", f"[a-z ]*{i} abc") for i in range(700)]
    facts = local_table(spark, [(v,) for v in rows], "value string")
    hits = matching.regex_hits(facts, local_table(spark, rules, "rule_id string, pattern string"), ["value"])
    got = sorted((r["value"], r["rule_id"]) for r in hits.collect())
    assert got == sorted((v, name) for v in rows for name, p in rules if re.search(p, v))


def test_required_literals():
    cases = {"[a-z]+token=": "token=", "abc*d": None, r"\d+\.example\.com": ".example.com", "(x|y)long": "long", "one|other": None, "(?i)word": None, "a[]b]word{2}": "wor", "x{2}abc": "abc", r"\Qab\E": None}
    assert {r: matching.required_literal(r) for r in cases} == cases


def test_addresses_end_at_their_bound(spark):
    rows = ["see http://a.example/" + "x" * n + " end" for n in (900, 1500, 3000)]
    got = [r["u"] for r in values(spark, rows).select(F.regexp_extract_all("value", F.lit(K.SCRIPT_URL_RE), F.lit(0)).alias("u")).collect()]
    assert sorted(len(u[0]) for u in got) == [917, 1517, 2055]


def test_precision_of_nested_rules_and_circles(spark):
    rules = local_table(spark, [(f"c{i}", None, ["all"]) for i in range(6)] + [("x", None, ["all"]), ("y", None, ["all"])], "rule_id string, needs int, for_types array<string>")
    conds = local_table(spark, [(f"c{i}", "all", f"c{i - 1}" if i else "atom") for i in range(6)] + [("c5", "all", "atom"), ("x", "all", "y"), ("y", "all", "x")], "rule_id string, clause string, ref_id string")
    known = local_table(spark, [("atom", 2.5)], "rule_id string, precision double")
    got = {r["rule_id"]: r["precision"] for r in precision.composite_precision(rules, conds, known).collect()}
    assert got == {**{f"c{i}": 2.5 for i in range(5)}, "c5": 5.0, "x": 1.0, "y": 1.0}


def test_rules_behind_a_circle_get_its_value(spark):
    clauses = {
        "d::a": [("all", "d::b"), ("all", "five")], "d::b": [("all", "d::a")], "d::c": [("all", "d::a")], "d::d": [("any", "d::c"), ("any", "d::b"), ("none", "d::a")],
        "d::self": [("all", "d::self"), ("unless", "five"), ("all", None)], "e::a": [("all", "e::b")], "e::b": [("all", "e::c"), ("all", "d::c")], "e::c": [("any", "e::a"), ("any", "unknown")],
        "f::bare": [], "g::a": [("all", "e::a"), ("all", "d::d")],
    }
    rules = local_table(spark, [(r, 2 if r == "d::d" else None, ["all"]) for r in clauses], "rule_id string, needs int, for_types array<string>")
    conds = local_table(spark, [(r, clause, ref) for r, some in clauses.items() for clause, ref in some], "rule_id string, clause string, ref_id string")
    known = local_table(spark, [("five", 5.0)], "rule_id string, precision double")
    got = {r["rule_id"]: round(r["precision"], 6) for r in precision.composite_precision(rules, conds, known).collect()}
    a, b, c = 6.0, 1.0, 6.0
    d, ea = c + b + a + 0.3, 1.0
    assert got == {"d::a": a, "d::b": b, "d::c": c, "d::d": d, "d::self": 1.0 + 5.0 + 0.3, "e::a": ea, "e::b": 1.0 + c, "e::c": 1.0, "f::bare": 0.0, "g::a": ea + d}


def test_circle_edges_against_reachability(spark):
    rng = random.Random(11)
    for n, m in ((8, 10), (14, 22), (30, 36)):
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        ahead = {}
        for u, v in edges:
            ahead.setdefault(u, set()).add(v)

        def reach(u, seen):
            for v in ahead.get(u, ()):
                if v not in seen:
                    seen.add(v)
                    reach(v, seen)
            return seen

        want = {(u, v) for u, v in edges if u in reach(v, set()) or u == v}
        got = graph.circle_edges(local_table(spark, sorted(edges), "u string, v string"), "u", "v")
        assert {tuple(r) for r in got.collect()} == want


def test_samples_are_five_of_very_many(spark):
    facts = spark.range(3000).select((F.col("id") % 2).alias("file_id"), F.format_string("v%05d", "id").alias("symbol"))
    got = {r["file_id"]: (r["n"], r["sample"]) for r in predicates.counted_per_file(facts.select("file_id").distinct(), facts, "symbol").collect()}
    assert got == {f: (1500, [f"v{2 * k + f:05d}" for k in range(5)]) for f in (0, 1)}


def test_references(spark):
    known = local_table(spark, [("a/b::x",), ("a/b/c::y",), ("d::x",), ("a/bb::z",), ("legacy/x",)], "rule_id string")
    refs = local_table(spark, [("a/b::x",), ("x",), ("a/b",), ("q::x",)], "ref_id string")
    got = {(r["ref_id"], r["target_id"]) for r in matching.resolve_references(refs, known).collect()}
    assert got == {("a/b::x", "a/b::x"), ("x", "a/b::x"), ("x", "d::x"), ("x", "legacy/x"), ("a/b", "a/b::x"), ("a/b", "a/b/c::y")}


def _composites(spark, rules, findings, **more):
    rows = [(name, 1, 1.0, None, None, None, ["all"], None, None) for name in rules]
    conds = [(name, clause, i, ref) for name, clauses in rules.items() for clause, refs in clauses.items() for i, ref in enumerate(refs)]
    files = local_table(spark, [(i, "text", 10) for i in (1, 2)], "file_id bigint, file_type string, size_bytes bigint")
    found = local_table(spark, [(f, r, 1, 0) for f, r in findings], "file_id bigint, rule_id string, line_no bigint, offset bigint")
    catalog = local_table(spark, rows, "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, size_min bigint, size_max bigint")
    out = composites.evaluate_composites(files, found, found, catalog, local_table(spark, conds, "rule_id string, clause string, idx int, ref_id string"), **more)
    return {(r["file_id"], r["rule_id"]) for r in out.collect()}


def test_rules_may_refer_to_each_other(spark):
    circle = {"d::a": {"any": ["d::b", "x::1"]}, "d::b": {"any": ["d::a"]}, "d::p": {"all": ["d::q"]}, "d::q": {"all": ["d::p"]}, "e/f::self": {"any": ["e/f", "x::1"]}}
    assert _composites(spark, circle, [(1, "x::1"), (2, "y::1")]) == {(1, "d::a"), (1, "d::b"), (1, "e/f::self")}


def test_rounds_end_at_their_limit(spark):
    chain = {f"d::c{i}": {"all": [f"d::c{i - 1}" if i else "x::1"]} for i in range(12)}
    names = {(1, f"d::c{i}") for i in range(12)}
    assert _composites(spark, chain, [(1, "x::1")], max_rounds=12) == names
    assert _composites(spark, chain, [(1, "x::1")]) == {n for n in names if n[1] not in ("d::c10", "d::c11")}


def test_unless_sees_earlier_rounds_only(spark):
    rules = {"d::first": {"all": ["x::1"]}, "d::same": {"all": ["x::1"], "unless": ["d::first"]}, "d::later": {"all": ["d::first"], "unless": ["d::same"]}, "d::atomic": {"all": ["x::1"], "unless": ["x::2"]}}
    assert _composites(spark, rules, [(1, "x::1"), (2, "x::1"), (2, "x::2")]) == {(1, "d::first"), (1, "d::same"), (1, "d::atomic"), (2, "d::first"), (2, "d::same")}


def test_section_of_every_row(spark):
    strings = local_table(spark, [(1, 5, "a"), (1, 5, "a"), (1, 70000, "b"), (1, None, "c"), (2, 1, "d")], "file_id bigint, offset bigint, value string")
    parts = local_table(spark, [(1, ".b", 0, 9223372036854775807), (1, ".a", 0, 10), (1, ".c", 10, 10), (2, ".z", 2, 9)], "file_id bigint, name string, start bigint, end bigint")
    got = sorted((r["file_id"], r["offset"], r["section"]) for r in joins.containing_section(strings, parts).collect() if r["offset"] is not None)
    assert got == [(1, 5, ".a"), (1, 5, ".a"), (1, 70000, ".b"), (2, 1, None)]
    assert joins.containing_section(strings, parts).count() == 5


def test_renames_pair_until_none_is_left(spark):
    pairs = local_table(spark, [("r1", "a1", 0.95), ("r2", "a1", 0.97), ("r1", "a2", 0.92), ("r3", "a2", 0.92)], "baseline_path string, target_path string, score double")
    got = {(r["baseline_path"], r["target_path"]) for r in diff.best_pairs(pairs).collect()}
    assert got == {("r2", "a1"), ("r1", "a2")}
    assert diff.best_pairs(pairs.limit(0)).count() == 0


def test_many_conditions_need_several_masks(spark):
    hits = local_table(spark, [(1, "r", "any", i, f"t{i}") for i in range(130)], "file_id bigint, comp string, clause string, idx int, target_id string")
    assert column(composites.clause_counts(hits, composites.mask_blocks(129)), "n_any") == [130]


def test_near_pairs_are_those_of_proximity(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-50, 400)])) for _ in range(110)] + [(50, 8), (50, 8), (51, 9), (51, 19), (52, 9), (52, 18)]
    table = local_table(spark, rows, "k int, p int")
    got = sorted(column(windows.near_pairs(table, ["k"], "p", 9), "k"), key=str)
    assert got == sorted(column(windows.proximity(table, ["k"], "p", 9, 2), "k"), key=str)
    assert {50, 52} <= {*got} and 51 not in got


def test_proximity_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(4), rng.randrange(300)) for _ in range(200)]
    got = {r["k"]: r["near_count"] for r in windows.proximity(local_table(spark, rows, "k int, p int"), ["k"], "p", 9, 3).collect()}
    want = {}
    for k in range(4):
        mine = [p for q, p in rows if q == k]
        best = max(sum(1 for p in mine if s <= p <= s + 9) for s in mine)
        if best >= 3:
            want[k] = best
    assert got == want


def test_running_total_crosses_blocks(spark):
    rows = [(1, i * 7, i) for i in range(50)]
    df = windows.running_total(local_table(spark, rows, "k int, o bigint, n int"), "k", "o", "n", "before", block=16)
    assert {r["o"]: r["before"] for r in df.collect()} == {i * 7: sum(range(i)) for i in range(50)}


def test_first_n_is_exact(spark):
    rows = [(i % 3, i) for i in range(500)]
    got = windows.first_n_per_group(local_table(spark, rows, "k int, v int"), ["k"], [F.col("v").desc()], 4)
    assert sorted((r["k"], r["v"]) for r in got.collect()) == sorted((k, v) for k in range(3) for v in [x for x in range(499, -1, -1) if x % 3 == k][:4])


def test_one_edit_pairs(spark):
    names = ["react", "reac", "raect", "reactt", "preact", "axios", "reakt"]
    pairs = joins.one_edit_apart(values(spark, names, "a"), values(spark, ["react"], "b"), "a", "b")
    assert sorted(column(pairs, "a")) == ["preact", "reac", "reactt", "reakt"]


def test_applicable_rules_are_counted_by_type(spark):
    """Repeated files and rules, a file of two types, types without rules and none; rules are not paired with every file."""
    files_ = local_table(spark, [(i, ["en", "de", None, "xx"][i % 4]) for i in range(2000)] + [(0, "de"), (4, "en")], "file_id bigint, file_type string")
    rules = local_table(spark, [(f"r{i}", ["en", "de", "all", "fr", None][i % 5]) for i in range(3000)] + [("r2", "all"), ("r5", "en")], "rule_id string, file_type string")
    got = {r["file_id"]: (r["n_rules"], r["first_rule"]) for r in matching.applicable_counts(files_, rules).collect()}
    mine = {t: sorted({f"r{i}" for i in range(3000) if i % 5 == k or i % 5 == 2}) for k, t in enumerate(("en", "de"))}
    mine["xx"] = sorted({f"r{i}" for i in range(3000) if i % 5 == 2})
    want = {i: (len(mine[t]), mine[t][0]) for i in range(2000) if (t := ["en", "de", None, "xx"][i % 4])}
    assert got == want | {0: (len(mine["en"]) + len(mine["de"]), "r0"), 4: (2 * len(mine["en"]), "r0")}


def test_similar_names_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.choice([10, 21, 34]))) for _ in range(30)]

    def edit(s):
        i = rng.randrange(len(s))
        return rng.choice([s[:i] + s[i + 1 :], s[:i] + "z" + s[i:], s[:i] + "y" + s[i + 1 :]])

    other = [edit(edit(s)) if i % 3 else edit(s) for i, s in enumerate(base)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in base for b in other if 1 - distance(a, b) / max(len(a), len(b)) >= 0.9 - 1e-12}
    got = diff.similar_names(values(spark, [f"d/{s}" for s in base], "path"), values(spark, [f"d/{s}" for s in other], "path"))
    assert {(r["baseline_path"][2:], r["target_path"][2:]) for r in got.collect()} == want


def test_similar_names_of_one_template(spark):
    """Lengths on both sides of the next allowed edit; names that share most pieces are not compared with each other."""
    pairs = [("abcdefghij", "abcdefghi"), ("abcdefghijklmnopqrst", "bcdefghijklmnopqrsu"), ("abcdefghijklmnopqrstuvwxyz0123", "zabcdefghijklmnopqrstuvwxyz01"),
             ("abcdefghijklmnopqrst", "cdefghijklmnopqrst"), ("a", "a"), ("abc", "abd"), ("abcdefghijklmnopqrstuvwxyz012", "abXdefghijklmnopqrstuvwXyz0123")]
    got = diff.similar_names(values(spark, [f"{i}/{r}" for i, (r, _) in enumerate(pairs)], "path"), values(spark, [f"{i}/{a}" for i, (_, a) in enumerate(pairs)], "path"))
    assert {r["baseline_path"][0]: r["score"] for r in got.collect()} == {"0": 0.9, "1": 0.9, "2": 0.9, "3": 0.9, "4": 1.0, "6": 0.9}
    many = [f"d/long-report-name-{i * 7919 % 1000003:06d}.md" for i in range(3000)]
    near = diff._spelled_pairs(*(df.withColumns({"dir": diff.directory(F.col(p)), n: diff.basename(F.col(p))}) for df, p, n in zip(diff._sides(values(spark, many[:1500], "path"), values(spark, many[1500:], "path")), ("baseline_path", "target_path"), ("r_name", "a_name"))))
    assert near.count() < 40_000  # of 2,250,000 that share two of three pieces


def test_container_tree_numbers_members(spark):
    members = local_table(spark, [(1, 70000, "b"), (1, 5, "a!!x"), (1, 200000, "c")], "container_id bigint, file_id bigint, path string")
    roots = local_table(spark, [(1, "r.zip")], "container_id bigint, root_path string")
    got = sorted((r["id"], r["depth"], r["path"]) for r in containers.container_tree(roots, members).collect())
    assert got == [(0, 0, "r.zip"), (1, 1, "a!!x"), (2, 1, "r.zip!!b"), (3, 1, "r.zip!!c")]


def test_regexes_and_literals_meet_by_class(spark):
    """Ids may repeat with another criticality; a literal counts once for each id."""
    schema = "rule_id string, crit int, ctype string, for_types array<string>, case_insensitive boolean, exact string, substr string, regex string, word string"
    rng = random.Random(2)
    words = ["red", "green", "blue", "tan"]
    rows = [(f"l{i % 40}", i % 2, "string", ["all"], False, f"{rng.choice(words)} {rng.choice(words)} {i % 50}", None, None, None) for i in range(300)]
    rows += [(f"r{i % 9}", i % 3, "string", ["all"], False, None, None, "|".join(rng.sample(words, 2)), None) for i in range(24)]
    df = spark.createDataFrame(rows, schema)
    got = {r["rule_id"]: (r["other_id"], r["n"]) for r in catalog_checks.regex_matches_literal(df).collect()}
    want = {}
    for rule in {r[0] for r in rows if r[7]}:
        hits = [(l[0], l[5]) for r in rows if r[7] and r[0] == rule for l in rows if l[5] and l[1] == r[1] and re.search(r[7], l[5])]
        if hits:
            want[rule] = (min(i for i, _ in hits), len({v for _, v in hits}))
    assert got == want and len(want) > 5
    same = spark.createDataFrame([(p, 1, f"red green {i}", f"l{i}") for i in range(500) for p in ("red", "green")], "pattern string, crit int, value string, other_id string")
    classes = catalog_checks.literal_classes(same).collect()
    assert sorted((r["pattern"], r["n"], r["other_id"]) for r in classes) == [("green", 500, "l0"), ("red", 500, "l0")]


def test_entropies_equal_the_expression(spark):
    rng = random.Random(4)
    texts = ["", "a", "aaaa", "ab", "日本語🙂🙂", "x\0y", None, "qwerty" * 9, "".join(map(chr, range(33, 65))), "abc" * 200_000]
    texts += ["".join(rng.choices("abcdeé𐐷", k=rng.randrange(30))) for _ in range(300)]
    rows = values(spark, texts).select("value", metrics.entropies(F.col("value")).alias("got"), T.char_entropy(F.col("value")).alias("e")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["got"] == (None if r["e"] is None else pytest.approx(r["e"], rel=1e-9, abs=1e-12)), r["value"][:40]


def test_string_classes_of_words_and_signs(spark):
    words = ["netcat", "POWERSHELL", "deadbeef", "QUJDREVGR0hJSktM", "eval(x", "1=1--", "a@b.cc", "x.com", "http://x", "10.0.0.1", "a:b:c", "%41%42%43%44", "~", "plain", ""]
    rows = [(i, w) for i, w in enumerate(words) for _ in range(2)]
    got = {r["file_id"]: r for r in metrics.string_metrics(spark.createDataFrame(rows, "file_id int, value string")).collect()}
    flags = {r["value"]: r for r in metrics.string_class_flags(values(spark, words)).collect()}
    for i, w in enumerate(words):
        assert {k: got[i][k] for k in metrics.STRING_CLASSES} == {k: 2 * (w != "" and flags[w][k]) for k in metrics.STRING_CLASSES}, w


def test_cheap_tests_lose_no_match(spark):
    lengths = {"^[0-9]{16}$": 16, "[0-9a-f]{32,}": 32, "[a-z]{1,64}@[a-z.]{1,9}\\.[a-z]{2,3}": 6, "ab?c*d+": 2, "(abc)+x": 1, "a|bcd": 0, "[a[bc]d]e": 0, r"\bab\b": 2, r"\x41b": 0, "(?i)abc": 0}
    assert {r: matching.least_length(r) for r in lengths} == lengths
    texts = ["ab", "AB", "x@y.de", "@.de", "0" * 16, "0" * 15, "abcabcx", "acd", "be", "de", "x und y", "UND", "hund", "f" * 32, "1.2.3.4"]
    facts = local_table(spark, [(v,) for v in texts], "value string")
    plain = [r for r in lengths if r != "[a[bc]d]e"]
    for regex in plain:
        got = {r["value"] for r in facts.where(matching.tested(F.col("value"), regex)).collect()}
        assert got == {v for v in texts if re.search(regex, v)}, regex
    word = lambda folded: {r["value"] for r in facts.where(matching.word_tested(F.col("value"), "und", ("(?i)" if folded else "") + r"\b\Qund\E\b", folded)).collect()}
    assert word(False) == {"x und y"} and word(True) == {"x und y", "UND"}


def test_values_without_a_hit_build_no_keys(spark):
    rules = [("ip", 1, 1.0, "string", "external_ip", None, False, ["all"], *[None] * 6), ("hex", 1, 1.0, "string", "regex", "[0-9a-f]{32,}", False, ["all"], *[None] * 6)]
    facts = spark.range(10).select(F.col("id").alias("file_id"), F.col("id").cast("string").alias("value"))
    plan = scan.hits_of(facts, local_table(spark, rules, scan.RULE_SCHEMA), "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("octet_length(cast(id")


def test_a_batch_is_scanned_once(spark):
    from ruleloom.streaming.scan import scan_batch

    rules = local_table(spark, [("d::hex", 2, 1.0, "string", "regex", "[0-9a-f]{32,}", False, ["all"], *[None] * 6)], scan.RULE_SCHEMA)
    comps = local_table(spark, [("c::both", 3, 0.5, None, None, None, ["all"], None, None)], "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, size_min bigint, size_max bigint")
    conds = local_table(spark, [("c::both", "all", 0, "d::hex")], "rule_id string, clause string, idx int, ref_id string")
    files = local_table(spark, [(1, "text", 40, "x " + "a" * 32), (2, "text", 3, "abc")], "file_id bigint, file_type string, size_bytes bigint, text string")
    found = scan_batch(files, rules, comps, conds)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["file_id"], r["rule_id"], r["crit"]) for r in found.collect()} == {(1, "d::hex", 2), (1, "c::both", 3)}


def test_conditions_are_joined_once(spark, monkeypatch):
    plans, cut = [], precision.cut_lineage
    monkeypatch.setattr(precision, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    rules = local_table(spark, [("a", None, ["all"]), ("b", 1, ["elf"]), ("b", 2, ["elf"]), (None, None, ["elf"])], "rule_id string, needs int, for_types array<string>")
    conds = spark.range(7).select(F.element_at(F.array(*map(F.lit, "aabbb")), F.least(F.col("id") + 1, F.lit(5)).cast("int")).alias("rule_id"), F.when(F.col("id") < 4, "all").otherwise("any").alias("clause"), F.when(F.col("id") % 2 == 0, "a").otherwise("atom").alias("ref_id"))
    conds = conds.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("rule_id"), F.lit("all").alias("clause"), F.lit("a").alias("ref_id")))
    known = local_table(spark, [("atom", 2.5)], "rule_id string, precision double")
    got = sorted((str(r["rule_id"]), round(r["precision"], 6)) for r in precision.composite_precision(rules, conds, known).collect())
    assert sum("Range (0, 7" in p for p in plans) == 1
    assert got == [("None", 0.3), ("a", 3.5), ("b", 0.3 + 3.5 + 2.5 + 2.5), ("b", round(0.3 + 3.5 + 2.5 + 2.5 + 3.5, 6))]


def test_conditions_are_distinct_before_they_are_named(spark):
    from ruleloom.plans import catalog_tables as C

    li = spark.sql("select if(r % 7 = 0, null, o) l_orderkey, case when r % 11 = 0 then null when r % 5 = 0 then -p else p end l_partkey, case when r % 13 = 0 then null when r % 3 = 0 then -s else s end l_suppkey, cast(if(r % 17 = 0, null, r % 9) as int) l_linenumber from (select id r, (id * 31) % 60 - 30 o, (id * 17) % 50 p, (id * 7) % 30 s from range(5000))")
    named, plain = spark.sql(C.CONDS_ROWS, lineitem=li), spark.sql(C.CONDS, lineitem=li)
    assert named.dtypes == plain.dtypes and named.exceptAll(plain).isEmpty() and plain.exceptAll(named).isEmpty()
