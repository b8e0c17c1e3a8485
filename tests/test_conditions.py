"""Conditions as rows, the fact table they meet, and rules of a file as array expressions."""

import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import composites, conditions as C, facts as FA, rounds, scan
from ruleloom.session import local_table

FILES = "file_id bigint, file_type string, size_bytes bigint"


def conds(spark, *rows):
    return local_table(spark, [(r, "if", 0, None, C.condition(**c)) for r, c in rows], C.CONDS_SCHEMA)


def test_equal_conditions_are_one(spark):
    a = dict(kind="syscall", names=["open", "exec"], numbers=[2, 1])
    b = dict(kind="syscall", names=["exec", "open", "open"], numbers=[1, 2], case_insensitive=False)
    x = dict(kind="string", how="substr", pattern="AbC", case_insensitive=True)
    y = dict(kind="string", how="substr", pattern="aBc", case_insensitive=True)
    z = dict(kind="string", how="substr", pattern="abc")
    named = {r["rule_id"]: r["ref_id"] for r in C.named(conds(spark, ("a", a), ("b", b), ("x", x), ("y", y), ("z", z))).collect()}
    assert named["a"] == named["b"] and named["x"] == named["y"] and len(set(named.values())) == 3
    assert len(C.distinct_conditions(C.named(conds(spark, ("a", a), ("b", b), ("x", x), ("z", z))))) == 3


def test_unknown_kinds_and_fields_are_errors(spark):
    with pytest.raises(ValueError, match="yara"):
        C.distinct_conditions(C.named(conds(spark, ("a", dict(kind="yara", pattern="x")))))
    with pytest.raises(ValueError, match="glob"):
        C.distinct_conditions(C.named(conds(spark, ("a", dict(kind="string", how="glob", pattern="x")))))
    with pytest.raises(ValueError, match="colour"):
        C.condition(kind="string", colour="red")
    rules = local_table(spark, [("r", 1, 1.0, "symbol", "exact", "x", False, ["all"], None, None, None, None, None, None)], scan.RULE_SCHEMA)
    files = local_table(spark, [(1, "x", "text", 1)], "file_id bigint, text string, file_type string, size_bytes bigint")
    with pytest.raises(ValueError, match="symbol"):
        scan.atomic_findings(files, files.select("file_id", F.col("text").alias("value")), rules)


@pytest.mark.parametrize("direct", [True, False])
def test_grams_and_direct_tests_agree(spark, monkeypatch, direct):
    monkeypatch.setattr(C, "MAX_DIRECT", 64 if direct else 0)
    texts = ["Mail me at a@b.cd now", "mAIL", "x.mail()", "open /etc/passwd", "", "8.8.8.8 and 10.0.0.1", "10.0.0.1", "The wordy word", "abc" * 50]
    files = local_table(spark, [(i, "text", len(t)) for i, t in enumerate(texts)], FILES)
    content = local_table(spark, list(enumerate(texts)), "file_id bigint, text string")
    strings = local_table(spark, [(i, w, t.find(w)) for i, t in enumerate(texts) for w in t.split()], "file_id bigint, value string, offset bigint")
    symbols = local_table(spark, [(0, "_open", "import"), (1, "sym.imp.read", "export"), (2, "main", "function")], "file_id bigint, symbol string, kind string")
    facts = FA.together(FA.string_facts(strings), FA.content_facts(content, binary=True), FA.symbol_facts(symbols))
    cases = {
        "folded": (dict(kind="string", how="exact", pattern="MAIL", case_insensitive=True), {(0, 1), (1, 1)}),
        "part": (dict(kind="string", how="substr", pattern="mail"), {(2, 1)}),
        "word": (dict(kind="string", how="word", pattern="mail"), {(2, 1)}),
        "regex": (dict(kind="string", how="regex", pattern="[a-z]@b\\.c"), {(0, 1)}),
        "not": (dict(kind="string", how="substr", pattern="a", exceptions=[dict(how="exact", pattern="MAIL"), dict(how="regex", pattern="@")]), {(i, 1) for i in (0, 1, 2, 3, 5, 8)}),
        "import": (dict(kind="string", how="exact", pattern="open"), {(0, 1), (3, 1)}),
        "symbol": (dict(kind="symbol", how="regex", pattern="^(read|main)$"), {(1, 1), (2, 1)}),
        "any symbol": (dict(kind="symbol"), {(0, 1), (1, 1), (2, 1)}),
        "public": (dict(kind="string", external_ip=True), {(5, 1)}),
        "raw": (dict(kind="raw", how="substr", pattern="abc"), {(8, 50)}),
        "raw words": (dict(kind="raw", how="word", pattern="WORD", case_insensitive=True), {(7, 1)}),
        "raw place": (dict(kind="raw", how="substr", pattern="abc", low=2, high=-2), {(8, 48)}),
        "at": (dict(kind="string", how="regex", pattern=".", at=0), {(0, 2), (1, 2), *[(i, 1) for i in (2, 3, 5, 6, 7, 8)]}),
        "hex": (dict(kind="hex", pattern="2F 65 74 63 ?? [1-2]"), {(3, 1)}),
        "count": (dict(kind="string_count", how="regex", pattern="^[a-z]+$", e_min=3.0, n_min=0.0, n_max=1.0), {(i, 1) for i in (1, 2, 3, 4, 5, 6, 8)}),
    }
    # Imports and exports are strings without a place: `at` takes them, and file 0 has two
    # short words in lower case with its import.
    wanted = C.named(conds(spark, *[(name, c) for name, (c, _) in cases.items()]))
    ids = {r["rule_id"]: r["ref_id"] for r in wanted.collect()}
    found = {}
    for r in C.condition_hits(files, facts, C.distinct_conditions(wanted)).collect():
        found.setdefault(r["cond_id"], set()).add((r["file_id"], r["hits"]))
    assert {name: found.get(ref, set()) for name, ref in ids.items()} == {name: hits for name, (_, hits) in cases.items()}


def test_structured_values(spark):
    data = local_table(spark, [(1, '{"a": {"b": [1, "x", null, {"c": "deep"}]}, "l": ["p", "q"], "n": null, "f": true}'), (2, "not json"), (3, '[{"a": 1}]'), (4, "{}")], "file_id bigint, json string")
    paths = ["a.b", "a.b[*]", "a.b[1]", "a.b[*].c", "a.b[3].c", "l", "n", "f", "missing", "[*].a"]
    got = {(r["file_id"], r["key"], r["text"], r["number"]) for r in FA.kv_facts(data, paths).collect()}
    deep = '{"c":"deep"}'
    assert got == {
        (1, "", None, None), (3, "", None, None), (4, "", None, None),
        (1, "a.b", f'[1,"x",null,{deep}]', 4.0), (1, "a.b", "1", None), (1, "a.b", "x", None), (1, "a.b", deep, None),
        (1, "a.b[*]", "1", None), (1, "a.b[*]", "x", None), (1, "a.b[*]", deep, 1.0), (1, "a.b[1]", "x", None),
        (1, "a.b[*].c", "deep", None), (1, "a.b[3].c", "deep", None), (1, "l", '["p","q"]', 2.0), (1, "l", "p", None), (1, "l", "q", None),
        (1, "f", "true", None), (3, "[*].a", "1", None),
    }


def test_a_thousand_paths_are_parsed_once(spark):
    keys = [f"k{i}" for i in range(1000)]
    data = local_table(spark, [(1, "{" + ", ".join(f'"{k}": {{"v": {i}}}' for i, k in enumerate(keys)) + "}")], "file_id bigint, json string")
    found = FA.kv_facts(data, [f"{k}.v" for k in keys])
    got = {r["key"]: r["text"] for r in found.where("key <> ''").collect()}
    assert got == {f"{k}.v": str(i) for i, k in enumerate(keys)}


# -- rules of a file in one row -----------------------------------------------------------------

RULES = "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, size_min bigint, size_max bigint"


def evaluate(spark, rules, findings, **more):
    """`rules`: {id: clauses and fields}; `findings`: (file, rule, line, offset)."""
    rows = [(name, r.get("crit", 2), 0.5, r.get("needs"), r.get("near_lines"), r.get("near_bytes"), r.get("for_types", ["all"]), None, None) for name, r in rules.items()]
    clauses = [(name, c, i, ref) for name, r in rules.items() for c in ("all", "any", "none", "unless", "down_all", "down_any", "down_none") for i, ref in enumerate(r.get(c, []))]
    files = local_table(spark, [(f, "text", 10) for f in sorted({f for f, *_ in findings} | {99})], FILES)
    found = local_table(spark, findings, "file_id bigint, rule_id string, line_no bigint, offset bigint")
    out = composites.evaluate_composites(files, found, found, local_table(spark, rows, RULES), local_table(spark, clauses, "rule_id string, clause string, idx int, ref_id string"), **more)
    return out


def test_proximity_over_rules_waits_for_them(spark):
    rules = {
        "d::pair": {"all": ["x::a", "x::b"]},
        "d::near": {"all": ["d::pair"], "needs": 3, "near_lines": 10},
        "d::both": {"any": ["d::pair", "x::c"], "needs": 2, "near_lines": 50, "near_bytes": 5},
        "d::behind": {"all": ["d::near"], "unless": ["d::pair2"]},
        "d::pair2": {"all": ["d::behind"]},
        "d::after": {"all": ["d::pair2", "d::near"], "near_lines": 3, "needs": 2},
        "d::plain": {"any": ["x::a", "x::b"], "needs": 2, "near_bytes": 4},
    }
    findings = [
        (1, "x::a", 1, 100), (1, "x::b", 5, 102), (1, "x::b", 9, 900), (1, "x::c", 500, 104),
        (2, "x::a", 1, 100), (2, "x::b", 50, 500), (2, "x::b", 90, 900),
        (3, "x::a", 1, 1), (3, "x::a", 2, 2),
    ]
    got = {(r["file_id"], r["rule_id"]) for r in evaluate(spark, rules, findings).collect()}
    one = {"d::pair", "d::near", "d::both", "d::behind", "d::pair2", "d::plain", "d::after"}
    assert got == {*[(1, r) for r in one], (2, "d::pair")}


@pytest.mark.parametrize("columns", [16, 0])
def test_rules_against_plain_rounds(spark, monkeypatch, columns):
    monkeypatch.setattr(rounds, "MAX_COLUMNS", columns)
    rng = random.Random(5)
    atoms = [f"x/{i % 7}::a{i}" for i in range(90)]
    names = [f"r/{i % 3}::c{i}" for i in range(40)]
    rules = {}
    for i, name in enumerate(names):
        pick = lambda n: [rng.choice([*atoms, *names, "x/1", "x/2", "none::such", "a9"]) for _ in range(n)]
        r = {"any": pick(rng.randrange(1, 5))} if i % 2 else {"all": pick(rng.randrange(1, 3))}
        if i % 4 == 0:
            r |= {"unless": pick(1)}
        if i % 9 == 0:
            r |= {"none": pick(2)}
        if i % 5 == 0:
            r |= {"needs": 2, "any": pick(3)}
        if i % 3 == 0:
            r |= {rng.choice(["down_all", "down_any", "down_none"]): pick(2)}
        rules[name] = r
    found = {f: set(rng.sample(atoms, rng.randrange(1, 40))) for f in range(25)} | {99: set()}
    rows = [(f, a, 1, 1) for f, some in found.items() for a in some]

    known = {a for some in found.values() for a in some} | set(names)

    def targets(ref):
        if ref in known:
            return {ref}
        if "::" in ref:
            return set()
        if "/" in ref:
            return {k for k in known if k.startswith((ref + "::", ref + "/"))}
        return {k for k in known if k.endswith(("::" + ref, "/" + ref))}

    negative = {n for n, r in rules.items() if r.get("none")}

    def count(r, clause, seen):
        return sum(bool((targets(x) - negative) & seen) for x in r.get(clause, []))

    def holds(r, seen):
        some = not r.get("any") or count(r, "any", seen) >= r.get("needs", 1)
        return count(r, "all", seen) == len(r.get("all", [])) and some and not count(r, "none", seen) and not count(r, "unless", seen)

    want = {}
    for f, atoms_ in found.items():
        seen, fired = set(atoms_), set()
        fresh = set(atoms_)
        for _ in range(10):
            fresh = {n for n, r in rules.items() if n not in negative | fired and any((targets(x) - negative) & fresh for c in ("all", "any") for x in r.get(c, [])) and holds(r, seen)}
            if not fresh:
                break
            fired |= fresh
            seen |= fresh
        fired |= {n for n in negative if holds(rules[n], seen)}
        seen |= fired
        for n in fired:
            r = rules[n]
            hit = lambda x: bool(targets(x) & seen)
            down = (all(map(hit, r["down_all"])) if r.get("down_all") else any(map(hit, r["down_any"])) if r.get("down_any") else not any(map(hit, r["down_none"])) if r.get("down_none") else False)
            want[f, n] = 1 if down else 2
    for refs in (False, True):
        got = {(r["file_id"], r["rule_id"]): r["crit"] for r in evaluate(spark, rules, rows, with_refs=refs).collect()}
        assert got == want


def test_a_small_catalog_is_written_out(spark):
    """No condition is looked up row by row, and a circle of rules does not make the plan grow from round to round."""
    rules = {"d::a": {"any": ["d::b", "x::1"]}, "d::b": {"any": ["d::a", "d::c"]}, "d::c": {"all": ["d::b"], "down_any": ["x::1"]}, "d::none": {"none": ["d::c"]}}
    out = evaluate(spark, rules, [(1, "x::1", 1, 1), (2, "x::2", 1, 1)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "aggregate(" not in plan and len(plan) < 200_000
    assert {(r["file_id"], r["rule_id"], r["crit"]) for r in out.collect()} == {(1, "d::a", 2), (1, "d::b", 2), (1, "d::c", 1), (2, "d::none", 2), (99, "d::none", 2)}


def test_matched_ids_are_those_met_when_a_rule_fires(spark):
    rules = {"d::a": {"any": ["x", "d::b"], "all": ["x::1"]}, "d::b": {"all": ["d::a"]}, "d::none": {"none": ["x::9"], "any": ["x::2", "x::3"]}}
    got = {(r["file_id"], r["rule_id"]): r["trait_refs"] for r in evaluate(spark, rules, [(1, "x::1", 1, 1), (1, "x::2", 1, 1), (1, "y/x", 1, 1)], with_refs=True).collect()}
    assert got == {(1, "d::a"): ["x::1", "y/x"], (1, "d::b"): ["d::a"], (1, "d::none"): ["x::2"]}


def test_a_directory_of_many_ids_is_one_target(spark):
    findings = [(f, f"metadata/import/npm::p{i}", None, None) for f in (1, 2) for i in range(f, 3000, 2)]
    rules = {"d::imports": {"all": ["metadata/import/npm"]}, "d::one": {"any": ["metadata/import/npm::p7"]}}
    assert {(r["file_id"], r["rule_id"]) for r in evaluate(spark, rules, findings).collect()} == {(1, "d::imports"), (2, "d::imports"), (1, "d::one")}


def test_structured_facts_parse_each_text_once(spark):
    """Steps over nulls, scalars and odd names; the plan reads its input in one place."""
    texts = ['{"a":{"b c":1,"n":null},"d":[{"n":"x"},5,null,{"n":["y",null]}]}', "[[1,2],[3]]", "bad{", None, "null", '{"d":{"n":"z"},"a":[]}']
    data = local_table(spark, list(enumerate(texts)), "file_id bigint, json string")
    found = FA.kv_facts(data, ["a.b c", "a.n", "a", "d[*].n", "d[3].n", "[*]", "[0][1]"])
    got = sorted((r["file_id"], r["key"], r["text"] or "", r["number"]) for r in found.collect())
    assert got == sorted([
        (0, "", "", None), (1, "", "", None), (4, "", "", None), (5, "", "", None), (0, "a.b c", "1", None), (0, "a", '{"b c":1,"n":null}', 2.0), (0, "d[*].n", "x", None),
        (0, "d[*].n", '["y",null]', 2.0), (0, "d[*].n", "y", None), (0, "d[3].n", '["y",null]', 2.0), (0, "d[3].n", "y", None),
        (1, "[*]", "[1,2]", 2.0), (1, "[*]", "1", None), (1, "[*]", "2", None), (1, "[*]", "[3]", 1.0), (1, "[*]", "3", None), (1, "[0][1]", "2", None), (5, "a", "[]", 0.0),
    ])
    assert found._jdf.queryExecution().executedPlan().toString().count("LocalTableScan") <= 2


# -- conditions that are written out ------------------------------------------------------------

EVERY = [
    dict(kind="kv", key="a.b", how="exact", pattern="X", case_insensitive=True), dict(kind="kv", key="a", n_min=1.0, n_max=2.0), dict(kind="kv", key="l", how="regex", pattern="^p"),
    dict(kind="kv", key="a.b", exists=False), dict(kind="metrics", key="text.size_bytes", n_min=2.0), dict(kind="structure", key="x/y", n_min=1.0), dict(kind="structure", key="x/y/"),
    dict(kind="syscall", names=["open", "exec"], others=["ARM"]), dict(kind="syscall", numbers=[3, 5]), dict(kind="syscall"), dict(kind="encoded", names=["hex"], how="substr", pattern="b"),
    dict(kind="section", how="substr", pattern="te", n_min=5.0, e_max=6.0, readable=True, writable=False), dict(kind="section_ratio", pattern="^t", n_min=0.2, n_max=0.9),
    dict(kind="section_ratio", pattern="^t", key="^[td]", n_min=0.1), dict(kind="import_combination", names=["re", "op"], others=["x$", "^o"], n_min=1.0, n_max=3.0),
    dict(kind="exports_count", n_min=1.0, n_max=1.0), dict(kind="exports_count", n_max=0.0), dict(kind="string", how="substr", pattern="b", section="text", low=1, high=-1),
    dict(kind="string", how="regex", pattern="[a-z]", low=0, high=3), dict(kind="raw", how="substr", pattern="b", low=1, high=4), dict(kind="raw", how="regex", pattern="b.", low=-4, high=-1),
    dict(kind="raw", how="exact", pattern="ABABéb", case_insensitive=True), dict(kind="raw", how="substr", pattern="b", section="text"), dict(kind="basename", how="word", pattern="f"),
    dict(kind="string_count", how="substr", pattern="b", n_min=0.0, n_max=1.0),
]


def mixed_facts(spark):
    """Facts of all kinds with nulls, of which file 1 is in the file table twice and file 4 not at all."""
    files = local_table(spark, [(i, "text", 6) for i in (0, 1, 1, 2, 3, None)], FILES)
    content = local_table(spark, [(0, "ababéb"), (1, "xbbb"), (2, None), (3, ""), (4, "bb")], "file_id bigint, text string")
    strings = local_table(spark, [(i, v, o) for i in (0, 1, 4, None) for v, o in (("b", 1), ("ab", 0), (None, 2), ("bb", None), ("b", 9))], "file_id bigint, value string, offset bigint")
    symbols = local_table(spark, [(0, "sym.read", "import"), (0, "_openx", "import"), (0, "b", "export"), (1, "__re", "import"), (2, None, "export"), (2, "fcn.b", "function")], "file_id bigint, symbol string, kind string")
    parts = local_table(spark, [(i, n, s, s + 6, 6, 5.0, p) for i in (0, 1, 2) for n, s, p in (("text", 1, "r-x"), (".text", 0, "r--"), ("data", 7, None))], 'file_id bigint, name string, `start` bigint, `end` bigint, size bigint, entropy double, permissions string')
    data = local_table(spark, [(0, '{"a": {"b": "x"}, "l": ["p", "q"]}'), (1, '{"a": [1, {"b": 2}], "l": "p"}'), (2, "{"), (3, '{"a": {"b": null}}')], "file_id bigint, json string")
    calls = local_table(spark, [(0, "arm64", "open", 3), (0, "x86", "exec", 5), (1, None, None, 5), (2, "ARM", "exec", None)], "file_id bigint, arch string, name string, number int")
    facts = FA.together(
        FA.string_facts(strings), FA.content_facts(content), FA.symbol_facts(symbols), FA.section_facts(parts), FA.kv_facts(data, ["a", "a.b", "l"]), FA.syscall_facts(calls),
        FA.structure_facts(local_table(spark, [(0, "x/y"), (0, "x/y/z"), (1, "x/yy"), (2, "x/y//z"), (3, None)], "file_id bigint, feature_id string")),
        FA.metric_facts(local_table(spark, [(0, "text.size_bytes", 2.0), (1, "text.size_bytes", 1.0), (2, "other", 9.0)], "file_id bigint, field string, value double")),
        FA.encoded_facts(local_table(spark, [(0, "b", ["hex"]), (1, "b", ["base64", "hex"]), (2, "b", ["base64"]), (3, None, ["hex"])], "file_id bigint, value string, encoding_chain array<string>")),
        FA.basename_facts(local_table(spark, [(0, "d/f.txt"), (1, "f/d.txt")], "file_id bigint, path string")),
    )
    return files, facts, parts


@pytest.mark.parametrize("placed", [True, False])
def test_conditions_written_out_and_looked_up_agree(spark, monkeypatch, placed):
    files, facts, parts = mixed_facts(spark)
    some = [c for c in EVERY if placed or not {"section", "low", "high"} & {*c}]
    wanted = C.distinct_conditions(C.named(conds(spark, *[(str(i), c) for i, c in enumerate(some)])))
    found = []
    for most in (64, 0):
        monkeypatch.setattr(C, "MAX_DIRECT", most)
        hits = C.condition_hits(files, facts, wanted, parts)
        found.append(sorted(map(tuple, hits.join(files.select("file_id").distinct(), "file_id").select("file_id", "cond_id", "hits", "sample").collect()), key=repr))
    assert found[0] == found[1] and len({cond for _, cond, *_ in found[0]}) >= len(wanted) - 3


def test_content_is_cut_before_it_meets_its_file(spark, monkeypatch):
    carried, placed = [], C._placed
    monkeypatch.setattr(C, "_placed", lambda hits, *more, **named: carried.append(hits.columns) or placed(hits, *more, **named))
    files = local_table(spark, [(0, "text", 9)], FILES)
    facts = FA.content_facts(local_table(spark, [(0, "abc" * 3)], "file_id bigint, text string"))
    wanted = C.distinct_conditions(C.named(conds(spark, ("a", dict(kind="raw", how="substr", pattern="abc", low=0, high=5)), ("b", dict(kind="raw", how="substr", pattern="c")))))
    hits = C.condition_hits(files, facts, wanted)
    assert sorted(r["hits"] for r in hits.collect()) == [1, 3]
    assert len(carried) == 1 and "text" not in carried[0]
    assert C._head({**C.condition(kind="raw", low=0, high=5)})._jc.toString().lower().startswith("substr")


def test_structured_facts_are_made_once(spark):
    """Files with nothing at a path are found without a second pass over all facts."""
    read = spark.sparkContext.accumulator(0)
    files = local_table(spark, [(0, "json", 2), (1, "json", 2)], FILES)
    data = local_table(spark, [(0, "{}"), (1, '{"a": 1}')], "file_id bigint, json string")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    facts = FA.kv_facts(data.mapInArrow(counted, data.schema), ["a"])
    wanted = C.distinct_conditions(C.named(conds(spark, ("a", dict(kind="kv", key="a", exists=False)))))
    assert [(r["file_id"], r["hits"]) for r in C.condition_hits(files, facts, wanted).collect()] == [(0, 1)]
    assert read.value == 2
