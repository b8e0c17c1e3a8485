"""Composite rules of one file as array expressions over what was found in it.

A file is one row: the ids found in it are bits of an array of longs, and each condition
of a rule is a set of masks. All rounds, the rules with a `none` clause and the downgrades
are expressions over that row, so nothing is shuffled between rounds. Proximity needs the
places of the evidence. Where a rule's conditions are atomic its evidence is known from the
start, and whether it is near enough together is one more bit of the file. Where they are
composites, a file in which the rule holds otherwise waits, the places are joined, and it
goes on from there.

A catalog of few rules is written out as tests of bits, which Spark compiles: each round
has the rules that can fire in it. A larger one stands in the plan as one literal, however
many rules it has, and its tests are looked up there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import ids
from ruleloom.operators.matching import is_small
from ruleloom.operators.windows import near_pairs, proximity
from ruleloom.session import cut_lineage, local_table

BITS = 62
NEAR = "near::"
# Up to so many words the bits are columns of one aggregation.
MAX_COLUMNS = 16
# Up to so many conditions, over all rounds, the tests are written out.
MAX_TESTS = 1000
CELLS = "array<struct<w:int,m:bigint>>"
RULE = (
    "struct<p:int,rule_id:string,crit:int,conf:double,bit:int,needs:int,types:array<string>,size_min:bigint,size_max:bigint,"
    f"near:boolean,keep:boolean,any_of:boolean,targets:array<int>,all:array<{CELLS}>,any:array<{CELLS}>,none:{CELLS},unless:{CELLS},"
    f"down:string,down_all:array<{CELLS}>,down_any:{CELLS},down_none:{CELLS}>"
)
USED = "array<struct<p:int,b:int,t:array<int>,atoms:array<int>>>"
INTS = "array<int>"


# The expressions are SQL text: as calls on columns, building them took longer than a round.


def let(value: str, name: str, body: str) -> str:
    """`body`, in which `name` is a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _bit(i: str) -> str:
    return f"shiftleft(1L, cast({i} % {BITS} as int))"


def _word(i: str) -> str:
    return f"cast({i} div {BITS} as int)"


def has(found: str, i: str) -> str:
    return f"((get({found}, {_word(i)}) & {_bit(i)}) <> 0)"


def met(cells: str, found: str) -> str:
    """Whether any id of a condition was found."""
    return f"exists({cells}, cell -> (get({found}, cell.w) & cell.m) <> 0)"


def _none(kind: str) -> str:
    return f"cast(array() as {kind})"


class Catalog:
    """The rules and their conditions, numbered and put into literals.

    `resolved` has a row for each id a condition stands for, and one with a null
    `target_id` for a condition that stands for none.
    """

    def __init__(self, rules: list, resolved: list, with_refs: bool) -> None:
        sizes: dict[tuple[str, str], set[int]] = {}
        targets: dict[tuple[str, str, int], set[str]] = {}
        for c in resolved:
            sizes.setdefault((c["rule_id"], c["clause"]), set()).add(c["idx"])
            if c["target_id"] is not None:
                targets.setdefault((c["rule_id"], c["clause"], c["idx"]), set()).add(c["target_id"])
        # A rule with proximity over atomic ids has a bit of its own for being near enough.
        near = {r["rule_id"] for r in rules if r["near_lines"] is not None or r["near_bytes"] is not None}
        composite = {r["rule_id"] for r in rules}
        positive = {name: {t for (r, clause, _), some in targets.items() if r == name and clause in ("all", "any") for t in some} for name in near}
        self.settled = {name for name, some in positive.items() if some and not some & composite}
        for name in self.settled:
            targets[name, "all", -1] = {NEAR + name}
            sizes.setdefault((name, "all"), set()).add(-1)
        self.ids = sorted({t for some in targets.values() for t in some})
        number = {name: i for i, name in enumerate(self.ids)}
        negative = {r["rule_id"] for r in rules if (r["rule_id"], "none") in sizes}
        self.near = {r["rule_id"]: r for r in rules if r["near_lines"] is not None or r["near_bytes"] is not None}

        def of(rule: str, clause: str, usable: bool) -> list[list[int]]:
            found = (targets.get((rule, clause, i), ()) for i in sorted(sizes.get((rule, clause), ())))
            return [sorted(number[t] for t in some if not (usable and t in negative)) for some in found]

        # Composites whose evidence a rule with proximity can reach.
        built_on = {r: {self.ids[t] for clause in ("all", "any") for some in of(r, clause, True) for t in some} & composite for r in composite}
        # Of settled rules the places are known from the start.
        carried, reached = set(self.near) - self.settled, set(self.near) - self.settled
        while reached:
            reached = {t for r in reached for t in built_on[r]} - carried
            carried |= reached
        self.rules: list[dict] = []
        self.users: list[list[int]] = [[] for _ in self.ids]
        self.negative: list[int] = []
        self.near_ids: set[str] = set()
        self.waits = [False, False]  # whether files can wait for proximity: in the rounds, and at the rules with `none`
        for p, r in enumerate(rules):
            name = r["rule_id"]
            clauses = {c: of(name, c, True) for c in ("all", "any", "none", "unless")}
            down = {c: of(name, c, False) for c in ("down_all", "down_any", "down_none")}
            flat = lambda lists: sorted({t for some in lists for t in some})
            mine = [t for t in flat(clauses["all"] + clauses["any"]) if not self.ids[t].startswith(NEAR)]
            close = name in self.near
            waits = close and name not in self.settled and bool(clauses["all"] or clauses["any"])
            keep = with_refs or name in carried
            self.rules.append(
                {
                    "p": p, "rule_id": name, "crit": r["crit"], "conf": 1.0 if close or r["conf"] is None else min(r["conf"], 1.0),
                    "bit": number.get(name, -1), "needs": 1 if r["needs"] is None else r["needs"], "types": list(r["for_types"]),
                    "size_min": r["size_min"], "size_max": r["size_max"], "near": waits, "keep": keep,
                    "any_of": bool(clauses["any"]), "targets": mine if keep else [],
                    "all": [_cells(some) for some in clauses["all"]], "any": [_cells(some) for some in clauses["any"]],
                    "none": _cells(flat(clauses["none"])), "unless": _cells(flat(clauses["unless"])),
                    "down": next((c for c in ("down_all", "down_any", "down_none") if down[c]), None),
                    "down_all": [_cells(some) for some in down["down_all"]], "down_any": _cells(flat(down["down_any"])), "down_none": _cells(flat(down["down_none"])),
                }
            )
            if name in negative:
                self.negative.append(p)
            else:
                for t in flat(clauses["all"] + clauses["any"]):
                    self.users[t].append(p)
            self.waits[name in negative] |= waits
            if name in carried | self.settled:
                self.near_ids |= {self.ids[t] for t in mine} - composite
        self.place = {r["rule_id"]: r["p"] for r in self.rules}
        self.positive = {name: {number[t] for t in positive[name]} for name in self.settled}
        self.number = number
        self.words = max(1, -(-len(self.ids) // BITS))

    def by_round(self, max_rounds: int) -> list[list[int]] | None:
        """The rules that can fire in each round, or None if their tests are too many to be written out.

        From the second round on a rule needs an id that one of the round before adds.
        """
        out, left = [], MAX_TESTS - sum(map(self._tests, range(len(self.rules))))
        mine = sorted({p for some in self.users for p in some})
        while mine and len(out) < max_rounds:
            out.append(mine)
            left -= sum(map(self._tests, mine))
            mine = sorted({p for q in mine if self.rules[q]["bit"] >= 0 for p in self.users[self.rules[q]["bit"]]})
        return out if left >= 0 and self.words <= MAX_COLUMNS else None

    def _tests(self, p: int) -> int:
        r = self.rules[p]
        return 1 + sum(map(len, (*r["all"], *r["any"], r["none"], r["unless"], *r["down_all"], r["down_any"], r["down_none"])))

    def literal(self, value: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def columns(self) -> dict[str, Column]:
        return {"rules": self.literal(self.rules, f"array<{RULE}>"), "users": self.literal(self.users, f"array<{INTS}>")}


def _cells(numbers: list[int]) -> list[dict]:
    words: dict[int, int] = {}
    for i in numbers:
        words[i // BITS] = words.get(i // BITS, 0) | 1 << (i % BITS)
    return [{"w": w, "m": m} for w, m in sorted(words.items())]


def numbered(rows: DataFrame, members: DataFrame, catalog: Catalog, wanted: set[str] | None = None) -> DataFrame:
    """Rows of a rule_id with `i`, the number of the target it belongs to."""
    numbers = local_table(rows.sparkSession, [(i, t) for i, t in enumerate(catalog.ids) if wanted is None or t in wanted], "i int, target string")
    placed = members.join(F.broadcast(numbers), "target").select("rule_id", "i")
    return rows.join(F.broadcast(placed) if is_small(placed) else placed, "rule_id")


def file_rows(files: DataFrame, findings: DataFrame, near: DataFrame | None, members: DataFrame, catalog: Catalog) -> DataFrame:
    """(file_id, file_type, size_bytes, found): every file with the ids found in it as bits.

    `near` (file_id, i) has the bits of rules whose evidence is near enough together.
    """
    spark = files.sparkSession
    hits = numbered(findings, members, catalog).select("file_id", "i")
    hits = hits if near is None else hits.unionByName(near)
    seen = hits.select("file_id", F.expr(_word("i")).alias("w"), F.expr(_bit("i")).alias("m"))
    zero = F.lit(0).cast("bigint")
    if catalog.words <= MAX_COLUMNS:
        words = [F.coalesce(F.bit_or(F.when(F.col("w") == w, F.col("m"))), zero) for w in range(catalog.words)]
        found = seen.groupBy("file_id").agg(*[m.alias(f"_w{w}") for w, m in enumerate(words)])
        found = found.select("file_id", F.array(*[f"_w{w}" for w in range(catalog.words)]).alias("found"))
    else:
        some = seen.groupBy("file_id", "w").agg(F.bit_or("m").alias("m")).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("by"))
        at = F.sequence(F.lit(0), F.lit(catalog.words - 1))
        found = some.select("file_id", F.transform(at, lambda w: F.coalesce(F.try_element_at("by", w), zero)).alias("found"))
    none = F.array_repeat(zero, catalog.words)
    # Rows are narrow and take long: a number given here is not lowered for being few bytes.
    spread = files.select("file_id", "file_type", "size_bytes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_id")
    return spread.join(found, "file_id", "left").withColumn("found", F.coalesce("found", none))


def _numbers_in(found: str) -> str:
    """The numbers of the bits that are set."""
    words = f"filter(transform({found}, (m, w) -> named_struct('m', m, 'w', w)), x -> x.m <> 0)"
    return f"flatten(transform({words}, x -> transform(filter(sequence(0, {BITS - 1}), i -> (x.m & shiftleft(1L, i)) <> 0), i -> x.w * {BITS} + i)))"


def _holds(r: str, found: str) -> str:
    """Gates, `all`, `any` with `needs`, `none` and `unless`; not yet proximity."""
    types = f"(array_contains({r}.types, 'all') or coalesce(array_contains({r}.types, file_type), false))"
    low = f"({r}.size_min is null or coalesce(size_bytes >= {r}.size_min, false))"
    high = f"({r}.size_max is null or coalesce(size_bytes <= {r}.size_max, false))"
    every = f"forall({r}.all, cells -> {met('cells', found)})"
    some = f"(not {r}.any_of or size(filter({r}.any, cells -> {met('cells', found)})) >= {r}.needs)"
    return f"({types} and {low} and {high} and {every} and {some} and not {met(f'{r}.none', found)} and not {met(f'{r}.unless', found)})"


def _used(rules: str, found: str, used: str) -> str:
    """For rules that keep it: the ids their conditions met, and the atomic ids behind those."""
    behind = f"coalesce(get(filter({used}, u -> u.b = i), 0).atoms, array(i))"
    entry = f"named_struct('p', q.p, 'b', q.bit, 't', t, 'atoms', flatten(transform(t, i -> {behind})))"
    here = f"filter(q.targets, i -> {has(found, 'i')})"
    return f"transform(filter({rules}, q -> q.keep), q -> {let(here, 't', entry)})"


STATE = ("found", "fresh", "fired", "used", "pending", "waiting", "round")


def _state(s: str, **changed: str) -> str:
    """A state with some of its fields replaced."""
    return "named_struct(" + ", ".join(f"'{name}', {changed.get(name, f'{s}.{name}')}" for name in STATE) + ")"


def _fire(s: str, fired: str) -> str:
    """The state after some rules (structs) fired in it."""
    new = f"transform({s}.found, (m, w) -> aggregate(filter(bits, b -> {_word('b')} = w), 0L, (a, b) -> a | {_bit('b')}))"
    after = _state(
        s, found=f"zip_with({s}.found, new, (m, n) -> m | n)", fresh="new", fired=f"concat({s}.fired, transform({fired}, f -> f.p))", used=f"concat({s}.used, {_used(fired, f'{s}.found', f'{s}.used')})",
        pending=_none(INTS), waiting=_none(INTS),
    )
    return let(f"filter(transform({fired}, f -> f.bit), b -> b >= 0)", "bits", let(new, "new", after))


def _or_pause(s: str, holding: str) -> str:
    """The state after rules fired, or waiting for proximity if one of them needs it."""
    pause = _state(s, pending=f"transform(filter({holding}, h -> h.near), h -> h.p)", waiting=f"transform(filter({holding}, h -> not h.near), h -> h.p)")
    return f"if(exists({holding}, h -> h.near), {pause}, {_fire(s, holding)})"


def _round(s: str, max_rounds: int) -> str:
    """One round: the rules that refer to something new, on what earlier rounds found."""
    mine = f"array_except(array_distinct(flatten(transform({_numbers_in(f'{s}.fresh')}, i -> get(users, i)))), {s}.fired)"
    holding = f"filter(transform({mine}, p -> get(rules, p)), r -> {_holds('r', f'{s}.found')})"
    after = let(_state(s, round=f"{s}.round + 1"), "n", let(holding, "held", _or_pause("n", "held")))
    return f"if(not exists({s}.fresh, m -> m <> 0) or size({s}.pending) > 0 or {s}.round >= {max_rounds}, {s}, {after})"


def _start() -> Column:
    empty = {"fired": _none(INTS), "used": _none(USED), "pending": _none(INTS), "waiting": _none(INTS), "round": "0"}
    return F.expr(_state("", found="found", fresh="found", **empty))


def _mask(numbers: list[int], word: int) -> int:
    return sum(1 << (i % BITS) for i in numbers if i // BITS == word)


def _any_of(cells: list[dict], words: str = "w") -> str:
    """Whether any id of a condition was found, as tests of the columns that hold the words."""
    return "(" + (" or ".join(f"({words}{c['w']} & {c['m']}L) <> 0" for c in cells) or "false") + ")"


def _or(masks: list[str]) -> str:
    return "(" + (" | ".join(masks) or "0L") + ")"


def _written_out(r: dict) -> str:
    """What `_holds` tests of a rule, apart from its gates."""
    tests = [_any_of(cells) for cells in r["all"]]
    if r["any_of"]:
        tests.append("(" + " + ".join(f"if({_any_of(cells)}, 1, 0)" for cells in r["any"]) + f") >= {r['needs']}")
    tests += [f"not {_any_of(r[clause])}" for clause in ("none", "unless") if r[clause]]
    return " and ".join(tests) or "true"


def _gate(r: dict) -> Column:
    gate = F.lit(True) if "all" in r["types"] else F.coalesce(F.col("file_type").isin([t for t in r["types"] if t is not None]), F.lit(False))
    if r["size_min"] is not None:
        gate = gate & F.coalesce(F.col("size_bytes") >= r["size_min"], F.lit(False))
    if r["size_max"] is not None:
        gate = gate & F.coalesce(F.col("size_bytes") <= r["size_max"], F.lit(False))
    return gate


def _numbers(mask: str, rules: list[int]) -> str:
    """The rules whose bits are set in the columns of a mask."""
    set_ = ", ".join(f"if(({mask}{p // BITS} & {1 << p % BITS}L) <> 0, {p}, -1)" for p in rules)
    return f"array_remove(array({set_}), -1)" if rules else _none(INTS)


def _written_rounds(df: DataFrame, catalog: Catalog, steps: list[list[int]], last: bool) -> DataFrame:
    """Rows (…, s) after rounds whose rules are known, or after the rules with `none` (`last`).

    The words of the state are columns w (found), f (fresh), d (rules that fired), p and q
    (rules that are pending or wait) while the rounds last; a round makes h, the rules that
    hold, and n, the bits these add. g has the rules whose gates let a file pass.
    """
    rules, words = catalog.rules, range(catalog.words)
    blocks = range(max(1, -(-len(rules) // BITS)))
    everyone = sorted({p for some in steps for p in some})
    targets = {p: _cells([t for t, some in enumerate(catalog.users) if p in some]) for p in everyone}
    other = [c for c in df.columns if c != "s"]
    carried = [*(f"{x}{i}" for x in "wf" for i in words), *(f"{x}{j}" for x in "dpqg" for j in blocks)]
    gates = [reduce(Column.bitwiseOR, [F.when(_gate(rules[p]), F.lit(1 << p % BITS)).otherwise(F.lit(0)).cast("bigint") for p in everyone if p // BITS == j] or [F.lit(0).cast("bigint")]) for j in blocks]
    fired = [_or([f"if(array_contains(s.fired, {p}), {1 << p % BITS}L, 0L)" for p in everyone if p // BITS == j]) for j in blocks]
    rows = df.select(
        *other, "s", *[F.expr(f"s.{name}[{i}]").alias(f"{x}{i}") for x, name in (("w", "found"), ("f", "fresh")) for i in words],
        *[F.expr(m).alias(f"d{j}") for j, m in enumerate(fired)], *[F.lit(0).cast("bigint").alias(f"{x}{j}") for x in "pq" for j in blocks],
        *[g.alias(f"g{j}") for j, g in enumerate(gates)], F.col("s.used").alias("used"), F.col("s.round").alias("round"),
    )
    for k, mine in enumerate(steps):
        new = " or ".join(f"f{i} <> 0" for i in words)
        idle = " and ".join(f"p{j} = 0" for j in blocks)
        runs = "true" if last else f"(round = {k} and ({new}) and ({idle}))"
        held: dict[int, list[str]] = {j: [] for j in blocks}
        for p in mine:
            bit = 1 << p % BITS
            fresh = "" if last else f"{_any_of(targets[p], 'f')} and (d{p // BITS} & {bit}L) = 0 and "
            held[p // BITS].append(f"if((g{p // BITS} & {bit}L) <> 0 and {fresh}{_written_out(rules[p])}, {bit}L, 0L)")
        rows = rows.selectExpr(*other, "s", *carried, "used", "round", f"{runs} as runs", *[f"if({runs}, {_or(held[j])}, 0L) as h{j}" for j in blocks])
        adds = [_or([f"if((h{p // BITS} & {1 << p % BITS}L) <> 0, {1 << rules[p]['bit'] % BITS}L, 0L)" for p in mine if rules[p]["bit"] >= 0 and rules[p]["bit"] // BITS == i]) for i in words]
        near = [_mask([p for p in mine if rules[p]["near"]], j) for j in blocks]
        pause = " or ".join(f"(h{j} & {m}L) <> 0" for j, m in enumerate(near) if m) or "false"
        rows = rows.selectExpr(*other, "s", *carried, "used", "round", "runs", *[f"h{j}" for j in blocks], *[f"{a} as n{i}" for i, a in enumerate(adds)], f"({pause}) as pause")
        keep = [p for p in mine if rules[p]["keep"]]
        used = "used"
        if keep:
            kept = " or ".join(f"(h{j} & {m}L) <> 0" for j in blocks if (m := _mask(keep, j)))
            entries = let(f"array({', '.join(f'w{i}' for i in words)})", "found", let(f"transform({_numbers('h', keep)}, i -> get(rules, i))", "held", _used("held", "found", "used")))
            used = f"if(not pause and ({kept}), concat(used, {entries}), used)"
            rows = rows.withColumns(catalog.columns())
        rows = rows.selectExpr(
            *other, "s", *[f"if(pause, w{i}, w{i} | n{i}) as w{i}" for i in words], *[f"if(runs, n{i}, f{i}) as f{i}" for i in words],
            *[f"if(pause, d{j}, d{j} | h{j}) as d{j}" for j in blocks], *[f"if(pause, h{j} & {m}L, p{j}) as p{j}" for j, m in enumerate(near)],
            *[f"if(pause, h{j} & ~{m}L, q{j}) as q{j}" for j, m in enumerate(near)], *[f"g{j}" for j in blocks], f"{used} as used", "round" if last else f"if(runs, {k + 1}, round) as round",
        )
    array = lambda x: f"array({', '.join(f'{x}{i}' for i in words)})"
    before = f"filter(s.fired, i -> not i in ({', '.join(map(str, everyone)) or -1}))" if last else None
    now = _numbers("d", everyone)
    return rows.selectExpr(
        *other, _state("s", found=array("w"), fresh=array("f"), fired=f"concat(s.fired, {now})" if before else now, used="used", pending=_numbers("p", everyone), waiting=_numbers("q", everyone), round="round") + " as s"
    )


def _resume() -> Column:
    """The state after the rules that waited for proximity: those in `close` fire too."""
    fired = f"concat(s.waiting, array_intersect(s.pending, coalesce(close, {_none(INTS)})))"
    return F.expr(let(f"transform({fired}, p -> get(rules, p))", "held", _fire("s", "held")))


def _near_enough(found: DataFrame, catalog: Catalog, rules: list[str]) -> DataFrame:
    """(file_id, p): the rules whose evidence (file_id, p, line_no, offset) is near enough together.

    Rules with the same span and count share one pass; the catalog has few such pairs.
    """
    parts, tests = [], {}
    for position, field in (("line_no", "near_lines"), ("offset", "near_bytes")):
        groups: dict[tuple[int, int], list[int]] = {}
        for name in rules:
            rule, p = catalog.near[name], catalog.place[name]
            if rule[field] is not None:
                tests[p] = tests.get(p, 0) + 1
                groups.setdefault((rule[field], max(rule["needs"] or 1, 1)), []).append(p)
        for (span, needed), mine in groups.items():
            rows = found if len(mine) == len(rules) else found.where(F.col("p").isin(mine))
            near = near_pairs(rows, ["file_id", "p"], position, span) if needed == 2 else proximity(rows, ["file_id", "p"], position, span, needed)
            parts.append(near.select("file_id", "p"))
    both = [p for p, n in tests.items() if n == 2]
    passed = reduce(DataFrame.unionByName, parts)
    if both:
        passed = passed.groupBy("file_id", "p").agg(F.count("*").alias("n")).where(~F.col("p").isin(both) | (F.col("n") == 2)).drop("n")
    return passed


def _settled(located: DataFrame, catalog: Catalog) -> DataFrame:
    """(file_id, i): the bits of rules with proximity whose evidence is known from the start."""
    spark = located.sparkSession
    uses = local_table(spark, [(i, catalog.place[name]) for name in sorted(catalog.settled) for i in sorted(catalog.positive[name])], "i int, p int")
    bits = local_table(spark, [(catalog.place[name], catalog.number[NEAR + name]) for name in sorted(catalog.settled)], "p int, i int")
    found = located.join(F.broadcast(uses), "i").select("file_id", "p", "line_no", "offset")
    return _near_enough(found, catalog, sorted(catalog.settled)).join(F.broadcast(bits), "p").select("file_id", "i")


def _close(waiting: DataFrame, located: DataFrame, catalog: Catalog, literals: dict[str, Column]) -> DataFrame:
    """(file_id, close): the pending rules whose evidence is near enough together."""
    rows = waiting.withColumns(literals).select("file_id", F.expr("explode(transform(s.pending, p -> get(rules, p)))").alias("r"), "s")
    atoms = F.expr(f"get({_used('array(r)', 's.found', 's.used')}, 0).atoms")
    wanted = rows.select("file_id", F.col("r.p").alias("p"), F.explode(atoms).alias("i"))
    found = wanted.join(located, ["file_id", "i"]).select("file_id", "p", "line_no", "offset")
    open_ = [name for name in catalog.near if name not in catalog.settled]
    return _near_enough(found, catalog, sorted(open_)).groupBy("file_id").agg(F.collect_set("p").alias("close"))


def _until_done(rows: DataFrame, located: DataFrame | None, catalog: Catalog, literals: dict[str, Column], step: Callable[[DataFrame], DataFrame], again: bool) -> DataFrame:
    """Rows (…, s) after `step`, with proximity joined for as long as files wait for it."""
    if not catalog.waits[not again]:
        return step(rows)
    done = []
    while True:
        rows = cut_lineage(step(rows))
        done.append(rows.where(F.size("s.pending") == 0))
        waiting = rows.where(F.size("s.pending") > 0)
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
        near = _close(waiting, located, catalog, literals)
        rows = waiting.join(near, "file_id", "left").withColumns(literals).withColumn("s", _resume()).drop("close", *literals)
        if not again:
            return reduce(DataFrame.unionByName, [*done, rows])


def _lowered(catalog: Catalog, rules: list[int]) -> str:
    """The rules whose downgrade applies, as words; `all` decides if given, then `any`, then `none`."""

    def test(r: dict) -> str:
        if r["down"] == "down_all":
            return " and ".join(map(_any_of, r["down_all"]))
        return _any_of(r["down_any"]) if r["down"] == "down_any" else f"not {_any_of(r['down_none'])}"

    blocks = range(max(1, -(-len(catalog.rules) // BITS)))
    masks = [_or([f"if({test(catalog.rules[p])}, {1 << p % BITS}L, 0L)" for p in rules if p // BITS == j and catalog.rules[p]["down"]]) for j in blocks]
    return f"array({', '.join(masks)})"


def _downgraded(r: str, found: str) -> str:
    """`all` decides if given, then `any`, then `none`."""
    return (
        f"case {r}.down when 'down_all' then forall({r}.down_all, cells -> {met('cells', found)}) "
        f"when 'down_any' then {met(f'{r}.down_any', found)} when 'down_none' then not {met(f'{r}.down_none', found)} else false end"
    )


def run(files: DataFrame, findings: DataFrame, evidence: DataFrame, members: DataFrame, catalog: Catalog, max_rounds: int, with_refs: bool) -> DataFrame:
    """(file_id, rule_id, crit, conf[, trait_refs]) of the composites that fire.

    `members` has the target (a name of the catalog's `ids`) of each id of the findings.
    """
    literals = catalog.columns()
    located = near = None
    if catalog.near_ids:
        located = numbered(evidence, members, catalog, catalog.near_ids).select("file_id", "i", "line_no", "offset")
    if catalog.settled:
        near = _settled(located, catalog)

    steps = catalog.by_round(max_rounds)

    def stepped(df: DataFrame, step: str) -> DataFrame:
        return df.withColumns(literals).withColumn("s", F.expr(step)).drop(*literals)

    def rounds(df: DataFrame) -> DataFrame:
        if steps is not None:
            return _written_rounds(df, catalog, steps, last=False)
        return stepped(df, f"aggregate(sequence(1, {max_rounds}), s, (v, x) -> {_round('v', max_rounds)})")

    def last(df: DataFrame) -> DataFrame:
        if steps is not None:
            return _written_rounds(df, catalog, [catalog.negative], last=True)
        mine = f"filter(transform(array({', '.join(map(str, catalog.negative))}), p -> get(rules, p)), r -> {_holds('r', 's.found')})"
        return stepped(df, let(mine, "held", _or_pause("s", "held")))

    rows = file_rows(files, findings, near, members, catalog).withColumn("s", _start()).drop("found")
    rows = _until_done(rows, located, catalog, literals, rounds, again=True)
    if catalog.negative:
        rows = _until_done(rows, located, catalog, literals, last, again=False)
    fired = rows
    if steps is None:
        lowered, held = _downgraded("get(rules, p)", "s.found"), F.lit(None).alias("lowered")
    else:
        at = fired.select("*", *[F.expr(f"s.found[{i}]").alias(f"w{i}") for i in range(catalog.words)])
        fired, lowered, held = at, has("lowered", "p"), F.expr(_lowered(catalog, [*range(len(catalog.rules))])).alias("lowered")
    # Not `explode`: it would test the array before the rounds, whose expressions would stand in that filter again and again.
    each = fired.select("file_id", "s", held).select("file_id", "s", "lowered", F.explode_outer("s.fired").alias("p")).where("p is not null").withColumns(literals)
    crit = F.expr("get(rules, p).crit")
    out = each.select(
        "file_id",
        F.expr("get(rules, p).rule_id").alias("rule_id"),
        F.when(F.expr(lowered), ids.downgraded(crit)).otherwise(crit).alias("crit"),
        F.expr("get(rules, p).conf").alias("conf"),
        "s",
        "p",
    )
    if with_refs:
        names = catalog.literal(catalog.ids, "array<string>")
        refs = F.expr("array_sort(transform(get(filter(s.used, u -> u.p = p), 0).t, t -> get(names, t)))")
        out = out.withColumn("names", names).withColumn("trait_refs", refs).drop("names")
    return out.drop("s", "p")
