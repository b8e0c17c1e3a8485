"""Spelling variants: frequent words one edit away from a much more frequent one.

Near words are the pairs that an acceptor of the vocabulary, a transducer of exactly one
edit and the acceptor again accept together. No task holds the whole vocabulary: two near
words are equal before the edit and behind it, so words meet by what lies outside a
window of places where the first difference may be. Each such group is one initial state
of the acceptor of its task, and the pairs of a group are enumerated from its state. A
group that is too large is cut into those of two windows of half the width, down to a
single place, where one or two characters are all that its words differ in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import hand_back, kept_state, slices, small
from ruleloom.session import cut_lineage

RATE = 199
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
# Words of one group at most, unless its window is a single place.
GROUP_WORDS = 20_000
# Words, and composed states, that a task works on at a time.
BLOCK_WORDS = 60_000
STATES = 1 << 20
EQUAL_STATES = 1 << 13
BUFFER = 1 << 18

# Characters are Latin-1 bytes, which bytes.lower() lower-cases A-Z of alone.
RUNS = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """How often a document has each word of MIN_LENGTH characters or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. If the
    crc32 h of `doc_id:run` (a null id is empty there) is divisible by RATE, the run loses
    its character number h modulo its length.
    """
    runs = Counter(RUNS.findall((text or "").encode("latin-1", "replace").lower()))
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hashes = ((run, crc32(run if run.isalpha() else run.decode("latin-1").encode(), start)) for run in runs)
    damaged = [(run, h % len(run), runs[run]) for run, h in hashes if h % RATE == 0]
    for run, _, _ in damaged:
        del runs[run]
    for run, at, n in damaged:
        if len(run) > MIN_LENGTH:
            runs[run[:at] + run[at + 1 :]] += n
    return runs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's documents, added up as far as a buffer holds them."""
    kept_state(None)
    held: Counter = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words, n = list(held), list(held.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[i : i + 50_000]]), pa.array(n[i : i + 50_000], pa.int64())], names=["word", "n"])

    for batch in batches:
        for ids, texts in slices(batch, 1):
            for doc_id, text in zip(ids, texts):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
            if len(held) > BUFFER:
                yield from rows()
                held.clear()
    yield from rows()
    hand_back()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): all words of `docs` with their occurrences, from `min_count` on.

    Null and empty texts have no words; repeated rows count each; other columns are not
    read. Counts are added up in each task before they are shuffled.
    """
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_counts, "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# A window (a, lo, hi): the shorter word of a pair has `a` characters, and lo to hi of them
# are equal before the first difference.


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (word, n, a, lo, hi) with the group they meet in, and the part that differs."""
    behind = F.greatest(F.col("a") - 1 - F.col("hi"), F.lit(0))
    end = F.length("word") - behind
    group = F.concat_ws("\x1f", "a", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", end + 1, behind))
    return rows.withColumn("group", group).withColumn("part", F.substring("word", F.col("lo") + 1, end - F.col("lo")))


def _windows(words: DataFrame) -> DataFrame:
    """Every word in the windows of the pairs it may be the shorter or the longer word of."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("a")).where(F.col("a") >= MIN_LENGTH)
    middle = F.floor((F.col("a") + 1) / 2).cast("int")
    window = lambda lo, hi: F.struct(F.lit(lo).alias("lo") if isinstance(lo, int) else lo.alias("lo"), hi.alias("hi"))
    return rows.withColumn("w", F.explode(F.array(window(0, middle - 1), window(middle, F.col("a"))))).select("word", "n", "a", "w.lo", "w.hi")


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(group, part, word, n, a, lo, hi): the rows that meet in groups of two words or more."""
    done, rows = None, _windows(words)
    while True:
        rows = cut_lineage(_grouped(rows))
        sizes = rows.groupBy("group").agg(F.count("*").alias("words"), F.min(F.length("word")).alias("least"))
        kept = sizes.where((F.col("words") > 1) & (F.col("least") == F.split("group", "\x1f")[0].cast("int")))
        large = cut_lineage(kept.where((F.col("words") > group_words) & (F.split("group", "\x1f")[1] != F.split("group", "\x1f")[2])).select("group"))
        fine = rows.join(kept.select("group"), "group", "left_semi").join(small(large), "group", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if large.isEmpty():
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct((middle + 1).alias("lo"), "hi")))
        rows = rows.join(small(large), "group", "left_semi").withColumn("w", halves).select("word", "n", "a", "w.lo", "w.hi")


@dataclass
class Acceptor:
    """A minimised deterministic acceptor with one initial state for each group.

    The arcs of state s are first[s] to first[s + 1], by symbol. before[x] words are
    accepted from a state ahead of those that begin with arc x, so the sum along a path is
    a word's place among the sorted words of its group.
    """

    initial: np.ndarray
    final: np.ndarray
    first: np.ndarray
    symbol: np.ndarray
    target: np.ndarray
    before: np.ndarray


def _ids(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows get equal numbers: (the number of each row, a row for each number)."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    number = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out, order[new]


def accept(group: np.ndarray, parts: list[bytes]) -> Acceptor:
    """The minimised acceptor of sorted distinct strings, sorted by group number first.

    The tree of the strings is folded from its leaves: states of equal height are one if
    they agree on being final and on their arcs. A list of arcs is numbered from its last
    one on, as (symbol, target, the rest of the list).
    """
    rows, width = len(parts), max(map(len, parts), default=0)
    size = np.array([len(p) for p in parts], np.int64)
    signs = np.zeros((rows, width + 1), np.uint8)
    for i, p in enumerate(parts):
        signs[i, : len(p)] = np.frombuffer(p, np.uint8)
    # A node (depth, row) begins where a row differs from the one above in its first signs.
    common = np.full(rows, -1, np.int64)
    if rows > 1:
        same = np.cumprod(signs[1:, :width] == signs[:-1, :width], axis=1).sum(axis=1) if width else np.zeros(rows - 1, np.int64)
        common[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)
    starts, bases, total = [], [0], 0
    for depth in range(width + 1):
        at = np.flatnonzero((common < depth) & (size >= depth))
        starts.append(at)
        total += len(at)
        bases.append(total)
    depth_of = np.repeat(np.arange(width + 1), [len(s) for s in starts])
    row_of = np.concatenate(starts)
    final = size[row_of] == depth_of
    parent = np.full(total, -1, np.int64)
    for depth in range(1, width + 1):
        parent[bases[depth] : bases[depth + 1]] = bases[depth - 1] + np.searchsorted(starts[depth - 1], starts[depth], side="right") - 1
    height = np.zeros(total, np.int64)
    for depth in range(width, 0, -1):
        nodes = slice(bases[depth], bases[depth + 1])
        np.maximum.at(height, parent[nodes], height[nodes] + 1)
    # Arcs by parent; within one they are in the order of their symbols already.
    arcs = np.argsort(parent[bases[1] :], kind="stable") + bases[1]
    arc_from = parent[arcs]
    arc_symbol = signs[row_of[arcs], depth_of[arcs] - 1].astype(np.int64)
    arc_first = np.searchsorted(arc_from, np.arange(total + 1))
    degree = np.diff(arc_first)

    state = np.full(total, -1, np.int64)
    kept: list[np.ndarray] = []
    count = 0
    for h in range(height.max(initial=0) + 1):
        nodes = np.flatnonzero(height == h)
        lists = np.full(len(nodes), -1, np.int64)
        base = 0
        for back in range(1, int(degree[nodes].max(initial=0)) + 1):
            mine = np.flatnonzero(degree[nodes] >= back)
            arc = arc_first[nodes[mine] + 1] - back
            number, some = _ids(arc_symbol[arc], state[arcs[arc]], lists[mine])
            lists[mine] = base + number
            base += len(some)
        number, some = _ids(final[nodes].astype(np.int64), lists)
        state[nodes] = count + number
        kept.append(nodes[some])
        count += len(some)
    node = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    degrees = degree[node]
    first = np.concatenate(([0], np.cumsum(degrees)))
    source = np.repeat(np.arange(len(node)), degrees)
    arc = arc_first[node][source] + np.arange(first[-1]) - first[source]
    target = state[arcs[arc]]
    accepted = final[node].astype(np.int64)
    before = np.zeros(first[-1], np.int64)
    # Targets are of lower height and so have lower numbers: heights in turn.
    for h in range(1, height.max(initial=0) + 1):
        mine = np.flatnonzero(height[node][source] == h)
        if len(mine):
            of, words = source[mine], accepted[target[mine]]
            run = np.cumsum(words) - words
            head = np.concatenate(([True], of[1:] != of[:-1]))
            before[mine] = run - run[head][np.cumsum(head) - 1] + accepted[of]
            np.add.at(accepted, of, words)
    return Acceptor(state[: bases[1]], final[node], first, arc_symbol[arc], target, before)


def _out(a: Acceptor, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All arcs of some states: the place of the state among them, and the arc."""
    degree = a.first[states + 1] - a.first[states]
    at = np.repeat(np.arange(len(states)), degree)
    return at, a.first[states][at] + np.arange(len(at)) - np.repeat(np.cumsum(degree) - degree, degree)


def _step(a: Acceptor, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The arc of each state with the given symbol, or -1."""
    lo, hi = a.first[states].copy(), a.first[states + 1]
    end = hi.copy()
    while (lo < hi).any():
        middle = (lo + hi) // 2
        less = np.zeros(len(lo), bool)
        open_ = lo < hi
        less[open_] = a.symbol[middle[open_]] < symbols[open_]
        lo, hi = np.where(open_ & less, middle + 1, lo), np.where(open_ & ~less, middle, hi)
    found = lo < end
    found[found] = a.symbol[lo[found]] == symbols[found]
    return np.where(found, lo, -1)


def compose(a: Acceptor, places: np.ndarray, widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words that acceptor, one edit and acceptor accept, as places of words.

    `places` is the place of each group's first word, `widths` how many symbols may come
    before the edit. The edit is made where the words first differ: one symbol for
    another, or a symbol of the second word that the first one doesn't have and doesn't go
    on with. Every pair is found once: the longer word second, and of equal lengths the
    first one first.

    States are worked on in bounded blocks, the deepest ones first.
    """
    # Equal so far: (place so far, state, symbols that may follow before the edit). Edited: (place one, place two, state one, state
    # two, symbol that the first word must not go on with).
    equal = [(places, a.initial, widths)]
    edited: list[tuple[np.ndarray, ...]] = []
    none = -1

    def block(stack: list, most: int) -> tuple[np.ndarray, ...]:
        rows = stack.pop()
        if len(rows[0]) > most:
            stack.append(tuple(c[most:] for c in rows))
        return tuple(c[:most] for c in rows)

    while equal or edited:
        if edited:
            one, two, left, right, barred = block(edited, STATES)
            both = a.final[left] & a.final[right]
            if both.any():
                yield one[both], two[both]
            at, arc = _out(a, left)
            fits = a.symbol[arc] != barred[at]
            at, arc = at[fits], arc[fits]
            other = _step(a, right[at], a.symbol[arc])
            met = other >= 0
            if met.any():
                at, arc, other = at[met], arc[met], other[met]
                edited.append((one[at] + a.before[arc], two[at] + a.before[other], a.target[arc], a.target[other], np.full(len(at), none)))
            continue
        place, state, width = block(equal, EQUAL_STATES)
        at, arc = _out(a, state)
        if not len(at):
            continue
        after = place[at] + a.before[arc]
        edited.append((place[at], after, state[at], a.target[arc], a.symbol[arc]))
        # The arcs of a state in pairs, the first one with each behind it.
        later = a.first[state][at] + (a.first[state + 1] - a.first[state])[at] - arc - 1
        which = np.repeat(np.arange(len(at)), later)
        if len(which):
            second = which + 1 + np.arange(len(which)) - np.repeat(np.cumsum(later) - later, later)
            edited.append((after[which], after[second], a.target[arc[which]], a.target[arc[second]], np.full(len(which), none)))
        more = width[at] > 0
        if more.any():
            equal.append((after[more], a.target[arc[more]], width[at[more]] - 1))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, best): near words of each word in a block, counted, with the best one."""
    kept_state(None)
    names, types = ["word", "near", "best"], [pa.string(), pa.int64(), pa.struct([("m", pa.int64()), ("word", pa.string())])]
    held: list[tuple] = []

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        group = np.cumsum([i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))]) - 1
        lo, hi, least = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        size = np.array([len(r[2]) for r in rows], np.int64)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        a = accept(group, [r[1].encode("latin-1") for r in rows])
        n = np.array([r[3] for r in rows], np.int64)
        # Sorted words have ranks, so of equally frequent ones the first is the best.
        rank = np.empty(len(rows), np.int64)
        rank[sorted(range(len(rows)), key=lambda i: rows[i][2])] = np.arange(len(rows))
        near, best = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        order = np.lexsort((-rank, n))
        grade = np.empty(len(rows), np.int64)
        grade[order] = np.arange(len(rows))
        for one, two in compose(a, heads, (hi - lo)[heads]):
            fits = np.minimum(size[one], size[two]) == least[one]
            one, two = one[fits], two[fits]
            for x, y in ((one, two), (two, one)):
                np.add.at(near, x, 1)
                np.maximum.at(best, x, grade[y])
        some = np.flatnonzero(near)
        of = order[best[some]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in some], types[0]), pa.array(near[some]), pa.array([{"m": int(n[j]), "word": rows[j][2]} for j in of], types[2])], names=names
        )

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= BLOCK_WORDS:
            # The last group may go on in the next batch.
            end = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            if end:
                yield from block(held[:end])
                held = held[end:]
    if held:
        yield from block(held)
    hand_back()


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best): how many near words each word has, and the most frequent one.

    `words`: word, n, distinct words of Latin-1 characters with MIN_LENGTH or more of them.
    Two words are near if exactly one inserted, deleted or replaced character lies between
    them. Words without a near one are left out.
    """
    rows = groups(words, group_words).select("group", "part", "word", "n", "lo", "hi", "a")
    stream = rows.repartition("group").sortWithinPartitions("group", "part")
    found = stream.mapInArrow(_near, "word string, near long, best struct<m:bigint,word:string>")
    # The largest n, then the least word: the least of (-n, word).
    least = F.min(F.struct((-F.col("best.m")).alias("m"), F.col("best.word").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that have a form, following forms to the last word.

    `forms`: word, form. A form is more frequent than its word, so there are no circles.
    Each round replaces what a pointer points to by what that one points to.
    """
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(state.join(small(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def group_variants(words: DataFrame, times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """Every word with its form, its root and its near words.

    `words` as `vocabulary` returns them. A word's form is its near word of largest n
    (ties: the first in code-point order) if that is at least `times` its own n, else
    null; its root is where the forms end, itself without one. Returns word, form, root,
    n, n_near and form_n. An empty vocabulary gives an empty table.
    """
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, group_words).withColumnRenamed("word", "_word")
    best: Column = -F.col("best.m")
    fits = F.coalesce(best >= F.col("n") * times, F.lit(False))
    told = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word",
        F.when(fits, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, best).alias("form_n"),
    )
    told = cut_lineage(told)
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
