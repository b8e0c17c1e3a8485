"""Best-fit packing of documents into fixed-length sequences.

Only lengths matter, and there are at most as many as a sequence has tokens. So the
driver sees a histogram and decides how many sequences of which composition to make; the
pieces then find their places by number, without meeting each other.

The compositions solve a configuration linear program: cover every length as often as it
occurs, with as few sequences as possible. Multiplicative weights give lengths that lag
behind a larger price, a knapsack by dynamic programming finds for every length the most
valuable sequence that holds it, and the fractional solution is rounded down. What is
left over is solved again; the last part is packed by best fit, a composition at a time,
from the point of the rounding that needs the fewest sequences.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.bpe import Merges
from ruleloom.llm.common import map_slices
from ruleloom.llm.hashing import span_hashes, word_spans
from ruleloom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
CACHE_PIECES = 300_000
LATIN_END = "\u0130"  # letters below are composed, and have a lower case of one letter
ALNUM, SIGNS = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
SIGNS[ord("!") : 0x7F] = ~ALNUM[ord("!") : 0x7F]
ROUNDS = 6
EAGERNESS = 1.0
SPREAD = 1e-3
SLACK = 1e-3
LEAST_PROGRESS = 0.02
LAST_SHARES = (0.15, 0.4, 0.7)
NUMBERING_ROWS = 20_000


def byte_alphabet() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the others above 255."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordTokenizer:
    """Ids of a text from a cache of its words.

    The vocabulary's own rules drop white space and never join what it separates, so a
    text's ids are those of its words one after another. Words are cut at ASCII white
    space, for a whole slice of texts at once, and only distinct ones are looked up; the
    signs behind a word are a word of their own. Latin words are merged here, all new ones
    together; any other word goes to the library. The cache has two generations, which
    bounds its memory.
    """

    def __init__(self, path: str):
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, signs = model["vocab"], byte_alphabet()
        pairs = {vocab[a] << 32 | vocab[b]: vocab[a + b] for a, b in model["merges"]}
        if list(pairs.values()) != sorted(pairs.values()):
            raise ValueError("the ids of merged tokens do not follow the order of the merges")
        self.merges = Merges(pairs, [vocab[c] for c in signs], [vocab[c + model["end_of_word_suffix"]] for c in signs])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        found = {w: self.old[w] for w in words if w in self.old}
        new = [(w, w.decode("utf-8")) for w in words if w not in found]
        latin = [(w, t) for w, t in new if t.isalpha() and max(t) < LATIN_END]
        found.update(zip([w for w, _ in latin], self.merges.many([t.lower().encode("utf-8") for _, t in latin])))
        rest = [(w, t) for w, t in new if w not in found]
        if rest:
            coded = self.tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
            found.update((w, array("I", c.ids).tobytes()) for (w, _), c in zip(rest, coded))
        self.young.update(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        data = [t.encode("utf-8") for t in texts]
        joined = b"\n".join([*data, b""])
        whole = np.frombuffer(joined, np.uint8)
        starts, ends = word_spans(whole)
        if not len(starts):
            return [b""] * len(texts)
        # The signs behind a letter or digit at the end of a word are a piece of their own.
        last_kept = np.maximum.accumulate(np.where(SIGNS[whole], 0, np.arange(len(whole))))
        core = last_kept[ends - 1] + 1
        mark = (core > starts) & (core < ends) & ALNUM[whole[core - 1]]
        core = np.where(mark, core, ends)
        place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(mark)[:-1]))
        first, last = np.empty((2, len(starts) + int(mark.sum())), np.int64)
        first[place], last[place] = starts, core
        first[place[mark] + 1], last[place[mark] + 1] = core[mark], ends[mark]
        _, examples, which = np.unique(span_hashes(whole, first, last), return_index=True, return_inverse=True)
        words = [joined[a:b].lower() for a, b in zip(first[examples].tolist(), last[examples].tolist())]
        codes = list(map(self.young.get, words))
        if None in codes:
            self._learn({w for w, c in zip(words, codes) if c is None})
            codes = list(map(self.young.__getitem__, words))
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        sizes = np.array(list(map(len, codes)), np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(codes), "<u4")
        each = sizes[which]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(begins[which] - total[:-1], each) + np.arange(total[-1])].tobytes()
        cuts = (4 * total[np.searchsorted(first, np.cumsum([len(d) + 1 for d in data]))]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")


def _cut(tok: WordTokenizer, ids: list, texts: list, capacity: int, end_id: int, keep_ids: bool) -> dict:
    out: dict[str, list] = {name: [] for name in PIECE_COLUMNS}
    end = int(end_id).to_bytes(4, "little")
    for doc_id, codes in zip(ids, tok.encode(["" if t is None else t for t in texts])):
        codes += end
        for piece, at in enumerate(range(0, len(codes), 4 * capacity)):
            part = codes[at : at + 4 * capacity]
            for values, value in zip(out.values(), (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                values.append(value)
    return out


def cut_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): token pieces of at most `capacity`.

    Only a longer document is cut. Null and empty texts are the end id alone; `ids`
    (little-endian 32-bit numbers) are null unless asked for.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    work = partial(_cut, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return map_slices(rows, work, schema, 1, partial(WordTokenizer, path or default_path()))


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For every capacity the value of a most valuable filling: an unbounded knapsack.

    Lengths ascend.
    """
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c] = max(best[c - 1], (best[c - lengths[:n]] + values[:n]).max()) if n else best[c - 1]
    return best


def _fill(first: int, best: np.ndarray, values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """A filling with one item of length `first` that is most valuable beside it.

    It follows the knapsack's values down; a length without value is not used.
    """
    items, room = Counter({first: 1}), capacity - int(lengths[first])
    while (n := int(np.searchsorted(lengths, room, side="right"))) and room:
        gain = np.where(values[:n] > 0, best[room - lengths[:n]] + values[:n], -1.0)
        j = int(gain.argmax())
        if gain[j] < 0:
            break
        items[j] += 1
        room -= int(lengths[j])
    return tuple(sorted(items.items()))


def _fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> Counter:
    """A solution of the linear program: compositions and how often each is used.

    Round r covers the share r / rounds of every length's count. Values vary a little
    from filling to filling, as many fillings are worth the same and different ones are
    needed; a length that has run ahead by a round has no value until the others follow.
    """
    covered, uses = np.zeros(len(lengths)), Counter()
    reach = _price(lengths.astype(float), lengths, capacity)
    spread = np.random.default_rng(0).uniform(1, 1 + SPREAD, 2 * len(lengths))
    for r in range(1, rounds + 1):
        goal, most = r / rounds, min(1.0, (r + 1) / rounds)
        values = lengths / capacity * np.exp(EAGERNESS * (goal - covered))
        best = _price(values, lengths, capacity)
        for i in np.argsort(-lengths, kind="stable").tolist():
            if covered[i] >= goal - 1e-9:
                continue
            filling = _fill(i, best, values * spread[i : i + len(lengths)], lengths, capacity)
            if sum(a * int(lengths[j]) for j, a in filling) < lengths[i] + reach[capacity - lengths[i]] - SLACK * capacity:
                continue  # what would fill it has run ahead; a later round, or what is left over
            step = min((most - covered[j]) * counts[j] / a for j, a in filling)
            uses[filling] += step
            for j, a in filling:
                covered[j] += step * a / counts[j]
                if covered[j] >= most - 1e-9:
                    values[j] = 0.0
    return uses


def _best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The rest, longest first, each into the fullest sequence with room for it.

    Sequences of one composition are one entry with their number. A length fills one after
    another, as a sequence that has taken an item is then the fullest; so it leaves three
    new entries at most, and their number follows that of the lengths.
    """
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    open_rooms = np.zeros(capacity + 1, bool)

    def put(room: int, items: dict[int, int], n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((items, n))
            open_rooms[room] = room > 0

    for length, count in sorted(zip(lengths, counts), reverse=True):
        while count:
            at = length + int(open_rooms[length:].argmax())
            if not open_rooms[at]:
                at, items, n = capacity, {}, count
            else:
                items, n = rooms[at].pop()
                open_rooms[at] = bool(rooms[at])
            each = at // length
            full = min(n, count // each)
            put(at - each * length, items | {length: each}, full)
            count -= full * each
            n -= full
            if n and count:  # fewer are left than the next one has room for
                put(at - count * length, items | {length: count}, 1)
                n, count = n - 1, 0
            if items:
                put(at, items, n)
    return [entry for entries in rooms.values() for entry in entries]


def _rounded(histogram: dict[int, int], capacity: int, rounds: int) -> Iterator[tuple[list[tuple[dict[int, int], int]], dict[int, int]]]:
    """Solve and round down; (sequences made, items left) as each of LAST_SHARES is reached.

    The last one has the program cover all it can: it ends with no more items than the
    histogram has lengths, or where it makes no progress.
    """
    left = {length: n for length, n in histogram.items() if n}
    made: list[tuple[dict[int, int], int]] = []
    total, shares = sum(length * n for length, n in left.items()), sorted(LAST_SHARES)
    while left and (sum(length * n for length, n in left.items()) > LAST_SHARES[0] * total or sum(left.values()) > len(histogram)):
        lengths = np.array(sorted(left), np.int64)
        counts = np.array([left[x] for x in lengths.tolist()], np.int64)
        weight, rest = int(lengths @ counts), counts.copy()
        uses = _fractional(lengths, counts, capacity, rounds)
        for up in (0, 1):  # round down, then up where the items are left; the longest first
            for filling, use in sorted(uses.items(), key=lambda u: (-u[0][-1][0], -u[1], u[0])):
                n = min(1 if up else int(use + 1e-6), *(int(rest[j]) // a for j, a in filling))
                if n > 0:
                    made.append(({int(lengths[j]): a for j, a in filling}, n))
                    for j, a in filling:
                        rest[j] -= n * a
                    while shares and lengths @ rest <= shares[-1] * total:
                        shares.pop()
                        yield made[:], {int(x): int(n) for x, n in zip(lengths, rest) if n}
        left = {int(x): int(n) for x, n in zip(lengths, rest) if n}
        if weight - int(lengths @ rest) < LEAST_PROGRESS * weight:
            break
    yield made, left


def compositions(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Sequences to make: (how many items of each length, how many such sequences).

    Together they hold every item of the histogram exactly once. Best fit takes what the
    program leaves at different points of one run of it, and the point that needs the fewest
    sequences is taken, the latest of equal ones. One candidate is held besides the best.
    """
    best: list[tuple[dict[int, int], int]] | None = None
    for made, left in _rounded(histogram, capacity, rounds):
        found = made + _best_fit(list(left), list(left.values()), capacity)
        if best is None or sum(n for _, n in found) <= sum(n for _, n in best):
            best = found
    return best


def seats(made: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the k-th item of each length goes, as ranges of k.

    A row says: from number `first` of this length on, `each` items a sequence, from
    sequence `sequence` on, beginning at `place`.
    """
    rows, numbered, sequence = [], Counter(), 0
    for items, n in made:
        place = 0
        for length in sorted(items, reverse=True):
            rows.append((length << 40 | numbered[length], numbered[length], items[length], sequence, place))
            numbered[length] += n * items[length]
            place += length * items[length]
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "each", "sequence", "place"), table.T.copy()))


def _seat(batches, table):
    import pyarrow as pa

    table = table.value
    for batch in batches:
        length, number = (batch.column(n).to_numpy() for n in ("length", "number"))
        at = np.searchsorted(table["key"], length.astype(np.int64) << 40 | number, side="right") - 1
        k = number - table["first"][at]
        columns = [*batch.columns[:-1], pa.array(table["sequence"][at] + k // table["each"][at]), pa.array(table["place"][at] + k % table["each"][at] * length)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with `sequence_id` and `offset`; sequences are gapless from 0.

    `pieces` has doc_id, piece, start, length (1 to `capacity`) and ids_crc32 and is read
    more than once, so hand over a stored table. Repeated rows are pieces of their own.
    Pieces are numbered within each length: by a window over parts of the length, as many
    as its rows need, and the counts of the parts before. An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(seats(compositions(histogram, capacity, rounds)))
    parts = max(64, -(-max(histogram.values(), default=0) // NUMBERING_ROWS))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    split = pieces.select(*columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int").alias("part"))
    counts = split.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = split.withColumn("own", own).join(before, ["length", "part"]).select(*columns, (F.col("before") + F.col("own") - 1).alias("number"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(partial(_seat, table=table), schema)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Cut documents into pieces and pack them; the pieces are stored in between."""
    return pack(cut_lineage(cut_pieces(df, path=path, capacity=capacity).drop("ids")), capacity)
