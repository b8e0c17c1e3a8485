"""Language of a text by interpolated Kneser-Ney models of its characters.

Every language has one model of character n-grams up to ORDER. A text belongs to the
language under which a character costs it the fewest bits on average. Letters are
lower-cased, everything between two words is one blank, and each text starts after blanks.

An n-gram is a 64-bit integer with 16 bits for each character, so that dropping its first
character is a mask and dropping its last one a shift. A model is one sorted array of such
integers for each order, beside arrays of the same length with what is left of each
probability after discounting. The counts of all lower orders follow from the highest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, hand_back, kept_state, map_slices, slices
from ruleloom.session import cut_lineage

ORDER = 4
BITS = 16
FOLDS = 5
HELD_OUT = 0
# The learning documents of this remainder are kept apart once, to calibrate on.
CALIBRATION = 1
TEMPERATURES = np.geomspace(1, 1000, 61)
# Share of a language's own texts that rejection may refuse.
REJECTED = 0.001
# Models of so many n-grams at most are sent to the tasks; larger ones stay tables.
SENT_NGRAMS = 2_500_000
FEW_DISCOUNT = 0.75
BUFFER = 1 << 21
NO_LANGUAGE = "und"


def fold(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    text = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % FOLDS


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _symbols(points: np.ndarray) -> np.ndarray:
    """Code points in 16 bits; those of the higher planes share numbers."""
    return np.where(points < 1 << BITS, points, points % 0xFFFF + 1).astype(np.int64)


def ngrams(letters: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each letter and word end of some texts, and the number of its text."""
    lowered = ["" if t is None else t.lower() for t in texts]
    points = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters[points]
    at = np.flatnonzero(letter | np.concatenate(([False], letter[:-1])))
    codes = np.where(letter[at], _symbols(points[at]), 0)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), at, side="right")
    first = np.searchsorted(owner, np.arange(len(texts)), side="left")
    place = np.arange(len(at)) - first[owner]
    keys = codes.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(codes)
        before[back:] = codes[:-back] if len(codes) > back else 0
        keys |= np.where(place >= back, before, 0) << (BITS * back)
    return keys, owner


def _tail(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of n-grams."""
    return keys if n == ORDER else keys & ((1 << (BITS * n)) - 1)


def _context(keys: np.ndarray) -> np.ndarray:
    """All characters but the last."""
    return (keys.view(np.uint64) >> np.uint64(BITS)).view(np.int64)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n, n_apart) of the texts of a task, merged as far as a buffer holds them."""
    letters = kept_state(partial(_letters))
    held: dict[tuple, list] = {}
    size = 0

    def rows(parts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, apart), pairs in parts.items():
            keys, counts = _merged([k for k, _ in pairs], [c for _, c in pairs])
            for i in range(0, len(keys), 100_000):
                k, c = keys[i : i + 100_000], counts[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c), pa.array(c if apart else np.zeros_like(c))], names=["lang", "key", "n", "n_apart"])

    for batch in batches:
        for langs, apart, texts in slices(batch, 2):
            keys, owner = ngrams(letters, texts)
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(langs, apart)])
            for which, number in groups.items():
                k, c = np.unique(keys[group[owner] == number], return_counts=True)
                held.setdefault(which, []).append((k, c))
                size += len(k)
            if size > BUFFER:
                held = {w: [_merged([k for k, _ in p], [c for _, c in p])] for w, p in held.items()}
                size = sum(len(k) for p in held.values() for k, _ in p)
                if size > BUFFER // 2:
                    yield from rows(held)
                    held, size = {}, 0
    yield from rows(held)
    hand_back()


@dataclass
class Level:
    """One order of one language: discounted n-grams and what their contexts leave over."""

    keys: np.ndarray
    alpha: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def _level(keys: np.ndarray, counts: np.ndarray) -> Level:
    cut = discount((counts == 1).sum(), (counts == 2).sum())
    # Keys are sorted as signed integers, which contexts never are: sort by context.
    order = np.argsort(_context(keys), kind="stable")
    contexts, bounds = np.unique(_context(keys)[order], return_index=True)
    total = np.add.reduceat(counts[order], bounds) if len(keys) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(bounds, len(keys)))
    alpha = np.empty(len(keys))
    alpha[order] = (counts[order] - cut) / np.repeat(total, kinds)
    return Level(keys, alpha, contexts, cut * kinds / total)


def discount(ones: int, twos: int) -> float:
    """What Kneser-Ney smoothing takes from every count, from the n-grams seen once and twice."""
    return float(ones / (ones + 2 * twos)) if ones and twos else FEW_DISCOUNT


def levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """The model of a language from the counts of its longest n-grams, sorted by key.

    An n-gram of a lower order counts the different characters seen before it.
    """
    out = [_level(keys, counts)]
    for n in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(_tail(keys, n), return_counts=True)
        out.append(_level(keys, counts))
    return out[::-1]


def _found(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def bits(model: list[Level], base: float, keys: np.ndarray) -> np.ndarray:
    """What the last character of each n-gram costs after the others."""
    p = np.full(len(keys), base)
    for n, level in enumerate(model, 1):
        tails = _tail(keys, n)
        p = _found(level.keys, level.alpha, tails, 0.0) + p * _found(level.contexts, level.rest, _context(tails), 1.0)
    return -np.log2(p)


@dataclass
class Models:
    """The models of all languages as arrays; `counts` is the table they come from."""

    languages: list[str]
    base: float
    counts: DataFrame | None
    sent: object = None
    temperature: float = 1.0
    limits: dict[str, tuple[float, float, float, float]] | None = None


def _sent(models: Models, counts: DataFrame, column: str) -> object:
    """The arrays of all languages, as a broadcast variable."""
    rows = counts.where(F.col(column) > 0).select("lang", "key", F.col(column).alias("n")).toArrow()
    lang, key, n = (rows.column(i).combine_chunks() for i in range(3))
    lang = lang.dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    codes, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
    key, n = key.to_numpy(), n.to_numpy()
    out = {}
    for code, name in enumerate(names):
        mine = codes == code
        order = np.argsort(key[mine], kind="stable")
        out[name] = levels(key[mine][order], n[mine][order])
    return counts.sparkSession.sparkContext.broadcast([out.get(name, []) for name in models.languages])


def _entropies(state: np.ndarray, texts: list[str | None], models: list[list[Level]], base: float) -> tuple[np.ndarray, np.ndarray]:
    """Characters counted in each text, and their bits on average under each model."""
    keys, owner = ngrams(state, texts)
    size = np.bincount(owner, minlength=len(texts))
    every, at = np.unique(keys, return_inverse=True)
    cost = np.stack([np.bincount(owner, bits(m, base, every)[at], len(texts)) for m in models], axis=1) if models else np.zeros((len(texts), 0))
    return size, cost / np.maximum(size, 1)[:, None]


def _lists(values: np.ndarray) -> list:
    return [row.tolist() for row in values]


def entropies(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """`docs` with `_n` (characters counted) and `_bits` (bits a character, by language).

    Models that were too large to send are joined as tables, by n-gram, once for every
    distinct text; the results are the same but for the last digits.
    """
    size, cost = fresh(docs, "_n"), fresh(docs, "_bits")
    if models.sent is None and models.languages:
        return _entropies_by_join(docs, models, text_col, size, cost)
    sent, base = models.sent, models.base
    columns = docs.columns

    def work(state: np.ndarray, *values: list) -> dict:
        n, average = _entropies(state, values[columns.index(text_col)], sent.value if sent else [], base)
        return dict(zip(columns, values)) | {size: n, cost: _lists(average)}

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_slices(docs, work, f"{names}, `{size}` long, `{cost}` array<double>", columns.index(text_col), partial(_letters))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = kept_state(partial(_letters))
    for batch in batches:
        for digests, texts in slices(batch, 1):
            keys, owner = ngrams(letters, texts)
            for i in range(len(texts)):
                k, c = np.unique(keys[owner == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([digests[i]] * len(k), pa.string()), pa.array(k), pa.array(c.astype(np.int64))], names=["digest", "key", "times"])


def _costs(keys: DataFrame, models: Models) -> DataFrame:
    """(key, lang, cost) for distinct n-grams under every language, by joins."""
    tail = lambda n: F.col("key") if n == ORDER else F.col("key").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
    languages = F.explode(F.array(*[F.lit(name) for name in models.languages]))
    p = keys.select("key", languages.alias("lang"), F.lit(models.base).alias("p"))
    grams = {ORDER: models.counts.select("lang", "key", "n").where("n > 0")}
    for n in range(ORDER - 1, 0, -1):
        grams[n] = cut_lineage(grams[n + 1].groupBy("lang", tail(n).alias("key")).agg(F.count("*").alias("n")))
    for n in range(1, ORDER + 1):
        found = grams[n].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()
        cuts = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(discount(r["a"], r["b"])))])
        context = F.shiftrightunsigned("key", BITS)
        totals = grams[n].groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), (F.element_at(cuts, F.first("lang")) * F.count("*") / F.sum("n")).alias("rest"))
        level = grams[n].select("lang", F.col("key").alias("tail"), (F.col("n") - F.element_at(cuts, F.col("lang"))).alias("less"))
        tails = p.withColumn("tail", tail(n)).withColumn("context", F.shiftrightunsigned("tail", BITS))
        met = tails.join(level, ["lang", "tail"], "left").join(totals, ["lang", "context"], "left")
        p = cut_lineage(met.select("key", "lang", (F.coalesce(F.col("less") / F.col("total"), F.lit(0.0)) + F.col("p") * F.coalesce("rest", F.lit(1.0))).alias("p")))
    return p.select("key", "lang", (-F.log2("p")).alias("cost"))


def _entropies_by_join(docs: DataFrame, models: Models, text_col: str, size: str, cost: str) -> DataFrame:
    digest = fresh(docs, "_digest")
    keyed = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    texts = keyed.groupBy(F.col(digest).alias("digest")).agg(F.first(text_col, ignorenulls=True).alias("text"))
    grams = cut_lineage(texts.mapInArrow(_grams, "digest string, key long, times long"))
    costs = _costs(grams.select("key").distinct(), models)
    sums = grams.join(costs, "key").groupBy("digest", "lang").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("cost")).alias("bits"))
    wide = sums.groupBy("digest").agg(F.max("n").alias(size), F.map_from_entries(F.collect_list(F.struct("lang", F.col("bits") / F.col("n")))).alias("by"))
    listed = wide.select(F.col("digest").alias(digest), size, F.array(*[F.element_at("by", F.lit(name)) for name in models.languages]).alias(cost))
    joined = keyed.join(listed, digest, "left").drop(digest)
    none = F.array(*[F.lit(0.0)] * len(models.languages))
    return joined.withColumn(size, F.coalesce(size, F.lit(0)).cast("long")).withColumn(cost, F.coalesce(cost, none))


def _sums(df: DataFrame, terms: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """What `terms` gives for the batches of a table, added up; a task hands over its sums alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = terms(batch) + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = df.mapInArrow(work, "sums array<double>").collect()
    return np.array([math.fsum(values) for values in zip(*(r["sums"] for r in rows))])


def _scored(batch: pa.RecordBatch, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the language, characters counted and bits under each language of some texts."""
    index = {name: i for i, name in enumerate(languages)}
    truth = np.array([index[name] for name in batch.column(0).to_pylist()], np.int64)
    cost = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(languages))
    return truth, batch.column(1).to_numpy(zero_copy_only=False).astype(float), cost


def _by_language(truth: np.ndarray, columns: list[np.ndarray], n: int) -> np.ndarray:
    return np.stack([np.bincount(truth, c, n) for c in columns])


def _losses(batch: pa.RecordBatch, languages: list[str]) -> np.ndarray:
    """Loss at each temperature, then rows, weights and weighted bits of each language."""
    truth, size, cost = _scored(batch, languages)
    odds = -(cost - cost.min(axis=1, keepdims=True)) * size[:, None] * np.log(2)
    mine = np.arange(len(truth))
    loss = [np.sum(np.log(np.exp(odds / t).sum(axis=1)) - odds[mine, truth] / t) for t in TEMPERATURES]
    weight = np.sqrt(size)
    return np.concatenate([loss, _by_language(truth, [np.ones_like(size), weight, weight * cost[mine, truth]], len(languages)).ravel()])


def _squares(batch: pa.RecordBatch, languages: list[str], means: np.ndarray) -> np.ndarray:
    """The sums that a line through squared distances from the mean over 1 / length needs."""
    truth, size, cost = _scored(batch, languages)
    y, x = (cost[np.arange(len(truth)), truth] - means[truth]) ** 2, 1 / size
    return _by_language(truth, [x, x * x, y, x * y], len(languages))


def _calibrate(models: Models, seen: DataFrame) -> None:
    """Temperature of the scores and limits of rejection, from texts the models haven't seen.

    `seen` is a stored table (lang, characters, bits by language), read a few times; only
    sums of it come here. A language's limit is on the distance of a text's bits from their
    mean, in units that grow as the text gets shorter.
    """
    models.limits = {}
    names = models.languages
    seen = seen.where("_n > 0").select("lang", "_n", "_bits")
    found = _sums(seen, partial(_losses, languages=names))
    if not len(found):
        return
    n, weights, weighted = found[len(TEMPERATURES) :].reshape(3, -1)
    loss = dict(zip(TEMPERATURES.tolist(), found / n.sum()))
    models.temperature = min(loss, key=lambda t: (round(loss[t], 12), t))
    means = weighted / np.where(weights > 0, weights, 1)
    x, xx, y, xy = _sums(seen, partial(_squares, languages=names, means=means)).reshape(4, -1)
    for i, name in enumerate(names):
        if n[i] < 20:
            continue
        # The squared distance has a part that stays and a part that falls with the length.
        stays, falls = np.maximum(np.linalg.lstsq([[n[i], x[i]], [x[i], xx[i]]], [y[i], xy[i]], rcond=1e-12)[0], 0)
        mean, stays, falls = float(means[i]), max(float(stays), 1e-4), float(falls)
        z = (F.get("_bits", F.lit(i)) - F.lit(mean)) / F.sqrt(F.lit(stays) + F.lit(falls) / F.col("_n"))
        most = int(n[i]) - math.ceil((1 - REJECTED) * (int(n[i]) - 1))  # so many texts are at the limit or beyond
        beyond = seen.where(F.col("lang") == name).select(z.alias("z")).orderBy(F.desc("z")).limit(most)
        models.limits[name] = (mean, stays, falls, beyond.agg(F.min("z")).first()[0])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sent_ngrams: int = SENT_NGRAMS) -> Models:
    """Models of all languages named in `docs`, from every document that isn't held out.

    Held out are ids whose crc32 is divisible by FOLDS, a null id among them; rows with a
    null language or text teach nothing, repeated rows each time, and a text without
    letters only that its language exists. Without any row there are no languages. All
    n-grams of all learning documents are counted; the counts stay a table in the shared
    folder, and reach the tasks as arrays if they are at most `sent_ngrams` rows.

    To calibrate, the counts without one further fold score every document of that fold.
    """
    rows = docs.select(fold(id_col).alias("fold"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    learning = rows.where((F.col("fold") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pieces = learning.select("lang", (F.col("fold") == CALIBRATION).alias("apart"), "text").mapInArrow(_count, "lang string, key long, n long, n_apart long")
    counts = cut_lineage(pieces.groupBy("lang", "key").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("n_apart")).alias("n_rest")))
    languages = sorted(r["lang"] for r in learning.select("lang").distinct().collect())
    letters = counts.select(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)).alias("c")).distinct().count()
    models = Models(languages, 1 / (letters + 1), counts.select("lang", "key", "n"))
    small = counts.limit(sent_ngrams + 1).count() <= sent_ngrams
    known = learning.where(F.col("fold") == CALIBRATION).select("lang", "text")
    rest = Models(languages, models.base, counts.select("lang", "key", F.col("n_rest").alias("n")))
    if small:
        rest.sent = _sent(rest, counts, "n_rest")
    _calibrate(models, cut_lineage(entropies(known, rest).select("lang", "_n", "_bits")))
    if small:
        if rest.sent is not None:
            rest.sent.unpersist()
        models.sent = _sent(models, counts, "n")
    return models


def predict(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """`docs` with a struct `language`: lang, score, bits and rejected.

    The language has the fewest bits a character (ties: least name); the score is its
    probability at the calibrated temperature, with all languages equally likely before.
    `rejected` says that the text costs more bits than nearly all texts of the language. A
    null or empty text, one without letters, and any text if no language is known get
    `und`, score 0 and no bits. Other columns pass through, clashing names too; repeated
    rows get the same, and texts are read whole, a few at a time.
    """
    name = fresh(docs, "language")
    cost, size = fresh(docs, "_bits"), fresh(docs, "_n")
    scored = entropies(docs, models, text_col)
    if not models.languages:
        return scored.withColumn(name, F.struct(F.lit(NO_LANGUAGE).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(False).alias("rejected"))).drop(cost, size)
    least = F.array_min(cost)
    names = F.array(*[F.lit(n) for n in models.languages])
    best = F.element_at(names, F.array_position(F.col(cost), least).cast("int"))
    odds = F.transform(F.col(cost), lambda b: F.exp(-(b - least) * F.col(size) * F.lit(float(np.log(2)) / models.temperature)))
    score = 1 / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    rejected = F.lit(False)
    for lang, (mean, stays, falls, limit) in sorted((models.limits or {}).items()):
        z = (least - F.lit(mean)) / F.sqrt(F.lit(stays) + F.lit(falls) / F.col(size))
        rejected = rejected | ((best == lang) & (z > limit))
    some = F.col(size) > 0
    told = F.struct(
        F.when(some, best).otherwise(NO_LANGUAGE).alias("lang"),
        F.when(some, score).otherwise(0.0).alias("score"),
        F.when(some, least).alias("bits"),
        (some & rejected).alias("rejected"),
    )
    return scored.withColumn(name, told).drop(cost, size)
