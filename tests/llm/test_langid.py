"""Character models against counts kept in dictionaries, and held-out documents."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import langid

TEXTS = {
    "de": ["der hund und die katze", "das haus und der garten", "Größe, über ß!", "und der und der", "ein haus"],
    "en": ["the dog and the cat", "this house and that garden", "The, the: THE 42 the", "a dog", "𐐷𐐷 the end"],
}


def plain_symbols(text):
    """Letters and single blanks, with a blank at the end."""
    out = []
    for sign in text.lower():
        if sign.isalpha():
            out.append(ord(sign) if ord(sign) < 65536 else ord(sign) % 65535 + 1)
        elif out and out[-1]:
            out.append(0)
    return out + [0] if out and out[-1] else out


def plain_grams(text):
    s = [0] * (langid.ORDER - 1) + plain_symbols(text)
    return [tuple(s[i - langid.ORDER + 1 : i + 1]) for i in range(langid.ORDER - 1, len(s))]


class Plain:
    """Interpolated Kneser-Ney smoothing as its formula reads."""

    def __init__(self, texts):
        self.counts = {langid.ORDER: Counter(g for t in texts for g in plain_grams(t))}
        for n in range(langid.ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.cut, self.total, self.kinds = {}, defaultdict(int), defaultdict(int)
        for n, c in self.counts.items():
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            self.cut[n] = ones / (ones + 2 * twos) if ones and twos else langid.FEW_DISCOUNT
            for g, v in c.items():
                self.total[g[:-1]] += v
                self.kinds[g[:-1]] += 1

    def p(self, gram, base):
        if not gram:
            return base
        n, context, lower = len(gram), gram[:-1], self.p(gram[1:], base)
        if not self.total[context]:
            return lower
        return (max(self.counts[n][gram] - self.cut[n], 0) + self.cut[n] * self.kinds[context] * lower) / self.total[context]


def table(spark, texts):
    """Documents whose ids teach, none of them to calibrate on."""
    ids = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % langid.FOLDS not in (langid.HELD_OUT, langid.CALIBRATION))
    return spark.createDataFrame([(next(ids), t, lang) for lang, ts in texts.items() for t in ts], "doc_id long, text string, lang string")


@pytest.mark.parametrize("sent", [langid.SENT_NGRAMS, 0])
def test_bits_equal_the_formula(spark, sent):
    docs = table(spark, TEXTS)
    models = langid.fit(docs, sent_ngrams=sent)
    assert (models.sent is None) == (sent == 0)
    assert models.languages == ["de", "en"]
    letters = {c for ts in TEXTS.values() for t in ts for c in plain_symbols(t)}
    assert models.base == 1 / (len(letters) + 1)
    tests = [*TEXTS["de"], *TEXTS["en"], "unseen wörds, Ωmega", "", "123", None, "x"]
    rows = spark.createDataFrame(list(enumerate(tests)), "i int, text string")
    got = {r["i"]: r for r in langid.entropies(rows, models).collect()}
    for i, text in enumerate(tests):
        grams = plain_grams(text or "")
        assert got[i]["_n"] == len(grams)
        for lang, bits in zip(models.languages, got[i]["_bits"]):
            plain = Plain(TEXTS[lang])
            expected = sum(-math.log2(plain.p(g, models.base)) for g in grams) / max(1, len(grams))
            assert bits == pytest.approx(expected, rel=1e-9, abs=1e-12)


def test_probabilities_add_up():
    texts = TEXTS["en"]
    grams = Counter(g for t in texts for g in plain_grams(t))
    key = lambda g: sum(c << (16 * (len(g) - 1 - i)) for i, c in enumerate(g))
    pairs = sorted((np.uint64(key(g)).astype(np.int64), n) for g, n in grams.items())
    model = langid.levels(np.array([k for k, _ in pairs]), np.array([n for _, n in pairs]))
    letters = sorted({c for g in grams for c in g})
    for context in [(0, 0, 0), (0, ord("t"), ord("h")), (1, 2, 3)]:
        keys = np.array([np.uint64(key((*context, c))).astype(np.int64) for c in letters])
        total = (2.0 ** -langid.bits(model, 1 / (len(letters) + 1), keys)).sum()
        assert 0.9 < total < 1
        # The one place left over is that of a letter never seen.
        unseen = np.array([np.uint64(key((*context, 9999))).astype(np.int64)])
        assert total + float((2.0 ** -langid.bits(model, 1 / (len(letters) + 1), unseen))[0]) == pytest.approx(1)


def test_awkward_rows(spark, docs):
    models = langid.fit(docs)
    told = langid.predict(docs.withColumn("language", F.lit(1)).withColumn("_n", F.lit(2)), models)
    assert told.columns == [*docs.columns, "language", "_n", "language_"]
    rows = told.select("doc_id", "text", "language", "_n", F.col("language_.*")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["language"], r["_n"]) == (1, 2)
        if r["doc_id"] in (2, 3):
            assert (r["lang"], r["score"], r["bits"]) == ("und", 0.0, None)
        else:
            assert r["lang"] in models.languages and 0 <= r["score"] <= 1
    assert len({(r["lang"], r["score"]) for r in rows if r["doc_id"] == 4}) == 1
    none = langid.fit(docs.limit(0))
    assert none.languages == [] and langid.predict(docs, none).select("language.lang").distinct().collect() == [("und",)]
    assert langid.predict(docs.limit(0), models).count() == 0


def test_calibration_reads_every_document_of_its_fold(spark):
    """Temperature and limits are those of numpy over all texts of the fold, more than 4,000."""
    words = {"de": ["hund", "katze", "garten", "haus", "größe"], "en": ["dog", "cat", "garden", "house", "size"]}
    rows = []
    for i in range(26_000):
        if (fold := zlib.crc32(str(i).encode()) % langid.FOLDS) == langid.CALIBRATION or (fold != langid.HELD_OUT and i % 51 == 0):
            lang = ("de", "en")[i % 2]
            rows.append((i, " ".join(words[lang][(i * k + i // 7) % 5] for k in range(1, 2 + i % 6)) + "xq" * (i % 97 == 0), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs)
    apart = docs.where(langid.fold("doc_id") == langid.CALIBRATION)
    rest = langid.fit(docs.where(langid.fold("doc_id") != langid.CALIBRATION))
    rest.base = models.base
    seen = langid.entropies(apart, rest).collect()
    assert len(seen) > 5_000
    truth = np.array([models.languages.index(r["lang"]) for r in seen])
    size, cost = np.array([float(r["_n"]) for r in seen]), np.array([r["_bits"] for r in seen])
    odds = -(cost - cost.min(axis=1, keepdims=True)) * size[:, None] * np.log(2)
    at = np.arange(len(seen))
    loss = {float(t): np.mean(np.log(np.exp(odds / t).sum(axis=1)) - odds[at, truth] / t) for t in langid.TEMPERATURES}
    assert models.temperature == min(loss, key=lambda t: (round(loss[t], 12), t))
    for i, name in enumerate(models.languages):
        b, n = cost[truth == i, i], size[truth == i]
        mean = np.average(b, weights=np.sqrt(n))
        stays, falls = np.maximum(np.linalg.lstsq(np.stack([np.ones_like(n), 1 / n], axis=1), (b - mean) ** 2, rcond=None)[0], 0)
        stays = max(stays, 1e-4)
        limit = np.quantile((b - mean) / np.sqrt(stays + falls / n), 1 - langid.REJECTED, method="higher")
        assert models.limits[name] == pytest.approx((mean, stays, falls, limit), rel=1e-6)


def test_lang_is_no_input_of_a_prediction(spark):
    docs = table(spark, TEXTS)
    models = langid.fit(docs)
    swapped = docs.withColumn("lang", F.lit(None).cast("string"))
    one = langid.predict(docs, models).orderBy("doc_id").select("doc_id", "language").collect()
    assert one == langid.predict(swapped, models).orderBy("doc_id").select("doc_id", "language").collect()


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    from ruleloom.llm.queries import RUN

    got = RUN["op11_language_models"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.03 * len(held)
    strange = spark.createDataFrame([("qxzj wvqk zzxq jjqx vvwq " * 20,)], "text string")
    models = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert langid.predict(strange, models).first()["language"]["rejected"]
