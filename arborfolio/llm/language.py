"""Language identification by words with backoff to character n-grams.

Every word is scored on its own. A word seen in training takes its log relative frequency in each
language, with a penalty for languages that never used it. An unseen word takes the mean score of
its longest character n-grams, if any of them is known, else of the next shorter ones, and so on.
The text's score in a language is the sum over its words; what decides is how far languages differ.

The model is fitted on a bounded sample of labelled rows: for each language at most ``per_language``
documents, those with the smallest hash of the id, and at most LANGUAGE_BYTES of their texts. It
keeps every word and n-gram of them, as sorted 64-bit digests that executors memory-map from their
copy of files in the shared folder.

The score of a prediction is the probability that a softmax over the languages gives, at a
temperature. It is the one, of a fixed list, that makes the labels of a fifth of the sample
likeliest; that fifth is not counted in the model.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, add_columns, mapped, publish, table

PER_LANGUAGE, LANGUAGE_BYTES, LONGEST = 1000, 32 << 20, 4
PENALTY = 1.0
TEMPERATURES = [2.0**k for k in range(9)]
CACHE_BYTES = 16 << 20
BROADCAST_LANGUAGES = 10_000
DISTINCT_ERROR = 0.02

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    """All n-grams of a word between spaces."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def digest(n: int, term: str) -> int:
    """The key of a word (n = 0) or an n-gram."""
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), n)


def _counts(batch: pa.RecordBatch) -> list[dict]:
    """For each language of a batch its counts of words (n = 0) and of n-grams."""
    found: dict[str, Counter] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        found.setdefault(lang, Counter()).update(words_of(text))
    rows = []
    for lang, words in found.items():
        grams: Counter = Counter()
        for word, k in words.items():
            for n in range(1, LONGEST + 1):
                for gram in grams_of(word, n):
                    grams[n, gram] += k
        rows += [{"lang": lang, "n": 0, "term": w, "count": k} for w, k in words.items()]
        rows += [{"lang": lang, "n": n, "term": g, "count": k} for (n, g), k in grams.items()]
    return rows


TERM = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("term", pa.string()), ("count", pa.int64())])


def sample_of(labelled: DataFrame, per_language: int = PER_LANGUAGE, language_bytes: int = LANGUAGE_BYTES) -> DataFrame:
    """(doc_id, lang, text, tries): the training sample; tries marks the fifth that the temperature is chosen on.

    The share of a language's hashes that could belong to its sample follows from how many different
    ids it has, so all other texts are left where they are and no language is ranked whole. That number
    is estimated within a few percent, which the threefold room of the threshold covers, and repeated
    rows do not count in it. Of several texts under one id and language the first in order counts.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    counts = Workspace(labelled.sparkSession, "languages").write(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id", DISTINCT_ERROR).alias("__all")), "counts")
    if counts.count() <= BROADCAST_LANGUAGES:  # rows of a name and a number; otherwise rows are dealt by language
        counts = F.broadcast(counts)
    rows = labelled.select("doc_id", "lang", "text", place.alias("__place")).join(counts, "lang")
    near = rows.where(F.col("__place") * F.col("__all") <= 3 * per_language + 100).groupBy("lang", "doc_id", "__place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("__place", "doc_id")
    first = near.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= per_language)
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tries = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    return first.withColumn("__bytes", so_far).where(F.col("__bytes") <= language_bytes).select("doc_id", "lang", "text", tries.alias("tries"))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from rows with doc_id, text and lang; rows with a null id or language are left out. No rows: a model without languages."""
    space = Workspace(labelled.sparkSession, "language")
    labelled = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    sample = space.write(sample_of(labelled, per_language), "sample")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist(_counts(batch), schema=TERM)

    terms = sample.where("NOT tries").mapInArrow(run, "lang string, n int, term string, count long")
    terms = space.write(terms.groupBy("lang", "n", "term").agg(F.sum("count").alias("count")), "terms")
    totals = {(r["lang"], r["n"]): r["total"] for r in terms.groupBy("lang", "n").agg(F.sum("count").alias("total")).collect()}
    model = _publish(space, terms, totals)
    if model["langs"]:
        model["temperature"] = _temperature(sample.where("tries"), model)
    return model


def _publish(space: Workspace, terms: DataFrame, totals: dict) -> dict:
    """The model's files: keys in order, and for each key the languages that use the term and their advantage."""
    langs = sorted({lang for lang, _ in totals})
    place = {lang: i for i, lang in enumerate(langs)}
    floor = {n: -np.log10(max((t for (_, m), t in totals.items() if m == n), default=1)) - PENALTY for n in range(LONGEST + 1)}
    if not langs:
        return {"langs": [], "files": "", "temperature": 1.0}
    rows = terms.toArrow()  # terms of at most LANGUAGE_BYTES a language
    n, lang = rows.column("n").to_pylist(), rows.column("lang").to_pylist()
    keys = np.array([digest(k, t) for k, t in zip(n, rows.column("term").to_pylist(), strict=True)], dtype=np.uint64)
    share = np.array([totals[p] for p in zip(lang, n, strict=True)], dtype=np.float64)
    least = np.array([floor[k] for k in n])
    gain = np.log10(rows.column("count").to_numpy() / share) - least
    own = np.array([place[x] for x in lang], dtype=np.int32)
    order = np.lexsort((own, keys))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(keys) else np.zeros(0, dtype=np.int64)
    arrays = {
        "keys": keys[order][starts], "at": np.append(starts, len(keys)).astype(np.int64),
        "langs": own[order], "gain": gain[order].astype(np.float32),
    }
    return {"langs": langs, "files": publish(space, arrays), "temperature": 1.0}


class Scorer:
    """Scores of words by the model, remembered in a bounded table."""

    def __init__(self, model: dict):
        self.langs, self.temperature, files = model["langs"], model["temperature"], model["files"]
        self.keys, self.at = mapped(files, "keys", np.uint64), mapped(files, "at", np.int64)
        self.owner, self.gain = mapped(files, "langs", np.int32), mapped(files, "gain", np.float32)
        self.most = max(10_000, CACHE_BYTES // (4 * max(1, len(self.langs))))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), dtype=np.float32)

    def find(self, keys: list[int]) -> np.ndarray:
        """The positions of digests among the model's keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        asked = np.array(keys, dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)

    def _add(self, scores: np.ndarray, rows: np.ndarray, found: np.ndarray, share: np.ndarray) -> None:
        """Add to each row the gains of a key, weighted by its share."""
        sizes = (self.at[found + 1] - self.at[found]).astype(np.int64)
        at = np.repeat(self.at[found] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        np.add.at(scores, (np.repeat(rows, sizes), self.owner[at]), self.gain[at] * np.repeat(share, sizes))

    def learn(self, words: list[str]) -> None:
        """Score new words: by their own frequency, else by their longest n-grams of which any is known."""
        scores = np.zeros((len(words), len(self.langs)), dtype=np.float64)
        found = self.find([digest(0, w) for w in words])
        own = np.flatnonzero(found >= 0)
        self._add(scores, own, found[own], np.ones(len(own)))
        open_ = np.flatnonzero(found < 0)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            grams = [[digest(n, g) for g in grams_of(words[i], n)] for i in open_]
            sizes = np.array([len(g) for g in grams])
            found, rows = self.find([k for g in grams for k in g]), np.repeat(np.arange(len(open_)), sizes)
            hit = np.flatnonzero(found >= 0)
            hits = np.bincount(rows[hit], minlength=len(open_))
            self._add(scores, open_[rows[hit]], found[hit], 1 / hits[rows[hit]])
            open_ = open_[hits == 0]
        at = len(self.rows)
        while len(self.scores) < at + len(words):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[at : at + len(words)] = scores
        self.rows.update(zip(words, range(at, at + len(words)), strict=True))

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the sum of its words' scores in every language; None for a text without letters."""
        listed = [words_of(t) for t in texts]
        if len(self.rows) > self.most:
            self.forget()
        if new := list(dict.fromkeys(w for words in listed for w in words if w not in self.rows)):
            self.learn(new)
        rows = self.rows
        lettered = [bool(words) and any(c.isalpha() for w in words for c in w) for words in listed]
        return [self.scores[[rows[w] for w in words]].sum(axis=0, dtype=np.float64) if ok else None for words, ok in zip(listed, lettered, strict=True)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        found = []
        for total in self.totals(texts):
            if total is None:
                found.append(("und", 0.0))
                continue
            odds = np.exp(np.log(10) * (total - total.max()) / self.temperature)
            best = int(total.argmax())
            found.append((self.langs[best], float(odds[best] / odds.sum())))
        return found


def _temperature(tried: DataFrame, model: dict) -> float:
    """The temperature that makes the labels of the tried rows likeliest; the highest if there are none."""
    place = {lang: i for i, lang in enumerate(model["langs"])}

    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> list[list]:
            losses = []
            for total, lang in zip(scorer.totals(batch.column("text").to_pylist()), batch.column("lang").to_pylist(), strict=True):
                if total is None or lang not in place:
                    losses.append([0.0] * len(TEMPERATURES))
                    continue
                logs = [np.log(10) * (total - total.max()) / t for t in TEMPERATURES]
                losses.append([float(np.log(np.exp(x).sum()) - x[place[lang]]) for x in logs])
            return [losses]

        return step

    loss = add_columns(tried, ["doc_id"], {"loss": pa.list_(pa.float64())}, make)
    total = loss.agg(*(F.sum(F.element_at("loss", k + 1)).alias(f"t{k}") for k in range(len(TEMPERATURES)))).first()
    return TEMPERATURES[-1] if total[0] is None else TEMPERATURES[int(np.argmin(np.array(total, dtype=np.float64)))]


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but text, if not given), and lang_pred, score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is any when nothing was learned.
    Ties go to the first language by name. Repeated rows are each judged. Columns named lang_pred or
    score are replaced.
    """

    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> list[list]:
            found = scorer.predict(batch.column("text").to_pylist())
            return [[lang for lang, _ in found], [score for _, score in found]]

        return step

    keep = keep or [c for c in docs.columns if c not in ("lang_pred", "score", "text")]
    return add_columns(docs, keep, {"lang_pred": pa.string(), "score": pa.float64()}, make)


def held_out(folds: int, remainder: int):
    """Rows whose crc32 of the id as text (null: empty) leaves ``remainder``."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(folds)) == remainder


def fit_language(docs: DataFrame) -> dict:
    """The model of the query and the pipeline: every fifth of the ids stays out of it."""
    return fit(docs.where(~held_out(5, 0) & F.col("lang").isNotNull()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), fit_language(docs))
