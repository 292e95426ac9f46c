"""Toxicity by nearest labelled examples.

Texts become TF-IDF vectors over every term of the labelled examples: words, and the beginnings of
longer ones. Document frequencies are counted over the whole corpus. As is usual for classification
by TF-IDF, a term's weight also grows with how strongly the labels lean on it, so that what two
texts share by chance counts little; no term and no example is left out.

The nearest examples by exact cosine are found with an inverted index whose postings are cut into
blocks of examples; every block of a term keeps its largest weight. The blocks that promise most are
read first, then those whose best possible score still reaches the result. The nearest vote with
the square of their cosine and with what each example stands for. Votes become probabilities by a logistic
curve fitted on a quarter of the examples, whose votes come from the other three quarters alone; the
neighbours found are the evidence.

The examples are a bounded sample of the labelled rows: for each label value at most ``per_label``
documents, those with the smallest hash of the id, and at most LABEL_BYTES of their texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .language import held_out
from .shared import SLICE, Workspace, add_columns, table

PER_LABEL, LABEL_BYTES = 2000, 64 << 20
NEIGHBOURS, BLOCK, FIRST_BLOCKS, COMMON, BEGINNING = 15, 64, 4, 0.06, 5
THRESHOLD, SMOOTHING = 0.3, 0.2
#: So many different words are looked up at a time, and so many bytes of text are taken together for that.
CACHED_WORDS, PORTION = 200_000, 6 << 20

LETTERS, BEYOND = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_\x00-\xff]")
ASCII = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))
LATIN = bytes(i if LETTERS.fullmatch(chr(i)) else 32 for i in range(256))


def letters_only(text: str | None) -> str:
    """The text in lower case, with spaces instead of all but letters."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(ASCII)
    if BEYOND.search(text):
        return " ".join(LETTERS.findall(text))
    return text.encode("latin-1", "replace").translate(LATIN).decode("latin-1")  # what is replaced is no letter


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case."""
    return letters_only(text).split()


def terms_of(word: str) -> list[str]:
    """A word and, if it is longer, its beginning, marked by a trailing hyphen."""
    return [word, f"{word[:BEGINNING]}-"] if len(word) > BEGINNING else [word]


def examples_of(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, label_bytes: int = LABEL_BYTES) -> DataFrame:
    """(doc_id, text, toxic, stands_for, tries) of the sampled examples.

    Of several labels of a document the largest counts, of several texts under one id the first in
    order. stands_for is how many labelled documents of its label an example stands for; tries marks
    the quarter that the votes are calibrated on.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(4, 2)).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = known.where("toxic = 1").orderBy(*order).limit(per_label).union(known.where("toxic = 0").orderBy(*order).limit(per_label))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    so_far = F.sum(size).over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = texts.withColumn("__ahead", F.coalesce(so_far, F.lit(0)) + size).where(F.col("__ahead") <= label_bytes)
    of_label = Window.partitionBy("toxic")
    counts = known.groupBy("toxic").agg(F.count("*").alias("__all"))
    stands = F.col("__all") / F.count("*").over(of_label)
    tries = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    return kept.join(F.broadcast(counts), "toxic").select("doc_id", "text", "toxic", stands.alias("stands_for"), tries.alias("tries"))


def _example_terms(batches):
    """Partial counts by term over examples: all, toxic ones, and both without those that are tried."""
    counts = [Counter() for _ in range(4)]
    for batch in batches:
        for text, toxic, tried in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "tries")), strict=True):
            found = {t for w in set(words_of(text)) for t in terms_of(w)}
            for counter, counts_here in zip(counts, (True, toxic, not tried, toxic and not tried), strict=True):
                if counts_here:
                    counter.update(found)
    names = list(counts[0])
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        columns = [pa.array(some, pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "n_toxic", "m", "m_toxic"])


class Vocabulary:
    """Term numbers and counts of texts; terms that no example has are left out."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.string())

    def _numbers(self, words: pa.StringArray) -> np.ndarray:
        """The numbers of the terms of each word, its own and its beginning's, -1 for none."""
        longer = pc.greater(pc.utf8_length(words), BEGINNING)
        beginnings = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, BEGINNING), "-", "")
        wanted = pa.concat_arrays([words, pc.if_else(longer, beginnings, "")])
        return pc.fill_null(pc.index_in(wanted, value_set=self.terms), -1).to_numpy().reshape(2, -1).T

    def of_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each text's terms start, and the end of all; term numbers in order, each once a text; counts) of texts.

        The words of all texts are brought together first, so that each different one is looked up once.
        """
        lists = pc.ascii_split_whitespace(pa.array([letters_only(t) for t in texts], pa.string()))
        words = lists.flatten().dictionary_encode()
        different = words.dictionary
        numbers = [self._numbers(different[at : at + CACHED_WORDS]) for at in range(0, len(different), CACHED_WORDS)]
        found = np.concatenate([np.zeros((0, 2), dtype=np.int32), *numbers])[words.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts), dtype=np.int64) << 32, pc.list_value_length(lists).to_numpy())
        keys, counts = np.unique((text[:, None] | found)[found >= 0], return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << 32)
        return starts, keys & 0xFFFFFFFF, counts.astype(np.float64)

    def each(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(term numbers in order, counts) of each of some texts."""
        starts, numbers, counts = self.of_all(texts)
        return [(numbers[a:b], counts[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def distinct(self, text: str | None) -> np.ndarray:
        """The term numbers of a text, each once."""
        return self(text)[0]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers in order, counts) of a text."""
        return self.each([text])[0]


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PORTION bytes of text, whatever the number of their rows; a longer text is not cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PORTION)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # terms of at most 2 * LABEL_BYTES of text

    def count(batches):
        vocabulary, found, rows = Vocabulary(shared.value), np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for portion in portions(batch):
                found += np.bincount(vocabulary.of_all(portion.column("text").to_pylist())[1], minlength=len(terms))
        some = np.flatnonzero(found)
        columns = [np.append(some, -1), np.append(found[some], rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n, found = counted.column("term").to_numpy(), counted.column("n").to_numpy(), np.zeros(len(terms), dtype=np.int64)
    found[at[at >= 0]] = n[at >= 0]
    return found, int(n[at < 0].sum())


def term_weights(df: np.ndarray, rows: int, n: np.ndarray, n_toxic: np.ndarray, examples: int, toxic: int) -> np.ndarray:
    """Inverse document frequency, raised by how far the labels lean on the term.

    The lean is the likelihood ratio of the term's labels against chance, in units of what the best
    of so many terms reaches by chance. Every term keeps at least its inverse document frequency.
    """
    idf = np.log(1 + rows / np.maximum(df, 1))
    if not 0 < toxic < examples:
        return idf
    p, a, b = toxic / examples, n_toxic, n - n_toxic
    part = lambda x, chance: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(n * chance, 1e-12)), 0.0)
    return idf * (1 + (part(a, p) + part(b, 1 - p)) / np.log(max(3, len(df))))


def unit(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length one from the counts of a text's terms and the weights of these."""
    values = (1 + np.log(counts)) * weights
    return values / max(np.sqrt((values * values).sum()), 1e-300)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of runs of postings, one run after another."""
    at = np.repeat((starts - np.cumsum(sizes, dtype=np.int32) + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return at


class BlockMaxIndex:
    """Inverted lists of unit vectors, by blocks of examples, with each block's largest weight.

    The few terms that very many examples have are kept as a matrix, since their lists are all but full.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.block, self.count = block, len(vectors)
        self.blocks = max(1, -(-len(vectors) // block))
        none = np.zeros(0, dtype=np.int32)
        term = np.concatenate([none, *(t for t, _ in vectors)])
        owner = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        common = np.flatnonzero(np.bincount(term, minlength=terms) > max(block, COMMON * len(vectors)))
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.blocks * block))
        held = self.column[term] >= 0
        self.matrix[self.column[term[held]], owner[held]] = weight[held]
        term, owner, weight = term[~held], owner[~held], weight[~held]
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order], weight[order]
        run = term.astype(np.int64) * self.blocks + self.owner // block
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.run_block, self.run_at = self.owner[starts] // block, np.append(starts, len(run)).astype(np.int32)
        self.term_at = np.searchsorted(term[starts], np.arange(terms + 1)).astype(np.int32)

    def __getstate__(self) -> dict:
        """What is sent to the tasks: of the matrix, which holds mostly zeros, only the others with their positions."""
        at = np.flatnonzero(self.matrix)
        return {**vars(self), "matrix": (self.matrix.shape, at, self.matrix.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["matrix"]
        vars(self).update({**state, "matrix": np.zeros(shape)})
        np.put(self.matrix, at, values)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query the ``k`` examples of highest cosine, if above zero; ties to the earlier example."""
        known, split = np.zeros((len(queries), len(self.matrix))), []
        for row, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            rare = column < 0
            known[row, column[~rare]] = weights[~rare]
            split.append((terms[rare], weights[rare]))
        return [self._nearest(*q, scores, k) for q, scores in zip(split, known @ self.matrix, strict=True)]

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        starts = self.term_at.take(terms)  # take gathers faster than an index in brackets
        sizes = self.term_at.take(terms + 1) - starts
        runs, own = _runs(starts, sizes), np.repeat(weights, sizes)
        blocks = self.run_block.take(runs)
        reached = scores.reshape(self.blocks, self.block).max(axis=1)
        bound = reached + np.bincount(blocks, own * self.most.take(runs), minlength=self.blocks)
        first = np.zeros(self.blocks, dtype=bool)
        first[np.argpartition(-bound, FIRST_BLOCKS)[:FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else slice(None)] = True
        k, wanted = min(k, len(scores)), first
        for again in (True, False):
            picked = np.flatnonzero(wanted.take(blocks))
            some = runs.take(picked)
            starts = self.run_at.take(some)
            lengths = self.run_at.take(some + 1) - starts
            at = _runs(starts, lengths)
            scores += np.bincount(self.owner.take(at), np.repeat(own.take(picked), lengths) * self.weight.take(at), minlength=len(scores))
            least = np.partition(scores, -k)[-k]
            if again:  # a block whose bound stays below the k-th best so far can't hold a nearer example
                wanted = ~first & (bound > 0) & (bound >= least - 1e-9)
        hit = np.flatnonzero((scores > 0) & (scores >= least - 1e-11))
        return sorted(((float(scores[i]), int(i)) for i in hit), key=lambda x: (-round(x[0], 12), x[1]))[:k]


def _order(vectors: list[tuple[np.ndarray, np.ndarray]], frequency: np.ndarray) -> list[int]:
    """An order that brings alike examples into one block: by the heaviest frequent term, then by the commonest ones."""

    def key(i: int) -> tuple:
        terms, weights = vectors[i]
        if not len(terms):
            return (-1,), ()
        top = int(terms[weights.argmax()])
        common = terms[np.argsort(-frequency[terms], kind="stable")[:6]]
        return (top if frequency[top] > 20 else -1,), tuple(common.tolist())

    return sorted(range(len(vectors)), key=key)


def _model(terms: list[str], weights: np.ndarray, rows: list[dict], frequency: np.ndarray) -> dict:
    vectors = [(r["terms"], unit(r["counts"], weights[r["terms"]])) for r in rows]
    order = _order(vectors, frequency)
    rows = [rows[i] for i in order]
    stands, toxic = np.array([r["stands_for"] for r in rows]), np.array([r["toxic"] for r in rows])
    rate = (stands * toxic).sum() / stands.sum() if len(rows) else 0.0
    return {
        "terms": terms, "weights": weights, "index": BlockMaxIndex([vectors[i] for i in order], len(terms)),
        "ids": [r["doc_id"] for r in rows], "toxic": toxic, "stands": stands, "rate": float(rate), "curve": (1.0, 0.0),
    }


class Voter:
    """Votes of the nearest examples, before calibration, and the nearest of them."""

    def __init__(self, model: dict, neighbours: int):
        self.model, self.neighbours, self.vocabulary = model, neighbours, Vocabulary(model["terms"])
        self.own = SMOOTHING * float(model["stands"].mean()) if len(model["stands"]) else 1.0

    def __call__(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        m, counted = self.model, self.vocabulary.each(texts)
        queries = [(terms, unit(counts, m["weights"][terms])) for terms, counts in counted]
        found = [near for at in range(0, len(queries), SLICE) for near in m["index"].nearest(queries[at : at + SLICE], self.neighbours)]
        return [(self._vote(near), near) for near in found]

    def _vote(self, near: list[tuple[float, int]]) -> float:
        m, weights = self.model, [s * s * self.model["stands"][i] for s, i in near]
        votes = sum(w for w, (_, i) in zip(weights, near, strict=True) if m["toxic"][i])
        return (votes + self.own * m["rate"]) / (sum(weights) + self.own)


def _log_odds(vote):
    vote = np.clip(vote, 1e-4, 1 - 1e-4)
    return np.log(vote / (1 - vote))


def fit_curve(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve sigmoid(a * log odds of the vote + b), drawn a little towards (1, 0)."""
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    x = np.stack([_log_odds(votes), np.ones(len(votes))], axis=1)
    weights, curve, prior = weights * len(weights) / weights.sum(), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ curve))
        slope = x.T @ (weights * (toxic - p)) - (curve - prior)
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(bend, slope)
        curve = curve + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(curve[0], 0.05)), float(curve[1])


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-(curve[0] * _log_odds(vote) + curve[1]))))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, neighbours: int = NEIGHBOURS) -> dict:
    """Terms, their weights, the index of the examples and the curve; its size is bounded by ``per_label`` and LABEL_BYTES."""
    examples = Workspace(docs.sparkSession, "toxicity").write(examples_of(docs, labels, per_label), "examples")
    counted = examples.select("text", "toxic", "tries").mapInArrow(_example_terms, "term string, n long, n_toxic long, m long, m_toxic long")
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "n_toxic", "m", "m_toxic"))).orderBy("term").toArrow()
    terms = counted.column("term").to_pylist()
    n, n_toxic, m, m_toxic = (counted.column(c).to_numpy() for c in ("n", "n_toxic", "m", "m_toxic"))
    df, rows = document_frequencies(docs, terms)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # terms of at most 2 * LABEL_BYTES of text

    def number():
        vocabulary = Vocabulary(shared.value)

        def step(batch: pa.RecordBatch) -> list[list]:
            found = vocabulary.each(batch.column("text").to_pylist())
            return [[t.tolist() for t, _ in found], [c.tolist() for _, c in found]]

        return step

    listed = {"terms": pa.list_(pa.int32()), "counts": pa.list_(pa.float64())}
    found = add_columns(examples, ["doc_id", "toxic", "stands_for", "tries"], listed, number, portions).orderBy("doc_id").toArrow().to_pylist()
    for r in found:
        r["terms"], r["counts"] = np.array(r["terms"], dtype=np.int32), np.array(r["counts"], dtype=np.float64)
    toxic = sum(r["toxic"] for r in found)
    model = _model(terms, term_weights(df, rows, n, n_toxic, len(found), toxic), found, n)
    others = [r for r in found if not r["tries"]]
    part = _model(terms, term_weights(df, rows, m, m_toxic, len(others), sum(r["toxic"] for r in others)), others, m)
    tried = voted(examples.where("tries"), part, ["toxic", "stands_for"], neighbours).toArrow()
    model["curve"] = fit_curve(*(tried.column(c).to_numpy() for c in ("vote", "toxic", "stands_for")))
    return model


def voted(docs: DataFrame, model: dict, keep: list[str], neighbours: int = NEIGHBOURS) -> DataFrame:
    """The columns ``keep`` of ``docs`` and vote, the share of the nearest examples' votes for label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # see fit

    def make():
        voter = Voter(shared.value, neighbours)
        return lambda batch: [[vote for vote, _ in voter(batch.column("text").to_pylist())]]

    return add_columns(docs, keep, {"vote": pa.float64()}, make, portions)


def score(docs: DataFrame, model: dict, neighbours: int = NEIGHBOURS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but text, if not given), and score (0 to 1), predicted (1 from 0.3), evidence (ids and cosines).

    A text without any of the terms, null and empty ones included, has no neighbours and takes the
    rate of label 1. With no labelled example of label 1 every score is 0. Repeated rows are each
    scored. Columns named score, predicted or evidence are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # see fit

    def make():
        m = shared.value
        voter, some = Voter(m, neighbours), bool(m["toxic"].any())

        def step(batch: pa.RecordBatch) -> list[list]:
            found = voter(batch.column("text").to_pylist())
            scores = [calibrated(vote, m["curve"]) if some else 0.0 for vote, _ in found]
            evidence = [[{"doc_id": m["ids"][i], "cosine": s} for s, i in near[:3]] for _, near in found]
            return [scores, [int(s >= THRESHOLD) for s in scores], evidence]

        return step

    keep = keep or [c for c in docs.columns if c not in ("score", "predicted", "evidence", "text")]
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
    return add_columns(docs, keep, {"score": pa.float64(), "predicted": pa.int32(), "evidence": evidence}, make, portions)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model)
