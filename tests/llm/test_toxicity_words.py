import pickle
import random
import re

import numpy as np
import pyarrow as pa

from arborfolio.llm import toxicity as to


def test_words_are_the_runs_of_letters():
    r, some = random.Random(1), "aZ 9_²½éßİĸ٣漢😀-ʰⅷ\n"
    texts = [None, "", *(chr(c) + "a" for c in range(0x3000)), *("".join(r.choices(some, k=r.randrange(12))) for _ in range(5000))]
    assert all(to.words_of(t) == re.findall(r"[^\W\d_]+", (t or "").lower()) for t in texts)


def test_term_numbers_survive_forgetting(monkeypatch):
    terms = sorted({t for w in ("alpha", "alphabet", "beta", "gamma") for t in to.terms_of(w)})
    number = {t: i for i, t in enumerate(terms)}
    monkeypatch.setattr(to, "CACHED_WORDS", 3)
    vocabulary = to.Vocabulary(terms)
    for text in ("Alpha beta alphabet, alphabets", "none of 7 these", "beta gamma zeta Beta", "alphabetical", None):
        found = [number[t] for w in to.words_of(text) for t in to.terms_of(w) if t in number]
        numbers, counts = vocabulary(text)
        assert dict(zip(numbers.tolist(), counts.tolist())) == {t: found.count(t) for t in found}
        assert np.array_equal(vocabulary.distinct(text), sorted(set(found)))


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    r, words = random.Random(2), ["alpha", "alphabet", "alphabets", "Été", "naïveté", "漢字漢字漢字", "x"]
    texts = [None, "", *(" ".join(r.choices(words, k=r.randrange(9))) + r.choice("“”9_ é½") for _ in range(500)), ""]
    terms = sorted({t for w in words[1:] for t in to.terms_of(w.lower())})
    vocabulary, looked_up, own = to.Vocabulary(terms), [], to.Vocabulary._numbers
    monkeypatch.setattr(to.Vocabulary, "_numbers", lambda self, words: looked_up.extend(words.to_pylist()) or own(self, words))
    found = vocabulary.each(texts)
    assert len(looked_up) == len(set(looked_up)) and len(found) == len(texts)
    number = {t: i for i, t in enumerate(terms)}
    for text, (numbers, counts) in zip(texts, found):
        all_terms = [number[t] for w in to.words_of(text) for t in to.terms_of(w) if t in number]
        assert numbers.tolist() == sorted(set(all_terms)) and counts.tolist() == [all_terms.count(t) for t in numbers]


def test_portions_keep_every_row(monkeypatch):
    monkeypatch.setattr(to, "PORTION", 10)
    for texts in ([], [None], ["", None, "é" * 50, "abc", "abcd", "", "abcde", "x" * 9, "y"], ["ab"] * 100):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        parts = [p.column("text").to_pylist() for p in to.portions(batch)]
        assert [t for p in parts for t in p] == texts
        assert all(sum(len((t or "").encode()) for t in p[1:]) <= 10 for p in parts)
    assert len(parts) == 21


def test_index_is_sent_without_the_zeros_of_its_matrix():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        terms = np.unique(np.minimum(r.geometric(0.02, 30) - 1, 399))
        vectors.append((terms, to.unit(np.ones(len(terms)), r.random(400)[terms] + 0.1)))
    index = to.BlockMaxIndex(vectors, 400)
    sent = pickle.dumps(index)
    again = pickle.loads(sent)
    assert np.count_nonzero(index.matrix) < index.matrix.size / 4 and len(sent) < len(pickle.dumps(vars(index))) - index.matrix.nbytes / 2
    assert np.array_equal(again.matrix, index.matrix)
    assert again.nearest(vectors[:50], 15) == index.nearest(vectors[:50], 15)
