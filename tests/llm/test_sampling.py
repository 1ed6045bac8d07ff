"""Segmentation sampling against enumeration, and exact round trips."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import sampling
from kinmatch.llm.sampling import Lattices, decode, sample_segmentations, sample_texts

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DIR = "/root/testdata/sf0.001"


def enumerate_(lat, word):
    """All segmentations of a word with their probabilities, from the model's own pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    scores = {sp.id_to_piece(i).replace("▁", " "): (i, -np.log(1 - sp.get_score(i))) for i in range(259, sp.get_piece_size())}

    def rest(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in scores:
                i, w = scores[text[:n]]
                for ids, more in rest(text[n:]):
                    yield (i, *ids), w + more

    found = dict(rest(word))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: w - total for ids, w in found.items()}


def unpack(lat, packed):
    return tuple(np.frombuffer(packed, lat.dtype).tolist())


def test_samples_are_distinct_and_right():
    lat = Lattices(MODEL)
    truth = enumerate_(lat, " hello you")
    assert len(truth) > 50
    runs = sample_texts(lat, ["hello you"] * 4000, list(range(4000)), 6)
    first, weight = Counter(), []
    for samples in runs:
        ids = [unpack(lat, s[3]) for s in samples]
        assert len(set(ids)) == 6 and all(np.isclose(truth[i], s[0]) for i, s in zip(ids, samples))
        values = [s[1] for s in samples]
        assert values == sorted(values, reverse=True)
        first[ids[0]] += 1
        weight.append(sum(np.exp(s[0] - s[2]) for s in samples))
    for ids, log_p in sorted(truth.items(), key=lambda x: -x[1])[:5]:
        assert abs(first[ids] / 4000 - np.exp(log_p)) < 0.03
    assert abs(np.mean(weight) - 1) < 0.03  # inclusion scores make sums over samples unbiased
    both = Counter(frozenset(unpack(lat, s[3]) for s in samples[:2]) for samples in runs)
    (a, pa_), (b, pb) = sorted(((i, np.exp(p)) for i, p in truth.items()), key=lambda x: -x[1])[:2]
    assert abs(both[frozenset((a, b))] / 4000 - (pa_ * pb / (1 - pa_) + pa_ * pb / (1 - pb))) < 0.03


def test_all_segmentations_of_a_short_text():
    lat = Lattices(MODEL)
    truth = enumerate_(lat, " abc")
    (samples,) = sample_texts(lat, ["abc"], [7], 1000)
    assert {unpack(lat, s[3]) for s in samples} == set(truth) and all(s[2] == 0.0 for s in samples)
    assert np.isclose(np.logaddexp.reduce([s[0] for s in samples]), 0)
    assert [len(s) for s in sample_texts(lat, ["", "a"], [1, 1], 3)][0] == 1


def test_random_numbers_are_drawn_for_all_texts_at_once(monkeypatch):
    """The number of calls of the hash depends on the turns and the longest word, not on the number of texts."""
    calls, plain = [], sampling.mix
    monkeypatch.setattr(sampling, "mix", lambda x: calls.append(len(x)) or plain(x))
    lat = Lattices(MODEL)
    calls.clear()
    found = sample_texts(lat, [f"some words of text {i}" for i in range(200)], list(range(200)), 2)
    assert len(found) == 200 and len(calls) < 100
    # The order in which texts come, and what is remembered of others, change nothing.
    again = sample_texts(lat, [f"some words of text {i}" for i in range(199, -1, -1)], list(range(199, -1, -1)), 2)[::-1]
    lat.clear()
    fresh = [s for i in range(5) for s in sample_texts(lat, [f"some words of text {i}"], [i], 2)]
    assert [[s[3] for s in r] for r in again] == [[s[3] for s in r] for r in found]
    assert [[s[3] for s in r] for r in fresh] == [[s[3] for s in r] for r in found[:5]]


def test_words_met_often_are_kept(monkeypatch):
    built, build = [], Lattices._build
    monkeypatch.setattr(Lattices, "_build", lambda self, new: (built.extend(new), build(self, new)))
    texts = [f"the common word{i} wörd{i * 7} \u4e00{i} the\n  of" for i in range(60)]
    lat = Lattices(MODEL)
    expected = [lat.clear() or sample_texts(lat, [t], [i], 2)[0] for i, t in enumerate(texts)]
    lat.clear()
    built.clear()
    monkeypatch.setattr(sampling, "MOST_WORDS", 20)
    assert [sample_texts(lat, [t], [i], 2)[0] for i, t in enumerate(texts)] == expected
    assert built.count(" the") == built.count(" common") == 1 and len(lat.words) < 30


def test_round_trip(spark):
    texts = ["", " ", "  two  blanks\n\n and\ttabs \n", "▁ mark ▁▁", "é 漢字 👍🏽 ́", "x" * 3000 + " long " * 5000, None, "<s> <0x41> </s>"]
    df = spark.createDataFrame([(i, t, 1, "") for i, t in enumerate(texts)] + [(None, "no key", 1, ""), (3, texts[3], 1, "")], "doc_id long, text string, sample int, ids string")
    samples = sample_segmentations(df, MODEL, k=3)
    got = decode(samples, MODEL).collect()
    assert Counter(r.key for r in got if r.key not in (1, 3, 4)) == {0: 1, 6: 1, **{i: 3 for i in (2, 5, 7)}, None: 3}
    assert {r.key for r in got} == {None, *range(8)}
    assert all(r.text == ("no key" if r.key is None else texts[r.key] or "") for r in got)
    rows = samples.where("key = 3").groupBy("sample").agg(F.countDistinct("ids").alias("n")).collect()
    assert all(r.n == 1 for r in rows)
    assert sample_segmentations(df.limit(0), MODEL).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = decode(sample_segmentations(docs, MODEL, k=2), MODEL).join(docs.withColumnRenamed("text", "whole"), F.col("key") == F.col("doc_id"))
    assert got.where("text <> whole").count() == 0 and got.count() > docs.count()
    assert got.where("log_prob > 0 or log_inclusion > 0 or isnan(log_inclusion)").count() == 0
