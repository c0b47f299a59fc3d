import random

import pytest

from lodegraph.llm import packing
from lodegraph.llm.packing import CAPACITY, best_fit, containers, encoding, pieces, placed, summary


def test_best_fit_is_whole_and_tight():
    rng = random.Random(1)
    for loads in ([], [5], [2048] * 3, [1025] * 5, [1024] * 4, [rng.randint(1, 2048) for _ in range(2000)], [1] * 5000):
        bins = best_fit(loads, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(loads)))
        used = [sum(loads[i] for i in b) for b in bins]
        assert all(0 < u <= 2048 for u in used)
        assert len(bins) <= 11 / 9 * -(-sum(loads) // 2048) + 1 or min(loads) > 1024
    # against a plain scan for the fullest bin that still fits
    loads = [rng.randint(1, 60) for _ in range(300)]
    plain: list[int] = []
    for n in sorted(loads, reverse=True):
        fitting = [i for i, room in enumerate(plain) if room >= n]
        if fitting:
            plain[min(fitting, key=lambda i: plain[i])] -= n
        else:
            plain.append(100 - n)
    assert len(best_fit(loads, 100)) == len(plain)


def test_pieces():
    assert pieces(0, 10) == [] and pieces(10, 10) == [(0, 0, 10)] and pieces(25, 10) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = "alpha beta gamma delta naïve 数据 x1 { } ;".split()
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 300, 900])))) for i in range(400)]
    return out + [(1000, "word " * 20_000), (1001, ""), (1002, None), (None, "no id"), (3, out[3][1]), (3, out[3][1]), (1003, "   \n")]


def test_every_token_is_placed_once(spark, texts):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in texts], "doc_id bigint, text string, bin string, used int").repartition(13)
    bins = containers(docs).persist()
    rows = placed(bins).collect()
    count = encoding().encode_ordinary
    want = sorted((-1 if d is None else d, p, s, n) for d, t in texts if t for p, s, n in pieces(len(count(t)), CAPACITY))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.first_token, r.n_tokens) for r in rows) == want
    used = {}
    for r in rows:
        used[r.bin] = used.get(r.bin, 0) + r.n_tokens
    assert all(used[r.bin] == r.bin_tokens <= CAPACITY for r in rows)
    s = summary(bins).first()
    together = len(best_fit([r.n_tokens for r in rows], CAPACITY))  # what one task with all items would need
    assert s.n_bins == len(used) and s.n_tokens == sum(used.values()) and s.n_bins <= 1.1 * together


def test_nothing_to_pack(spark):
    assert placed(containers(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []
    assert placed(containers(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"))).collect() == []


def test_items_that_never_fit_together(spark):
    docs = spark.createDataFrame([(i, "word " * 1500) for i in range(30)], "doc_id bigint, text string").repartition(8)
    assert summary(containers(docs)).first().n_bins == 30


@pytest.mark.parametrize("bins_per_task", [1, 2])
def test_bins_of_several_flushes_have_names_of_their_own(spark, texts, monkeypatch, bins_per_task):
    monkeypatch.setattr(packing, "BINS_PER_TASK", bins_per_task)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
        rows = placed(containers(docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used = {}
    for r in rows:
        used[r.bin] = used.get(r.bin, 0) + r.n_tokens
    assert max(used.values()) <= CAPACITY and all(used[r.bin] == r.bin_tokens for r in rows)
    count = encoding().encode_ordinary
    assert sum(used.values()) == sum(len(count(t)) for _, t in texts if t)


def test_a_vocabulary_beyond_the_limit_is_refused(monkeypatch):
    packing.vocabulary.cache_clear()
    monkeypatch.setattr(packing, "VOCABULARY_LIMIT", 10)
    with pytest.raises(ValueError):
        packing.vocabulary()
