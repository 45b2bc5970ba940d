"""Groups of near copies of which many are too far apart to be linked."""

import random

import numpy as np
import pyarrow as pa
from helioframe.llm import ngram_join
from tests.llm.test_operators import brute_components, shingles


def test_components_of_far_copies(spark):
    dice = random.Random(5)
    base = [f"w{dice.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(100):
        words = list(base)
        for _ in range(i // 8):
            words[dice.randrange(150)] = f"x{dice.randrange(10**6)}"
        texts[i] = " ".join(words)
    order = list(texts.items())
    dice.shuffle(order)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()}
    want = brute_components({i: shingles(t) for i, t in texts.items()})
    assert got == want and 20 < len(set(want.values())) < 80


def test_a_pair_is_made_once_for_all_large_shards():
    """Twenty members meet in two shards; the finer points leave out the pairs of the second ten."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    sets = []
    for i in range(20):
        h, k = base.copy(), 3 if i < 10 else 30
        h[rng.choice(150, k, replace=False)] = rng.integers(0, 1 << 62, k).astype(np.uint64)
        sets.append(np.sort(h))
    h, at = np.concatenate(sets), np.arange(21) * 150
    points, fine = [p.tobytes() for p in ngram_join.group_points(h, at)], ngram_join.fine_points(h, at)
    two = lambda x, kind: pa.array(list(x) * 2, kind)
    columns = {
        "token": pa.array([5] * 20 + [9] * 20, pa.int64()), "i": two([0] * 20, pa.int32()), "j": two([0] * 20, pa.int32()), "mine": two([0] * 20, pa.int32()),
        "sig": two(range(20), pa.int64()), "n": two([150] * 20, pa.int32()), "root": two(range(20), pa.int64()), "m": two([20] * 20, pa.int64()),
        "point": two(points, pa.binary()), "fine": two(fine, pa.binary()), "first": two([[5, 9]] * 20, pa.list_(pa.int64())),
    }
    made = []
    list(ngram_join.walk(pa.RecordBatch.from_pydict(columns), True, lambda x, y, *rest: made.extend(zip(x.tolist(), y.tolist()))))
    pairs = {(min(p), max(p)) for p in made}
    assert len(made) == len(pairs) and {(i, j) for i in range(10) for j in range(i + 1, 10)} <= pairs
    assert not any(i >= 10 for i, _ in pairs)
