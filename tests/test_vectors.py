"""Exact search among vectors: ties, copies, empty vectors and blocks."""

from functools import reduce
from operator import add

import numpy as np
import pandas as pd

from glossaloom.operators import style as S


def by_hand(queries, bank, k):
    """The k best by cosine in double precision, ties to the smaller id; a zero vector has cosine 0."""
    # sum() compensates for what is lost on the way; the operator and DuckDB add place after place.
    added = lambda xs: reduce(add, xs)
    rows = []
    for q, x in queries:
        scored = []
        for i, y in bank:
            if y is not None and np.isfinite(y).all():
                dot, scale = added(a * b for a, b in zip(x, y)), np.sqrt(added(a * a for a in x) * added(b * b for b in y))
                scored.append((-(min(1.0, max(-1.0, dot / scale)) if scale > 0 else 0.0), i))
        rows += [(q, i, rank, -v) for rank, (v, i) in enumerate(sorted(scored)[:k], 1)]
    return rows


def test_vectors_are_searched_exactly_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    made = [[float(np.float32(v)) for v in rng.normal(size=6)] for _ in range(60)]
    # Copies, near copies beyond single precision, a zero and an opposite vector.
    bank = [(i, v) for i, v in enumerate(made + made[:9] * 3 + [[a * (1 + 1e-9 * j) for j, a in enumerate(v)] for v in made[:9]] + [[0.0] * 6, [-a for a in made[0]], None])]
    queries = [(i, v) for i, v in enumerate(made[:20] + [[0.0] * 6])]
    q = spark.createDataFrame(queries, "query_id bigint, features array<double>")
    b = spark.createDataFrame(bank, "item_id bigint, features array<double>")
    for k in (3, 11):
        for block in (4, 5000):
            got = sorted((r.query_id, r.item_id, r["rank"], r.score) for r in S.top_k(q, b, k, "cosine", block=block).collect())
            assert got == sorted(by_hand(queries, bank, k))


def test_vectors_are_scored_by_one_product_a_block(monkeypatch):
    """Only what single precision leaves among the best is scored pair by pair."""
    rng, scored = np.random.default_rng(5), []
    side = lambda n, key: pd.DataFrame({key: np.arange(n), "features": list(rng.normal(size=(n, 8)))})
    bank, asked = side(3000, "item_id").assign(bonus=0.0, number=0.0), side(50, "query_id").assign(below=np.inf)
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: scored.append(len(keys[0])) or lexsort(keys))
    out = S._vector_scorer([], 3)(asked, bank)
    assert len(out) == 150 and sum(scored) < 1000
