import random
import re

import pytest

from inkplane.llm import jaccard_join


def _sets(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        out.append((r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def _brute(rows):
    sets = _sets(rows)
    distinct = sorted({s for _, s in sets if s}, key=len)
    root = {s: s for s in distinct}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    for i, s in enumerate(distinct):
        for t in distinct[i + 1 :]:
            if 100 * len(s) < 75 * len(t):
                break
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                root[find(s)] = find(t)
    same = {}
    for d, s in sets:
        if s and d is not None:
            same.setdefault(d, s)
            root[find(s)] = find(same[d])
    least = {}
    for d, s in sets:
        if s and d is not None:
            least[find(s)] = min(least.get(find(s), d), d)
    return sorted((-1 if d is None else d, len(s), least.get(find(s), d) if s else d) for d, s in sets)


def _check(df):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect())
    assert got == _brute(df.collect())
    return got


def _corpus(seed, n=300):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rnd.choices(words, k=9))
    texts = []
    for i in range(n):
        if i % 3 and texts:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randrange(1, 3 + len(w) // 25)):
                w[rnd.randrange(len(w))] = rnd.choice(words).upper()
            if rnd.random() < 0.3:
                w = w[: rnd.randrange(len(w) + 1)] + [rnd.choice(words)]
            texts.append(" ".join(w))
        else:
            w = rnd.choices(words, k=rnd.choice([1, 2, 4, 5, 6, 7, 9, 12, 20, 60, 200]))
            texts.append(" ".join(w) + (" " + line if rnd.random() < 0.5 else ""))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_that_of_brute_force(spark, seed):
    got = _check(spark.createDataFrame(list(enumerate(_corpus(seed))), "doc_id long, text string").repartition(3))
    assert len({c for _, _, c in got}) < len(got)


def test_heavy_lists_cells_and_salts(spark, monkeypatch):
    for name, v in (("LIGHT", 2), ("CELL", 8), ("SALT_ROWS", 5), ("FREQUENT_FROM", 3)):
        monkeypatch.setattr(jaccard_join, name, v)
    _check(spark.createDataFrame(list(enumerate(_corpus(3))), "doc_id long, text string"))


def test_odd_rows(documents, spark):
    _check(documents)
    extra = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (900, "A b c  d e f g"), (901, "z z z z z"), (901, "y y y y y")], "doc_id long, text string"))
    _check(extra)
    assert jaccard_join.join(documents.where("false")).count() == 0


def test_boundary_follows_cost():
    assert jaccard_join.boundary({10: 100}, 1.0) == 0
    assert jaccard_join.boundary({10: 100}, 50.0) >= 12
