import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from broadsheet.llm import exact_dedup, jaccard_join
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        left = True
        for i in ids:
            kept = i == keep and left
            left &= not kept
            out[(i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_exact_groups(docs, rows):
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs).collect())) == expected_exact(rows)


def test_colliding_hashes_are_told_apart(docs, rows):
    weak = lambda text: F.pmod(F.length(text), F.lit(3))
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, content_hash=weak).collect())) == expected_exact(rows)
    strong = Counter(tuple(r) for r in exact_dedup.keep_first(docs).select("doc_id", "text").collect())
    kept = Counter(tuple(r) for r in exact_dedup.keep_first(docs, content_hash=weak).select("doc_id", "text").collect())
    assert {k[0] for k in kept} == {k[0] for k in strong} and kept.total() == strong.total()


def test_keep_first_keeps_whole_rows(clashing, rows):
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns
    got = kept.collect()
    assert len(got) == len({norm(r[1]) for r in rows})
    assert all(r["key"] == (f"key{r['doc_id']}" if r["doc_id"] is not None else None) for r in got)


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def expected_near(rows, with_root=False):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        known = [x for x in least[find(i)] if x is not None]
        out.append((find(i), len(sets[i])) if with_root else (r[0], len(sets[i]), min(known) if known else None))
    return Counter(out)


def test_jaccard_components(docs, rows):
    got = jaccard_join.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == expected_near(rows)


def test_small_blocks_and_cells_give_the_same(docs, rows, monkeypatch):
    """Regions of more than a few documents go through the rounds over DataFrames, with cells, balls and blocks."""
    for name, value in (("BLOCK", 4), ("SMALL", 2), ("BUCKET_ROWS", 5), ("SAMPLE_ROWS", 50), ("LARGE_PIVOTS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    for rounds in (1, 3):
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        got = jaccard_join.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(map(tuple, got)) == expected_near(rows)


def families(rng, sizes, length, most):
    """Sets of near copies: each family's are its base with up to `most` shingles exchanged."""
    sets = []
    for n in sizes:
        base = rng.choice(1 << 40, length, replace=False)
        for _ in range(n):
            own = base.copy()
            at = rng.choice(length, rng.integers(0, most + 1), replace=False)
            own[at] = rng.choice(1 << 40, len(at))
            sets.append(np.unique(own))
    order = rng.permutation(len(sets))
    return [sets[i] for i in order]


def all_links(sets):
    both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
    size = np.array([len(s) for s in sets])
    return np.argwhere(np.triu(5 * both >= 4 * (size[:, None] + size[None, :] - both), 1))


@pytest.mark.parametrize("sizes,length,most", [([300], 60, 12), ([150, 100, 60], 50, 9), ([20] * 14, 40, 6), ([280], 30, 20), ([1] * 30, 20, 0), ([2, 2, 1], 10, 1)])
def test_region_of_hundreds_against_brute_force(sizes, length, most):
    """With the constants as they are: components by cells, balls and windows are those of all links."""
    sets, tally = families(np.random.default_rng(len(sizes) + most), sizes, length, most), Counter()
    got = jaccard_join.spanning(len(sets), jaccard_join.join_region(sets, tally))
    want = jaccard_join.spanning(len(sets), iter([all_links(sets)]))
    assert got.tolist() == want.tolist()
    if len(sizes) > 1 and len(sets) > 50 and max(sizes) > 1:
        assert tally["cells"] > 0 and tally["ball"] > 0


def test_a_shingle_set_is_the_texts(rows):
    texts = [r[1] for r in rows]
    sets = jaccard_join.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    some = np.unique(np.concatenate(sets))[::7]
    for a, b in zip(sets, jaccard_join.shingle_sets(texts, some)):
        assert len(a) == len(b) and set(a.tolist()) == {x & ((1 << 62) - 1) for x in b.tolist()} and np.isin(a, some).sum() == (b >> 62).sum()
    for n in range(1, 60):  # the prefix is never too short for what must be shared in it
        assert 1 <= jaccard_join.prefix_length(n) <= n


def test_keep_one(clashing, rows):
    kept = jaccard_join.keep_one(clashing)
    assert kept.columns == clashing.columns
    got = kept.collect()
    comps = expected_near(rows, with_root=True)
    assert len([r for r in got if shingle_set(r["text"])]) == len({root for root, n in comps if n})
    assert len([r for r in got if not shingle_set(r["text"])]) == sum(n for k, n in comps.items() if k[1] == 0)


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_groups(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_a_line_that_all_texts_have_is_no_group_of_one_task(spark):
    """Two thousand different texts with one common line: no plan orders or buffers the rows of a shingle together."""
    rng = random.Random(4)
    rows = [(i, "this licence line stands in each of them " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(2000)]
    rows += [(5000 + i, rows[7 * i][1] + " more") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {i: c for i, c in got.items() if i >= 5000} == {5000 + i: 7 * i for i in range(20)}
    assert all(got[i] == i for i in range(2000))
