import random
import re
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import common, jaccard_join, shingles
from siltstone.llm.components import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_force(rows):
    """doc_id to (sizes, component) over all pairs."""
    sets = [(d, plain_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and 100 * both >= 75 * (len(x) + len(y) - both):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), find(d)) for d, s in sets)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passage = words(60)
    texts = [words(rng.randrange(1, 120)) for _ in range(60)]
    texts += [words(rng.randrange(20, 80)) + " " + passage + " " + words(rng.randrange(5, 60)) for _ in range(50)]
    for size, edits in ((2, 2), (5, 4), (30, 6), (80, 3), (12, 12)):
        texts += family(rng, words(rng.choice([60, 150, 300])), size, edits)
    texts += [words(40)] * 25 + ["A b C d e f g", "a B c D e f g", "one two", "ONE  two", "three", "", None, " \n ", "x y z\x0bq r"]
    rng.shuffle(texts)
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def test_shingles_equal_the_plain_sets():
    texts = ["", None, "a", "A b", "a b c d e", "a b c d e f a b c d e", "é Ü\x0bx\ty  z w\n", " lead and trail ", "a b c d e " * 900, "b a", "ab", "x" * 3000]
    got = shingles.sets_of(texts)
    assert [len(x) for x in got] == [len(plain_set(t)) for t in texts]
    seen = {}
    for own, text in zip(got, texts, strict=True):
        assert len({*own.tolist()}) == len(own) and (np.sort(own) == own).all()
        seen.setdefault(frozenset(own.tolist()), set()).add(frozenset(plain_set(text)))
    assert all(len(x) == 1 for x in seen.values())
    alone = [shingles.sets_of([t])[0].tolist() for t in texts]
    assert alone == [x.tolist() for x in got]
    assert alone == [x.tolist() for x in shingles.sets_of([(t or "").encode() for t in texts])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, g string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs).collect())
    assert got == brute_force(rows)


def test_common_shingles_leave_prefixes(spark, monkeypatch):
    """With a tiny sketch the order differs wildly; the result must not."""
    monkeypatch.setattr(jaccard_join, "LEAST_CELLS", 1 << 10)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.joined(docs).collect())
    assert got == brute_force(rows)


def test_repeated_and_null_ids(spark, nothing):
    long = " ".join(f"k{i}" for i in range(50))
    other = " ".join(f"m{i}" for i in range(50))
    rows = [(9, long), (9, long), (4, long + " more"), (9, other), (2, other), (None, long), (None, None), (7, "alone in the world of texts")]
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(2, 2), (4, 2), (7, 7), (9, 2), (9, 2), (9, 2)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert jaccard_join.joined(nothing).count() == 0


def test_star_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = defaultdict(set)
    for x in parent:
        want[find(x)].add(x)
    scratch = common.Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), scratch, "t").collect()}
    assert got == {x: c for c, members in want.items() for x in members if x != c}


def test_links_between_join_what_links():
    rng = random.Random(4)
    pool = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    sets, base = [], []
    for size in (1, 2, 3, 5, 20, 21, 40, 120, 130, 160):
        own = set(rng.sample(range(4000), size))
        for _ in range(14):
            base.append({x for x in own if rng.random() > 0.1} | set(rng.sample(range(4000), rng.randrange(1 + size // 12))) or {0})
    sets = [np.sort(pool[sorted(x)]) for x in base]
    for blocks in (np.zeros(len(sets), int), np.array([rng.randrange(2) for _ in sets])):
        two = blocks.max() > 0
        names = {k: k for k in range(len(sets))}

        def joined(pairs):
            parent = dict(names)

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
            return [find(x) for x in names]

        want = [(a, b) for a in names for b in range(a) if not (two and blocks[a] == blocks[b]) and 100 * len(base[a] & base[b]) >= 75 * len(base[a] | base[b])]
        got = jaccard_join.links_between(list(names), np.arange(len(sets)), blocks, sets)
        assert all(100 * len(base[a] & base[b]) >= 75 * len(base[a] | base[b]) for a, b in got)
        assert joined(got) == joined(want) and len(got) < len(sets)


def test_family_just_under_the_limit_makes_no_rows(spark, monkeypatch):
    """2,000 texts of which hardly two link: all of each other's lists, dealt in blocks, and only links become rows."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(600)]
    rows = []
    for d in range(2000):
        own = list(base)
        for at in rng.sample(range(3, 597, 6), 12):
            own[at] = f"x{d}y{at}"
        rows.append((d, " ".join(own)))
    made = []
    inner = jaccard_join.compared

    def counted(*args):
        out = inner(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "compared", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 700)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [frozenset(shingles.sets_of([t])[0].tolist()) for _, t in rows]
    ids = {x: k for k, x in enumerate(sorted(frozenset().union(*sets)))}
    table = np.zeros((len(sets), len(ids)), np.float32)
    for k, own in enumerate(sets):
        table[k, [ids[x] for x in own]] = 1
    both, n = table @ table.T, np.array([len(x) for x in sets])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(100 * both >= 75 * (n[:, None] + n[None, :] - both), 1)), strict=True):
        ra, rb = sorted((find(int(a)), find(int(b))))
        parent[rb] = ra
    want = {k: find(k) for k in range(len(sets))}
    assert got == want and len(set(want.values())) > 100
    assert sum(made) < len(sets)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signatures_lose_no_partner(seed):
    """Whatever may link stays, in one block and between two; what is far from all others goes; powers are kept or made anew."""
    rng = random.Random(seed)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [t for size in (8, 20, 40, 130, 500) for t in family(rng, words(size), 6, max(1, size // 30))] + [words(rng.randrange(5, 900)) for _ in range(60)]
    sets = shingles.sets_of(texts)
    n = np.array([len(s) for s in sets])
    component = np.array([rng.randrange(40) for _ in texts])
    for block in (np.zeros(len(texts), int), np.array([rng.randrange(2) for _ in texts])):
        got = jaccard_join.may_link(n, component, block, [jaccard_join.signature(s) for s in sets])
        want = np.zeros(len(texts), bool)
        for i in range(len(texts)):
            for j in range(i):
                both = shingles.common_count(sets[i], sets[j])
                if component[i] != component[j] and (block.max() == 0 or block[i] != block[j]) and 100 * both >= 75 * (n[i] + n[j] - both):
                    want[i] = want[j] = True
        assert want.any() and not (want & ~got).any()
        assert got[-60:].sum() <= 3
    long = " ".join(f"w{k}" for k in range(700_000))  # longer than a chunk
    assert len(shingles.sets_of([long, "a b c d e"])[0]) == 699_996 and shingles.sets_of(["a b c d e"])[0].tolist() == shingles.sets_of([long[:50], "a b c d e"])[1].tolist()
