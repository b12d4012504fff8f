"""N-gram Jaccard join against all pairs, hot groups in chunks, awkward rows."""

import random
import re

import pytest

from vigil.llm import jaccard_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    sets = [grams(t) for _, t in docs]
    n, root, links = len(docs), list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(n):
            if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i in range(n):
        classes.setdefault(find(i), []).append(docs[i][0])
    return sorted((d if d is not None else -1, min((x for x in classes[find(i)] if x is not None), default=-1), len(classes[find(i)]), links[i]) for i, (d, _) in enumerate(docs))


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.class_size, r.n_links) for r in df.collect())


def edited(words, rng, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(80)]
        docs += [" ".join(words)] * rng.randrange(1, 4)
        docs += [edited(words, rng, rng.choice([0.005, 0.01, 0.02, 0.05])) for _ in range(12)]
    return list(enumerate(docs))


def test_against_all_pairs(rows, ws, corpus):
    assert found(jaccard_join.similar(rows(corpus, "doc_id long, text string", 4), ws)) == brute(corpus)


def test_chunks_of_a_hot_group_lose_no_link(rows, ws, corpus):
    assert found(jaccard_join.similar(rows(corpus, "doc_id long, text string", 4), ws, chunk_rows=5)) == brute(corpus)


def test_awkward_rows(awkward, ws):
    assert found(jaccard_join.similar(awkward, ws)) == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])


def test_empty_table(no_docs, ws):
    assert found(jaccard_join.similar(no_docs, ws)) == []


def test_prefixes_are_shortened_to_the_target_recall():
    assert jaccard_join.matched_depth(0.8, 40, 7, 0.5) == 7
    depth = jaccard_join.matched_depth()
    assert 1 - (1 - 0.8**depth) ** jaccard_join.TREES >= jaccard_join.TARGET_RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES
    assert jaccard_join.matched_depth(0.1, 1, 7, 0.99) == 1


def test_components(rows, ws):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in jaccard_join.components(rows(chain, "a long, b long"), ws, "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --------------------------------------------------------------------------------- the forest
def _classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in groups.values()}


def test_neighbours_are_the_tries(spark, rows, ws):
    """At every depth the neighbours connect what shares a prefix in some tree, also across ranges and among equal signatures."""
    import random

    import numpy as np

    rng, trees, depth = random.Random(9), 3, 4
    signatures = {n: np.array([[rng.randrange(2 if n % 3 else 3) for _ in range(depth)] for _ in range(trees)], ">u2") for n in range(150)}
    for n in range(120, 150):
        signatures[n] = signatures[7]
    reps = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in signatures.items()], "node long, signature binary").repartition(6)
    edges = [(r.a, r.b, r.depth) for r in jaccard_join.forest(reps, ws, trees, depth, 1).collect()]
    shared = lambda x, y: max(int(k) for k in jaccard_join.shared_values(signatures[x], signatures[y]))
    assert all(a < b and 1 <= k <= shared(a, b) for a, b, k in edges) and len(edges) <= trees * 150
    for level in range(1, depth + 1):
        plain = [(a, b) for a in signatures for b in signatures if a < b and shared(a, b) >= level]
        assert _classes([(a, b) for a, b, k in edges if k >= level], signatures) == _classes(plain, signatures), level


def _level(spark, ws, texts):
    import numpy as np

    factors = jaccard_join.seeds(jaccard_join.TREES * jaccard_join.DEPTH)
    made = [(n, bytearray(jaccard_join.signature(jaccard_join.ngram_set(t), factors))) for n, t in enumerate(texts)]
    reps = spark.createDataFrame(made, "node long, signature binary")
    edges, level = jaccard_join.matched_edges(reps, ws, 0.8, jaccard_join.TREES, jaccard_join.DEPTH, jaccard_join.TARGET_RECALL)
    assert np.all([r.a < r.b for r in edges.collect()])
    return level


def test_prefixes_are_shortened_only_as_far_as_the_data_need(spark, ws):
    """Close copies are met by whole signatures; pairs just above the threshold need shorter prefixes."""
    import random

    from vigil.llm.shared import Workspace

    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    close, far = [], []
    for _ in range(150):
        words = prose(400)
        close += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["start", *words[1:]])]
        far += [" ".join(words), " ".join([*words[:-45], *prose(45)])]
    assert _level(spark, ws, close) == jaccard_join.DEPTH
    other = Workspace(spark, "far")
    assert _level(spark, other, far) < jaccard_join.DEPTH
    other.drop()


def test_every_pair_estimates_the_recall(spark, ws):
    """a few pairs are enough to stop at whole signatures, as none is left to a sample; brute force gives the same shares."""
    import random

    import numpy as np

    rng, trees, depth = random.Random(31), jaccard_join.TREES, jaccard_join.DEPTH
    texts = []
    for _ in range(4):
        words = [f"w{rng.randrange(100_000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"])]
    assert _level(spark, ws, texts) == depth
    signatures = [np.array([[rng.randrange(2) if n % 2 else 0 for _ in range(depth)] for _ in range(trees)], ">u2") for n in range(12)]
    reps = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in enumerate(signatures)], "node long, signature binary")
    pairs = [(a, b, 6 + (a + b) % 3) for a in range(12) for b in range(a)]
    got = jaccard_join.recall(spark.createDataFrame(pairs, "a long, b long, depth int"), reps, [7, 8], 0.5, trees)
    for level in (7, 8):
        near = [s for a, b, k in pairs if k >= level and (s := float((signatures[a] == signatures[b]).mean())) >= 0.5]
        assert len(near) > 3 and abs(got[level] - len(near) / sum(1 / (1 - (1 - s ** level) ** trees) for s in near)) < 1e-9
