import random
from collections import Counter

import xxhash

from wideflow.llm import simhash
from wideflow.llm.components import connected_components


def brute_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    c = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(s))


def brute_components(nodes, linked):
    nodes, label = list(nodes), {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(nodes):
            for b in nodes[i + 1:]:
                if label[a] != label[b] and linked(a, b):
                    low, high = sorted((label[a], label[b]))
                    label = {n: low if x == high else x for n, x in label.items()}
                    changed = True
    return label


def test_components_of_links(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(60)]
    links += [(600, 601 + i) for i in range(200)] + [(7, 7), (None, 3), (900, 900)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    adjacent = set(real)
    nodes = sorted({x for p in real for x in p})
    label = {n: n for n in nodes}
    for _ in nodes:
        new = dict(label)
        for a, b in adjacent:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    assert out == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_design_covers_the_distance():
    rng = random.Random(2)
    for bits in range(7):
        for design in simhash.designs(bits):
            assert sum(k for _, k, _ in design) == 32
            assert sum(r + 1 for _, _, r in design) > bits
            for _ in range(200):
                x = rng.getrandbits(64)
                y = x
                for b in rng.sample(range(64), bits):
                    y ^= 1 << b
                count = lambda v, d: bin(v >> (2 * d) & 3).count("1")
                assert any(sum(abs(count(x, d) - count(y, d)) for d in range(at, at + k)) <= r
                           for at, k, r in design)


def test_links_find_every_component(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for x in list(fps)[:12]:
        for _ in range(6):                                # dense groups and chains
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.4 else x
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f, 1 + i % 3) for i, f in enumerate(signed)], "fp long, n long")
    for bits in (0, 1, 3, 4):
        comp = {r.node: r.component for r in connected_components(simhash.links(frame, bits)).collect()}
        want = brute_components(signed, lambda a, b, k=bits: bin((a ^ b) & (2**64 - 1)).count("1") <= k)
        assert {f: comp.get(f, f) for f in signed} == want


def test_documents(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = simhash.simhash_components(docs).collect()
    assert len(out) == len(edge_rows)
    prints = Counter((i, format(brute_print(t), "016x")) for i, t, _, _ in edge_rows)
    assert Counter((r.doc_id, r.fingerprint) for r in out) == prints
    fps = {brute_print(t) for _, t, _, _ in edge_rows}
    label = brute_components(sorted(fps), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, t, _, _ in edge_rows:
        c = label[brute_print(t)]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    for r in out:
        assert r.component_id == least.get(label[int(r.fingerprint, 16)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len(set(label.values()))
    ids = Counter(r[0] for r in rows)
    assert all(ids[i] == 1 for i in least.values())
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
