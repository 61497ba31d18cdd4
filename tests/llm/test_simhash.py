import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from usagelens.llm import simhash
from usagelens.llm.components import components


def brute_fingerprint(text, k=3):
    table = {i: i + 32 for i in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, bits=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def test_groups_match_brute_force(documents, document_rows):
    found = [r for r in simhash.near_duplicates(documents).collect()]
    assert len(found) == len(document_rows)
    codes = {t: brute_fingerprint(t) for _, t, *_ in document_rows}
    expected = sorted(((i, codes[t]) for i, t, *_ in document_rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint % 2**64) for r in found), key=str) == expected
    rows = [(i, codes[t]) for i, t, *_ in document_rows]
    groups = brute_groups([c for _, c in rows])
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    by_code = {c: least.get(g) for (_, c), g in zip(rows, groups)}
    assert all(r.component_id == by_code[r.fingerprint % 2**64] for r in found)


def test_one_document_of_each_group_stays(documents, document_rows):
    kept = simhash.one_per_group(documents)
    assert kept.columns == documents.columns
    groups = brute_groups([brute_fingerprint(t) for _, t, *_ in document_rows])
    assert kept.count() == len(set(groups))
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 0 in ids


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.one_per_group(no_documents).count() == 0


def test_links_over_shards_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 20)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, dtype="u8")
    codes = [int(c) for c in base]
    for c in base[:60]:
        for _ in range(3):
            c ^= np.uint64(1) << np.uint64(rng.integers(64))
            codes.append(int(c))
    codes = sorted(set(codes))
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    found = components(simhash.links(spark.createDataFrame(signed, "fingerprint long"))).collect()
    groups = brute_groups(codes)
    size = {g: groups.count(g) for g in groups}
    expected = {frozenset(c for c, h in zip(codes, groups) if h == g) for g in groups if size[g] > 1}
    ours = {}
    for r in found:
        ours.setdefault(r.root, set()).add(r.node % 2**64)
    assert {frozenset(v) for v in ours.values()} == expected


def test_large_dense_group_yields_a_forest():
    rng = np.random.default_rng(4)
    flips = np.uint64(1) << rng.integers(0, 64, (9000, 3)).astype("u8")
    codes = np.unique(np.uint64(0x123456789ABCDEF) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    found = simhash.spanning_links(codes, 3)
    assert len(found) < 4 * len(codes)
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in found:
        assert (int(codes[a]) ^ int(codes[b])).bit_count() <= 3
        root[find(a)] = find(b)
    assert len({find(i) for i in range(len(codes))}) == 1


@given(st.lists(st.integers(0, 2**32 - 1), min_size=5, max_size=60, unique=True),
       st.integers(0, 31))
@settings(max_examples=60, deadline=None)
def test_tree_brings_close_codes_together(values, bit):
    codes = np.array([*values, values[0] ^ (1 << bit)], "u4")
    tree = simhash.VantageTree(codes[:20], 4, 1)
    shards = [set(at.tolist()) for _, at in tree.shards(codes)]
    assert any({0, len(codes) - 1} <= s for s in shards)
    assert set().union(*shards) == set(range(len(codes)))


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
