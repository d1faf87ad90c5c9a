from __future__ import annotations

import random

import numpy as np
import xxhash

from bidloom.llm import common, simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if sh and votes[b] * 2 > len(sh))


def slow_components(fps: dict[int, int]) -> dict[int, int]:
    ids, root = list(fps), {i: i for i in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 3:
                a, b = top(x), top(y)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_against_brute_force_on_the_tiny_table(spark, tiny):
    rows = common.read(spark, tiny, "documents").select("doc_id", "text").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    want = slow_components(fps)
    got = simhash.op9_simhash_near_dedup(spark, tiny).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(got) == len(rows)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    rows = [(5, None, "x", 1), (3, "", "x", 1), (9, " \t\n", None, 2), (7, "One two", "x", 1), (8, "one  TWO", "x", 1), (8, "one  TWO", "x", 1), (None, "zzz yyy xxx www", "x", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    assert {by[i].component_id for i in (3, 5, 9)} == {3} and by[5].fp == 0
    assert by[7].component_id == by[8].component_id == 7
    assert by[None].component_id is None
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forest_and_refined_deals_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = slow_components({x: x for x in fps})
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (4096, 10):
        edges = simhash.links(df, max_bucket=most).collect()
        root = {x: x for x in fps}

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for e in edges:
            a, b = top(e.a & (2**64 - 1)), top(e.b & (2**64 - 1))
            assert bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 3
            root[max(a, b)] = min(a, b)
        assert {x: top(x) for x in fps} == want


def test_pivot_tables_never_discard_a_link():
    refs = simhash.references()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    gap = np.abs(simhash.distance_table(x, refs).astype(int) - simhash.distance_table(y, refs).astype(int))
    assert gap.max() <= 3


def test_one_very_long_text():
    text = "a bb ccc dd " * 50_000
    assert simhash.fingerprint_text(text) == simhash.fingerprint_text(text.upper())


def test_deduplicate_removes_edited_copies(spark):
    rng = random.Random(3)
    rows, gone, far = [], set(), 0
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for k in rng.sample(range(10, 190), 3):
            other[k] = "edited"
        apart = words[:100] + [f"v{rng.randrange(10**6)}" for _ in range(100)]
        texts = [" ".join(x) for x in (words, other, apart)]
        far += bin(slow_fingerprint(texts[0]) ^ slow_fingerprint(texts[1])).count("1") > simhash.RADIUS
        assert simhash.jaccard(*map(simhash.shingle_set, texts[:2])) >= 0.8 > 0.5 > simhash.jaccard(*map(simhash.shingle_set, texts[::2]))
        rows += [(3 * i + k, t, "x", 1) for k, t in enumerate(texts)]
        gone.add(3 * i + 1)
    # One cluster far above MAX_BAND: copies of one text, each edited elsewhere.
    words = [f"u{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(300):
        rows.append((1000 + i, " ".join([*words[: 10 + i % 180], f"edit{i}", *words[11 + i % 180 :]]), "x", 1))
    gone |= set(range(1001, 1300))
    # A star: each copy is near the original and far from all other copies, so that they hang together by the original alone.
    words = [f"x{rng.randrange(10**6)}" for _ in range(200)]
    star = [" ".join(words)]
    for i in range(200):
        own = list(words)
        for k in range(4):
            own[rng.randrange(50 * k + 5, 50 * k + 45)] = f"star{i}"
        star.append(" ".join(own))
    sets = [simhash.shingle_set(t) for t in star]
    assert all(simhash.jaccard(sets[0], x) >= 0.8 for x in sets[1:]) and simhash.jaccard(sets[1], sets[2]) < 0.7
    rows += [(2000 + i, t, "x", 1) for i, t in enumerate(star)]
    gone |= set(range(2001, 2201))
    assert far > 10
    got = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted({r[0] for r in rows} - gone)


def test_edited_copies_without_a_broadcast(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words), "x", 1), (2, " ".join(words[:50] + ["new"] + words[51:]), "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "doc_id as row")
    profiles = df.select("doc_id", "row", "text").mapInArrow(simhash._profiles, "doc_id long, row long, fp long, same long, n int, bands array<long>")
    want = {tuple(r) for r in simhash.copies(df, common.cut(profiles, "p"), "row", "text").collect()}
    assert len(want) == 1 and want == {tuple(r) for r in simhash.copies(df, common.cut(profiles, "p"), "row", "text", most=0).collect()}


def test_links_inside_large_bands_are_not_lost(spark, monkeypatch):
    """Texts of one large cluster whose links no hub sees: pairs of twins that are near each other and far from all others, in bands of the whole cluster."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        own = list(words)
        for k in range(12):
            own[15 * k + rng.randrange(14)] = f"twin{i}"
        other = list(own)
        for k in (20, 120):
            other[k + rng.randrange(40)] = f"own{i}"
        texts += [own, other]
    texts = [" ".join(t) for t in texts]
    sets, fps = [simhash.shingle_set(t) for t in texts], [slow_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(600) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8 or bin(fps[i] ^ fps[j]).count("1") <= 3]
    root = list(range(600))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    mul, add = simhash._multipliers()
    keys = [set(simhash.bands(s, mul, add)) for s in sets]
    for i, j in near:
        if keys[i] & keys[j] or bin(fps[i] ^ fps[j]).count("1") <= 3:
            root[max(top(i), top(j))] = min(top(i), top(j))
    want = [i for i in range(600) if top(i) == i]
    assert 200 < len(want) < 550
    got = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect()]
    assert sorted(got) == want
