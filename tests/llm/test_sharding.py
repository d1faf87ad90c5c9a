from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from bidloom.llm import common, sharding

SCHEMA = "doc_id long, text string, shard string, row int"


def law(rows, shards):
    """Counts at most one apart, slots gapless from 0."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    return by


def test_tiny_table(spark, tiny):
    docs = {r.doc_id: r.text for r in common.read(spark, tiny, "documents").collect()}
    got = sharding.op4_balanced_shards(spark, tiny).collect()
    law(got, 24)
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    # Equal texts have neighbouring ranks: each cut splits one text at most.
    split = Counter()
    for t in set(docs.values()):
        split[len({r.shard for r in got if docs[r.doc_id] == t}) > 1] += 1
    assert split[True] <= 23


def test_linked_documents_come_together(spark):
    line = "this line number {} is shared by some documents and by no others at all"
    rows = [(i, f"{line.format(i % 6)}\nown text of document {i} which nobody else has at all", "x", 1) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(df, shards=6).collect()
    law(got, 6)
    homes = defaultdict(Counter)
    for r in got:
        homes[r.doc_id % 6][r.shard] += 1
    kept = sum(max(c.values()) for c in homes.values())
    assert kept > 160  # 40 of 240 by chance

    again = sharding.shard(df, shards=6).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def slow_propagation(state, links, shards, chance):
    """The rounds by plain loops: state node -> (n, shard), links (node, line, chars), chance node -> number below 1."""
    room, before = -(-sum(n for n, _ in state.values()) // shards), -1.0
    while True:
        votes = defaultdict(lambda: [0.0] * shards)
        for node, line, _ in links:
            votes[line][state[node][1]] += state[node][0]
        pull, chars = defaultdict(lambda: [0.0] * shards), Counter()
        for node, line, c in links:
            chars[node] += c
            for k in range(shards):
                pull[node][k] += c * votes[line][k] / sum(votes[line])
        want, wishes, agreed, size = {}, [], 0, Counter()
        for n, at in state.values():
            size[at] += n
        for node, p in pull.items():
            p = [round(x / chars[node], 9) for x in p]
            n, at = state[node]
            to = p.index(max(p))
            agreed += int(n * p[at] * 1e6)
            if p[to] > p[at]:
                k = min(int((p[to] - p[at]) * sharding.BINS), sharding.BINS - 1)
                want.setdefault((at, to), [0] * sharding.BINS)[k] += n
                wishes.append((node, n, at, to, k))
        linked = sum(state[x][0] for x in pull)
        if not want or agreed / linked / 1e6 < before + sharding.STEP:
            return state
        before = agreed / linked / 1e6
        limit = {(a, b): (k, share) for a, b, k, share in sharding.quotas(size, want, room)}
        moved = [w for w in wishes if w[4] > limit[w[2:4]][0] or (w[4] == limit[w[2:4]][0] and chance[w[0]] < limit[w[2:4]][1])]
        state = state | {node: (n, to) for node, n, _, to, _ in moved}
        if sum(w[1] for w in moved) < sharding.STILL * linked:
            return state


def linked_rows(groups=6, n=240):
    """Documents of some groups: a group's documents share a long line with some of it, and a short one with all of every group."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        g = i % groups
        own = [f"shared line {g} number {rng.randrange(4)} of this group, somewhat long", f"text of document {i}", "yes", f"ok {rng.randrange(9)}"]
        rows.append((i if i % 50 else i - 1, "\n".join(own if i % 40 else own[:1]), "x", 1))
    return rows


def test_propagation_against_plain_loops(spark):
    rows, links = sharding.nodes_and_lines(spark.createDataFrame(linked_rows(), SCHEMA))
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"))
    # From a start by hash, so that there is something to move.
    state = common.cut(sharding.start(nodes, links, 6).withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(6)).cast("int")), "state")
    begun = {r.node: (r.n, r.shard) for r in state.collect()}
    chance = {r.node: r.c for r in nodes.select("node", ((F.pmod(F.xxhash64("node"), F.lit(1_000_000)) + 0.5) / 1_000_000).alias("c")).collect()}
    want = slow_propagation(begun, [(r.node, r.line, r.chars) for r in links.collect()], 6, chance)
    got = {r.node: (r.n, r.shard) for r in sharding.propagate(state, links, 6).collect()}
    assert got == want and want != begun


def test_links_of_every_length_and_cut_share(spark):
    df = spark.createDataFrame(linked_rows(), SCHEMA)
    rows, links = sharding.nodes_and_lines(df)
    assert links.agg(F.min("chars")).first()[0] == 3  # "yes"
    by = defaultdict(Counter)
    found = sharding.shard(df, shards=6)
    texts = {r.node: t for r, t in zip(rows.orderBy("row").collect(), [x[1] for x in linked_rows()], strict=True)}
    for r in found.collect():
        for line in set(texts[r.node].split("\n")):
            by[line][r.shard] += 1
    nodes_of = Counter(line for t in set(texts.values()) for line in set(t.split("\n")))
    pair, num, den = (lambda n: n * (n - 1) / 2), 0.0, 0
    for line, c in by.items():
        if nodes_of[line] > 1:
            num, den = num + len(line) * (1 - sum(map(pair, c.values())) / pair(sum(c.values()))), den + len(line)
    got = sharding.cut_share(found, links).first()
    assert abs(got.cut - num / den) < 1e-9
    by_hash = rows.select("node", F.pmod(F.xxhash64("doc_id"), F.lit(6)).alias("shard"))
    assert got.cut < 0.6 * sharding.cut_share(by_hash, links).first().cut


def test_placing_moves_no_more_than_it_must(spark):
    sizes = [7, 0, 3, 12, 5]
    rows = [(s, i) for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
    to, slot = sharding.placed(sizes, F.col("home"), F.col("rank"))
    got = spark.createDataFrame(rows, "home int, rank long").select("home", to.alias("shard"), slot.alias("slot")).collect()
    law(got, 5)
    assert sum(r.home == r.shard for r in got) == sum(min(n, t) for n, t in zip(sizes, [6, 5, 5, 6, 5], strict=True))


def test_hot_text_nulls_repeats_and_few_rows(spark):
    rows = [(i, "same text " * 9, "x", 1) for i in range(300)] + [(7, None, None, 1), (7, None, None, 1), (None, "", "x", 1), (None, None, "x", 1), (8, "\n" * 50, "x", 1), (9, "z" * 500_000, "x", 1)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    law(got, 24)
    assert len(got) == len(rows) and sum(r.size == 8 for r in got) == 4
    few = sharding.shard(spark.createDataFrame(rows[:5], SCHEMA)).collect()
    law(few, 24)
    assert len(few) == 5
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quotas_let_swaps_and_room_through():
    want = {(0, 1): [10, 0, 30], (1, 0): [20, 0, 0]}
    got = {(a, b): (k, s) for a, b, k, s in sharding.quotas({0: 100, 1: 95}, want, 100)}
    assert got == {(0, 1): (2, 25 / 30), (1, 0): (-1, 0.0)}
