"""Sharding by balanced label propagation.

Rows with equal texts are one node, weighted by its rows. Nodes are linked through the lines that they
share, of any length but blank ones: a line is the middle of a star, so a line of a third of all documents costs one row
a document and never a pair of documents. A node starts in the shard of its rarest shared line (or of its text).
In each round Spark joins carry

* to every line the weight that each shard has among its nodes, as shares of the line's whole, and
* to every node the mean of those shares over its lines, weighted by their length, so that a short phrase counts little beside
  a paragraph. The node would move to the shard of the highest mean; its agreement is the mean of its present shard.

What wants to move from shard a to b is summed up in ``BINS`` bins of gain; as much may move as moves
back, and besides what room b has below its quota, highest gains first, within the last bin by a hash. Those sums are at most
shards * shards * (BINS + 1) rows; nothing else reaches the driver. Rounds go on until less than ``STILL`` of the linked weight
moves, or until a round raises the agreement of the whole by less than ``STEP``; agreement is at most 1, so that there is an end.

The last step makes the law ``rows`` exact and moves no more than it must: nodes are ranked in the order of shard, linked or not,
rarest line and text, ranks being sums over range partitions; what a shard holds beyond its count goes, in that order, to the
shards that lack rows. A text's rows have neighbouring ranks, so they share a shard unless they cross such a border.
``cut_share`` measures what is left apart.

Defined results: a null text is an empty text of size 8; repeated rows each take a slot; null ids are
ids like others; fewer rows than shards fill as many shards with one each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidloom.llm import common

SHARDS = 24
STILL, STEP = 0.01, 0.005
BINS = 16
#: Bits below the partition number in a row number of ``monotonically_increasing_id``.
ROW_BITS = 33


def nodes_and_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, doc_id, size, text_crc32, node)`` and links ``(node, line, chars, held, hot)``, each line held by ``held`` nodes, two or more.

    ``hot`` marks the lines that hold over a thousandth of all links, which are fewer than a thousand lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.substring(F.sha2(text.cast("binary"), 256), 1, 32)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        node.alias("node"),
    )
    lines = F.filter(F.array_distinct(F.split(text, "\n")), lambda x: F.trim(x) != "")
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars")))
    held = docs.select(node.alias("node"), F.inline(each)).groupBy("node", "line").agg(F.max("chars").alias("chars"))
    held = common.cut(held, "lines")
    shared = common.cut(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    links = common.join_counted(held, shared, "line", "n").select("node", "line", "chars", F.col("n").alias("held"))
    total = int(shared.agg(F.sum("n")).first()[0] or 0)
    return common.cut(rows, "rows"), common.cut(links.withColumn("hot", F.col("held") * 1000 > total), "links")


def quotas(size: dict[int, int], want: dict[tuple[int, int], list[int]], room: int) -> list[tuple[int, int, int, float]]:
    """``(a, b, bin, share)``: moves from a to b of gains above ``bin`` go, of that bin the ``share``.

    want: for each (a, b) the weights that want to move by bin of gain. room: rows of a full shard.
    """
    into: dict[int, int] = {}
    for (_, b), bins in want.items():
        into[b] = into.get(b, 0) + sum(bins)
    out = []
    for (a, b), bins in sorted(want.items()):
        total = sum(bins)
        back = min(total, sum(want.get((b, a), [0])))
        free = max(0, room - size.get(b, 0)) * total // max(1, into[b])
        left = min(total, back + free)
        for k in range(len(bins) - 1, -1, -1):
            if left < bins[k]:
                out.append((a, b, k, left / bins[k]))
                break
            left -= bins[k]
        else:
            out.append((a, b, -1, 0.0))
    return out


def start(nodes: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(node, n, anchor, linked, shard)``: each node in the shard of its rarest shared line, the longest of equally rare ones."""
    anchors = links.groupBy("node").agg(F.min(F.struct("held", -F.col("chars"), "line")).getField("line").alias("line"))
    state = nodes.join(anchors, "node", "left").select("node", "n", F.coalesce("line", F.xxhash64("node")).alias("anchor"), F.col("line").isNotNull().alias("linked"))
    return common.cut(state.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")), "state")


def propagate(state: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``state`` with the shards after label propagation over ``links``."""
    spark = state.sparkSession
    room = -(-int(state.agg(F.sum("n")).first()[0] or 0) // shards)
    before = -1.0
    while True:
        at = links.join(state.select("node", "n", "shard"), "node")
        votes = at.groupBy("line", "hot").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"v{s}") for s in range(shards)])
        votes = common.cut(votes.select("line", "hot", *[(F.col(f"v{s}") / F.col("all")).alias(f"v{s}") for s in range(shards)]), "votes")
        # Hot lines are under a thousand rows and are broadcast; the others are spread by the shuffle.
        far = links.where("not hot").join(votes.where("not hot").drop("hot"), "line")
        near = links.where("hot").join(F.broadcast(votes.where("hot").drop("hot")), "line")
        pull = far.unionByName(near).groupBy("node").agg(F.sum("chars").alias("chars"), *[F.sum(F.col("chars") * F.col(f"v{s}")).alias(f"v{s}") for s in range(shards)])
        pulls = F.array(*[F.round(F.col(f"v{s}") / F.col("chars"), 9) for s in range(shards)])  # sums in any order agree
        wish = state.join(pull.select("node", pulls.alias("pull")), "node").withColumn("best", F.array_max("pull"))
        wish = wish.withColumn("own", F.get("pull", F.col("shard"))).withColumn("to", (F.array_position("pull", F.col("best")) - 1).cast("int"))
        gain = F.col("best") - F.col("own")
        wish = wish.withColumn("bin", F.when(gain > 0, F.least((gain * BINS).cast("int"), F.lit(BINS - 1))).otherwise(-1))
        wish = common.cut(wish.select("node", "n", "shard", "to", "bin", (F.col("n") * F.col("own") * 1e6).cast("long").alias("own")), "wishes")
        want: dict[tuple[int, int], list[int]] = {}
        linked = agreed = 0
        for r in wish.groupBy("shard", "to", "bin").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).collect():
            linked, agreed = linked + r.n, agreed + r.own
            if r.bin >= 0:
                want.setdefault((r.shard, r.to), [0] * BINS)[r.bin] += r.n
        agreement = agreed / max(1, linked) / 1e6
        if not want or agreement < before + STEP:
            return state
        before = agreement
        size = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        limit = spark.createDataFrame(quotas(size, want, room), "shard int, to int, least int, share double")
        chance = (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) + 0.5) / 1_000_000
        goes = (F.col("bin") >= 0) & ((F.col("bin") > F.col("least")) | ((F.col("bin") == F.col("least")) & (chance < F.col("share"))))
        moved = common.cut(wish.join(F.broadcast(limit), ["shard", "to"]).where(goes).select("node", "n", "to"), "moved")
        state = state.join(moved.select("node", "to"), "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
        state = common.cut(state, "state")
        if int(moved.agg(F.sum("n")).first()[0] or 0) < STILL * linked:
            return state


def ranked(state: DataFrame) -> DataFrame:
    """``(node, shard, first)``: the rank of each node's first row in the order of shard, linked or not, anchor and node."""
    state = state.withColumn("alone", ~F.col("linked"))
    order = ["shard", "alone", "anchor", "node"]
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = common.cut(state.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "order")
    sums = own.groupBy("part").agg(F.sum("n").alias("n"), F.min(F.struct(*order)).alias("low")).collect()  # one row a partition
    before, starts = 0, []
    for r in sorted(sums, key=lambda r: r.low):
        starts.append((r.part, before))
        before += r.n
    starts = state.sparkSession.createDataFrame(starts, "part int, before long")
    inside = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    own = own.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return own.join(F.broadcast(starts), "part").select("node", "shard", (F.col("before") + F.col("inside")).alias("first"))


def placed(sizes: list[int], shard: Column, rank: Column) -> tuple[Column, Column]:
    """(shard, slot) of a row by its present shard and its rank in the order of shards.

    The larger shards keep the one row more, a shard's first rows stay, and its others fill the shards that lack rows.
    """
    shards, total = len(sizes), sum(sizes)
    few, more = divmod(total, shards)
    large = set(sorted(range(shards), key=lambda s: (-sizes[s], s))[:more])
    target = [few + (s in large) for s in range(shards)]
    begin = list(accumulate(sizes, initial=0))[:-1]
    spilled = list(accumulate((max(0, n - t) for n, t in zip(sizes, target, strict=True)), initial=0))[:-1]
    holes = [(s, n, t - n) for s, (n, t) in enumerate(zip(sizes, target, strict=True)) if t > n] or [(0, 0, 0)]
    opens = list(accumulate((w for *_, w in holes), initial=0))[:-1]
    of = lambda xs, at: F.get(F.array(*[F.lit(x).cast("long") for x in xs]), at)
    inside = rank - of(begin, shard)
    over = inside - of(target, shard)
    at = of(spilled, shard) + over
    hole = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in opens]), lambda x: x <= at)) - 1
    stays = over < 0
    to = F.when(stays, shard.cast("long")).otherwise(of([s for s, *_ in holes], hole))
    return to.cast("int"), F.when(stays, inside).otherwise(of([n for _, n, _ in holes], hole) + at - of(opens, hole)).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, node, shard, slot)``: a row for each row, counts of shards at most one apart."""
    return _shard(*nodes_and_lines(docs, id_col, text_col), shards)


def _shard(rows: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    # A text's rows are numbered by input partition: however often it is copied, a task numbers no more than one
    # partition holds, and there are more such parts the larger the input is.
    rows = rows.withColumn("salt", F.shiftright("row", ROW_BITS))
    # Rows of a text by salt, and where each salt's rows begin within the text's.
    salted = common.cut(rows.groupBy("node", "salt").agg(F.count("*").alias("n")), "salted")
    nodes = common.cut(salted.groupBy("node").agg(F.sum("n").alias("n")), "nodes")
    state = propagate(start(nodes, links, shards), links, shards)
    sizes = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    by_salt = F.coalesce(F.sum("n").over(W.partitionBy("node").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = salted.withColumn("before", by_salt).join(ranked(state), "node")
    starts = common.cut(starts.select("node", "salt", F.col("shard").alias("home"), (F.col("first") + F.col("before")).alias("start")), "starts")
    inside = F.row_number().over(W.partitionBy("node", "salt").orderBy("doc_id", "row")) - 1
    out = rows.withColumn("inside", inside).join(starts, ["node", "salt"]).withColumn("rank", F.col("start") + F.col("inside"))
    to, slot = placed([sizes.get(s, 0) for s in range(shards)], F.col("home"), F.col("rank"))
    return out.select("doc_id", "size", "text_crc32", "node", to.alias("shard"), slot.alias("slot"))


def cut_share(found: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``(lines, pairs, cut)``: of the pairs of rows that share a line, the mean share over lines that lie in different shards.

    found: rows ``(node, shard)``. ``cut`` weighs lines by their length.
    """
    each = links.select("node", "line", "chars").join(found.groupBy("node", "shard").agg(F.count("*").alias("n")), "node")
    each = each.groupBy("line", "chars", "shard").agg(F.sum("n").cast("double").alias("n")).groupBy("line", "chars")
    each = each.agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same")).withColumn("pairs", F.col("all") * (F.col("all") - 1) / 2)
    return each.agg(F.count("*").alias("lines"), F.sum("pairs").alias("pairs"), (F.sum(F.col("chars") * (1 - F.col("same") / F.col("pairs"))) / F.sum("chars")).alias("cut"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) for all documents."""
    found = shard(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op4_balanced_shards": op4_balanced_shards}
ORACLE: dict[str, str] = {}
