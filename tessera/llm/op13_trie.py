"""The prefix trie of conversations: which beginnings they share, how many go on, and how many tokens sharing saves.

Turns are dictionary-encoded: each distinct (role, text) gets a number, and a conversation is the array of its turns'
numbers. Conversations are then dealt out by radix, most significant turn first: all of a bucket share a prefix, the
smallest and largest array of the bucket (a map-side aggregate) say how far they go on together, and the turn after that
deals them out to the next buckets. A bucket of at most ``LOCAL`` turns is local: tasks finish it by multikey quicksort,
whose equal parts are the nodes. Buckets above that recurse, so a first turn or a whole conversation that a third of all
have is many tasks' work; a common prefix of any length is one round.

What flows between rounds is cut into the shared folder. Buckets that recurse hold over ``LOCAL`` turns each, so there are at
most turns / ``LOCAL`` of them in a round; their rows meet them by a join in which hot keys are broadcast. Totals of subtrees
go up round by round. The ids of the conversations that end at one node are joined in sorted pieces, over which the digest is
streamed. A task holds one conversation's array at least (8 bytes a turn), never a bucket that recurses.

Defined results: rows without conv_id take no part; null role or text is empty; turns are in order of ``turn``, nulls
first, equal ones by the digest of role and text; repeated rows are turns of their own; ``c - c % 20`` rounds towards zero;
a conversation without turns after rebuilding is a member of the root; an empty table has no nodes; other columns than
``conv_id, turn, role, text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, join_hot

#: A bucket of at most so many turns is finished by one task.
LOCAL = 2048
#: Ids that are joined into one piece before a node's digest is streamed over the pieces.
PIECE = 512
#: Conversations in a block share the beginning of the block's first one, up to fewer than ``HEAD`` turns.
BLOCK, HEAD = 20, 4
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
WORD = r"[^\x20\x09-\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, words``: every turn in its place, from 0. Texts stay where they are; their digests are shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    return rows.select("conv", place.cast("long").alias("pos"), "digest", "words")


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEAD


def rebuilt(all_turns: DataFrame) -> DataFrame:
    """``conv, part, pos, digest, words``: each conversation's own turns after its head (part 1), its block's first ones before (part 0)."""
    own = all_turns.where(F.col("pos") >= _head(F.col("conv"))).select("conv", F.lit(1).alias("part"), "pos", "digest", "words")
    first = all_turns.where((F.col("conv") % BLOCK == 0) & (F.col("pos") < HEAD - 1)).withColumn("of", F.explode(F.sequence(F.lit(1 - BLOCK), F.lit(BLOCK - 1))))
    lent = first.select(F.try_add("conv", F.col("of").cast("long")).alias("to"), "conv", "pos", "digest", "words")
    lent = lent.where((F.col("to") - F.col("to") % BLOCK == F.col("conv")) & (F.col("pos") < _head(F.col("to"))))
    real = all_turns.select(F.col("conv").alias("to")).distinct()
    return own.unionByName(lent.join(real, "to", "left_semi").select(F.col("to").alias("conv"), F.lit(0).alias("part"), "pos", "digest", "words"))


def encoded(rows: DataFrame) -> DataFrame:
    """``rows(conv, part, pos, digest, words)`` with ``id``, the number of the turn in the dictionary of all distinct turns."""
    known = cut(rows.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    total = known.agg(F.sum("n")).first()[0] or 0
    return join_hot(rows, known, "digest", "n", total, "id")


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv, seq, words``: one row for each conversation, also without turns: turn ids and word counts in order."""
    found = cut(turns(conversations))
    ids = encoded(cut(rebuilt(found)))
    one = ids.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "id", "words"))).alias("t"))
    got = found.select("conv").distinct().join(one, "conv", "left")
    empty = F.array().cast("array<long>")
    return got.select("conv", F.coalesce(F.col("t.id"), empty).alias("seq"), F.coalesce(F.col("t.words"), empty).alias("words"))


def _ids(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()


def subtree(convs: list[int], seqs: list, words: list, members: list[int], depth: int) -> list[list]:
    """The nodes below and with the one at ``depth`` that all ``members`` share, parents first: the columns of ``NODE``.

    Multikey quicksort: a part is split by its middle turn at one depth into less, equal and more; the equal part is a node, and is
    split on at the next depth. ``convs, seqs, words`` are indexed by member.
    """
    nodes, above = [], []

    def node(own: list[int], at: int, parent: int) -> list[int]:
        """Adds a node; members that go on come back."""
        ended = [convs[m] for m in own if len(seqs[m]) == at]
        saved = (len(own) - 1) * int(words[own[0]][at - 1]) if at else 0
        nodes.append([min(convs[m] for m in own), at, nodes[parent][0] if parent >= 0 else None, len(own), 0, 0, saved, _ids(ended)])
        above.append(parent)
        return [m for m in own if len(seqs[m]) > at]

    todo = [(node(members, depth, -1), depth, 0)]
    while todo:
        part, at, parent = todo.pop()
        if not part:
            continue
        pivot, less, same, more = seqs[part[len(part) // 2]][at], [], [], []
        for m in part:
            x = seqs[m][at]
            (less if x < pivot else more if x > pivot else same).append(m)
        todo += [(less, at, parent), (more, at, parent)]
        rest = node(same, at + 1, parent)
        todo.append((rest, at + 1, len(nodes) - 1))
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        n[5] = n[5] or 1
        if (p := above[k]) >= 0:
            nodes[p][4] += 1
            nodes[p][5] += n[5]
            nodes[p][6] += n[6]
    return nodes


def _finish(f: pd.DataFrame) -> pd.DataFrame:
    convs, seqs, words = f["conv"].tolist(), [x.tolist() for x in f["seq"]], [x.tolist() for x in f["words"]]
    buckets: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(f["up"], f["up_conv"], f["depth"], f["digit"])):
        buckets.setdefault(key, []).append(k)
    rows = []
    for (up, up_conv, depth, _), members in buckets.items():
        made = subtree(convs, seqs, words, members, depth)
        made[0][2] = up_conv
        rows += [(*n, up if k == 0 else None) for k, n in enumerate(made)]
    return pd.DataFrame(rows, columns=[*COLUMNS, "up"]).astype({"parent_conv_id": "Int64"})


def _pieces(size: int):
    """Sorted (bucket, conv) to joined ids, ``size`` at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, ids = None, None, []
        for f in frames:
            rows = []
            for bucket, conv in zip(f["bucket"].tolist(), f["conv"].tolist()):
                if ids and (bucket != key or len(ids) == size):
                    rows.append((key, first, ",".join(map(str, ids))))
                    ids = []
                if not ids:
                    key, first = bucket, conv
                ids.append(conv)
            yield pd.DataFrame(rows, columns=["bucket", "first", "ids"])
        if ids:
            yield pd.DataFrame([(key, first, ",".join(map(str, ids)))], columns=["bucket", "first", "ids"])

    return run


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to one digest a bucket, streamed."""
    key, state = None, None
    for f in frames:
        rows = []
        for bucket, ids in zip(f["bucket"].tolist(), f["ids"].tolist()):
            if bucket != key:
                if state:
                    rows.append((key, state.hexdigest()))
                key, state = bucket, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pd.DataFrame(rows, columns=["bucket", "ends"])
    if state:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["bucket", "ends"])


def _ends(ended: DataFrame, piece: int) -> DataFrame:
    """``bucket, ends`` of ``ended(bucket, conv)``: the digest of the sorted ids; of a hot bucket, a task reads pieces alone."""
    pieces = ended.repartitionByRange("bucket", "conv").sortWithinPartitions("bucket", "conv").mapInPandas(_pieces(piece), "bucket string, first long, ids string")
    return pieces.repartition("bucket").sortWithinPartitions("bucket", "first").mapInPandas(_digested, "bucket string, ends string")


def _shared_length(a: Column, b: Column) -> Column:
    apart = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    return F.when(apart == 0, F.size(a)).otherwise((apart - 1).cast("int"))


def _round(active: DataFrame, buckets: DataFrame, total: int, local: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the radix: how far each bucket's conversations go together, then their next turn deals them out.

    ``active(bucket, conv, seq, words)``, ``buckets(bucket, top, up, up_conv, depth, n)`` with the smallest id as ``top``. Returns the buckets with ``upto``, ``words`` of
    their common turns and ``n_children``; the rows with their ``digit``; and the buckets that those make.
    """
    ends = active.groupBy("bucket").agg(F.min(F.struct("seq", "words")).alias("low"), F.max("seq").alias("high"))
    told = buckets.join(ends, "bucket").withColumn("upto", _shared_length(F.col("low.seq"), F.col("high")))
    told = cut(told.select(*buckets.columns, "upto", F.slice(F.concat(F.array(F.lit(0).cast("long")), "low.words"), F.col("depth").cast("int") + 1, F.col("upto") - F.col("depth").cast("int") + 1).alias("chain")))
    rows = join_hot(active, told, "bucket", "n", total, "top", "upto")
    digit = F.when(F.size("seq") > F.col("upto"), F.element_at("seq", F.when(F.size("seq") > F.col("upto"), F.col("upto") + 1).otherwise(1)))
    rows = cut(rows.select("bucket", "top", "upto", "conv", "seq", "words", digit.alias("digit")))
    made = rows.where("digit is not null").groupBy("bucket", "digit").agg(
        F.min("conv").alias("child"), F.count("*").alias("n"), F.sum(F.size("seq") - F.col("upto")).alias("turns"), F.first("top").alias("up_conv"), F.first("upto").alias("upto")
    )
    step = F.concat_ws(":", F.col("child").cast("string"), (F.col("upto") + 1).cast("string"))
    made = cut(made.select(F.concat_ws("/", "bucket", F.col("digit").cast("string")).alias("edge"), step.alias("into"), F.col("child").alias("top"), F.col("bucket").alias("up"), "up_conv", (F.col("upto") + 1).cast("long").alias("depth"), "n", (F.col("turns") > local).alias("large")))
    return told, rows, made


def nodes(sequences_: DataFrame, local: int = LOCAL, piece: int = PIECE) -> DataFrame:
    """The trie's nodes, the columns of ``NODE``, of ``sequences(conv, seq, words)``."""
    spark = sequences_.sparkSession
    active = cut(sequences_.select(F.lit("root").alias("bucket"), "conv", "seq", "words"))
    root = active.agg(F.min("conv").alias("top"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODE)
    buckets = spark.createDataFrame([("root", root["top"], None, None, 0, root["n"])], "bucket string, top long, up string, up_conv long, depth long, n long")
    rounds, locals_, ended = [], [], []
    total = root["n"]
    while total:
        told, rows, made = _round(active, buckets, total, local)
        rounds.append(told)
        ended.append(rows.where("digit is null").select("bucket", "conv"))
        going = rows.where("digit is not null").withColumn("edge", F.concat_ws("/", "bucket", F.col("digit").cast("string"))).drop("bucket", "top", "upto")
        dealt = cut(join_hot(going, made, "edge", "n", total, "into", "up", "up_conv", "depth", "large"))
        locals_.append(dealt.where("not large").select("conv", "seq", "words", "up", "up_conv", "depth", "digit"))
        active = dealt.where("large").select(F.col("into").alias("bucket"), "conv", "seq", "words")
        buckets = made.where("large").select(F.col("into").alias("bucket"), "top", "up", "up_conv", "depth", "n")
        total = buckets.agg(F.sum("n")).first()[0] or 0
    small = reduce(DataFrame.unionByName, locals_)
    size = small.agg(F.sum(F.size("seq"))).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // local + 1)
    finished = cut(small.withColumn("bin", F.pmod(F.xxhash64("up", "digit"), F.lit(bins))).groupBy("bin").applyInPandas(_finish, f"{NODE}, up string"))
    below = finished.where("up is not null").groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    below, digests = cut(below), cut(_ends(reduce(DataFrame.unionByName, ended), piece))
    tops, large = None, []
    for told in reversed(rounds):
        sums = below if tops is None else below.unionByName(tops).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "cls"])
        got = told.join(sums, "bucket", "left").join(digests, "bucket", "left")
        own = F.aggregate("chain", F.lit(0).cast("long"), lambda a, w: a + w) * (F.col("n") - 1)
        got = cut(got.withColumn("c", F.coalesce("c", F.lit(0))).withColumn("l", F.coalesce("l", F.lit(1))).withColumn("s", F.coalesce("s", F.lit(0))).withColumn("own", own))
        tops = got.where("up is not null").groupBy(F.col("up").alias("bucket")).agg(F.count("*").alias("c"), F.sum("l").alias("l"), F.sum(F.col("s") + F.col("own")).alias("s"))
        large.append(_chain(got))
    return reduce(DataFrame.unionByName, [*large, finished.select(*COLUMNS)])


def _chain(got: DataFrame) -> DataFrame:
    """The nodes of recursing buckets: from the bucket's first node down to where its conversations part."""
    each = got.select("*", F.posexplode("chain").alias("i", "w"))
    under = F.sum("w").over(Window.partitionBy("bucket").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("depth") + F.col("i") == F.col("upto")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return each.select(
        F.col("top").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("up_conv")).otherwise(F.col("top")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("c")).otherwise(1).cast("long").alias("n_children"), F.col("l").alias("n_leaves"), ((F.col("n") - 1) * under + F.col("s")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", none)).otherwise(none).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, local: int = LOCAL, piece: int = PIECE) -> DataFrame:
    """The contract's rows: one for each node of the trie of rebuilt conversations."""
    return nodes(sequences(conversations), local, piece)


#: Prefixes spelled out: a node is the digest of a sequence; sums run over the prefixes of each node's smallest member.
ORACLE = r"""
WITH h AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)), poly AS (SELECT list(v ORDER BY n) AS tab FROM h),
t AS (SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, digest) - 1 AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
c AS (SELECT conv, conv - conv % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(conv AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, v: xor(tab[(xor(a, v) & 255) + 1], a >> 8)), 4294967295) % 4 AS head FROM (SELECT DISTINCT conv FROM t), poly),
r AS (SELECT c.conv, 0 AS part, pos, digest, words FROM c JOIN o ON o.conv = base AND pos < head UNION ALL SELECT c.conv, 1, pos, digest, words FROM c JOIN o ON o.conv = c.conv AND pos >= head),
s AS (SELECT c.conv, coalesce(list(digest ORDER BY part, pos) FILTER (WHERE digest IS NOT NULL), []) AS seq, coalesce(list(words ORDER BY part, pos) FILTER (WHERE digest IS NOT NULL), []) AS words FROM c LEFT JOIN r ON r.conv = c.conv GROUP BY c.conv),
p AS (SELECT conv, d, len(seq) AS size, sha256(d || ':' || array_to_string(seq[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256((d - 1) || ':' || array_to_string(seq[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, min(conv) AS conv, count(*) AS n_convs, any_value(w) * (count(*) - 1) AS own, coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE size = d), '') AS ends FROM p GROUP BY node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT p.node, count(*) FILTER (WHERE k.parent IS NULL) AS n_leaves, sum(n.own) AS saved FROM n JOIN p ON p.conv = n.conv AND p.d <= n.d LEFT JOIN k ON k.parent = n.node GROUP BY p.node)
SELECT n.conv AS conv_id, n.d AS depth, q.conv AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON u.node = n.node LEFT JOIN k ON k.parent = n.node LEFT JOIN n q ON q.node = n.parent
"""
