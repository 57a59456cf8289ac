"""The trie of all prefixes of many turn sequences, built by halving the depth (van Emde Boas recursion) in DataFrame operations.

A trie over depths (lo, hi] is cut at half depth. The prefix of a sequence up to the cut is named; sequences with one name are one sequence of the upper
trie, and what lies below the cut belongs to the lower trie that hangs on that name. Upper tries and lower forests of a level are cut again, all in the
same jobs, until every piece is one turn deep: log2(depth) levels, however long a sequence is. Totals come back the same way: every node is the cut node
of exactly one level, where the total of the lower trie below it is grafted on, coarsest level first.

A piece is named by the exclusive or of two 64-bit hashes of (position, turn digest) over its turns. That sum can be made in parts, so the turns of one
sequence never have to meet in a task, and the name of a prefix is its root's name with the piece's added. Digests of the pieces of each size are made
from those of half the size; pieces, digests and totals of all levels together have a few times as many rows as there are turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.session import discard_stored, stored
from pairwell.skew import rank_within

WORD = r"[^\x20\x09-\x0D]+"
#: Ids that one piece of a list of ids holds at most.
CHUNK_IDS = 8192
KEY = ["q1", "q2"]


def ordered(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of every conversation in order: conv_id, pos (from 0), digest (of role and text), words (of the text).

    Turns go by number, a null number first; equal numbers by role, then text. A null role or text is empty. Rows without id belong to no conversation
    and are left out; repeated rows are turns like any other. Other columns are not read. The ranks are made over ranges of rows, so a conversation may
    hold any share of them.
    """
    rows = conversations.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ranked = rank_within(rows, ["conv_id"], ["turn", "role", "text"], "place")
    return stored(ranked.select("conv_id", (F.col("place") - 1).alias("pos"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-turns")


def spliced(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of rebuilt conversations: the first h turns of conversation c - c % ``every``, then c's own turns after its first h.

    h is crc32(decimal c) % ``most``. A lender with fewer turns gives all, an absent one none. ``turns`` as of :func:`ordered`; ``ids`` has every
    conversation, also one that is left without turns.
    """
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("lender"))
    lenders = convs.select(F.col("conv_id").alias("lender"), F.col("n").alias("has"))
    convs = stored(convs.join(lenders, "lender", "left").select("conv_id", "lender", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("got")), "trie-convs")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("lender"), "pos", "digest", "words")
    borrowed = convs.join(heads, "lender").where("pos < h").select("conv_id", "pos", "digest", "words")
    kept = turns.join(convs.select("conv_id", "h", "got"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "digest", "words")
    return borrowed.unionByName(kept), convs.select("conv_id")


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def _half(j: str = "j") -> Column:
    return F.shiftright(j, 1).alias("j")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _pieces(digests: list[DataFrame]) -> list[DataFrame]:
    """Per level s the pieces of 2^s turns at most: c, j (its place), p1 and p2 (name of the prefix above it), w (sequences it stands for), n (turns).

    ``digests``: the names of all pieces of each level. Pieces of 2^s turns that begin alike are one piece, that of the smallest c.
    """
    levels = [stored(digests[-1].select("c", "j", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(1).cast("long").alias("w"), "n"), "trie-pieces")]
    for s in range(len(digests) - 2, -1, -1):
        pieces, half = levels[0], 1 << s
        upper = digests[s].where("j % 2 = 0").select("c", _half(), "x1", "x2")
        cut = pieces.where(F.col("n") >= half).join(upper, ["c", "j"]).select("c", "j", "p1", "p2", _xor("p1", "x1").alias("q1"), _xor("p2", "x2").alias("q2"), "w", "n")
        named = cut.groupBy("j", "p1", "p2", *KEY).agg(F.min("c").alias("c"), F.sum("w").alias("w"))
        left = F.shiftleft("j", 1).alias("j")
        above = named.select("c", left, "p1", "p2", "w", F.lit(half).cast("long").alias("n"))
        below = cut.where(F.col("n") > half).select("c", (F.shiftleft("j", 1) + 1).alias("j"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "w", (F.col("n") - half).alias("n"))
        short = pieces.where(F.col("n") < half).select("c", left, "p1", "p2", "w", "n")
        levels.insert(0, stored(_union([above, below, short]), "trie-pieces"))
    return levels


def _grafts(nodes: DataFrame, pieces: list[DataFrame]) -> DataFrame:
    """Per node with descendants that a cut parted from it: c, depth, saved and leaves of all of them."""
    totals = [nodes.select("c", (F.col("depth") - 1).alias("j"), "saved", "leaves")]
    for _ in pieces[2:]:
        halves = totals[-1].groupBy("c", _half()).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        totals.append(stored(halves, "trie-totals"))
    done = [nodes.select("c", "depth", "saved", "leaves").where("false")]
    for s in range(len(pieces) - 2, -1, -1):
        own = totals[s].where("j % 2 = 1")
        # What earlier rounds grafted on the last nodes of these pieces counts here too.
        more = _union(done).select("c", (F.shiftright("depth", s) - 1).alias("j"), "saved", "leaves")
        trees = pieces[s].where("j % 2 = 1").select("c", "j", F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        sums = trees.join(own.unionByName(more), ["c", "j"]).groupBy("j", *KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        cuts = nodes.where(F.col("depth") % (2 << s) == 1 << s).select("c", "depth", *KEY)
        done.append(stored(sums.withColumn("depth", F.shiftleft("j", s)).join(cuts, ["depth", *KEY]).select("c", "depth", "saved", "leaves"), "trie-grafts"))
    discard_stored(*totals[1:])
    return _union(done)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, q1, q2, c) as runs of ids of one node, joined by commas."""
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in ("depth", *KEY)), strict=True))
        ids, out, at = batch.column("c").to_pylist(), [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or keys[i] != keys[at] or i - at == CHUNK_IDS:
                out.append((*keys[at], ids[at], ",".join(map(str, ids[at:i]))))
                at = i
        if out:
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*out, strict=True))[:4]], pa.array([x[4] for x in out])], ["depth", *KEY, "c", "listed"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of ids as one SHA-256 per node; only the hash's state is kept between rows."""

    def row(key: tuple, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([state.hexdigest()])], ["depth", *KEY, "ends_sha256"])

    last, state = None, None
    for batch in batches:
        for *key, listed in zip(*(batch.column(k).to_pylist() for k in ("depth", *KEY, "listed")), strict=True):
            if key != last:
                if last:
                    yield row(last, state)
                last, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(listed.encode())
    if last:
        yield row(last, state)


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256) from (depth, q1, q2, c): the ids of a node are sorted over many tasks, and reach its hash in long runs."""
    keys = ["depth", *KEY, "c"]
    runs = stored(ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_listed, "depth long, q1 long, q2 long, c long, listed string"), "trie-ends")
    return runs.repartition("depth", *KEY).sortWithinPartitions(*keys).mapInArrow(_hashed, "depth long, q1 long, q2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (0, 1, ... without gaps), digest, words; ``ids``: conv_id of every sequence, also of those without turns. A node is a distinct
    sequence of first turns; its conv_id is the smallest id that begins with it, and depth and conv_id name it. The root stands for no turns; it has no
    parent. n_convs counts the sequences that begin with the node, n_children its children, n_leaves the childless nodes of its subtree (itself
    included). saved_tokens sums, over the subtree, the words of a node's last turn for all but one of its sequences: what sharing prefixes saves.
    ends_sha256 is that of the ascending ids of sequences that end there, joined by commas. Without ids there is no node.
    """
    spark = turns.sparkSession
    name = lambda seed: F.xxhash64(F.lit(seed), "pos", "digest")
    rows = stored(turns.select(F.col("conv_id").alias("c"), F.col("pos").cast("long").alias("j"), name(1).alias("x1"), name(2).alias("x2"), "words"), "trie-rows")
    ids = stored(ids.select(F.col("conv_id").alias("c")), "trie-ids")
    deepest = rows.agg(F.max("j")).first()[0]
    digests = [rows.select("c", "j", "x1", "x2", F.lit(1).cast("long").alias("n"))]
    for _ in range((deepest or 0).bit_length()):
        halves = digests[-1].groupBy("c", _half()).agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("n").alias("n"))
        digests.append(stored(halves, "trie-digests"))
    pieces = _pieces(digests)

    turn = pieces[0].join(rows, ["c", "j"]).select("c", (F.col("j") + 1).alias("depth"), "p1", "p2", _xor("p1", "x1").alias("q1"), _xor("p2", "x2").alias("q2"), "w", "words")
    nodes = stored(turn.groupBy("depth", "p1", "p2", *KEY).agg(F.min("c").alias("c"), F.sum("w").alias("w"), F.min("words").alias("words")), "trie-nodes")
    zero = F.lit(0).cast("long")
    children = stored(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    nodes = nodes.join(children, ["depth", *KEY], "left").select("c", "depth", "p1", "p2", *KEY, "w", F.coalesce("n_children", zero).alias("n_children"), ((F.col("w") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    nodes = stored(nodes, "trie-nodes")
    grafts = _grafts(nodes, pieces)

    whole = nodes.agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.count_if(F.col("depth") == 1).alias("children")).first()
    least = ids.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("w")).first()
    root = [(least["c"], 0, 0, 0, 0, 0, least["w"], whole["children"], whole["saved"] or 0, whole["leaves"] or 1)]
    root = spark.createDataFrame(root if least["w"] else [], "c long, depth long, p1 long, p2 long, q1 long, q2 long, w long, n_children long, saved long, leaves long")
    grown = nodes.join(grafts.select("c", "depth", F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves")), ["c", "depth"], "left")
    grown = grown.withColumn("saved", F.col("saved") + F.coalesce("more_saved", zero)).withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", zero))
    grown = stored(grown.select(root.columns).unionByName(root), "trie-grown")

    ended = digests[-1].select(F.col("n").alias("depth"), F.col("x1").alias("q1"), F.col("x2").alias("q2"), "c")
    turnless = ids.join(digests[-1].select("c"), "c", "left_anti").select(zero.alias("depth"), zero.alias("q1"), zero.alias("q2"), "c")
    ends = stored(_ends(ended.unionByName(turnless)), "trie-hashes")
    discard_stored(ids, *digests[1:], *pieces, children)
    parents = grown.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("c").alias("parent"))
    found = stored(grown.join(parents, ["depth", "p1", "p2"], "left").select("c", "depth", *KEY, "parent", "w", "n_children", "leaves", "saved"), "trie-found")
    discard_stored(grown, nodes, rows)
    nothing = hashlib.sha256().hexdigest()
    return found.join(ends, ["depth", *KEY], "left").select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("w").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
