"""Jaccard self-join of texts on word n-grams, by adaptive multi-match prefixes, and the groups it links.

Texts with one set of n-grams are one class. The n-grams of a class are ordered by their hash. Two classes that are similar enough share one of the first
p n-grams, and share m of the first p + m - 1. A prefix is lengthened by its candidate cost: each costly n-gram met (one that more than ``list_limit``
classes have) adds a place, and one more shared n-gram is asked for. With m - 1 costly ones in it, m shared ones include a cheap one, so the lists of the
costly ones need not be gone through. A class that does not get p cheap n-grams in its window keeps its plain prefix and is compared over the costly
lists as well: with one hub of each list first, then, where it is not yet in the hub's group, in blocks.

Candidates pass a parity bitmap: bits that differ are n-grams that differ, so nothing similar is lost. Pairs over cheap n-grams meet a narrow bitmap first;
what is left between two groups, and all pairs of a costly list, a wide one of two bits an n-gram or more, which lets little else through. The rest is
verified on the texts in three rounds, each of which looks at pairs between two groups only: one pair of each class (to the hub of a costly list, or to
its first cheap neighbour), then the most promising pair of each two groups, then, where that failed, all that is left, which are near misses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.lattice import _trimmed, words_of
from pairwell.llm.pretokens import by_bytes, column_bytes, giving_back
from pairwell.session import discard_stored, free_shuffles, stored

#: A list of keys of at most so many rows (16 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
BLOCK = 1024
#: Bits of a bitmap. A set of more than half as many n-grams lets more pairs through to verification.
MAX_BITS = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit n-gram hashes of each text, offsets). A text of fewer words is one n-gram; one without words has none."""
    words, codes, counts = words_of(data, offsets)
    names = np.array(_trimmed(words).cast(pa.string()).to_pylist() or [""], object)
    hashes = _mixed(pd.util.hash_array(names, categorize=False).astype(np.uint64))[codes]
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    grams, owner = [], []
    for n in range(1, size + 1):  # n words in a row: all of them for n = size, the whole text for shorter ones
        at = np.flatnonzero(np.arange(len(text)) + n <= (first + counts)[text]) if n == size else first[counts == n]
        total = np.full(len(at), n, np.uint64)
        for i in range(n):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
        grams.append(total)
        owner.append(text[at])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(counts)))]).astype(np.int64)


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _bitmaps(grams: np.ndarray, ends: np.ndarray, share: float) -> pa.Array:
    """Of each set, the parity of its hashes' low bits, as bytes: a power of two of bits, ``share`` times as many as hashes at least, MAX_BITS at most."""
    n = np.diff(ends)
    bits = np.minimum(64 << np.ceil(np.log2(np.maximum(n * share / 64, 1))).astype(np.int64), MAX_BITS)
    start = np.cumsum(bits) - bits
    at = np.repeat(start, n) + (grams & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    offsets = (np.concatenate([start, [bits.sum()]]) // 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(parity, bitorder="little"))])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.uint64)]).astype(np.uint64)
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, id: str, text: str, size: int, percent: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """Per row: id, text_hash, n (n-grams), d1, d2 (of the set), window (first hashes in order), bitmap, wide (a bitmap of more bits)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in by_bytes(offsets, batch_bytes):
                grams, ends = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(ends)
                short = np.minimum(n, (3 * prefix(n, percent)) // 2 + 8)
                rank = np.arange(len(grams)) - np.repeat(ends[:-1], n)
                window = grams[rank < np.repeat(short, n)]
                digests = [pa.array(_sums(_mixed(grams ^ np.uint64(k)), ends)) for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                cells = [pa.array(n), *digests, _lists(window, np.concatenate([[0], np.cumsum(short)])), _bitmaps(grams, ends, 0.5), _bitmaps(grams, ends, 2)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in (0, 2)], *cells], ["id", "text_hash", "n", "d1", "d2", "window", "bitmap", "wide"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"id {kind}, text_hash long, n long, d1 long, d2 long, window array<bigint>, bitmap binary, wide binary")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all 64-bit words of a column of bitmaps, offsets of its rows in them)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view(np.uint64), (offsets - offsets[0]) // 8


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row, the bits in which two bitmaps differ, the longer one folded to the size of the shorter."""
    (x, xs), (y, ys) = _words(a), _words(b)
    wx, wy = np.diff(xs), np.diff(ys)
    out = np.zeros(len(wx), np.int64)
    for one, two in sorted(set(zip(wx.tolist(), wy.tolist(), strict=True))):
        rows = np.flatnonzero((wx == one) & (wy == two))
        least = min(one, two)
        for at in range(0, len(rows), max(1, (1 << 20) // max(one, two))):
            k = rows[at : at + max(1, (1 << 20) // max(one, two))]
            p, q = x[xs[k][:, None] + np.arange(one)], y[ys[k][:, None] + np.arange(two)]
            p, q = (np.bitwise_xor.reduce(m.reshape(len(k), -1, least), axis=1) for m in (p, q))
            out[k] = np.bitwise_count(p ^ q).sum(axis=1)
    return out


def _apart(a: str, b: str) -> Column:
    """The bits in which the bitmaps of two columns differ: at most the n-grams in which the sets do."""

    def differ(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(differing(x, y), pa.int64())

    return F.arrow_udf(differ, "long")(F.col(a), F.col(b))


def _sized(percent: int, a: str, b: str) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable over ``edges`` (a, b), for every vertex that has an edge.

    Labels spread over edges and then jump to their own labels' labels; a round halves the distances. Each round is a written table.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "v").select("v", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("to"), F.col("label").alias("next"))
        new = stored(spread.join(jump, "to", "left").select("v", F.least("to", F.coalesce("next", "to")).alias("label"), "was"), "labels")
        moved = new.where("label < was").limit(1).count()
        discard_stored(labels)
        labels = new.select("v", "label")
        if not moved:
            discard_stored(both)
            return labels


class _Links:
    """Verified links and the groups they make; candidates come in rounds."""

    def __init__(self, classes: DataFrame, docs: DataFrame, id: str, text: str, size: int, percent: int):
        self.classes, self.docs, self.id, self.text, self.size, self.percent = classes, docs, id, text, size, percent
        self.labels: DataFrame | None = None

    def labelled(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with the groups of both sides."""
        for side in ("a", "b"):
            if self.labels is None:
                pairs = pairs.withColumn(f"l{side}", F.col(side))
            else:
                known = self.labels.select(F.col("v").alias(side), F.col("label").alias(f"l{side}"))
                pairs = pairs.join(known, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
        return pairs

    def texts(self, vertices: DataFrame) -> DataFrame:
        """(v, text) of one document of each class."""
        keys = stored(self.classes.select(F.col("rid").alias("v"), "rep", "text_hash").join(vertices, "v"), "join-keys")
        side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        rows = self.docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text"))
        found = rows.join(side, rows["id"].eqNullSafe(side["rep"]) & (F.xxhash64("text") == side["text_hash"])).select("v", "text")
        texts = stored(found.groupBy("v").agg(F.min("text").alias("text")), "join-texts")
        discard_stored(keys)
        return texts

    def add(self, picked: DataFrame) -> DataFrame:
        """Verify all of ``picked`` (a, b), and join the groups of those that are linked. Returns the pairs, stored."""
        picked = stored(picked.select("a", "b").distinct(), "join-picked")
        if not picked.limit(1).count():
            return picked
        texts = self.texts(picked.select(F.col("a").alias("v")).union(picked.select(F.col("b").alias("v"))).distinct())
        tested = stored(self.verified(picked, texts), "join-tested")
        links = tested.where("linked").select("a", "b")
        # Groups known before are joined as they are: a link between two classes is one between their groups.
        if self.labels is None:
            self.labels = components(links)
        else:
            edges = stored(self.labelled(links).where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), "edges")
            roots = components(edges).select(F.col("v").alias("root"), F.col("label").alias("to"))
            known = self.labels.union(edges.select(F.col("a"), F.col("a")).union(edges.select(F.col("b"), F.col("b")))).groupBy("v").agg(F.min("label").alias("label"))
            before, self.labels = self.labels, stored(known.join(roots, F.col("label") == F.col("root"), "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
            discard_stored(before, roots, edges)
        discard_stored(texts, tested)
        free_shuffles(self.docs.sparkSession)
        return picked

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b, linked). Pairs are grouped by a and dealt in parts, so a text that many pairs share goes to as many tasks as it needs."""
        size, percent = self.size, self.percent
        buckets = max(1, math.ceil(pairs.count() / 256))
        parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / 64).cast("int").alias("parts"))
        dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        right = dealt.join(texts.select(F.col("v").alias("b"), "text"), "b").select("a", "b", "part", "text")
        left = parts.join(texts.select(F.col("v").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
        bucket = F.pmod(F.xxhash64("a", "part"), F.lit(buckets))

        def run(mine: pa.Table, others: pa.Table) -> pa.Table:
            (x, xe), (y, ye) = (gram_sets(*column_bytes(t.column("text").combine_chunks()), size) for t in (mine, others))
            at = {k: i for i, k in enumerate(zip(mine.column("a").to_pylist(), mine.column("part").to_pylist(), strict=True))}
            linked = []
            for k, key in enumerate(zip(others.column("a").to_pylist(), others.column("part").to_pylist(), strict=True)):
                i = at[key]
                one, two = x[xe[i] : xe[i + 1]], y[ye[k] : ye[k + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            return pa.table({"a": others.column("a"), "b": others.column("b"), "linked": pa.array(linked, pa.bool_())})

        left = left.select(*[F.col(c).alias(c) for c in left.columns], bucket.alias("bucket"))  # other columns than those of the right side
        return left.groupBy("bucket").cogroup(right.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(run, "a long, b long, linked boolean")


def _compared(members: DataFrame, extra: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs (token, a, b, apart) of each costly list: members that are ``full`` against all, in blocks of bounded size, by bitmap.

    ``members``: token, rid, n, full, label; ``extra``: rid, bitmap, lists (the first three lists that the class is in), which the members get last, when
    they are dealt to blocks. Pairs of one group are left out; ``apart`` is the number of bits that differ. With ``best`` a block returns only the pair
    of the fewest such bits of each two groups. Two members may meet in many lists; if they have one of their first three in common, only the first such
    list returns them.
    """
    counts = members.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("full"), 1)).alias("q"), (F.min("label") < F.max("label")).alias("several")).where("q > 0 and several")
    cut = stored(counts.select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("cols"), F.ceil(F.col("q") / BLOCK).cast("int").alias("rows")), "join-cut")
    rows, block = members.join(cut, "token"), F.xxhash64("rid")
    col, row = F.pmod(block, F.col("cols")).cast("int"), F.pmod(block, F.col("rows")).cast("int")
    place = lambda i, j, row, col: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(row).alias("is_row"), F.lit(col).alias("is_col"))
    # A member is a column in every block row, and a full one a row in every block column; where the two meet, one copy is both.
    across = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), col.alias("j"), (F.col("full") & (i == row)).alias("is_row"), F.lit(True).alias("is_col")))
    down = F.when(F.col("full"), F.filter(F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: place(row, j, True, False)), lambda x: x["j"] != col))
    dealt = rows.select("token", "rid", "n", "label", F.explode(F.concat(across, F.coalesce(down, F.array()))).alias("at")).select("token", "at.*", "rid", "n", "label")

    def run(table: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> tuple:
            maps = [np.frombuffer(x, np.uint64) for x in t.column("bitmap").to_pylist()]
            first = np.array([[*x, *[None] * 3][:3] for x in t.column("lists").to_pylist()], object).reshape(len(maps), 3)
            known = first != None  # noqa: E711
            lists = np.where(known, first, 0).astype(np.int64)
            return t.column("rid").to_numpy(), t.column("n").to_numpy(), t.column("label").to_numpy(), maps, np.array([len(m) for m in maps], np.int64), lists, known

        here = table.column("token")[0].as_py()
        (ra, na, la, ma, wa, fa, ka), (rb, nb, lb, mb, wb, fb, kb) = side(table.filter(table.column("is_row"))), side(table.filter(table.column("is_col")))
        a_out, b_out, d_out, g_out = [], [], [], []
        for w in np.unique(wb).tolist() if len(wb) else []:
            mine = np.flatnonzero(wb == w)
            stack = np.stack([mb[k] for k in mine])
            for i in range(len(ra)):
                at = mine[(la[i] != lb[mine]) & (np.minimum(na[i], nb[mine]) * 100 >= np.maximum(na[i], nb[mine]) * percent)]
                if not len(at):
                    continue
                x, y = ma[i], stack[np.searchsorted(mine, at)]
                if wa[i] > w:
                    x = np.bitwise_xor.reduce(x.reshape(-1, w), axis=0)
                elif wa[i] < w:
                    y = np.bitwise_xor.reduce(y.reshape(len(y), -1, wa[i]), axis=1)
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                near = apart * (100 + percent) <= (na[i] + nb[at]) * (100 - percent)
                hit, apart = at[near], apart[near]
                common = (fa[i][None, :, None] == fb[hit][:, None, :]) & ka[i][None, :, None] & kb[hit][:, None, :]
                least = np.where(common.any(axis=2), fa[i][None, :], np.iinfo(np.int64).max).min(axis=1)
                first = ~common.any(axis=(1, 2)) | (least == here)
                hit, apart = hit[first], apart[first]
                if best and len(hit):
                    order = np.lexsort((rb[hit], apart, lb[hit]))
                    order = order[np.concatenate([[True], np.diff(lb[hit][order]) != 0])]
                    hit, apart = hit[order], apart[order]
                a_out.append(np.minimum(ra[i], rb[hit]))
                b_out.append(np.maximum(ra[i], rb[hit]))
                d_out.append(apart)
                g_out.append(np.stack([np.minimum(la[i], lb[hit]), np.maximum(la[i], lb[hit])], axis=1))
        a, b, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out, d_out))
        if best and len(a):
            groups = np.concatenate(g_out)
            order = np.lexsort((b, a, d, groups[:, 1], groups[:, 0]))
            order = order[np.concatenate([[True], (np.diff(groups[order], axis=0) != 0).any(axis=1)])]
            a, b, d = a[order], b[order], d[order]
        return pa.table({"token": np.full(len(a), here, np.int64), "a": a, "b": b, "apart": d})

    whole = dealt.join(extra, "rid").select("token", "i", "j", "is_row", "is_col", "rid", "n", "label", "bitmap", "lists")
    return whole.groupBy("token", "i", "j").applyInArrow(run, "token long, a long, b long, apart long").where("a < b")


def linked_groups(docs: DataFrame, size: int = 3, percent: int = 90, id: str = "doc_id", text: str = "text", groups: bool = False, list_limit: int = 16) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are runs of characters other than ASCII white space, A-Z lowered; a text's set is its distinct ``size``-word n-grams, or its whole word
    sequence if that is shorter. Two texts link when 100 * |intersection| >= ``percent`` * |union|. A null or empty text, or one without words, has an
    empty set and links with nothing. Rows with equal sets are linked, repeated rows too. A null id is ignored as a smallest id: a row without id gets
    the component's smallest known id, or null. An empty table gives no rows. Other columns are not read. With ``groups``,
    ``text_hash`` (xxhash64 of the text) and ``group`` are returned too, a number of the component, null for an empty set.

    N-grams are compared by 64-bit hashes, sets of a class by 128 bits. No cap bounds the members of a list or the partners of a text.
    """
    spark = docs.sparkSession
    made = stored(sketches(docs, id, text, size, percent), "join-sketches")
    of_class = made.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("least"), F.max(F.struct("id", "text_hash")).alias("one"), F.first("window").alias("window"), F.first("bitmap").alias("bitmap"), F.first("wide").alias("wide"))
    sets = stored(of_class.select("d1", "d2", "n", "least", F.col("one.id").alias("rep"), F.col("one.text_hash").alias("text_hash"), "window", "bitmap", "wide", F.monotonically_increasing_id().alias("rid")), "join-sets")
    ids = stored(made.select("id", "text_hash", "n", "d1", "d2"), "join-ids")
    discard_stored(made)
    free_shuffles(spark)

    p = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    grams = sets.select("rid", "n", F.posexplode("window").alias("pos", "token"))
    shared = stored(grams.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "join-shared")
    free_shuffles(spark)
    posts = stored(grams.join(shared, "token").select("token", "rid", "n", "pos", (F.col("f") > list_limit).alias("dear")), "join-posts")
    classes = stored(sets.drop("window", "bitmap", "wide"), "join-classes")
    bitmaps, wides = stored(sets.select("rid", "n", "bitmap"), "join-bitmaps"), stored(sets.select("rid", "n", "wide"), "join-wides")
    discard_stored(sets, shared)
    free_shuffles(spark)
    costly = posts.where("dear").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("costly"))
    rows = posts.join(costly, "rid", "left").withColumn("costly", F.coalesce("costly", F.array().cast("array<struct<pos:int,token:bigint>>"))).withColumn("p", p)
    before = F.size(F.filter("costly", lambda x: x["pos"] < F.col("pos")))
    cheap = F.least("n", F.floor(3 * F.col("p") / 2) + 8) - F.size("costly")
    rows = rows.withColumn("full", cheap < F.col("p")).withColumn("member", F.when(F.col("full"), F.col("pos") < F.col("p")).otherwise(F.col("pos") - before < F.col("p")))
    members = stored(rows.where("member").select("token", "rid", "n", "dear", "full", F.size("costly").alias("costly")), "join-members")
    discard_stored(posts)
    # What a class's own prefix asks for: m, and its costly n-grams in it.
    met = members.where("dear").groupBy("rid").agg(F.collect_list("token").alias("met"), F.first("full").alias("full"))
    met = met.select("rid", F.sort_array("met").alias("met"), F.when(F.col("full"), 1).otherwise(F.size("met") + 1).alias("m"))
    about = bitmaps.join(met, "rid", "left").select("rid", "n", "bitmap", F.coalesce("met", F.array().cast("array<bigint>")).alias("met"), F.coalesce("m", F.lit(1)).alias("m"))
    about = stored(about, "join-about")
    discard_stored(bitmaps)
    free_shuffles(spark)

    def passing(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(about.select(*[F.col(c).alias(f"{c}_{side}") for c in about.columns]), F.col(side) == F.col(f"rid_{side}"))
        enough = F.col("c") + F.size(F.array_intersect("met_a", "met_b")) >= F.least("m_a", "m_b")
        return close(pairs.where(enough), "bitmap").select("a", "b", "apart")

    def close(pairs: DataFrame, bitmap: str) -> DataFrame:
        near = pairs.withColumn("apart", _apart(f"{bitmap}_a", f"{bitmap}_b"))
        return near.where(F.col("apart") * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))

    def between(pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b), those between two groups that pass the wide bitmap."""
        pairs = links.labelled(pairs.select("a", "b")).where("la <> lb").select("a", "b")
        for side in ("a", "b"):
            pairs = pairs.join(wides.select(*[F.col(c).alias(f"{c}_{side}") for c in wides.columns]), F.col(side) == F.col(f"rid_{side}"))
        return close(pairs, "wide").select("a", "b", "apart")

    light = members.where("not dear").select("token", "rid", "n")
    one, two = light.select("token", F.col("rid").alias("a"), F.col("n").alias("na")), light.select("token", F.col("rid").alias("b"), F.col("n").alias("nb"))
    pairs = one.join(two, "token").where((F.col("a") < F.col("b")) & _sized(percent, "na", "nb")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    lists = members.where("dear")
    hubs = stored(lists.where("full").groupBy("token").agg(F.max_by("rid", F.struct("costly", "rid")).alias("hub"), F.max_by("n", F.struct("costly", "rid")).alias("nh")), "join-hubs")
    # Of each class, the hub with which it shares the most costly lists.
    star = lists.join(hubs, "token").where((F.col("rid") != F.col("hub")) & _sized(percent, "n", "nh")).groupBy("rid", "hub").agg(F.count(F.lit(1)).alias("f"))
    star = star.groupBy("rid").agg(F.max_by("hub", F.struct("f", "hub")).alias("hub"))
    star = star.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct().withColumn("c", F.lit(1 << 20))
    cheap = stored(passing(pairs), "join-cheap")
    free_shuffles(spark)
    links = _Links(classes, docs, id, text, size, percent)
    # Of each class, the smallest of its neighbours over cheap n-grams, and its hub.
    ends = cheap.select(F.col("a").alias("v"), F.col("b").alias("other")).union(cheap.select(F.col("b").alias("v"), F.col("a").alias("other")))
    first = ends.groupBy("v").agg(F.min("other").alias("other")).select(F.least("v", "other").alias("a"), F.greatest("v", "other").alias("b"))
    tested = [links.add(first.union(passing(star).select("a", "b")))]
    inner = stored(lists.join(hubs.select("token"), "token").select("token", F.col("rid").alias("a"), F.col("rid").alias("b"), "n", "full"), "join-inner")
    extra = stored(wides.select("rid", F.col("wide").alias("bitmap")).join(about.select("rid", F.slice("met", 1, 3).alias("lists")), "rid"), "join-extra")
    left = stored(between(cheap), "join-cheap")
    discard_stored(hubs, cheap, wides)
    dear = None
    for best in (True, False):
        now = links.labelled(inner if best else inner.join(links.labelled(dear).where("la <> lb").select("token").distinct(), "token"))
        now = now.select("token", F.col("a").alias("rid"), "n", "full", F.col("la").alias("label"))
        found = stored(_compared(now, extra, percent, best), "join-dear")
        cross = links.labelled(left.select("a", "b", "apart").union(found.select("a", "b", "apart"))).where("la <> lb")
        if best:
            dear = found
            cross = cross.groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
        cross = cross.select("a", "b").distinct()
        for t in tested:
            cross = cross.join(t, ["a", "b"], "left_anti")
        tested.append(links.add(cross))
        free_shuffles(spark)
    discard_stored(left, dear, found, inner, extra, *tested)

    known = links.labelled(classes.select("d1", "d2", "n", "least", F.col("rid").alias("a"), F.col("rid").alias("b"))).select("d1", "d2", "n", "least", F.col("la").alias("label"))
    known = stored(known, "join-known")
    roots = stored(known.groupBy("label").agg(F.min("least").alias("component_id")), "join-roots")
    of_class = stored(known.join(roots, "label").select("d1", "d2", "n", "component_id", F.col("label").alias("group")), "join-groups")
    discard_stored(classes, members, about, known, roots)
    out = ids.join(of_class, ["d1", "d2", "n"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *(["text_hash", "group"] if groups else []))
