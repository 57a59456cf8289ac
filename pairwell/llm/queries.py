"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm import bpe, digests, lattice, leaks, ngram_join, packing, prefix_trie, quality, ranked_search, shards, token_counts, topk, url_lists, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL twins, where SQL can express the operator; the other queries are tested against brute force.
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles below the shared folder and read back."""
    folder = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 of the SHA-1: its 160 bits as text, five at a time.
ORACLE["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
g AS (SELECT page_id, octet_length(body) AS payload_bytes, unhex(hex)::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY hex) AS response FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
         + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM g
"""


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group that links of Jaccard 0.9 on 3-word shingles put them in."""
    return ngram_join.linked_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shingles are compared as text, since words hold no space; groups are what is reachable over links.
ORACLE["op2_ngram_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: concat(words[i], ' ', words[i + 1], ' ', words[i + 2])) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.both >= 90 * (p.n + q.n - c.both)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(g.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) g ON g.a = d.doc_id
"""


@query
def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; every seventh by the CRC of its id is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again; the digests are of the ids as little-endian 32-bit integers, and of the decoded text."""
    columns = {
        "n_tokens": ("long", lambda coded: np.diff(coded.offsets)),
        "ids_sha256": ("string", digests.ids_sha256),
        "decoded_sha256": ("string", digests.decoded_sha256),
    }
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.transcode(docs, public_tokenizers.path("byte_bpe_50k.json"), columns).drop("text")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a classifier learned from at most 1,000 labelled documents of either class outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fitted(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by lists that were in force when they were fetched.

    The tables have neither lists nor fetch times. Both are derived from the pages: page n was fetched n days, counted round 3,000, after 2015-01-01;
    of the hosts, every third by hash entered a list of sites, left it later, and entered it again, and first path parts of every second are on a list
    of allowed places from a day of their own.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2015-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, (F.col("page_id") % 3000).cast("int")))
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]+)", 1).alias("part")).where("host is not null").distinct()
    mark = lambda column: F.crc32(column.cast("binary"))
    sites = hosts.select("host").distinct().where(mark(F.col("host")) % 3 < 2).withColumn("d", (mark(F.col("host")) % 1000).cast("int"))
    events = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), (F.col("d") + k).alias("after")) for a, k in (("add", 0), ("remove", 700), ("add", 1500))]))
    blocks = sites.select(F.lit("sites").alias("list"), F.col("host").alias("rule"), F.lit("block").alias("verdict"), events.alias("e")).select("list", "rule", "verdict", "e.action", F.date_add(start, F.col("e.after")).alias("day"))
    places = hosts.where("part <> ''").select(F.concat_ws("/", "host", "part").alias("rule"))
    places = places.where(mark(F.col("rule")) % 2 == 0)
    allows = places.select(F.lit("places").alias("list"), "rule", F.lit("allow").alias("verdict"), F.lit("add").alias("action"), F.date_add(start, (mark(F.col("rule")) % 2000).cast("int")).alias("day"))
    return url_lists.judged(captures, blocks.unionByName(allows))


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


ORACLE["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(COALESCE(list_sum(list_transform(a.q, lambda x, i: x * b.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 5
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item in it, with at most a fifth of the item edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = leaks.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return marked.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.distance").alias("distance"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their bytes and tokens."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shards.kd_shards(table(spark, sf_dir, "documents"), shards=24)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the conversation that its group of twenty begins with."""
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.spliced(turns, every=20, most=4))


#: The CRC-32 of the decimal id is folded bit by bit: a step of -1 shifts, any other takes in a byte. A node's key is the digests of its turns in a row.
ORACLE["op11_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lender, count(*) AS n,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id),
g AS (SELECT c.conv_id, c.lender, c.h, least(c.h, coalesce(l.n, 0)) AS got FROM c LEFT JOIN c l ON l.conv_id = c.lender),
r AS (
  SELECT g.conv_id, t.pos, t.digest, t.words FROM g JOIN t ON t.conv_id = g.lender AND t.pos < g.h
  UNION ALL SELECT g.conv_id, t.pos - g.h + g.got, t.digest, t.words FROM g JOIN t ON t.conv_id = g.conv_id AND t.pos >= g.h),
p AS (
  SELECT conv_id, pos + 1 AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos) AS key, words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM g),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words FROM p GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
u AS (
  SELECT a.depth, a.key, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM m) b JOIN n a ON a.depth = b.above AND a.key = left(b.key, 32 * b.above) GROUP BY a.depth, a.key),
l AS (SELECT conv_id, max(depth) AS depth, arg_max(key, depth) AS key FROM p GROUP BY conv_id),
e AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM l GROUP BY depth, key)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM m JOIN u USING (depth, key) LEFT JOIN e USING (depth, key) LEFT JOIN n o ON o.depth = m.depth - 1 AND o.key = left(m.key, 32 * (m.depth - 1))
"""


def _crc32(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 2,048 tokens, dealt to steps of 32,768 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), made={"ids_crc32": ("long", _crc32)})
    steps = packing.step_groups(pieces).select("sequence_id", "step")
    return pieces.join(steps, "sequence_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step")


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item, of all documents."""
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE["op13_ranked_search"] = """
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
a AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM d),
s AS (SELECT doc_id, 75 + (25 * count(*) * (SELECT docs FROM a)) // (SELECT terms FROM a) AS m FROM d GROUP BY doc_id),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM a) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY term),
v AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN s USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM v WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""
