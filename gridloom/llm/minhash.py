"""Near-duplicate documents by SuperMinHash.

Documents with equal shingle sets are one node. Each node gets a SuperMinHash signature: every shingle draws, step by step, the slots of one random permutation and puts the step plus a random fraction there, a slot keeps the least value, and steps end as soon as none can be lowered any more; the slots are negatively correlated, so estimates vary less than with independent hashes. Bands of the signature name buckets. Links are confirmed on the full shingle sets and grouped by union-find, in two rounds:

1. Each node of a bucket is held against the bucket's node with the smallest id.
2. In buckets that still hold several components, every node outside the bucket's largest component is held against all nodes of other components there. Pairs within one component need no check, as they change nothing. Buckets with up to PAIRS such pairs list them. The nodes of larger ones are dealt to a grid of blocks, BLOCK nodes a side, in which every node outside is held against a whole block at once by a lookup of its shingles; of a block, only a spanning forest of its links is kept.

Sizes of sets rule pairs out, and one bit for each slot gives an estimate which, at six and more standard deviations under the threshold, spares the confirmation. Bands are set so that a pair just at the threshold is missed with a chance under MISS.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, joined, shared_dir, table, written
from .components import components, union
from .textscan import BASE, U, mix, shingle_sets, slices

SLOTS, MISS = 256, 1e-6
#: Pairs of a bucket up to which they are listed before they are confirmed. Nodes and shingles of a block of a larger one.
PAIRS, BLOCK, BLOCK_SHINGLES = 256, 512, 1 << 20
#: Shingles whose permutations are held at a time.
ELEMENTS = 1 << 15


def bands_for(percent: int, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows a band: the most rows at which a pair at the threshold is missed with a chance under miss."""
    t = percent / 100
    rows = max(r for r in range(1, slots + 1) if r == 1 or (1 - t**r) ** (slots // r) < miss)
    return slots // rows, rows


def superminhash(shingles: np.ndarray, first: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (rows x m) of rows of shingles; a row without shingles keeps infinity."""
    rows = len(first) - 1
    sig = np.full(rows * m, np.inf)
    of = np.repeat(np.arange(rows), np.diff(first))
    for at in range(0, len(shingles), ELEMENTS):
        x, row = shingles[at : at + ELEMENTS], of[at : at + ELEMENTS]
        perm = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1)).ravel()
        live = np.arange(len(x))
        for j in range(m):
            h = mix(x[live] + U((j + 1) * BASE & (2**64 - 1)))
            value = j + (h >> U(11)).astype(np.float64) * 2.0**-53
            k = live * m + j + (mix(h + U(BASE)) % U(m - j)).astype(np.int64)
            slot = perm[k]
            perm[k] = perm[live * m + j]
            np.minimum.at(sig, row[live] * m + slot, value)
            low, high = row[0], row[-1] + 1
            open_ = sig[low * m : high * m].reshape(-1, m).max(axis=1) >= j + 1
            live = live[open_[row[live] - low]]
            if not len(live):
                break
    return sig.reshape(rows, m)


def named(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each row's set, by which equal sets are known."""
    n, out = np.diff(first).astype(U), []
    for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(shingles ^ U(c)))])[first]
        out.append(mix(np.diff(total) + n).view(np.int64))
    return out[0], out[1]


def _sketches(k: int, bands: int, rows: int, m: int):
    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            shingles, first = shingle_sets(batch.column("text"), k)
            n = np.diff(first)
            sig = np.ascontiguousarray(superminhash(shingles, first, m)).view(U)
            factors = mix(np.arange(1, rows + 1, dtype=U) * U(BASE))
            keys = mix((sig[:, : bands * rows].reshape(-1, bands, rows) * factors).sum(axis=2) + np.arange(bands, dtype=U) * U(INDEX))
            bits = np.packbits((mix(sig) & U(1)).astype(np.uint8), axis=1).view(np.int64)
            node, check = named(shingles, first)
            none = n == 0
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(np.ascontiguousarray(v).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(node, mask=none), pa.array(check, mask=none), lists(keys), lists(bits)], ["key", "n", "set_a", "set_b", "bands", "bits"])

    return run


INDEX = 0xD1342543DE82EF95


OWN = "struct<node: long, set_a: long, set_b: long, n: long>"


def _sets(k: int):
    def run(batches):
        for batch in slices(batches, "text"):
            shingles, first = shingle_sets(batch.column("text"), k)
            own = batch.column("own")
            wanted = [own.field(x).to_numpy(zero_copy_only=False) for x in ("set_a", "set_b")]
            same = np.all([x == y for x, y in zip(named(shingles, first), wanted, strict=True)], axis=0)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([own, lists], ["own", "shingles"]).filter(pa.array(same))

    return run


def most_apart(percent: int, m: int = SLOTS) -> int:
    """Bits in which signatures of a pair at the threshold differ, plus six deviations."""
    p = (1 + percent / 100) / 2
    return int(m * (1 - p) + 6 * sqrt(m * p * (1 - p)))


def likely(a: Column, b: Column, percent: int, m: int = SLOTS) -> Column:
    """Whether bits of two signatures agree as often as at the threshold, less six deviations: a slot's bits agree with chance (1 + J) / 2."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(m // 64)))
    return differ <= most_apart(percent, m)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs: shingle sets of k words are linked at a Jaccard similarity of percent / 100.

    component_id is the smallest key reachable, kept says whether it is the row's own. Texts null, empty or blank have no shingles and are their own components, as are rows with a null key and no shingles. A node is named by the smallest key that has its set: rows with equal keys are one document, linked by whichever of their texts links; rows equal in key and text are one. A set that only rows with a null key have takes no part in linking: such rows have a null component. Very long texts are scanned whole, about two megabytes of texts at a time. An empty table gives an empty one. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    base, (bands, rows) = shared_dir(spark), bands_for(percent)
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sketch = written(narrow.mapInArrow(_sketches(k, bands, rows, SLOTS), "key long, n long, set_a long, set_b long, bands array<long>, bits array<long>"), f"{base}/sketch")
    names = ["set_a", "set_b"]
    nodes = written(sketch.where("set_a IS NOT NULL").groupBy(names).agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), f"{base}/nodes")
    linked = nodes.where("node IS NOT NULL").select("node", "n", *names, "bands", "bits")
    # a node of equal keys with several sets has rows for each; its sets are told apart by their names
    entries = linked.select("node", *names, "n", F.explode("bands").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min(F.struct("node", *names, "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select("bucket", "head")
    members = written(entries.join(heads, "bucket").select("bucket", F.struct("node", *names, "n").alias("own"), "head"), f"{base}/members")
    stars = members.where(F.col("own") != F.col("head")).where(sizes_allow(F.col("own.n"), F.col("head.n"), percent)).select(F.col("own").alias("a"), F.col("head").alias("b")).distinct()
    stars = written(prefiltered(stars, linked, percent), f"{base}/stars")
    links = confirmed(stars, narrow, k, percent, f"{base}/links")
    roots = components(links)
    # second round: only buckets whose members are of several components
    seen = members.join(roots, F.col("own.node") == F.col("node"), "left").select("bucket", "own", F.coalesce("root", "own.node").alias("root"))
    counts = seen.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count("*").alias("roots"))
    held = counts.where("roots > 1").select("bucket", "main", (F.col("all") * (F.col("all") - F.col("most")) > PAIRS).alias("large"))
    mixed = written(seen.join(held, "bucket"), f"{base}/mixed")
    across = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))) & sizes_allow(F.col("a.n"), F.col("b.n"), percent)
    side = lambda d, x: d.select("bucket", "main", F.col("own").alias(x), F.col("root").alias(f"root_{x}"))
    small, large = mixed.where("NOT large"), mixed.where("large")
    pairs = side(small.where("root != main"), "a").join(side(small, "b").drop("main"), "bucket").where(across).select("a", "b").distinct()
    # what the first round turned down needs no second look
    both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = written(prefiltered(pairs.join(both, ["a", "b"], "left_anti"), linked, percent), f"{base}/pairs")
    found = []
    if not pairs.isEmpty():
        found.append(confirmed(pairs, narrow, k, percent, f"{base}/more"))
    if not large.isEmpty():
        sets = shingles_of(large.select("own").distinct(), narrow, k, f"{base}/sets")
        found.append(written(in_blocks(large, sets, linked, percent), f"{base}/reached"))
    if found and not (more := reduce(DataFrame.union, found)).isEmpty():
        # the first round's stars stand for its links
        roots = components(more.union(roots.toDF("a", "b")))
    of = nodes.select(*names, "node").join(roots.toDF("node", "root"), "node", "left").select(*names, F.coalesce("root", "node").alias("component_id"))
    result = sketch.select("key", "n", *names).join(of, names, "left")
    result = written(result.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("set_a").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")), f"{base}/found")
    delete(spark, *(f"{base}/{x}" for x in ("sketch", "nodes", "members", "stars", "links", "mixed", "pairs", "more", "sets", "reached")))
    return result.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def sizes_allow(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def prefiltered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b: node, set_a, set_b, n) whose signatures' bits let them be similar."""
    bits = lambda x: nodes.select(F.struct("node", "set_a", "set_b", "n").alias(x), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(bits("a"), "a").join(bits("b"), "b").where(likely(F.col("bits_a"), F.col("bits_b"), percent)).select("a", "b")


def shingles_of(wanted: DataFrame, docs: DataFrame, k: int, place: str) -> DataFrame:
    """(own, shingles) of the sets wanted (own: node, set_a, set_b, n), written at place; texts are read again for them."""
    wanted = written(wanted.select("own", F.col("own.node").alias("key")), f"{place}-wanted")
    texts = joined(docs, wanted, ["key"], wanted.count()).select("own", "text")
    # a key may come with several texts: a row counts if its set is the one wanted; rows that repeat make links that repeat
    sets = written(texts.mapInArrow(_sets(k), f"own {OWN}, shingles array<long>"), place)
    delete(docs.sparkSession, f"{place}-wanted")
    return sets


def in_blocks(large: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes outside the main component of their buckets, to nodes in it and to each other; large: bucket, own, root, main. A block holds BLOCK nodes or BLOCK_SHINGLES of their shingles, whichever is less."""
    family = large.select("main", "own", (F.col("root") != F.col("main")).alias("outside")).distinct()
    held = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK, F.coalesce(F.sum(F.when(side, F.col("own.n"))), F.lit(0)) / BLOCK_SHINGLES))
    blocks = family.groupBy("main").agg(held(F.col("outside")).alias("n_out"), held(~F.col("outside")).alias("n_in"))
    bits = nodes.select(F.struct("node", "set_a", "set_b", "n").alias("own"), "bits")
    dealt = family.join(blocks, "main").join(sets.join(bits, "own"), "own").withColumn("node", F.col("own.node"))
    # blocks from 0 hold nodes outside, then come those inside
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("own"), F.col("n_out"))).otherwise(F.col("n_out") + F.pmod(F.xxhash64("own", F.lit(1)), F.col("n_in")))
    dealt = dealt.withColumn("at", own.cast("long")).withColumn("blocks", (F.col("n_out") + F.col("n_in")).cast("long"))
    left = dealt.where("outside").select("main", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"), "node", "shingles", "bits")
    right = dealt.select("main", F.explode(F.sequence(F.lit(0).cast("long"), F.least("at", F.col("n_out").cast("long") - 1))).alias("i"), F.col("at").alias("j"), "node", "shingles", "bits", "outside")
    by = ["main", "i", "j"]
    left, right = (d.select(*(F.col(c).alias(c) for c in d.columns)) for d in (left, right))
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(_met(percent), "a long, b long").distinct()


def _met(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[int, int] = {}
        if left.num_rows and right.num_rows:
            flat = lambda t: (t["shingles"].combine_chunks().flatten().to_numpy(), pa.compute.list_value_length(t["shingles"]).to_numpy().astype(np.int64), t["node"].to_numpy())
            (x, nx, a), (y, ny, b) = flat(left), flat(right)
            known, y = np.unique(y, return_inverse=True)
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            shared, present = known[at] == x, np.zeros(len(known), bool)
            starts, ends, pairs = np.cumsum(ny) - ny, np.cumsum(nx), []
            inside = not right["outside"][0].as_py()
            words = lambda t: t["bits"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            bits_a, bits_b, most = words(left), words(right), most_apart(percent)
            for i in range(len(a)):
                if not (np.bitwise_count(bits_a[i] ^ bits_b).sum(axis=1) <= most).any():
                    continue  # nothing here can be similar
                mine = at[ends[i] - nx[i] : ends[i]][shared[ends[i] - nx[i] : ends[i]]]
                present[mine] = True
                met = np.add.reduceat(present[y], starts, dtype=np.int64)
                present[mine] = False
                found = b[((100 + percent) * met >= percent * (nx[i] + ny)) & (b != a[i])]
                pairs.append((np.full(len(found[: 1 if inside else None]), a[i]), found[: 1 if inside else None]))
            if pairs:
                p, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
                out = union(p, q)
        return pa.table({"a": pa.array(list(out), pa.int64()), "b": pa.array(list(out.values()), pa.int64())})

    return run


def similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets reach the threshold: i / (m + n - i) >= t."""
    return (100 + percent) * F.size(F.array_intersect(a, b)) >= percent * (F.size(a) + F.size(b))


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, place: str) -> DataFrame:
    """Links (a, b: nodes) of those of pairs (a, b: node, set_a, set_b, n) whose full shingle sets reach the threshold, written at place."""
    sets = shingles_of(pairs.select(F.explode(F.array("a", "b")).alias("own")).distinct(), docs, k, f"{place}-sets")
    a, b = (sets.select(F.col("own").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    kept = written(pairs.join(b, "b").join(a, "a").where(similar(F.col("set_a"), F.col("set_b"), percent)).select("a.node", F.col("b.node").alias("b")).toDF("a", "b"), place)
    delete(pairs.sparkSession, f"{place}-sets")
    return kept


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the component that links of 3-word shingle sets at 0.85 put them in."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, r.doc_id = min(r.root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
