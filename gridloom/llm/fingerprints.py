"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j a text shows the character its pointer stands on, and a random bit of (j, character) tells whether the pointer moves on. Two texts that differ by few edits soon show the same characters again, so that their edit distance becomes a Hamming distance of what they show. A walk over n characters takes 3 n steps, which takes it through the whole text. Texts of a batch walk together, one array operation a step.

A fingerprint holds what the text shows at SAMPLE positions: of the positions below 3 n, those whose hashes are least. Samples of texts of any two lengths therefore agree on their positions as far as both walks go.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, shared_dir, table, written
from .components import components
from .textscan import BASE, U, mix

SAMPLE, STEPS, SEED = 128, 3, 8
#: Steps for which a table of random bits is made at a time. Characters that walk together, at least.
PERIOD, CHARS = 1 << 13, 24 << 20
#: For texts of less than so many characters, steps of a stretch that is a band, and walks. Stretches of a walk, at most; members of a block of a large bucket.
WIDTHS, KEPT, BLOCK = ((14, 6, 16), (60, 8, 16), (400, 16, 16), (float("inf"), 16, 8)), 192, 512
#: Bytes of texts that a task gets, on average at most.
PART_BYTES = 128 << 20


@lru_cache(maxsize=24)
def moves(seed: int, block: int) -> np.ndarray:
    """For the PERIOD steps of a block, by character: whether the pointer moves on; never from 0, the end of a text."""
    first = (seed << 40 | block) * BASE & (2**64 - 1)
    bits = (mix(mix(np.arange(PERIOD * 256, dtype=U)) + U(first)) & U(1)).astype(np.uint8).reshape(PERIOD, 256)
    bits[:, 0] = 0
    return bits


class Positions:
    """The positions that are sampled for some length, ascending: those among the SAMPLE least hashes of all positions up to them."""

    def __init__(self, seed: int = SEED):
        self.seed, self.upto, self.heap, self.at, self.rank = seed, 0, [], [], []

    def extend(self, end: int) -> None:
        while self.upto < end:
            to = min(end, self.upto + (1 << 20))
            h = mix(np.arange(self.upto, to, dtype=U) ^ U((self.seed + 77) * BASE & (2**64 - 1))) >> U(1)
            for i in np.flatnonzero(h < U(-self.heap[0])) if len(self.heap) == SAMPLE else range(len(h)):
                v = int(h[i])
                if len(self.heap) < SAMPLE:
                    heapq.heappush(self.heap, -v)
                elif v < -self.heap[0]:
                    heapq.heapreplace(self.heap, -v)
                else:
                    continue
                self.at.append(self.upto + int(i))
                self.rank.append(v)
            self.upto = to

    def of(self, end: int) -> np.ndarray:
        """Indices into at of what is sampled below end, ascending."""
        self.extend(end)
        n = int(np.searchsorted(self.at, end))
        least = np.argsort(np.array(self.rank[:n], np.int64), kind="stable")[:SAMPLE]
        return np.sort(least)


def walk(texts: list[str], positions: Positions, seed: int = SEED) -> np.ndarray:
    """What each text (column) shows at each of positions.at (row), as bytes from 1 to 255; 0 once it has ended."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(texts) else 0
    positions.extend(STEPS * longest)
    shown = np.zeros((int(np.searchsorted(positions.at, STEPS * longest)), len(texts)), np.uint8)
    code = np.frombuffer("\0".join([texts[i] for i in order] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths[order] + 1)
    buf = ((code * np.uint32(2654435761) >> np.uint32(11)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    buf[ends - 1] = 0
    pointer, steps = ends - lengths[order] - 1, STEPS * lengths[order]
    active = np.searchsorted(-steps, -np.arange(1, 2), "right")[0] if len(texts) else 0
    wanted, due = iter(positions.at), 0
    row, here, stay = 0, np.empty(len(texts), np.uint8), np.empty(len(texts), np.uint8)
    due = next(wanted, -1)
    for j in range(STEPS * longest):
        if j % PERIOD == 0:
            bits = moves(seed, j // PERIOD)
        while active and steps[active - 1] <= j:
            active -= 1
        p, c, m = pointer[:active], here[:active], stay[:active]
        np.take(buf, p, out=c, mode="clip")
        if j == due:
            shown[row, :active] = c
            row, due = row + 1, next(wanted, -1)
        np.take(bits[j % PERIOD], c, out=m, mode="clip")
        np.add(p, m, out=p)
    out = np.empty_like(shown)
    out[:, order] = shown
    return out


def likeness(n: int, a: bytes, m: int, b: bytes, positions: Positions) -> float:
    """Share of the longer text's sampled positions at which both show the same; 1 for two empty texts."""
    if n > m:
        n, a, m, b = m, b, n, a
    if not m:
        return 1.0
    long_ = np.array(positions.at)[positions.of(STEPS * m)] if m > n else None
    if long_ is None:
        return float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
    if not n:
        return 0.0
    short = np.array(positions.at)[positions.of(STEPS * n)]
    both = long_ < STEPS * n
    where = np.searchsorted(short, long_[both])
    return float(np.sum(np.frombuffer(a, np.uint8)[where] == np.frombuffer(b, np.uint8)[both]) / len(long_))


class Fingerprints:
    def __init__(self, seed: int = SEED):
        self.positions, self.seed, self.samples = Positions(seed), seed, {}

    def sample(self, n: int) -> np.ndarray:
        if n not in self.samples:
            if len(self.samples) > 20_000:
                self.samples.clear()
            self.samples[n] = self.positions.of(STEPS * n)
        return self.samples[n]

    def shown(self, texts: list[str]) -> list[bytes]:
        grid = walk(texts, self.positions, self.seed)
        return [grid[self.sample(len(t)), i].tobytes() for i, t in enumerate(texts)]


def named(n: int, shown: bytes) -> str:
    return f"{n}:{shown.hex()}"


def read(fingerprint: str) -> tuple[int, bytes]:
    n, _, shown = fingerprint.partition(":")
    return int(n), bytes.fromhex(shown)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the start of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Stretches of rows (part, ahead, doc_id, text) of about CHARS characters; each but the last of a part ends with the row that starts the next."""
    held, chars = [], 0
    for batch in batches:
        for part, ahead, doc, text in zip(batch["part"], batch["ahead"], batch["doc_id"], batch["text"], strict=True):
            r = (part, ahead, None if pd.isna(doc) else int(doc), text or "")
            if held and (held[-1][0] != part or held[-1][1]):
                if held[-1][0] != part:
                    yield held
                    held, chars = [], 0
                else:
                    continue  # further rows of the first key behind this part
            held.append(r)
            chars += len(r[3])
            if chars >= CHARS and not ahead:
                yield held
                held, chars = [r], len(r[3])
    if held:
        yield held


def _fingerprint(batches):
    fp = Fingerprints()
    for rows in _in_order(batches):
        if len(rows) < 2:
            continue
        texts = [r[3] for r in rows]
        altered = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        shown = fp.shown(texts + altered)
        own, other = shown[: len(texts)], shown[len(texts) :]
        out = []
        for i, (_, _, doc, text) in enumerate(rows[:-1]):
            n, m, k = len(text), len(altered[i]), len(texts[i + 1])
            out.append((doc, n, hashlib.sha256(altered[i].encode("utf-8", "surrogatepass")).hexdigest(), named(n, own[i]), named(m, other[i]), likeness(n, own[i], m, other[i], fp.positions), likeness(n, own[i], k, own[i + 1], fp.positions)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"doc_id": "Int64"})


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, ahead, doc_id, text) dealt by ranges of doc_id, in order; each part ends with the row, marked ahead, that follows its last one; the first of all follows the last.

    Ranges start at keys that occur (quantiles over all keys), so the row that follows a range is known beforehand and is dealt to both sides.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    probs = ",".join(str(i / parts) for i in range(1, parts)) or "0.5"
    found = d.agg(F.expr(f"percentile_approx(doc_id, array({probs}), {max(1000, 20 * parts)})").alias("q"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    splits = np.array(sorted({x for x in found["q"] or [] if x is not None and (x > found["low"] or found["nulls"])}), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        keys = ids.to_numpy(float if ids.hasnans else np.int64, na_value=np.nan) if ids.hasnans else ids.to_numpy(np.int64)
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(splits, np.where(ids.isna(), 0, keys).astype(np.int64), "right")), dtype="int32")

    first = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["low"])
    starts = F.col("doc_id").isin([int(x) for x in splits]) if len(splits) else F.lit(False)
    own = F.struct(F.col("p").alias("part"), F.lit(False).alias("ahead"))
    before = F.when(starts, F.struct((F.col("p") - 1).alias("part"), F.lit(True).alias("ahead")))
    last = F.when(first, F.struct(F.lit(len(splits)).alias("part"), F.lit(True).alias("ahead")))
    dealt = d.withColumn("p", part_of("doc_id")).select(F.inline(F.filter(F.array(own, before, last), lambda x: x.isNotNull())), "doc_id", "text")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """OUT's columns for each row of docs (doc_id, text) in order of doc_id: its fingerprint, that of its edited text, and likenesses.

    Null texts are empty: their fingerprint is `0:`, which is like another empty one (1) and unlike all others (0). Rows with null doc_id come first; rows of equal doc_id follow each other by text. The only row of a table follows itself. Long texts walk to their end, 3 steps a character. An empty table gives an empty one. Other columns are not read.
    """
    if not parts:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return with_following(docs, parts).mapInPandas(_fingerprint, OUT)


def distance(a: str, b: str) -> int:
    """Edit distance, bit-parallel: a column of the table of distances is two integers of differences."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full, top, plus, minus, d = (1 << len(b)) - 1, 1 << (len(b) - 1), (1 << len(b)) - 1, 0, len(b)
    for c in a:
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        d += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return d


def step_of(percent: int) -> float:
    """Texts are dealt to classes by the logarithm of their length over this, so that two of a pair are at most one class apart."""
    return 1.001 * max(0.01, log(100 / max(1, percent)))


@lru_cache(maxsize=4096)
def stretches(size: int, percent: int) -> tuple[int, int, tuple[int, ...]]:
    """For texts of the classes size - 1 and size: steps a stretch, walks, and the steps its stretches start at, KEPT with the least hashes."""
    least = exp((size - 1) * step_of(percent))
    steps, walks = next((s, w) for below, s, w in WIDTHS if least < below)
    steps = max(4, steps * 10 // max(10, 100 - percent))
    at = np.arange(max(1, int(STEPS * least) // steps), dtype=U)
    return steps, walks, tuple(np.sort(at[np.argsort(mix(at + U(1)), kind="stable")][:KEPT] * U(steps)).astype(np.int64).tolist())


class Steps:
    """Given positions, for walk()."""

    def __init__(self, at: np.ndarray):
        self.at = at

    def extend(self, end: int) -> None:
        pass


def bands_of(texts: list[str], size: int, percent: int) -> list[np.ndarray]:
    """Names of the stretches of texts of class size, for this class and the next; those that an end of a text falls into have none."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for of in (size, size + 1):
        steps, walks, starts = stretches(of, percent)
        at = np.array(starts)[:, None] + np.arange(steps)
        for seed in range(SEED, SEED + walks):
            grid = np.zeros((at.size, len(texts)), np.uint8)
            shown = walk(texts, Steps(at.ravel()), seed)
            grid[: len(shown)] = shown
            grid = grid.reshape(len(starts), steps, len(texts))
            name = mix(np.array(starts, U) * U(BASE) + U(of << 8 | seed))[:, None] * np.ones((1, len(texts)), U)
            for i in range(steps):
                name = mix(name ^ grid[:, i].astype(U)) + U(i)
            whole = (grid > 0).all(axis=1)
            for i in range(len(texts)):
                out[i].append(name[whole[:, i], i])
    return [np.unique(np.concatenate(x)).view(np.int64) for x in out]


def _banded(percent: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            sizes = [int(log(len(t)) / step_of(percent)) for t in texts]
            order = sorted(range(len(texts)), key=sizes.__getitem__)
            at = 0
            while at < len(order):
                to, chars = at, 0
                while to < len(order) and to - at < 256 and sizes[order[to]] == sizes[order[at]] and chars < CHARS:
                    chars += len(texts[order[to]])
                    to += 1
                rows = order[at:to]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array(bands_of([texts[i] for i in rows], sizes[rows[0]], percent), pa.list_(pa.int64()))], ["id", "bands"])
                at = to

    return run


def apart(a: str, b: str) -> int:
    """A lower bound of the edit distance: characters, with their numbers, that only one of the two has."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            most = [(100 - percent) * max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
            keep = [100 * apart(x, y) <= m and 100 * distance(x, y) <= m for x, y, m in zip(a, b, most, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def across(seen: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members of different components, whose lengths allow a link; seen: band, id, n, root. The members of a bucket are dealt to a grid of blocks, about BLOCK a side, so that no task holds a large bucket."""
    counts = seen.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.countDistinct("root").alias("roots")).where("roots > 1").drop("roots")
    dealt = seen.join(counts, "band").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    left = dealt.select("band", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    right = dealt.select("band", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    allowed = (F.lit(100) * F.abs(F.col("n_a") - F.col("n_b")) <= F.lit(100 - percent) * F.greatest("n_a", "n_b")) & (F.col("root_a") != F.col("root_b")) & ((F.col("i") != F.col("j")) | (F.col("a") < F.col("b")))
    return left.join(right, ["band", "i", "j"]).where(allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_by_edits(docs: DataFrame, percent: int = 90) -> DataFrame:
    """(doc_id, component_id): rows of docs whose texts share a band and differ by at most (100 - percent) % of the longer one's characters are linked.

    A band is what a walk shows over a stretch of steps in a row (WIDTHS). First every member of a bucket is held against its least doc_id, then, in buckets that still hold several components, against all members of other ones. At 90, pairs at the threshold with edits at random places are taken to share no band with a chance under 1e-4: an estimate from 150 pairs of each of eleven lengths from 10 to 900 characters, walks taken as independent; edits that are placed evenly on purpose, or another percent, may be missed more often. Equal texts are one; null and empty texts and rows with null doc_id are linked with nothing. doc_ids are unique.
    """
    base = shared_dir(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    distinct = written(d.where("text != ''").groupBy("text").agg(F.min("doc_id").alias("id")), f"{base}/distinct")
    bands = written(distinct.mapInArrow(_banded(percent), "id long, bands array<long>").select("id", F.explode("bands").alias("band")), f"{base}/bands")
    heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1").select("band", "head")
    members = written(bands.join(heads, "band"), f"{base}/members")
    text = lambda x: distinct.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    checked = lambda pairs, place: written(pairs.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verified(percent), "a long, b long"), place)
    stars = written(members.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), f"{base}/stars")
    links = checked(stars, f"{base}/links")
    seen = members.join(components(links), F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    seen = written(seen.join(distinct.select("id", F.length("text").alias("n")), "id"), f"{base}/seen")
    more = checked(across(seen, percent).join(stars, ["a", "b"], "left_anti"), f"{base}/more")
    roots = components(links.union(more))
    of = distinct.join(roots, F.col("id") == F.col("node"), "left").select("text", F.coalesce("root", "id").alias("component_id"))
    out = written(d.join(of, "text", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")), f"{base}/found")
    delete(docs.sparkSession, *(f"{base}/{x}" for x in ("distinct", "bands", "members", "stars", "links", "seen", "more")))
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
