"""Exact repeats of LENGTH bytes and more, by longest-previous-factor arrays over dealt groups of strings.

A byte string of LENGTH bytes has an anchor: of its GRAM-byte grams, the (leftmost) one with the least hash. Equal strings have equal anchors at equal places, so anchors, about one in 35 bytes, deal strings to groups in which all their repeats are. An anchor stands for the strings around it, its context.

1. Each task finds the anchors of its documents. Of equal contexts all but the first are repeats throughout; only the first goes on, so that a passage with many copies costs each task one row.
2. Dealt by anchor and sorted, equal contexts are settled over all tasks the same way; anchors that are left with one context have no further repeats. Contexts count as equal if two 64-bit hashes are, of the anchor and, by other arithmetic, of the whole context.
3. For the others, mostly where repeats begin and end, the bytes of contexts are read again and each group gets its suffix order (prefix doubling up to LENGTH bytes), common-prefix lengths of neighbours, and from the previous and next smaller place of each suffix its longest previous factor, all capped at LENGTH. Where that is LENGTH, the string came before. Contexts of an anchor that has more than CROWD of them, such as a common line in different surroundings, are taken apart so that no task gets the crowd: into parts of up to WIDE neighbouring strings, dealt by the bytes around the anchor that strings at those places share, and of equal parts in a slice of a task only the first goes on. Only if more than CROWD parts share even those bytes does each of their strings go on by itself, dealt by its own hash. Rows that are left alone with what they are dealt by have no repeats.
4. Starts of repeats are gathered by document and the bytes they cover are cut.

Groups are read from sorted partitions, so a task holds SORTED strings at a time, however large its partition or a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, numbered, shared_dir, table, written
from .textscan import BASE, U, block_hashes, bytes_of, mix, slices

LENGTH, GRAM = 100, 32
#: Strings an anchor may stand for. Bytes scanned at a time; positions of a stretch fit into its low bits.
WINDOW, STRETCH = LENGTH - GRAM + 1, 1 << 20
#: Anchors a task holds before it settles them.
HELD = 1_000_000
#: Contexts of an anchor beyond which they are dealt by string.
CROWD = 1_000
#: Neighbouring strings of a crowd's context that are dealt together.
WIDE = 16
#: Strings put into suffix order at a time.
SORTED = 200_000
ROW = "h long, c long, doc long, at long, span int"
NAMES = ["h", "c", "doc", "at", "span"]
PIECE = "h long, doc long, lo long, hi long, data binary"
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of which the hash of raw[a:b] is (total[b] - total[a]) * down[a]; for dealing only, as patterned strings of a thousand bytes can share one."""
    value = mix(np.arange(1, 257, dtype=U) * U(BASE))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(value[raw] * powers(BASE, len(raw)), out=total[1:])
    return total, powers(INVERSE, len(raw))


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of texts raw[starts:ends] (sorted, apart): which text, place, first and last string, hashes of gram and context."""
    total, down = prefix_hashes(raw)
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    low = U((1 << 20) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=U)
    # least over WINDOW grams, by doubling
    width, run = 1, least
    while width * 2 <= WINDOW:
        run = np.minimum(run[:-width], run[width:])
        width *= 2
    run = np.minimum(run[: len(grams) - WINDOW + 1], run[WINDOW - width : WINDOW - width + len(grams) - WINDOW + 1])
    counts = np.maximum(ends - starts - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    p = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    place = (run[p] & low).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, lo, hi = place[first], p[first], p[last]
    context = mix(block_hashes(raw, lo, hi + LENGTH, 2 * LENGTH) ^ (a - lo).astype(U))
    return text[first], a, lo, hi, grams[a], context


def _stretches(batch: pa.RecordBatch):
    """(raw, starts, ends, documents, offset of each start in its document): texts of a batch side by side, long ones cut with an overlap."""
    raw, offsets = bytes_of(batch.column("text"))
    docs = batch.column("doc").to_numpy()
    parts = []
    for doc, a, b in zip(docs.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for s in range(a, max(a + 1, b - LENGTH + 1), STRETCH // 2):
            if b - s >= LENGTH:
                parts.append((doc, s, min(b, s + STRETCH // 2 + LENGTH - 1), s - a))
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + parts[to][2] - parts[to][1] <= STRETCH - LENGTH):
            size += parts[to][2] - parts[to][1]
            to += 1
        group = parts[at:to]
        lengths = np.array([b - a for _, a, b, _ in group])
        ends = np.cumsum(lengths)
        yield np.concatenate([raw[a:b] for _, a, b, _ in group]), ends - lengths, ends, np.array([g[0] for g in group], np.int64), np.array([g[3] for g in group], np.int64)
        at = to


def _rows(h, c, doc, at, span) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64)) for x in (h, c, doc, at)] + [pa.array(span.astype(np.int32))], NAMES)


def _gone(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Repeated starts lo..hi as rows, neighbours joined; span -1 marks them, c is the last start."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return _rows(mix(doc[first].view(U) + lo[first].view(U)), hi[last], doc[first], lo[first], np.full(len(first), -1)) if len(doc) else _rows(*(np.zeros(0, np.int64),) * 5)


def _settled(h, c, doc, at, span):
    """Sorted by anchor, context and place, each place once; whether each is the first of its context."""
    order = np.lexsort((at, doc, c, h))
    h, c, doc, at, span = (x[order] for x in (h, c, doc, at, span))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    once = new.copy()
    once[1:] |= (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # rows that repeat a document
    return tuple(x[once] for x in (h, c, doc, at, span, new))


def _found(batches):
    held: list[tuple] = []
    count = 0

    def flush():
        h, c, doc, at, span, new = _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield _rows(h[new], c[new], doc[new], at[new], span[new])
        old = ~new
        yield _gone(doc[old], at[old] - (span[old] >> 8), at[old] - (span[old] & 255))

    for batch in batches:
        for part in slices([batch], "text"):
            for raw, starts, ends, docs, shift in _stretches(part):
                text, a, lo, hi, gram, context = anchors(raw, starts, ends)
                off = (shift - starts)[text]
                held.append((gram, context, docs[text], a + off, (a - lo) << 8 | (a - hi)))
                count += len(a)
                if count >= HELD:
                    yield from flush()
                    held.clear()
                    count = 0
    if held:
        yield from flush()


def _shared(batches):
    """Of anchors sorted by anchor, context and place: contexts that are not alone at their anchor, and repeats as rows of span -1."""
    last = held = None  # the last row seen, and the last context found, not handed on yet
    for batch in batches:
        h, c, doc, at, span = (np.asarray(x) for x in batch.columns)
        gone = span < 0
        if gone.any():
            yield _rows(h[gone], c[gone], doc[gone], at[gone], span[gone])
        h, c, doc, at, span = (x[~gone] for x in (h, c, doc, at, span))
        if not len(h):
            continue
        before = [np.concatenate([[x[0] if last is None else y], x[:-1]]) for x, y in zip((h, c, doc, at), last or (0,) * 4, strict=True)]
        new = (h != before[0]) | (c != before[1])
        old = ~new & ((doc != before[2]) | (at != before[3]))
        new[0] |= last is None
        last = (h[-1], c[-1], doc[-1], at[-1])
        if old.any():
            yield _gone(doc[old], at[old] - (span[old] >> 8), at[old] - (span[old] & 255))
        found = [x[new] for x in (h, c, doc, at, span)]
        if held is not None:
            found = [np.concatenate([[y], x]) for x, y in zip(found, held[:5], strict=True)]
        if not len(found[0]):
            continue
        same = found[0][1:] == found[0][:-1]
        shared = np.append(same, False) | np.append(held is not None and held[5], same)
        fresh = shared.copy()
        fresh[0] &= held is None or not held[5]  # a context that was known to have company has been handed on
        yield _rows(*(x[fresh] for x in found))
        held = (*(x[-1] for x in found), bool(shared[-1]))


def _pieces(h, doc, lo, hi, data, crowd) -> pa.RecordBatch:
    """Strings that start at lo..hi and their bytes, dealt by h; crowd: whether the row is part of a context of a crowd."""
    columns = [pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x) for x in (h, doc, lo, hi)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary()), pa.array(np.full(len(columns[0]), crowd))], ["h", "doc", "lo", "hi", "data", "crowd"])


def _dropped(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Repeated starts lo..hi among pieces: data is null."""
    gone = _gone(doc, lo, hi)
    return _pieces(*(gone.column(x).to_numpy() for x in ("h", "doc", "at", "c")), [None] * len(gone), False)


def _contexts(batches):
    """The bytes around anchors; contexts of crowds in parts, the first of equal ones in a slice."""
    for batch in slices(batches, "text"):
        raw, offsets = bytes_of(batch.column("text"))
        n, items = np.asarray(pa.compute.list_value_length(batch.column("items"))), batch.column("items").flatten()
        doc, start = np.repeat(batch.column("doc").to_numpy(), n), np.repeat(offsets[:-1], n)
        h, at, span, crowd = (pa.compute.struct_field(items, x).to_numpy(zero_copy_only=False) for x in ("h", "at", "span", "crowd"))
        most, least = (span >> 8).astype(np.int64), (span & 255).astype(np.int64)  # places before the anchor
        own = np.flatnonzero(~crowd)
        if len(own):
            lo, hi = (at - most)[own], (at - least)[own]
            data = [raw[a:b].tobytes() for a, b in zip((start[own] + lo).tolist(), (start[own] + hi + LENGTH).tolist(), strict=True)]
            yield _pieces(h[own], doc[own], lo, hi, data, False)
        own = np.flatnonzero(crowd)
        if not len(own):
            continue
        parts = most[own] // WIDE - least[own] // WIDE + 1
        own = np.repeat(own, parts)
        part = least[own] // WIDE + np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        near, far = part * WIDE, np.minimum(part * WIDE + WIDE, WINDOW) - 1
        doc, start, at = doc[own], start[own], at[own]
        lo, hi = at - np.minimum(most[own], far), at - np.maximum(least[own], near)
        h = mix(block_hashes(raw, start + at - near, start + at + LENGTH - far, 2 * LENGTH) ^ part.astype(U))
        order = np.lexsort((lo, doc))
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(doc[order]) != 0) | (np.diff(lo[order]) != 0)  # rows that repeat a document
        order = order[once]
        h, doc, start, lo, hi = (x[order] for x in (h, doc, start, lo, hi))
        first: dict[bytes, int] = {}
        for i, (a, b) in enumerate(zip((start + lo).tolist(), (start + hi + LENGTH).tolist(), strict=True)):
            first.setdefault(raw[a:b].tobytes(), i)
        new = np.zeros(len(lo), bool)
        new[list(first.values())] = True
        yield _pieces(h[new], doc[new], lo[new], hi[new], list(first), True)
        if not new.all():
            yield _dropped(doc[~new], lo[~new], hi[~new])


def _strings(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """All strings of rows in order of place, each place once: the rows' bytes, and of each string its document, place and where it is among the bytes."""
    docs, los = rows["doc"].to_numpy(), rows["lo"].to_numpy()
    lengths = np.asarray(pa.compute.binary_length(rows["data"].combine_chunks())).astype(np.int64)
    raw = np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8)
    n = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, place, at = docs[row], los[row] + i, (np.cumsum(lengths) - lengths)[row] + i
    order = np.lexsort((place, doc))
    once = np.ones(len(order), bool)
    once[1:] = (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)
    order = order[once]
    return raw, doc[order], place[order], at[order]


def _alone(batches):
    """Pieces; those that are large come string by string, dealt by their own hashes, the first of equal ones in a batch."""
    names = ["h", "doc", "lo", "hi", "data"]
    for batch in batches:
        large = pa.compute.and_(batch.column("large").is_valid(), batch.column("data").is_valid())
        yield batch.filter(pa.compute.invert(large)).select(names)
        if len(rows := batch.filter(large)):
            raw, doc, place, at = _strings(pa.Table.from_batches([rows]))
            gone = earlier(raw, at)
            yield _dropped(doc[gone], place[gone], place[gone]).select(names)
            doc, place, at = doc[~gone], place[~gone], at[~gone]
            yield _pieces(block_hashes(raw, at, at + LENGTH, LENGTH), doc, place, place, [raw[x : x + LENGTH].tobytes() for x in at.tolist()], True).select(names)


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _needed() -> dict[int, list[int]]:
    """By width, the offsets from a suffix at which suffix_order() looks at ranks of so many bytes: to double them, and for common prefixes."""
    widths = [8]
    while widths[-1] < LENGTH:
        widths.append(min(2 * widths[-1], LENGTH))
    out, left = {LENGTH: [0]}, {0}
    for wide, width in zip(widths[:0:-1], widths[-2::-1], strict=True):
        out[width] = sorted({x + y for x in out[wide] for y in (0, wide - width)} | {x for x in left if x + width <= LENGTH})
        left |= {x + width for x in left if x + width <= LENGTH}
    return out


NEEDED = _needed()


def _reach(at: np.ndarray, width: int) -> np.ndarray:
    return np.unique((at[:, None] + np.array(NEEDED[width])).ravel())


def suffix_order(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of raw at each of at in order of their first LENGTH bytes, equal ones as they are given, and the common-prefix length, up to LENGTH, of each with the one before; by prefix doubling."""
    eight = np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,))
    # ranks of the bytes at every offset that is needed, from eight bytes on
    few = len(at) * len(NEEDED[8]) < len(raw)
    levels, width, reach = [], 8, _reach(at, 8) if few else np.arange(len(raw) - 7)
    rank = np.zeros(len(raw), np.int64)
    rank[reach] = dense(eight[reach].astype(U))
    while True:
        levels.append((width, rank))
        if width == LENGTH:
            break
        step = min(width, LENGTH - width)
        reach = reach[reach + step + width <= len(raw)]
        reach = at if width + step == LENGTH else _reach(at, width + step) if few else reach
        doubled = np.zeros(len(raw), np.int64)
        doubled[reach] = dense(rank[reach] * np.int64(len(raw) + 1) + rank[reach + step])
        width, rank = width + step, doubled
    order = np.argsort(rank[at], kind="stable")
    a, b = at[order][:-1], at[order][1:]
    same = np.append(False, rank[a] == rank[b])
    common = np.zeros(len(at), np.int64)
    common[same] = LENGTH
    a, b, left = a[~same[1:]], b[~same[1:]], np.zeros(int((~same[1:]).sum()), np.int64)
    for width, rank in levels[-2::-1]:
        left += np.where((left + width <= LENGTH) & (rank[a + left] == rank[b + left]), width, 0)
    byte = np.ones(len(left), bool)
    for _ in range(7):
        byte &= raw[a + left] == raw[b + left]
        left += byte
    common[1:][~same[1:]] = left
    return order, common


def previous_factors(order: np.ndarray, common: np.ndarray, place: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest previous factor of each suffix: its longest common prefix with one at a smaller place, which is the next before or after it in suffix order that has a smaller place. Where that is under least, it may be given as less than it is."""
    n, out = len(order), np.zeros(len(order), np.int64)
    spot = place[order]
    for back in (True, False):
        ranked, to = (spot, common) if back else (spot[::-1], np.append(common[1:], 0)[::-1])
        # candidates walk towards the smaller place; between a suffix and its candidate all places are larger
        near, shared = np.arange(n) - 1, to.copy()
        open_ = np.flatnonzero((near >= 0) & (shared >= least))
        while len(open_):
            open_ = open_[(near[open_] >= 0) & (shared[open_] >= max(least, 1))]
            open_ = open_[ranked[np.maximum(near[open_], 0)] >= ranked[open_]]
            via = near[open_]
            shared[open_], near[open_] = np.minimum(shared[open_], shared[via]), near[via]
        shared[near < 0] = 0
        smaller = np.zeros(n, bool)
        smaller[near >= 0] = ranked[near[near >= 0]] < ranked[near >= 0]
        shared[~smaller] = 0
        out[order] = np.maximum(out[order], shared if back else shared[::-1])
    return out


def earlier(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of the suffix at each of at, which are in order of place, has LENGTH bytes."""
    order, common = suffix_order(raw, at)
    return previous_factors(order, common, np.arange(len(at)), LENGTH) >= LENGTH


def _groups(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, bool]]:
    """Whole groups of equal h with about SORTED strings together, from batches sorted by h; a larger group comes in parts, of which all but the last are marked."""
    held, strings = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = np.asarray(pa.compute.binary_length(batch.column("data")))[at:] - LENGTH + 1
            to = at + max(1, int(np.searchsorted(np.cumsum(n) + strings, SORTED, "right")))
            held.append(batch.slice(at, to - at))
            strings += int(n[: to - at].sum())
            at = to
            if strings < SORTED * 0.9 and at >= batch.num_rows:
                continue
            rows = pa.Table.from_batches(held)
            h = rows["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:  # the last group may go on
                yield rows.slice(0, cut), False
                held, strings = rows.slice(cut).combine_chunks().to_batches(), int((np.asarray(pa.compute.binary_length(rows["data"].slice(cut).combine_chunks())) - LENGTH + 1).sum())
            elif strings >= SORTED:
                left = yield rows, True
                held, strings = left.combine_chunks().to_batches(), left.num_rows
    if held:
        yield pa.Table.from_batches(held), False


def _matched(batches):
    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.compute.is_valid(batch.column("data"))).select(["h", "doc", "lo", "data"])

    def told():
        for batch in batches:
            gone = batch.filter(pa.compute.is_null(batch.column("data")))
            if gone.num_rows:
                found.append(_gone(*(gone.column(x).to_numpy() for x in ("doc", "lo", "hi"))))
            if len(rest := known(batch)):
                yield rest

    found: list[pa.RecordBatch] = []
    groups = _groups(told())
    send = None
    while True:
        try:
            rows, part = groups.send(send)
        except StopIteration:
            break
        send = None
        if not part:
            same = np.diff(rows["h"].to_numpy()) == 0
            rows = rows.filter(pa.array(np.append(False, same) | np.append(same, False)))
            if not len(rows):
                continue
        raw, doc, place, at = _strings(rows)
        gone = earlier(raw, at)
        found.append(_gone(doc[gone], place[gone], place[gone]))
        if part:  # what is left of the group so far stands for it
            h = rows["h"][-1].as_py()
            left = ~gone
            send = pa.table({"h": pa.array([h] * int(left.sum()), pa.int64()), "doc": doc[left], "lo": place[left], "data": pa.array([raw[x : x + LENGTH].tobytes() for x in at[left]], pa.binary())})
        yield from found
        found.clear()
    yield from found


def _cut(batches):
    for batch in slices(batches, "text"):
        raw, offsets = bytes_of(batch.column("text"))
        out = []
        for key, a, b, spans in zip(batch.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
            text, runs = raw[a:b], 0
            kept = text
            if spans:
                step = np.zeros(b - a + 1, np.int32)
                for s in spans:
                    step[s["lo"]] += 1
                    step[s["hi"] + LENGTH] -= 1
                covered = np.cumsum(step[:-1]) > 0
                runs, kept = int(covered[0]) + int(np.count_nonzero(covered[1:] & ~covered[:-1])), text[~covered]
            out.append((key, b - a, b - a - len(kept), runs, kept.tobytes()))
        key, n, removed, runs, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each text without the bytes that a string of LENGTH bytes covers which also starts earlier (at a smaller key, or before in the same text); kept is what remains, as UTF-8 bytes.

    Strings are judged on the texts as given, and never cross them. Null texts are empty. Rows equal in key and text are one document, each with its whole result; rows of one key with different texts are documents in the order of hashes of their texts. Rows with a null key stay as they are and are no source of repeats. Long texts are read STRETCH bytes at a time. An empty table gives an empty one. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = numbered(d.where("key IS NOT NULL"), "key", "text", f"{base}/numbers").withColumnRenamed("__doc", "doc")
    found = keyed.where("octet_length(text) >= %d" % LENGTH).select("doc", "text").mapInArrow(_found, ROW)
    shared = written(found.repartition("h").sortWithinPartitions("h", "c", "doc", "at").mapInArrow(_shared, ROW), f"{base}/shared")
    open_ = shared.where("span >= 0")
    crowds = written(open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("h", F.lit(True).alias("crowd")), f"{base}/crowds")
    crowded = crowds.count()
    items = joined(open_, crowds, ["h"], crowded, "left").groupBy("doc").agg(F.collect_list(F.struct("h", "at", "span", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("items"))
    contexts = keyed.select("doc", "text").join(items, "doc").mapInArrow(_contexts, PIECE + ", crowd boolean")
    if crowded:
        contexts = written(contexts, f"{base}/contexts")
        large = written(contexts.where("crowd").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("h", F.lit(True).alias("large")), f"{base}/large")
        if count := large.count():
            contexts = joined(contexts, large, ["h"], count, "left").mapInArrow(_alone, PIECE)
    matched = written(contexts.select("h", "doc", "lo", "hi", "data").repartition("h").sortWithinPartitions("h", "doc", "lo").mapInArrow(_matched, ROW), f"{base}/matched")
    starts = shared.where("span < 0").unionByName(matched).select("doc", F.col("at").alias("lo"), F.col("c").alias("hi"))
    spans = starts.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    none = d.where("key IS NULL").select("key", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"))
    cut = keyed.join(spans, "doc", "left").select("key", "text", "spans").union(none).mapInArrow(_cut, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("key", key)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeats of 100 bytes and more."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
