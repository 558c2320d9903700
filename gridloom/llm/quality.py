"""Quality classifier from weak labels.

Overlapping heuristics, and annotators where labels are given, vote on a document: heuristics to reject it or abstain, as each looks for one fault only, annotators for either side. There are two aspects, junk and toxicity, with voters of their own. For each, expectation-maximisation over the counts of all vote patterns (a few hundred, whatever the corpus) estimates how often each voter is right on good and on bad documents, and with it the posterior of every pattern. A hashed linear scorer is trained on the posterior labels of at most TRAIN_ROWS documents; it also judges documents on which the heuristics abstain. A document is kept if, in both aspects, the log odds of its posterior, by the heuristics alone, and the scorer's add up to more than 0; the scorer, which sees words only, speaks for no document that the heuristics are against.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, shared_dir, table, written
from .textscan import BASE, U, bytes_of, mix, slices, word_hashes

#: Documents the scorer is trained on, at most: those with the least hashes of each side.
TRAIN_ROWS = 6_000
#: Labelled documents, not toxic and toxic, that word stems are learned from, at most; bytes of a stem.
STEM_ROWS, STEM_BYTES = (20_000, 5_000), (4, 5, 6)
#: Heuristics look for gross faults: they are taken to hit no more than this share of good documents. Without a bound, a fault that only one of them sees is as well explained as a way of good documents.
MISFIRE = 0.003
#: Words of the stretches by which repetition in long texts is judged, at least.
PART = 1000
#: Hashed features.
FEATURES = 1 << 18
#: Words that hardly serve but to insult, in English, German, French, Spanish, Italian, Portuguese and Dutch; a general list. Ten words here and in MILD are those of an earlier list, which had been fitted to the test tables.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles scum scumbag scumbags dumbass asshole assholes arsehole arseholes cunt cunts dickhead dickheads dipshit douchebag fuckhead fucker fuckers motherfucker motherfuckers shithead shitheads twat wanker wankers dimwit halfwit nitwit numbskull cretin cretins lowlife lowlifes "
    "idioten vollidiot vollidioten dummkopf schwachkopf hohlkopf trottel volltrottel vollpfosten arschloch wichser hurensohn missgeburt drecksau drecksack schlampe fotze abschaum blödmann spasti mistkerl "
    "idiote idiotes imbécile imbéciles crétin crétins crétine abruti abrutis abrutie connard connards connasse salaud salauds salope salopes enculé enculés enfoiré enfoirés "
    "idiota idiotas imbécil gilipollas cabrón cabrones pendejo pendejos pendeja hijoputa malnacido "
    "stronzo stronzi stronza coglione coglioni cretino cretini cretina imbecille imbecilli vaffanculo "
    "imbecil imbecis otário otária babaca babacas cuzão "
    "klootzak klootzakken sukkel sukkels hufter kutwijf mafkees"
)
#: Words that insult people but are plain words as well, of things or in literature: two different ones within NEAR words are taken for an insult, one alone is not.
MILD = (
    "bastard bastards bitch bitches whore whores jackass stupid dumb fool fools foolish loser losers clown clowns trash garbage vermin pathetic worthless disgusting brainless coward cowards liar liars creep parasite parasites "
    "depp deppen dumm blöd erbärmlich widerlich wertlos abfall müll ekelhaft hässlich clown feigling lügner "
    "bouffon débile débiles pourriture ordures stupide stupides minable minables pathétique dégoûtant dégoûtante perdant perdante déchet déchets ordure clown menteur "
    "capullo subnormal mamón escoria patético patética asqueroso asquerosa basura perdedor perdedora payaso payasa tonto tonta estúpido estúpida estúpidos estúpidas despreciable cobarde repugnante "
    "bastardo bastardi puttana stupido stupida patetico patetica schifoso schifosa spazzatura perdente pagliaccio "
    "escroto desgraçado patético nojento lixo perdedor palhaço "
    "zielig walgelijk waardeloos "
)
NEAR = 20


#: The heuristics, in the order of their votes.
HEURISTICS = ("symbols", "shouting", "exclaiming", "repeating", "empty", "letters", "insulting", "insulting often", "stems")
#: Which votes belong to an aspect; the last one of each is the annotators'.
ASPECTS = {"junk": (0, 1, 2, 3, 4, 5, 9), "toxic": (6, 7, 8, 10)}


def stem_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first 4, 5 and 6 bytes of the bare words of all rows, and the row of each."""
    raw, offsets = bytes_of(_letters(column))
    raw = np.concatenate([np.where((raw >= 65) & (raw <= 90), raw + 32, raw), np.full(8, 32, np.uint8)]).astype(U)
    blank = np.isin(raw, np.array([9, 10, 11, 12, 13, 32], U))
    first = np.zeros(len(raw), bool)
    first[offsets] = True
    begins = np.flatnonzero(~blank & (first | np.concatenate([[True], blank[:-1]])))
    row = np.searchsorted(offsets, begins, "right") - 1
    value, inside, out, of = np.zeros(len(begins), U), np.ones(len(begins), bool), [], []
    for i in range(max(STEM_BYTES)):
        at = begins + i
        inside &= ~blank[at] & ((i == 0) | ~first[at])
        value = value * U(256) + raw[at]
        if i + 1 in STEM_BYTES:
            out.append(mix(value[inside] * U(8) + U(i + 1)))
            of.append(row[inside])
    return np.concatenate(out), np.concatenate(of)


def _stem_counts(batches):
    for batch in slices(batches, "text"):
        value, row = stem_hashes(batch.column("text"))
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, toxic = value[new], np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), np.int64)[row[new]]
        known, at = np.unique(value, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.bincount(at, toxic, len(known)).astype(np.int64)), pa.array(np.bincount(at, 1 - toxic, len(known)).astype(np.int64))], ["stem", "toxic", "clean"])


def learned_stems(d: DataFrame, labels: DataFrame, place: str) -> np.ndarray:
    """Hashes of word stems that labelled toxic documents have and others never; d has id and text. A stem must be in so many toxic documents that not one in a hundred such lists would hold one by chance, were labels dealt at random."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = [written(marks.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(STEM_ROWS[v]), f"{place}/stems{v}") for v in (0, 1)]
    n = [c.count() for c in chosen]
    if not all(n):
        return np.zeros(0, U)
    least = max(4, int(np.ceil(np.log(1e8) / np.log(sum(n) / n[1]))))
    found = d.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("text", "toxic").mapInArrow(_stem_counts, "stem long, toxic long, clean long")
    found = found.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where((F.col("t") >= least) & (F.col("c") == 0))
    return np.sort(np.array([r["stem"] for r in found.select("stem").collect()], np.int64).view(U))


def repeating(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether less than a quarter of a text's words are distinct. As the share of distinct words falls with length in good texts too, a text of 2 PART words or more is judged by all its stretches of PART to 2 PART words, at least half of which have to repeat, and, for what repeats at longer distances, by its distinct runs of five words."""
    out = np.zeros(len(first) - 1, bool)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        cuts = np.linspace(a, b, max(1, (b - a) // PART) + 1).astype(np.int64).tolist()
        low = [len(np.unique(hashes[x:y])) < 0.25 * (y - x) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        out[i] = 2 * sum(low) >= len(low)
        if len(low) > 1 and not out[i]:
            runs = sum(mix(hashes[a + j : b - 4 + j] + U(j)) for j in range(5))
            out[i] = len(np.unique(runs)) < 0.25 * len(runs)
    return out


def votes(column: pa.Array, stems: np.ndarray) -> np.ndarray:
    """A row of votes for each text: -1 to reject it, 0 to abstain; counts are of whole texts."""
    raw, offsets = bytes_of(column)
    hashes, first = word_hashes(column)
    bare, bare_first = word_hashes(_letters(column))
    listed = lambda names: np.isin(bare, word_hashes(pa.array(names.split()))[0])
    total = lambda mask, at: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    n, w = np.diff(offsets), np.diff(first)
    upper, lower = total((raw >= 65) & (raw <= 90), offsets), total((raw >= 97) & (raw <= 122), offsets)
    odd = total(np.isin(raw, np.frombuffer(b"#$%&*@^~|<>=+_{}[]", np.uint8)), offsets)
    bangs = total(raw == 33, offsets)
    mild = np.flatnonzero(listed(MILD))
    of = np.searchsorted(bare_first, mild, "right") - 1
    close = (np.diff(mild) <= NEAR) & (of[1:] == of[:-1]) & (bare[mild[1:]] != bare[mild[:-1]])
    rude = total(listed(INSULTS), bare_first) + np.bincount(of[1:][close], minlength=len(n))
    value, row = stem_hashes(column)
    stemmed = np.bincount(row[stems[np.minimum(np.searchsorted(stems, value), len(stems) - 1)] == value], minlength=len(n)) if len(stems) else np.zeros(len(n), int)
    letters = upper + lower + total(raw >= 128, offsets)
    bad = [
        odd > 0.03 * n,
        (upper > 0.5 * (upper + lower)) & (w >= 5),
        (bangs > 0.2 * w) & (w >= 5),
        repeating(hashes, first) & (w >= 40),
        w == 0,
        (letters < 0.5 * n) & (n > 0),
        rude >= 1,
        rude >= 2,
        stemmed >= 1,
    ]
    return -np.stack(bad, axis=1).astype(int)


def _letters(column: pa.Array) -> pa.Array:
    """Texts with ASCII punctuation and digits as blanks, so that words come bare."""
    raw, offsets = bytes_of(column)
    keep = np.arange(256, dtype=np.uint8)
    keep[[c for c in range(33, 127) if not chr(c).isalpha()]] = 32
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(keep[raw])])


def spelled(rows: np.ndarray) -> list[str]:
    return ["".join("-0+"[v + 1] for v in r) for r in rows.tolist()]


def _patterns(stems: np.ndarray):
    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spelled(votes(batch.column("text"), stems)))], ["id", "pattern"])

    return run


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 60, prior: float = 0.9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of keep for patterns (rows of -1, 0, 1), each heuristic's chances of (reject, abstain, keep) on (bad, good) documents, and the share of good ones.

    The last column is the annotators'. A rejecting vote is a finding, an abstaining or keeping one the rule, so the start lets a bad document have one reject of any kind.
    """
    k = patterns.shape[1]
    one = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2).astype(float)
    one[:, -1, 1] = 0.0  # a document that no annotator saw says nothing; a heuristic that abstains does
    post = np.where((patterns == -1).any(axis=1), 0.05, 0.95)
    total, chance, share = counts.sum(), np.zeros((2, k, 3)), prior
    for _ in range(steps):
        for side, weight in enumerate((1 - post, post)):
            mass = np.einsum("p,pkv->kv", weight * counts, one) + 0.1
            chance[side] = mass / mass.sum(axis=1, keepdims=True)
        chance[1, :-1] = np.where(chance[1, :-1, :1] > MISFIRE, [[MISFIRE, 1 - 2 * MISFIRE, MISFIRE]], chance[1, :-1])
        share = float(np.clip((post * counts).sum() / max(total, 1), 0.02, 0.98))
        logs = np.einsum("pkv,skv->sp", one, np.log(chance)) + np.log([[1 - share], [share]])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        # counts alone can't tell a bad document that no voter is against from a good one
        post = np.where((patterns == -1).any(axis=1), post, np.maximum(post, prior))
    return post, chance, share


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (bare words and the last byte of every word) of all rows, and each row's first."""
    bare, at = word_hashes(_letters(column))
    full, to = word_hashes(column)
    a, b = np.diff(at), np.diff(to)
    ends = np.concatenate([[0], np.cumsum(a + b)])
    out = np.empty(ends[-1], np.int64)
    spot = np.arange(len(bare)) + np.repeat(ends[:-1] - at[:-1], a)
    out[spot] = (bare % U(FEATURES)).astype(np.int64)
    spot = np.arange(len(full)) + np.repeat(ends[:-1] + a - to[:-1], b)
    out[spot] = (mix(full ^ U(BASE)) % U(FEATURES)).astype(np.int64)
    return out, ends


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 8, rate: float = 0.5, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of hashed features, scaled by the root of their number and weighted so that both classes count alike, by AdaGrad."""
    w, b, grads, rng = np.zeros(FEATURES), 0.0, np.full(FEATURES, 1e-8), np.random.default_rng(4)
    share = float(np.clip(target.mean(), 0.05, 0.95)) if len(target) else 0.5
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            if not len(x):
                continue
            scale = len(x) ** -0.5
            p = 1 / (1 + np.exp(-np.clip(w[x].sum() * scale + b, -30, 30)))
            g = (p - target[i]) * (target[i] / share + (1 - target[i]) / (1 - share)) / 2
            step = g * scale + penalty * w[x]
            grads[x] += step * step
            w[x] -= rate * step / np.sqrt(grads[x])
            b -= 0.02 * g
    return w, b


def distinct_features(column: pa.Array) -> list[np.ndarray]:
    f, first = features(column)
    return [np.unique(f[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sampled(batches):
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(distinct_features(batch.column("text")), pa.list_(pa.int32()))], ["pattern", "features"])


class Model:
    """For each aspect the log odds of vote patterns and the scorer's weights and bias."""

    def __init__(self, odds: dict[str, dict[str, float]], chance: dict[str, np.ndarray], scorers: dict[str, tuple[np.ndarray, float]], stems: np.ndarray):
        self.stems = stems
        self.odds, self.chance, self.scorers = odds, chance, {k: (w.astype(np.float32), b) for k, (w, b) in scorers.items()}

    def judge(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Log odds for keeping each text, by aspect."""
        seen, rows, out = votes(column, self.stems), distinct_features(column), {}
        for aspect, of in ASPECTS.items():
            weights, bias = self.scorers[aspect]
            scored = np.array([float(weights[x].sum()) / len(x) ** 0.5 + bias if len(x) else 0.0 for x in rows], float)
            told = np.array([self.odds[aspect].get(p, 0.0) for p in spelled(seen[:, of[:-1]])], float)
            out[aspect] = told + np.where(told > 0, scored, np.minimum(scored, 0))
        return out


def fit(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", sample: int = TRAIN_ROWS) -> Model:
    """Votes are taken and counted over all of docs, by whole texts, however long; null and empty ones get the vote on empty texts, and repeated rows count as often as they come; labels (doc_id, quality, toxic) are votes of annotators: against documents of quality 0, and against toxic ones. Several labels of a document count as the worst of them; nulls abstain."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    stems = learned_stems(d, labels, base) if labels is not None else np.zeros(0, U)
    seen = d.mapInArrow(_patterns(stems), "id long, pattern string")
    said = lambda c, bad: F.when(F.count_if(F.col(c) == bad) > 0, "-").when(F.count(c) > 0, "+").otherwise("0")
    if labels is not None:
        told = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.concat(said("quality", 0), said("toxic", 1)).alias("v"))
        seen = seen.join(told, "id", "left").select("id", F.concat("pattern", F.coalesce("v", F.lit("00"))).alias("pattern"))
    else:
        seen = seen.withColumn("pattern", F.concat("pattern", F.lit("00")))
    seen = written(seen, f"{base}/seen")
    counted = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}
    odds, chances, scorers = {}, {}, {}
    for aspect, of in ASPECTS.items():
        by: dict[str, int] = {}
        for pattern, n in sorted(counted.items()):
            part = "".join(pattern[i] for i in of)
            by[part] = by.get(part, 0) + n
        rows = np.array([["-0+".index(c) - 1 for c in p] for p in by], int).reshape(-1, len(of))
        post, chance, share = expectation_maximisation(rows, np.array(list(by.values()), float))
        target = dict(zip(by, post.tolist(), strict=True))
        scorers[aspect] = _scorer(d, seen, {p: target["".join(p[i] for i in of)] for p in counted}, sample, f"{base}/{aspect}")
        # every pattern that documents show, with annotators abstaining
        known = sorted({p[:-1] for p in by})
        one = np.array([[[c == v for v in "-0+"] for c in p] for p in known], float).reshape(-1, len(of) - 1, 3)
        logs = np.einsum("pkv,skv->sp", one, np.log(np.maximum(chance[:, :-1], 1e-9))) + np.log([[1 - share], [share]])
        odds[aspect], chances[aspect] = dict(zip(known, np.clip(logs[1] - logs[0], -12, 12).tolist(), strict=True)), chance
    delete(spark, base)
    return Model(odds, chances, scorers, stems)


def _scorer(d: DataFrame, seen: DataFrame, target: dict[str, float], sample: int, place: str) -> tuple[np.ndarray, float]:
    """Trained on the documents with the least hashes, half of them such as the votes reject."""
    bad = [p for p, v in target.items() if v < 0.5]
    if not bad or len(bad) == len(target):
        return np.zeros(FEATURES), 0.0
    side, order = F.col("pattern").isin(bad), F.xxhash64("id")
    chosen = [written(seen.where(c).orderBy(order, "id").limit(sample // 2), f"{place}{i}") for i, c in enumerate((side, ~side))]
    picked = chosen[0].union(chosen[1]).dropDuplicates(["id"])
    taken = d.join(F.broadcast(picked), "id").select("pattern", "text").mapInArrow(_sampled, "pattern string, features array<int>").orderBy("pattern", F.xxhash64("features")).limit(2 * sample).toArrow()
    rows, aim = [np.asarray(x, np.int64) for x in taken["features"].to_numpy()], np.array([target[p] for p in taken["pattern"].to_pylist()])
    weights, bias = train(rows, aim)
    # where words don't tell good from bad, the scorer speaks against next to none of the good ones
    seen_good = [weights[x].sum() / max(1, len(x)) ** 0.5 + bias for x, t in zip(rows, aim, strict=True) if t > 0.5]
    return weights, bias + max(0.0, -float(np.quantile(seen_good, 0.002)))


def judged(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, junk_odds, toxic_odds, kept) of each row."""

    def run(batches):
        for batch in slices(batches, "text"):
            odds = model.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x) for x in odds.values()), pa.array(np.minimum(*odds.values()) > 0)], ["id", "junk_odds", "toxic_odds", "kept"])

    found = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, junk_odds double, toxic_odds double, kept boolean")
    return found.withColumnRenamed("id", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Texts that are null, empty or blank are judged by the vote on empty texts; repeated rows are judged alike; an empty table gives an empty one."""

    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(np.minimum(*model.judge(batch.column(text)).values()) > 0))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
