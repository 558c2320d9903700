"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, components, decontamination, fingerprints, lines, minhash, mixing, quality, repeats, sharding, textscan, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(30)]
    out = list(base)
    for t in base[:15]:  # near copies
        w = t.split()
        for i in rng.sample(range(len(w)), 2):
            w[i] = "edited"
        out.append(" ".join(w))
    out += base[:4] * 3 + ["", None, "one", "one two", "ONE  two\n", " \n ", "x " * 3000, " ".join(rng.choices(vocabulary, k=4000)), "Grüße 𝄞 an alle, die hier sind"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("key", F.lit(1)).cache()


def empty(docs):
    return docs.where("false")


# 1


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in range(len(sets))}
    assert minhash.near_duplicates(empty(docs), k, percent).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Copies of copies: a chain of texts that drift apart, in blocks so small that several are needed."""
    monkeypatch.setattr(minhash, "PAIRS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(5)
    w = [f"v{i}" for i in range(150)]
    made = []
    for i in range(60):
        w = list(w)
        w[rng.randrange(150)] = f"e{i}"
        made.append(" ".join(w))
    rng.shuffle(made)
    sets = [shingles(t, 3) for t in made]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = components.union(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: want.get(i, i) for i in range(60)}


def test_rows_with_equal_keys_and_null_keys(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "totally different words in here now"), (None, "a b c d e f"), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(-1, 0, -1), (-1, 4, 1), (1, 4, 1), (1, 4, 1), (1, 4, 1)]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = textscan.mix(np.arange(3000, dtype=np.uint64))
    for shared in (50, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        s = minhash.superminhash(np.concatenate([a, rng.permutation(b)]), np.array([0, 1000, 2000]))
        assert abs(np.mean(s[0] == s[1]) - shared / (2000 - shared)) < 0.08
    assert len(set(np.floor(minhash.superminhash(pool[:5], np.array([0, 5]))[0]))) > 20  # few shingles go on until every slot is filled
    assert minhash.bands_for(85)[0] * minhash.bands_for(85)[1] <= minhash.SLOTS


def test_components_of_a_long_path(spark):
    n = 300
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 5000)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 5000: 5000}
    assert components.components(path.where("false")).count() == 0


def test_few_links_make_few_files(spark, monkeypatch):
    """Files follow the number of links, not the number of shuffle partitions; links confirmed are written once."""
    files, places = [], Counter()

    def counted(df, place):
        out = write(df, place)
        files.append(len(out.inputFiles()))
        return out

    def noted(df, place):
        places[",".join(df.columns)] += 1
        return write(df, place)

    write = components.written
    monkeypatch.setattr(components, "written", counted)
    monkeypatch.setattr(minhash, "written", noted)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 600, 2)], "a long, b long").coalesce(1)
    assert components.components(links).count() == 600 and set(files) == {1}
    monkeypatch.setattr(components, "DEALT", 100)
    files.clear()
    assert components.components(links).count() == 600 and max(files) > 1
    words = [f"v{i}" for i in range(40)]
    made = [(i, " ".join([*words, f"e{i}"])) for i in range(3)]
    assert {r.component_id for r in minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85).collect()} == {0}
    assert places["a,b"] == 3  # stars, links, pairs


def test_long_patterned_words_differ(spark):
    """Byte strings on which sums of powers modulo 2^64 cancel, whatever the odd base."""
    rows = []
    for n in (10, 11, 12):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << n))
        rows += [(len(rows), one), (len(rows) + 1, one.translate(str.maketrans("ab", "ba")))]
    h, _ = textscan.word_hashes(pa.array([t for _, t in rows]))
    assert len(set(h.tolist())) == len(rows)
    assert len(set(textscan.word_hashes(pa.array(["ab" * n for n in range(1, 200)]))[0].tolist())) == 199
    if spark is not None:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert all(r.kept and r.component_id == r.doc_id for r in got)


def test_word_hashes_are_those_of_words(texts):
    h, first = textscan.word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    named = {}
    for i, t in enumerate(texts):
        for w, x in zip(words(t), h[first[i] : first[i + 1]].tolist(), strict=True):
            assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)
    assert [b - a for a, b in zip(*(lambda f: (f[:-1], f[1:]))(textscan.shingle_sets(pa.array(texts), 3)[1].tolist()), strict=True)] == [len(shingles(t, 3)) for t in texts]


# 2


def test_line_runs(spark):
    run = ["alpha beta gamma", "delta epsilon", "zeta eta theta"]
    long_line = " ".join(f"q{i}" for i in range(60))
    rows = [
        (1, "\n".join(["start here", *run, "", "end here"])),
        (2, "\n".join(["other", *(x.upper() for x in run), "more"])),
        (3, "alpha beta gamma\nsolo line"),  # a single short line that repeats stays
        (4, "own\n" + long_line),
        (5, long_line + "\nmine"),
        (6, "\n".join(run + ["between"] + run)),
        (7, ""), (8, None), (9, "\n\n"), (None, "\n".join(run)),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.without_repeated_lines(d).collect()}
    assert got[1] == (rows[0][1], 6, 0)
    assert got[2] == ("other\nmore", 5, 3)
    assert got[3][2] == 0 and got[4][2] == 0
    assert got[5] == ("mine", 2, 1)
    assert got[6] == ("between", 7, 6)
    assert got[7] == ("", 1, 0) and got[8] == (None, 1, 0) and got[9] == ("\n\n", 3, 0) and got[None][2] == 0
    assert lines.without_repeated_lines(d.where("false")).count() == 0


def brute_lines(rows):
    """Lines of rows (key, text), in order of key, that stand in a run which starts earlier too and has three lines or 50 words."""
    seen, out = set(), {}
    for k, t in rows:
        whole = t.split("\n") if t else [""]
        numbered = [(i, words(x.lower())) for i, x in enumerate(whole)]
        numbered = [(i, w) for i, w in numbered if w]
        gone, own = set(), []
        for n in (1, 2, 3):
            for p in range(len(numbered) - n + 1):
                run = tuple(tuple(w) for _, w in numbered[p : p + n])
                if n == 3 or sum(map(len, run)) >= 50:
                    own.append((p, n, run))
        for p, n, run in sorted(own):
            if run in seen:
                gone |= {i for i, _ in numbered[p : p + n]}
            seen.add(run)
        out[k] = "\n".join(x for i, x in enumerate(whole) if i not in gone)
    return out


@pytest.mark.parametrize("pool_size,seed", [(5, 1), (12, 2), (12, 3)])
def test_runs_that_occur_before_are_deleted(spark, pool_size, seed):
    rng = random.Random(seed)
    pool = [f"line {i} of the pool" for i in range(pool_size)] + [" ".join(f"x{j}" for j in range(i, i + 26)) for i in (1, 2)] + [" ".join(f"y{j}" for j in range(55)), "", "  "]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n".join(f"a long text's line {i}" for i in range(3000))), (63, "\n".join(f"A long  text's line {i}" for i in range(1000, 2000)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("hashes", F.lit(1)).repartition(3)
    found = lines.without_repeated_lines(d.union(d.where("doc_id IN (3, 7, 60, 63)"))).collect()
    assert {(r.doc_id, r.text or "") for r in found} == set(brute_lines(rows).items()) and len(found) == len(rows) + 4
    assert found[0].doc == "clash" and len(found[0]) == 6


def test_a_longer_match_with_a_later_place(spark):
    """Whatever line hashes say: a run of four is found although its middle stands in an earlier document."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    rows = []
    for i in range(40):
        x, y, z, w = (word() for _ in range(4))
        rows += [(i, f"{word()}\n{y}\n{z}\n{word()}"), (100 + i, f"{x}\n{y}\n{z}\n{w}"), (200 + i, f"{word()}\n{x}\n{y}\n{z}\n{w}\n{word()}")]
    got = {r.doc_id: r.n_removed for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 4 if k >= 200 else 0 for k, _ in rows}


def test_lines_of_keys_that_repeat(spark):
    text = "\n".join(f"line {i}" for i in range(6))
    rows = [(1, text), (1, text), (1, "other\n" + text), (2, "one\ntwo\nthree"), (None, text), (None, None)]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # one of the two texts of key 1 keeps its lines, in all its rows
    assert got in ([(0, 1, 0), (0, 6, 0), (1, 6, 0), (1, 6, 0), (1, 7, 6), (2, 3, 0)], [(0, 1, 0), (0, 6, 0), (1, 6, 6), (1, 6, 6), (1, 7, 0), (2, 3, 0)])


def test_passages_on_two_lines_are_deleted(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(a), line(50 - a)] for a in rng.choices(range(1, 50), k=60)]
    short = [[line(20), line(29)] for _ in range(3)]
    around = lambda p: "\n".join([line(9), line(9), *p, line(9), line(9)])
    rows = [(i, around(p)) for i, p in enumerate(2 * passages)] + [(200 + i, around(p)) for i, p in enumerate(short)]
    got = {r.doc_id: r.n_removed for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(120)] == [0] * 60 + [2] * 60 and not any(got[200 + i] for i in range(3))


# 3


def test_contained_items(spark):
    rng = random.Random(4)
    v = [f"t{i}" for i in range(300)]
    items = [" ".join(rng.choices(v, k=n)) for n in (3, 6, 12, 30, 59)] + ["", None]
    filler = lambda n: " ".join(rng.choices(v, k=n))
    texts = [filler(3000) + " " + it + " " + filler(2000) for it in items if it] + [items[3].upper(), " ".join(items[4].split()[:50]), " ".join(items[4].split()[:30]), items[0], "", None, filler(50)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("h", F.lit(2))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            s, q = shingles(t, 5), shingles(it, 5)
            if q and 100 * len(s & q) >= 80 * len(q):
                want.add((i, j, len(q), len(s & q)))
    assert {tuple(r) for r in decontamination.contained_items(d, b).collect()} == want and len(want) >= 6
    keys = [None, 1, 1, 2]
    t = spark.createDataFrame([(k, x) for k, x in zip(keys, ["a b c d e f g h", "a b c d", "e f g h i", "a b c d e f g h " * 3000], strict=True)], "doc_id long, text string")
    i = spark.createDataFrame([(None, "A B C D E F G"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "b c d e f g h")], "item_id long, text string")
    found = sorted(((r.doc_id or 0), (r.item_id or 0), r.n_item, r.n_shared) for r in decontamination.contained_items(t.union(t), i).collect())
    assert found == [(k, j, 3, 3) for k in (0, 2) for j in (0, 7, 8)]
    assert decontamination.contained_items(d.where("false"), b).count() == 0 and decontamination.contained_items(d, b.where("false")).count() == 0


# 4


def test_quality(spark):
    rng = random.Random(6)
    v = ["the", "river", "runs", "under", "bridge", "stone", "light", "morning", "people", "walk", "slowly", "home", "again", "before", "winter", "comes"]
    good = [" ".join(rng.choices(v, k=60)) + "." for _ in range(200)]
    junk = [" ".join(w + "***" for w in rng.choices(v, k=40)) for _ in range(30)] + [" ".join(rng.choices(v, k=40)).upper() for _ in range(20)]
    toxic = [" ".join(rng.choices(v, k=40) + rng.choices(quality.INSULTS.split(), k=3)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(good + junk + toxic + ["", None])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pattern", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(20)] + [(250 + i, 1, 1) for i in range(8)] + [(None, None, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, None):
        got = {r.doc_id: r.kept for r in quality.judged(d, quality.fit(d, given)).collect()}
        assert sum(got[i] for i in range(200)) == 200 and not any(got[i] for i in range(250, 270)) and sum(got[i] for i in range(200, 250)) <= 2
    kept = quality.keep_good(d, quality.fit(d, labels))
    assert kept.columns == d.columns and kept.count() == sum(got.values())
    assert quality.keep_good(d.where("false"), quality.fit(d.where("false"), labels.where("false"))).count() == 0


def test_repetition_is_seen_at_every_length(spark):
    rng = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (i + 10) for i in range(3000)], k=n))
    good = [text(60) for _ in range(100)] + [text(n) for n in (1999, 2000, 3000, 30_000)]
    passage = text(1500)
    junk = ["spam " * n for n in (100, 1999, 2000, 3000, 20_000)] + ["buy it now " * 1500, text(900) + " spam" * 2100, " ".join([passage] * 12)]
    seen = quality.votes(pa.array(good + junk), np.zeros(0, np.uint64))[:, quality.HEURISTICS.index("repeating")]
    assert len(set(good[-1].split())) < 0.25 * 30_000
    assert seen.tolist() == [0] * len(good) + [-1] * len(junk)
    d = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.judged(d, quality.fit(d)).where("kept").collect()}
    assert kept == set(range(len(good)))


def test_insults_outside_one_table_and_mild_words_once(spark):
    rng = random.Random(9)
    v = ["the", "river", "runs", "under", "bridge", "stone", "light", "morning", "people", "walk", "slowly", "home", "again", "before", "winter", "comes"]
    text = lambda *more: " ".join([*rng.choices(v, k=20), *more, *rng.choices(v, k=20)])
    clean = [text() for _ in range(200)] + [text(w) for w in ("trash", "clown", "Trash.", "stupid", "Müll", "basura")] + [text("trash", "trash"), text("trash", *rng.choices(v, k=30), "clown")]
    toxic = [text(*w) for w in (("asshole",), ("wankers!", "bastard"), ("Arschloch",), ("Vollidiot", "Abschaum"), ("connard",), ("enfoiré", "salaud"), ("gilipollas",), ("Pendejo",), ("stronzo",), ("trash", "clown"), ("pathetic", "loser", "worthless"))]
    d = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.judged(d, quality.fit(d)).where("kept").collect()}
    assert kept == set(range(len(clean)))


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < 0.2
    fire = np.stack([np.where(bad, rng.random(20_000) < p, rng.random(20_000) < q) for p, q in ((0.8, 0.002), (0.6, 0.001), (0.7, 0.002))], axis=1)
    patterns, counts = np.unique(-fire.astype(int), axis=0, return_counts=True)
    patterns = np.column_stack([patterns, np.zeros(len(patterns), int)])  # no annotators
    _, chance, share = quality.expectation_maximisation(patterns, counts.astype(float))
    chance = chance[:, :3]
    assert abs(share - 0.8) < 0.03 and np.allclose(chance[0, :, 0], (0.8, 0.6, 0.7), atol=0.06) and np.allclose(chance[1, :, 0], (0.002, 0.001, 0.002), atol=0.002)


# 5


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives(spark, tmp_path):
    big, small = "<p>" + "ü" * 60 + "</p>", "<p>s</p>"
    rows = [(5, "http://B.example.com:80/x?q=1", big), (2, "https://a.example.com/", big), (9, None, big), (1, "http://a.example.com/p q\r\nX: y", small), (3, "http://a.example.com/", small), (4, "http://a.example.com/", None), (None, "http://z.example.org/", big), (7, "http://[bad", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    place = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, place).cache()
    got = {r.page_id: r for r in warc.read_archives(spark, place, index).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), None: ("revisit", 2)} | {i: ("response", None) for i in (1, 3, 4, 7)}
    keys = [(r.url_key, r.timestamp) for r in index.collect()]
    assert keys == sorted(keys) and ("com,example,b)/x?q=1", "20200101000005") in keys
    none = warc.write_archives(pages.where("false"), f"file://{tmp_path}/v")
    assert none.count() == 0 and warc.read_archives(spark, f"file://{tmp_path}/v", none).count() == 0


# 6


def test_shards_follow_the_mixture(docs, spark):
    many = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 5) END AS source", "'x' AS slot")
    got = sharding.proportional_shards(many, 8, bucket_rows=50).toPandas()
    assert len(got) == 1000 and set(got.shard) == set(range(8))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    table = got.groupby(["source", "shard"], dropna=False).size().unstack(fill_value=0)
    assert (table.max(axis=1) - table.min(axis=1)).max() <= 2
    again = sharding.proportional_shards(many.repartition(5), 8, bucket_rows=50).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    out = sharding.proportional_shards(docs.union(docs), 3)
    assert out.count() == 2 * docs.count() and out.columns[-2:] == ["shard", "slot"]
    assert sharding.proportional_shards(empty(docs), 3).count() == 0


# 7


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for k, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[k] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(covered))), kept)
    return out


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "SORTED", 500)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(8)
    chars = "abcdefgh \nüß\0"
    unit = lambda n: "".join(rng.choices(chars, k=n))
    a, b, c = unit(400), unit(150), unit(90)
    texts = [a, unit(50) + a + unit(30), b + unit(20) + b, a[:250] + c + a[250:], "z" * 700, "ab" * 300, c, c + c, "", None, unit(99), a[37:200] + b[10:140] + a[100:330], "z" * 100, a]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(d).collect()}
    assert got == brute_repeats(rows)
    assert repeats.without_repeats(d.where("false")).count() == 0
    null = spark.createDataFrame([(None, a), (1, a), (2, a)], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.without_repeats(null).collect()) == [0, 0, len(a.encode())]


def test_longest_previous_factors():
    rng = random.Random(10)
    for n, letters in ((130, "a"), (400, "ab"), (600, "abcd"), (101, "xyz"), (700, "aaab")):
        raw = np.frombuffer("".join(rng.choices(letters, k=n)).encode(), np.uint8)
        raw = np.concatenate([raw, raw[: n // 2]])
        at = np.arange(len(raw) - repeats.LENGTH + 1)
        b = raw.tobytes()
        head = [b[i : i + repeats.LENGTH] for i in at]
        shared = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), repeats.LENGTH)
        order, common = repeats.suffix_order(raw, at)
        assert [head[i] for i in order] == sorted(head)
        assert common.tolist() == [0, *(shared(head[i], head[j]) for i, j in zip(order, order[1:], strict=False))]
        want = [max((shared(head[i], head[j]) for j in range(i)), default=0) for i in at]
        assert repeats.previous_factors(order, common, at).tolist() == want
        assert repeats.earlier(raw, at).tolist() == [w >= repeats.LENGTH for w in want]


def test_repeats_in_rows_that_repeat(spark):
    rng = random.Random(11)
    a, b = ("".join(rng.choices("abcdefgh", k=300)) for _ in "ab")
    result = lambda rows: sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert result([(1, a), (1, a)]) == [(1, 300, 0), (1, 300, 0)]
    assert result([(1, a), (1, a), (2, a + "Q"), (2, a + "Q")]) == [(1, 300, 0), (1, 300, 0), (2, 301, 300), (2, 301, 300)]
    got = result([(1, a + b), (1, a), (1, b), (0, "x" * 50)])  # texts of one key come one after the other: just one keeps each half
    assert sum(n - removed for _, n, removed in got) == 650


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 50)
    monkeypatch.setattr(repeats, "SORTED", 3000)
    rng = random.Random(12)
    common = "".join(rng.choices("abcdefgh", k=110))
    rows = [(i, "".join(rng.choices("ijklmnop", k=90)) + common + "".join(rng.choices("ijklmnop", k=90))) for i in range(1500)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_repeats(rows)


def test_a_crowd_costs_little_more_than_its_texts():
    rng = random.Random(13)
    common = "".join(rng.choices("abcdefgh", k=60))
    rows = [(i, "".join(rng.choices("ijklmnop", k=90)) + common + "".join(rng.choices("ijklmnop", k=90))) for i in range(40)]
    d = pa.RecordBatch.from_pydict({"doc": [i for i, _ in rows], "text": [t for _, t in rows]})
    found = [r for b in repeats._found([d]) for r in b.to_pylist()]
    items = [[{"h": r["h"], "at": r["at"], "span": r["span"], "crowd": True} for r in found if r["doc"] == i] for i, _ in rows]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("span", pa.int32()), ("crowd", pa.bool_())]))
    sent = pa.Table.from_batches(repeats._contexts([d.append_column("items", pa.array(items, kind))]))
    lengths = pa.compute.binary_length(sent["data"]).to_pylist()
    assert sum(n - repeats.LENGTH + 1 for n in lengths) == sum(len(t) - repeats.LENGTH + 1 for _, t in rows)  # every string, once
    assert sum(lengths) < 10 * sum(len(t) for _, t in rows)  # 59 times, if each string came by itself


def test_suffix_order_of_strings_apart(monkeypatch):
    rng = random.Random(14)
    head = ["".join(rng.choices("ab", k=repeats.LENGTH)).encode() for _ in range(150)]
    head += [h[:n] + bytes(reversed(h[n:])) for h in head[:50] for n in (3, 40, 64, 90)] + head[:20]
    raw, at = np.frombuffer(b"".join(head), np.uint8), np.arange(len(head)) * repeats.LENGTH
    ranked, plain = [], repeats.dense
    monkeypatch.setattr(repeats, "dense", lambda keys: ranked.append(len(keys)) or plain(keys))
    order, common = repeats.suffix_order(raw, at)
    assert [head[i] for i in order] == sorted(head)
    shared = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), repeats.LENGTH)
    assert common.tolist() == [0, *(shared(head[i], head[j]) for i, j in zip(order, order[1:], strict=False))]
    assert sum(ranked) < len(raw) / 2  # not every byte's rank at every width


def test_texts_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 1024)
    rng = random.Random(9)
    a = "".join(rng.choices("abcdef", k=3000))
    rows = [(0, a), (1, a[500:2500] + "Q" * 10 + a[:700])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


# 8


def naive_walk(text, seed):
    out, i = [], 0
    for j in range(fingerprints.STEPS * len(text)):
        c = 0 if i >= len(text) else (ord(text[i]) * 2654435761 % 2**32 >> 11) % 255 + 1
        out.append(c)
        i += int(fingerprints.moves(seed, j // fingerprints.PERIOD)[j % fingerprints.PERIOD, c])
    return out


def test_walks_and_samples():
    fp = fingerprints.Fingerprints()
    texts = ["", "a", "hello world", "x" * 500, "Grüße 𝄞 " * 40, "abc" * 1500]
    for t, shown in zip(texts, fp.shown(texts), strict=True):
        w, at = naive_walk(t, fp.seed), np.array(fp.positions.at)[fp.sample(len(t))]
        assert list(shown) == [w[p] for p in at] and len(at) == min(fingerprints.SAMPLE, 3 * len(t))


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, 5).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[45].fingerprint == got[0].fingerprint
    assert np.mean([got[i].near_edited for i in range(30)]) > np.mean([got[i].near_next for i in range(14)]) + 0.2
    assert fingerprints.fingerprints(empty(docs), 5).count() == 0


def test_fingerprints_of_odd_keys(spark):
    d = spark.createDataFrame([(None, "null key"), (3, "b"), (3, "a"), (2**62, "far"), (-5, None)], "doc_id long, text string")
    assert sorted(r.n_chars for r in fingerprints.fingerprints(d, 3).collect()) == [0, 1, 1, 3, 8]
    one = fingerprints.fingerprints(d.where("text = 'far'"), 4).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_edit_distance_and_near_texts(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(7)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert fingerprints.distance(a, b) == plain(a, b)
    base = "".join(rng.choices("abcdefghij ", k=300))
    near = base[:100] + "!" + base[100:180] + base[182:]
    rows = [(1, base), (2, near), (3, "".join(rng.choices("klmnop", k=300))), (4, base), (5, ""), (6, None)]
    got = {r.doc_id: r.component_id for r in fingerprints.near_by_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


@pytest.mark.parametrize("size,block", [(30, 512), (120, 512), (360, 16)])
def test_near_texts_are_found_at_every_corpus_size(spark, monkeypatch, size, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(size)
    start = "this notice stands at the head of every text, "
    texts = [start + "".join(rng.choices("etaoinshrdlu ", k=rng.randint(60, 100))) for _ in range(size // 2)]
    for t in texts[: size - size // 2]:
        c = list(t)
        for _ in range(rng.randint(1, len(t) // 11)):
            i = rng.randrange(len(c))
            c[i : i + rng.randint(0, 1)] = rng.choices("etaoinshrdlu ", k=rng.randint(0, 1))
        texts.append("".join(c))
    near = lambda a, b: 10 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 10 * fingerprints.distance(a, b) <= max(len(a), len(b))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near(texts[i], texts[j])]
    of = components.union(*np.array(links).T)
    got = {r.doc_id: r.component_id for r in fingerprints.near_by_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(links) >= size // 2 - 1 and got == {i: of.get(i, i) for i in range(len(texts))}


# 9


def test_targets():
    got = mixing.targets([("b", 10), (None, 1000), ("a", 100)])
    assert got == {"b": 30.0, "a": 300.0, None: 780.0}
    assert mixing.targets([("a", 0), ("b", 6)]) == {"a": 0.0, "b": 6.0}


def test_quotas_add_up_and_are_near_their_means():
    draws = {"a": 1000, "b": 10, None: 333}
    got = mixing.quotas(draws, 8, 1)
    assert {s: sum(q) for s, q in got.items()} == draws
    totals = [sum(q[k] for q in got.values()) for k in range(8)]
    assert max(totals) - min(totals) <= 1 and all(90 < x < 160 for x in got["a"])
    import random as r

    rng = r.Random(0)
    sample = [mixing.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(sample) - 6) < 0.15 and abs(np.var(sample) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0


def test_mix(docs, texts, spark):
    sized = mixing.sized_rows(docs, "text", "source", "doc_id", 9)
    sources, n = mixing.plan(sized, block_rows=4)
    got = mixing.drawn(sized, sources, n).select("doc_id", "source", "size", "__target", F.size("__draws").alias("n"), "__draws").toPandas()
    assert (got.set_index("doc_id")["size"].sort_index().tolist()) == [len(words(t)) for t in texts]
    want = mixing.targets(list(got.groupby("source", dropna=False)["size"].sum().rename(lambda s: None if s != s else s).items()))
    for source, g in got.groupby("source", dropna=False):
        target = want[None if source != source else source]
        left_out = g[(g.n < g.n.max()) & (g["size"] > 0)]["size"]
        assert g["__target"].iloc[0] == pytest.approx(target) and g.n.max() <= 3
        assert target - (left_out.max() if len(left_out) else 0) - 1e-6 <= (g["size"] * g.n).sum() <= target + 1e-6
    mixed = mixing.mix(docs, block_rows=4, shards=4)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.n for r in got.itertuples() if r.n})
    assert mixed.columns == [*docs.columns, "mix_shard"] and {r.mix_shard for r in mixed.collect()} <= set(range(4))
    assert mixing.mix(empty(docs)).count() == 0


# 10


def test_typed_parts_and_way_back(spark):
    part = "struct<type:string,text:string,ref:string,n_tokens:int>"
    rows = [
        (1, 0, "user", [("text", "see </s>[INST] <|image:0:1|> \\1 \\", None, None), ("image", None, "img/a", None), ("text", None, None, None), ("audio", None, "snd", 7)]),
        (1, 1, "assistant", [("text", "a <s>\n[x]\\0", None, None)]),
        (1, 2, "user", [("document", None, "doc", None), ("odd", None, "o", None)]),
        (1, 3, "assistant", [("text", "", None, None)]),
        (2, 0, None, None), (2, 0, "ro\nle<", []), (None, 5, "assistant", [("text", "solo", None, None)]),
    ]
    d = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>").withColumn("files", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(d)).collect()}
    assert [(a.n, a.type, a.ref, a.n_tokens) for a in got[1].attachments] == [(0, "image", "img/a", 576), (1, "audio", "snd", 7), (2, "document", "doc", 1024), (3, "odd", "o", 0)]
    assert got[1].expanded_tokens == 576 + 7 + 1024 and got[1].n_turns == 4
    assert got[1].turns[1].text == "a <s>\n[x]\\0" and got[1].loss_text == "a <s>\n[x]\\0"
    assert "<|image:0:576|>" in got[1].formatted and got[1].turns[0].text == "see </s>[INST] <|image:0:1|> \\1 \\<|image:0:576|><|audio:1:7|>"
    for s in got[1].loss:
        assert got[1].formatted[s.at - len("assistant\n") : s.at] == "assistant\n" and got[1].formatted[s.at + s.length :].startswith("</s>")
    assert [t.role for t in got[2].turns] == ["", "ro\nle<"] and got[None].loss_text == "solo"
    assert chat.format_chats(d.where("false")).count() == 0


def test_plain_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices("ab<>[]\\/sINT\n|0123é𝄞", k=rng.randint(0, 40)))) for c in range(20) for t in range(5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_chats(d.withColumn("parts", chat.text_parts(F.col("text"))))).collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in mine]
        assert r.loss_text == "".join(x[3] for x in mine if x[2] == "assistant")


def test_mixture_is_counted_in_its_shards(spark, tmp_path):
    rows = [(1, "a", "x y z")] * 5 + [(None, "a", "p q"), (2, "b", None), (3, "b", "w w w w"), (3, "b", "other")] + [(i, "a", f"word {i}") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_shard", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sized = mixing.sized_rows(docs, "text", "source", "doc_id", mixing.SEED)
    planned = mixing.drawn(sized, *mixing.plan(sized)).select("doc_id", "size", (F.col("size") * F.size("__draws")).alias("taken"))
    got = mixing.op9(spark, str(tmp_path)).select("doc_id", "size", "taken")
    assert sorted(map(str, got.collect())) == sorted(map(str, planned.collect()))
    empty(docs).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert mixing.op9(spark, f"{tmp_path}/none").count() == 0
