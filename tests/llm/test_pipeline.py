"""The corpus pipeline's stages against brute force on a small corpus."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from gridloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, place = random.Random(1), tmp_path_factory.mktemp("sf")
    v = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(v, k=n))
    items = [text(20), text(45)]
    texts = [text(rng.randint(20, 200)) for _ in range(80)]
    texts += [t + " tail" for t in texts[:10]] + texts[10:14] + [text(50) + " " + items[0] + " " + text(60), items[1].upper()]
    texts += [" ".join(w + "***" for w in text(40).split()) for _ in range(6)] + [text(30) + " idiot moron scum" for _ in range(4)] + [None, ""]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(96, 0, 0), (97, 0, 0), (102, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place), {r[0]: r for r in rows}, items


def test_stages(spark, corpus):
    place, rows, items = corpus
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{place}/documents.parquet")
    good = stage["quality"](spark, docs, place).cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and set(range(96)) <= kept and not kept & set(range(96, 106))

    sets = {i: shingles(rows[i][1]) for i in kept}
    group = {i: i for i in kept}
    for _ in range(3):
        for i in sorted(kept):
            for j in sorted(kept):
                n = len(sets[i] & sets[j])
                if i < j and n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    group[i] = group[j] = min(group[i], group[j])
    single = stage["near_dedup"](spark, good, place).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in kept if group[i] == i)

    clean = stage["decontamination"](spark, single, place).cache()
    holds = lambda i: any(100 * len(shingles(rows[i][1]) & shingles(t)) >= 80 * len(shingles(t)) for t in items)
    left = {r.doc_id for r in clean.collect()}
    assert left == {r.doc_id for r in single.collect() if not holds(r.doc_id)} and 94 not in left and 95 not in left

    mixed = stage["mixing"](spark, clean, place).cache()
    taken = Counter(r.doc_id for r in mixed.collect())
    size = lambda i: len(WORD.findall(rows[i][1] or ""))
    by = Counter()
    for i in left:
        by[rows[i][3]] += size(i)
    for source, target in mixing.targets(list(by.items())).items():
        mine = [i for i in left if rows[i][3] == source]
        assert abs(sum(size(i) * taken[i] for i in mine) - target) <= max(map(size, mine)) and max(taken[i] for i in mine) <= 3
    assert mixed.columns == docs.columns and set(taken) <= left

    shards = stage["sharding"](spark, mixed, place).collect()
    assert Counter(r.doc_id for r in shards) == taken
    sizes = Counter(r.shard for r in shards)
    assert max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1
    assert all(sorted(r.slot for r in shards if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_run_is_the_stages_in_turn(spark, corpus):
    place, rows, _ = corpus
    out = corpus_pipeline.run(spark, place)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    assert all(r.text == rows[r.doc_id][1] for r in out.collect())
    again = corpus_pipeline.run(spark, place)
    key = lambda r: (r.shard, r.slot, r.doc_id)
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))


def test_empty_corpus(spark, corpus):
    place, _, _ = corpus
    docs = spark.read.parquet(f"{place}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, place).count() == 0
