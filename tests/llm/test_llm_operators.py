"""The operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats."""

import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusops.contracts import DatasetError
from corpusops.llm import (
    decontamination,
    language,
    licenses,
    links,
    mixture,
    near_duplicates,
    neighbours,
    repeats,
    sharding,
    toxicity,
)

# Extra columns named like what the operators add.
CLASHING = "n_words long, size int, key string, shard int, contamination string, language string, toxicity int, row int, draws int, block long"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASHING}"
EXTRA = (1, 2, "k", 3, "c", "l", 4, 5, 6, 7)
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    near = []
    for b in base[:8]:
        words = b.split()
        for k in (1, 3):
            other = words[:]
            for _ in range(k):
                other[rng.randrange(len(other))] = "changed"
            near.append(" ".join(other))
    odd = [None, "", " \t\n ", "one", "one two", "ONE two", "é ü", "123 !!", "\x00\x01", prose(rng, 30_000), "a" * 3_000]
    return base + near + odd + base[:3] + [base[0]] * 5


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["b", "a", None, "b", ""][i % 5], *EXTRA) for i, t in enumerate(texts)]
    rows.append((None, "no id here", None, None, *EXTRA))
    rows.append((3, texts[3], None, "a", *EXTRA))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def groups(sets, percent=80):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_brute_force(docs, texts, size):
    found = near_duplicates.near_duplicates(docs, size=size).collect()
    expected = groups({i: shingles(t, size) for i, t in enumerate(texts)})
    assert len(found) == len(texts) + 2
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]], size))
        assert r["component_id"] == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("large", [32, 1])
def test_bucket_mates_of_other_components_are_compared(spark, monkeypatch, large):
    """A chain whose links the smallest member of a bucket does not see."""
    monkeypatch.setattr(near_duplicates, "LARGE_BUCKET", large)
    words = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 80])) for i in range(10)]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert found == groups({i: shingles(t, 4) for i, t in rows})
    assert set(found.values()) == {0}


@pytest.mark.parametrize("block", [16])
def test_large_group_around_the_threshold(spark, monkeypatch, block):
    """Hundreds of copies of one text with few to many changes: links between outliers are found, in blocks."""
    monkeypatch.setattr(near_duplicates, "BLOCK_SETS", block)
    monkeypatch.setattr(near_duplicates, "SLICE", 64)
    rng = random.Random(12)
    base, rows = prose(rng, 140).split(), []
    for i in range(300):
        words = base[:]
        for _ in range(rng.randint(1, 14)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    # Twins of outliers, with a link to each other only.
    rows += [(1_000 + i, t + " tail") for i, t in rows[::10]]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=4).collect()}
    expected = groups({i: shingles(t, 4) for i, t in rows})
    assert found == expected
    assert 10 < len(set(expected.values())) < 250


def test_super_minhash_estimates_and_stops():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        elements = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = elements[:240], elements[60:]
        same = (near_duplicates.super_minhash(a, 240) == near_duplicates.super_minhash(b, 240)).mean()
        errors.append(same - 180 / 300)
    assert abs(np.mean(errors)) < 0.02
    # Every register is filled even by one element, and a permutation visits each once.
    one = near_duplicates.super_minhash(np.array([5], np.uint64), 16)
    assert sorted(one >> np.uint64(48)) == list(range(16))


def test_components_of_a_long_chain(spark):
    links_ = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in near_duplicates.components(links_).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_labels_are_merged(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, component long")
    links_ = spark.createDataFrame([(2, 6), (8, 9), (6, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in near_duplicates.merged_labels(labels, links_).collect()}
    assert found == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8}


def test_links_of_every_text_of_an_id_count(spark):
    rng = random.Random(5)
    one, two = prose(rng, 80), prose(rng, 80)
    rows = [(1, one), (2, one), (2, two), (3, two + " end"), (4, prose(rng, 80)), (None, two)] + [(5, one + " more")] * 3
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [
        (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), *[(5, 1, False)] * 3,
    ]


def test_near_duplicates_of_nothing(none):
    assert near_duplicates.near_duplicates(none).count() == 0


def contamination(texts, items, window=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    windows = {}
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    for t in texts:
        w = split(t)
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])] - {None}
        out.append((len(w), len(hit), sorted(map(str, names))))
    return out


@pytest.mark.parametrize("block_windows", [200_000, 7])
def test_decontamination_equals_brute_force(spark, docs, texts, block_windows):
    words = texts[0].split()
    items = [
        (1, " ".join(words[5:40])),
        (22, texts[1].upper()),
        (3, "one two"),
        (4, "one"),
        (None, " ".join(texts[2].split()[:12])),
        (6, None),
        (7, "..."),
        (8, "never seen words at all in any of these documents here now"),
        (1, " ".join(words[5:40])),
        (9, "w1 w1 w1"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(docs, benchmark, block_windows=block_windows)
    assert [c for c in found.columns if c != "contamination"] == [c for c in docs.columns if c != "contamination"]
    rows = found.select(
        "doc_id", "text", "contamination.n_words", decontamination.hit_words().alias("hit"), "contamination.items"
    ).collect()
    assert len(rows) == len(texts) + 2
    expected = contamination([r["text"] for r in rows], items)
    assert [(r["n_words"], r["hit"], r["items"]) for r in rows] == expected
    assert any(e[1] for e in expected)


def test_decontamination_without_items_or_documents(spark, docs, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.find_contamination(docs, nothing).select("contamination.*", decontamination.contaminated().alias("c"))
    assert not any(r["c"] or r["items"] for r in found.collect())
    assert decontamination.find_contamination(none, nothing).count() == 0


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most_blocks", [4_000, 2])
def test_repeats_equal_brute_force(docs, monkeypatch, most_blocks):
    monkeypatch.setattr(repeats, "MOST_BLOCKS", most_blocks)
    monkeypatch.setattr(repeats, "BATCH_SUFFIXES", 500)
    short = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 50_000)
    source = [(r["doc_id"], r["text"]) for r in short.select("doc_id", "text").collect()]
    expected = sorted(map(repr, zip([i for i, _ in source], brute_repeats([t for _, t in source], 200))))
    found = repeats.find_repeats(short).collect()
    got = sorted(repr((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))) for r in found)
    assert got == expected
    assert sum(r["n_removed"] for r in found) > 0
    assert all(sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_removed"] for r in found)


def test_repeats_of_shifted_passages_and_runs(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(i, "".join(rng.choice("ijklm") for _ in range(17 * i)) + passage[i : 400 - i] + "xyz"[i % 3] * 9) for i in range(12)]
    rows += [(50, "ab" * 700), (51, "z" * 900), (52, "é" * 150), (53, "é" * 99), (54, None)]
    found = {r["doc_id"]: r for r in repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), want in zip(rows, brute_repeats([t for _, t in rows], 200)):
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == want


def test_repeats_across_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcd") for _ in range(2_000))
    cutter = repeats.Anchors(200)
    covered = [(int(f), int(n)) for _, first, count in cutter.blocks(text) for f, n in zip(first, count)]
    assert sorted(x for f, n in covered for x in range(f, f + n)) == list(range(1_801))


def test_suffix_levels_grow_geometrically():
    rng = random.Random(9)
    index = repeats.SuffixLevels(8)
    blocks = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(30)]
    for b in blocks:
        index.add([b], np.arange(40) <= 32)
    sizes = [len(level) for level in index.levels]
    assert sum(sizes) == 30 * 33 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    for level in index.levels:
        assert [index.suffix(p) for p in level] == sorted(index.suffix(p) for p in level)
    count = {}
    places = [i for k in range(30) for i in range(40 * k, 40 * k + 33)]
    for p in places:
        count[index.suffix(p)] = count.get(index.suffix(p), 0) + 1
    assert [bool(index.repeated[p]) for p in places] == [count[index.suffix(p)] > 1 for p in places]


def test_repeats_of_nothing(none):
    assert repeats.find_repeats(none).count() == 0


def test_shards_are_even_and_hold_the_mixture(docs, none, texts):
    rows = sharding.stratified_shards(docs, 4).collect()
    assert len(rows) == len(texts) + 2
    sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for source in {r["source"] for r in rows}:
        each = [sum(r["shard"] == s and r["source"] == source for r in rows) for s in range(4)]
        assert max(each) - min(each) <= 2
    for r in rows:
        text = "no id here" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
    assert sharding.stratified_shards(none, 4).count() == 0
    assert {r["shard"] for r in sharding.stratified_shards(docs.limit(2), 16).collect()} <= set(range(16))


def test_shards_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    table = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source")
    )
    rows = sharding.stratified_shards(table, 7).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 3_000
    for source in {r["source"] for r in rows}:
        each = [sum(r["shard"] == s and r["source"] == source for r in rows) for s in range(7)]
        assert max(each) - min(each) <= 1


def test_shard_plan_has_no_python(docs):
    plan = sharding.stratified_shards(docs, 4)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_water_fill_reshares_what_full_sources_leave():
    targets = mixture.water_fill([10, 100, 1_000], [3, 1, 2], 3, 2, 2)
    assert [t.value for t in targets[:1]] == [20]
    assert sum(t.value for t in targets) == pytest.approx(1_665)
    assert all(t.value <= 2 * t.words for t in targets)
    assert [t.value for t in mixture.water_fill([0, 0], [3, 1], 3, 2, 2)] == [0, 0]


def test_split_quota_is_exact():
    quota = np.array([5, 0, 1_000, 37])
    dealt = mixture.split_quota(quota, 16, np.random.default_rng(1))
    assert dealt.sum(axis=0).tolist() == quota.tolist()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 4


def test_mixture_meets_targets_and_reruns_agree(spark, docs, none, texts):
    rows = mixture.mix_sources(docs, n_shards=4).collect()
    assert len(rows) == len(texts) + 2
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for r in rows:
        assert r["size"] == count("no id here" if r["doc_id"] is None else texts[r["doc_id"]])
        assert len(r["draws"]) <= 2 and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        taken = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 0])
        taken[0] += r["size"] * len(r["draws"])
        taken[1] += r["size"]
        taken[4] = max(taken[4], r["size"])
    for taken, size, target, source_size, largest in by_source.values():
        assert size == source_size and target <= 2 * size
        assert abs(taken - target) <= largest / 2
    assert sum(x[2] for x in by_source.values()) == pytest.approx(1.5 * sum(x[1] for x in by_source.values()))
    again = mixture.mix_sources(docs.repartition(7), n_shards=4).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixture.mix_sources(none).count() == 0
    kept = mixture.mix_sources(docs, n_shards=4, keep=True)
    assert kept.select("row.*").columns == docs.columns


def test_mixture_of_equal_rows_meets_targets(spark):
    """A third of all rows are copies of one; another class has a copy under a second source."""
    rng = random.Random(4)
    hot = " ".join(["word"] * 100)
    rows = [(7, hot, "a")] * 600 + [(i, prose(rng, rng.randint(5, 150)), "ab"[i % 2]) for i in range(1_000, 2_200)]
    rows += [(8, hot, "a"), (8, hot, "b"), (8, hot, "b"), (9, hot, None), (9, hot, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (29, 31):
        mixed = mixture.mix_sources(docs, n_shards=4, seed=seed).collect()
        assert len(mixed) == len(rows)
        for source in ("a", "b", None):
            own = [r for r in mixed if r["source"] == source]
            assert abs(sum(r["size"] * len(r["draws"]) for r in own) - own[0]["target"]) <= 75
        again = mixture.mix_sources(docs.repartition(5), n_shards=4, seed=seed).collect()
        assert sorted(map(repr, mixed)) == sorted(map(repr, again))
    kept = mixture.mix_sources(docs, n_shards=4, keep=True).collect()
    words = sum(r["size"] * len(r["draws"]) for r in kept if r["source"] == "a")
    assert abs(words - next(r["target"] for r in kept if r["source"] == "a")) <= 75


def test_language_sample_holds_a_copied_text_once(spark):
    rows = [("ka to mi " * 5, "xx")] * 3_000 + [(f"schung ber {i}", "yy") for i in range(50)]
    sample = language.training_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 10_000)
    assert sorted(lang for lang, _, _ in sample) == ["xx"] + ["yy"] * 50


def test_language_is_learned_and_rejects(spark, none):
    rng = random.Random(2)
    sounds = {"xx": ["ka", "to", "mi"], "yy": ["sch", "ung", "ber"], "zz": ["é", "eau", "ou"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(5, 60)))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(sounds) * 60)]
    train = spark.createDataFrame(rows[:150] + [(900, None, "xx"), (901, "..", "yy"), (902, "ka", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    odd = [(1_000, None, None), (1_001, "", None), (1_002, "12 .. !", None), (1_003, "schungber " * 200_000, "yy")]
    judged = language.predict(spark.createDataFrame(rows[150:] + odd, "doc_id long, text string, language string"), F.col("text"), model)
    found = {r["doc_id"]: r["language"] for r in judged.collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[150:])
    assert all(0 <= x["score"] <= 1 for x in found.values())
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (1_000, 1_001, 1_002))
    assert found[1_003]["lang_pred"] == "yy"
    untrained = language.fit(none)
    rest = language.predict(train, F.col("text"), untrained).collect()
    assert all(r["language"]["lang_pred"] == "und" for r in rest)
    assert [r["language"]["rejected"] for r in rest if r["doc_id"] in (0, 900)] == [False, True]
    assert language.predict(none, F.col("text"), untrained).count() == 0


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Straße über das Äpfel-Feld " * 50
    whole = np.sort(np.concatenate(list(language.subwords(text))))
    monkeypatch.setattr(language, "PIECE", 64)
    assert np.array_equal(whole, np.sort(np.concatenate(list(language.subwords(text)))))


def test_toxicity_chain(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randint(5, 300)).split()
        rude, worse = i % 5 == 0, i % 10 == 0
        if rude:
            words.insert(rng.randrange(len(words)), rng.choice(["grump", "blarg"]))
        if worse:
            words.insert(rng.randrange(len(words)), "vrok")
        rows.append((i, " ".join(words)))
        labels.append((i, int(rude), int(worse), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels[:300] + [(999, 1, 1, 0), (5, None, 1, 0)], "doc_id long, rude int, worse int, never int")
    chain = toxicity.fit(docs, table, ["rude", "worse", "never"])
    assert [len(link.earlier) for link in chain.links] == [0, 1, 2]
    odd = spark.createDataFrame([(1_000, None), (1_001, ""), (1_002, prose(rng, 30_000)), (1_003, "BLARG!")], "doc_id long, text string")
    found = {r["doc_id"]: r["toxicity"] for r in toxicity.predict(docs.unionAll(odd), F.col("text"), chain).collect()}
    for i, rude, worse, _ in labels[300:]:
        assert (found[i]["is_rude"], found[i]["is_worse"], found[i]["is_never"]) == (bool(rude), bool(worse), False)
    assert not any(found[i]["is_rude"] for i in (1_000, 1_001, 1_002)) and found[1_003]["is_rude"]
    untrained = toxicity.fit(none, table.limit(0), ["rude"])
    assert not any(r["toxicity"]["is_rude"] for r in toxicity.predict(docs, F.col("text"), untrained).collect())


def brute_nearest(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, matrix = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i in queries:
            score = (matrix * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    same = rng.normal(size=8).tolist()
    rows += [(i, same) for i in range(300, 400)]
    odd = [(500, None), (520, [0.0] * 8), (540, [float("nan")] * 8), (560, [None] + [1.0] * 7), (580, [1.0, 2.0]), (600, [float("inf")] * 8), (None, same)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("part", F.lit("x"))
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=20, recall=1.0).collect()
    expected = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == expected.keys()
    for q, want in expected.items():
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)
    few = neighbours.nearest(table.filter("vec_id < 3"), F.col("vec_id") == 0, k=20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_recall_over_learned_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=20, sample=2_000).collect()
    expected = brute_nearest(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in want}) for q, want in expected.items())
    assert all(len(v) == 20 for v in got.values())
    assert hits / (20 * len(expected)) >= 0.95


def test_query_blocks_and_second_round_lose_nothing(spark, monkeypatch):
    """Small blocks on both sides, with most rows asking; all parts are probed, so results are exact."""
    monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 40)
    monkeypatch.setattr(neighbours, "ROWS_PER_BLOCK", 30)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, F.col("vec_id") % 3 != 0, k=5, recall=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in want] for q, want in brute_nearest(rows, {i for i, _ in rows if i % 3}, 5).items()}


def test_later_parts_return_only_what_can_win():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    vectors = pa.array(rng.normal(size=(500, 4)).tolist(), pa.list_(pa.float64()))
    rows = pa.table({"vec_id": pa.array(range(500)), "v": vectors})
    ask = lambda least: pa.table({"key": ["a"], "q": vectors[:1], "least": [least]})
    run = neighbours._rerank(21)
    everything = run(ask(float("-inf")), rows)["score"].to_pylist()
    assert len(everything) == 21
    assert run(ask(everything[4]), rows)["score"].to_pylist() == everything[:5]
    assert run(ask(1e9), rows).num_rows == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1_000, 8)).astype(np.float32)
    part = neighbours.balanced_parts(neighbours.neighbour_graph(vectors, 6), 3, rng)
    assert np.ptp(np.bincount(part)) <= 1
    router = neighbours.fit_router(vectors.astype(float), 8_000, 10)
    assert router.parts == 32 and 1 <= router.probes < 32


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def test_url_rules_and_odd_urls(spark):
    urls = {
        1: "http://A.Example.ORG/es/1?x",
        2: "https://example.org/en",
        3: "https://lonely.org",
        4: "http://badexample.org/es/",
        5: "ftp://x.com/fr/#y/de/",
        6: "http://x.com?/de/",
        7: None,
        8: "no scheme.org/",
        9: "",
        10: "http://org/",
        11: "x://y.org/a://b",
    }
    table = spark.createDataFrame([(i, u, None) for i, u in urls.items()], "page_id long, url string, html string").withColumn("host", F.lit("z"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in links.judge_urls(table, RULES).collect()}
    assert found == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en", "org/", "allow"),
        3: ("lonely.org", "", None, "allow"),
        4: ("badexample.org", "/es/", "org/", "allow"),
        5: ("x.com", "/fr/", "com/fr/", "allow"),
        6: ("x.com", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("org", "/", "org/", "allow"),
        11: ("y.org", "/a://b", "org/", "allow"),
    }
    assert links.judge_urls(table.limit(0), RULES).count() == 0


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    rows = [
        ("http://good.org/a", '<a href="http://friend.net/x">f</a> <a href="/own">o</a>'),
        ("http://friend.net/a", '<A class=x HREF = //far.net/>'),
        ("http://far.net/a", ""),
        ("http://bad.com/de/1", '<a href="http://victim.net/">v</a>'),
        ("http://shady.net/a", "<a href='http://bad.com/de/1'>b</a>"),
        ("http://darker.net/a", "<a href='http://shady.net/'>b</a>"),
        ("http://victim.net/a", None),
        ("http://alone.net/a", "text href=http://bad.com/ only"),
    ]
    table = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    found = {r["host"]: r for r in links.judge_urls(table, RULES).collect()}
    blocked = {h for h, r in found.items() if r["verdict"] == "block"}
    assert blocked == {"bad.com", "shady.net", "darker.net"}
    assert found["friend.net"]["trust"] > found["far.net"]["trust"] > 0 == found["victim.net"]["distrust"]

    # The same walk by matrices.
    names = sorted(found)
    edges = {("good.org", "friend.net"), ("friend.net", "far.net"), ("bad.com", "victim.net"), ("shady.net", "bad.com"), ("darker.net", "shady.net")}
    for kind, seed in (("trust", "good.org"), ("distrust", "bad.com")):
        step = np.zeros((len(names), len(names)))
        for a, b in edges if kind == "trust" else {(b, a) for a, b in edges}:
            step[names.index(b), names.index(a)] = 1.0
        start = np.array([float(n == seed) for n in names])
        x = start
        for _ in range(60):
            x = 0.85 * step @ x
            x = x + (1 - x.sum()) * start
        assert np.allclose(x, [found[n][kind] for n in names], atol=1e-4)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(i, f"http://h{i}.net/a", f'<a href="http://h{i + 1}.net/">n</a>') for i in range(30)] + [(30, "http://h30.net/x", '<a href="http://bad.com/de/">b</a>')]
    rows += [(31, "http://bad.com/de/1", ""), (32, "http://aside.net/", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["host"]: r for r in links.judge_urls(table, RULES).collect()}
    assert {h for h, r in found.items() if r["verdict"] == "allow"} == {"aside.net"}
    assert found["h0.net"]["distrust"] / found["h1.net"]["distrust"] == pytest.approx(0.85)
    with pytest.raises(DatasetError):
        edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, weight long")
        links.propagate(spark.createDataFrame([("a", 0, 1)], "host string, kind int, mass long"), edges, 0.85, 1e-6, 10)


def test_license_scan(spark, docs, none):
    lines = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "licensed under CC BY-NC 4.0": "CC-BY-NC",
    }
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 40)}\n{line}\n\n{prose(rng, 20)}", "k") for i, line in enumerate(lines)]
    rows += [(10, None, "k"), (11, "", "k"), (12, prose(rng, 20_000), "k"), (13, "The license plate of the car was new.", "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, family string")
    found = {(r["doc_id"], r["paragraph_no"]): r for r in licenses.scan(table).collect()}
    for i, family in enumerate(lines.values()):
        assert found[i, 1]["family"] == family and found[i, 1]["overlap"] >= 0.8
    assert not [k for k, r in found.items() if k[0] >= 10 and r["family"] != "unknown"]
    assert licenses.scan(none).count() == 0
    assert not re.search("Python|Arrow|Pandas", licenses.scan(table)._jdf.queryExecution().executedPlan().toString())


def test_license_notices_wrapped_and_within_long_lines(spark):
    mit, gpl, lgpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1], licenses.TEMPLATES["LGPL"][0]
    rng = random.Random(7)
    rows = [
        (1, "\n".join(textwrap.wrap(mit, 72))),
        (2, f"{prose(rng, 30)}\n#\n" + "\n".join(f"#  {x}" for x in textwrap.wrap(gpl, 60)) + f"\n#\n{prose(rng, 30)}"),
        (3, f"{prose(rng, 300)} {mit} {prose(rng, 300)}"),
        (4, f"/*\r\n * {prose(rng, 9)}\r\n *\r\n" + "\r\n".join(f" * {x}" for x in textwrap.wrap(lgpl, 40)) + "\r\n */"),
        (5, f"{prose(rng, 50)}\n" + "\n".join(f"dnl {x}" for x in textwrap.wrap(gpl, 30))),
        (6, f"{prose(rng, 61)} {mit} {prose(rng, 5)} {gpl} {prose(rng, 99)}"),
    ]
    # Half a notice is none, nor are two halves with a blank line between them.
    halves = mit.split()
    rows.append((7, " ".join(halves[:14]) + "\n\n" + " ".join(halves[14:])))
    rows += [(100 + i, prose(rng, 80)) for i in range(40)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("family != 'unknown'").collect()
    assert sorted((r["doc_id"], r["paragraph_no"], r["family"]) for r in found) == [
        (1, 0, "MIT"), (2, 2, "GPL-3.0"), (3, 0, "MIT"), (4, 3, "LGPL"), (5, 1, "GPL-3.0"), (6, 0, "GPL-3.0"), (6, 0, "MIT"),
    ]
    assert min(r["overlap"] for r in found) > 0.99


def test_license_windows_of_both_kinds_come_from_one_scan(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    known = licenses.templates(spark.createDataFrame([(1,)], "x int")).filter("family = 'MIT'").collect()
    rows = [(1, 0, "one two three"), (2, 0, "of this software and two words"), (3, 0, f"a b {mit} c d")]
    cut = licenses.pieces(spark.createDataFrame(rows, "doc_id long, first_line int, paragraph string").withColumn("_run", F.col("doc_id")))
    held = licenses._holds_pair_at({p for r in known for p in r["pairs"]})
    places = F.filter(licenses._places(F.col("words")), lambda i: held(F.col("words"), i))
    common = F.array_distinct(F.transform(places, lambda i: licenses._pair_at(F.col("words"), i)))
    found = licenses._windows(cut.withColumn("_common", common), known)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["family"]) for r in found.collect()}
    assert got == {(2, "unknown"), (3, "unknown"), (3, "MIT")}
    whole = found.filter("overlap = 1").collect()
    assert whole and {r["end"] for r in whole} == {2 + len(mit.split())}


def test_license_windows_without_a_template_pair_are_scored(spark):
    # Words of a notice in another order share no pair with any template, yet read like a licence.
    rng = random.Random(3)
    words = [w for w in re.findall("[a-z]+", licenses.TEMPLATES["GPL-3.0"][1].lower()) if len(w) > 3]
    pairs = {p for r in licenses.templates(spark.createDataFrame([(1,)], "x int")).collect() for p in r["pairs"]}
    while pairs & set(map(" ".join, zip(words, words[1:]))):
        rng.shuffle(words)
    other = " ".join(words)
    rows = [(1, f"{prose(rng, 30)}\n\n{other}")] + [(100 + i, prose(rng, 60)) for i in range(200)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), most=40).collect()
    assert (1, 2, "unknown") in {(r["doc_id"], r["paragraph_no"], r["family"]) for r in found}


def test_license_paragraphs_are_counted_as_they_are_cut(spark):
    rng = random.Random(4)
    bits = ["a", "rem", "dnl", "remark", " ", "\n", "\r\n", "\r", "#", "\x85", "É", "\x01", "7", "\n\n", "\n# dnl x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r["doc_id"], r["first_line"], r["paragraph"]) for r in licenses.paragraphs(table, "text", "doc_id").collect()]
    expected = []
    for i, text in enumerate(texts[:-1]):
        run = []
        for k, line in enumerate([*re.split(r"\r\n|\r|\n", text), ""]):
            if re.search("[a-zÉ0-9]", line):
                run.append((k, line))
            elif run:
                expected.append((i, run[0][0], "\n".join(x for _, x in run)))
                run = []
    assert sorted(found) == expected and licenses.n_paragraphs(table, "text") == len(expected)


def test_batches_stay_bounded(spark, docs):
    language.predict(docs, F.col("text"), language.Model([], np.zeros((language.BUCKETS, 0)), np.zeros(0)))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2_000
