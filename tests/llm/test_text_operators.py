"""Each operator against a plain version, on mixed and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import containment, langid, linededup, packing, quality, rindex, secrets, simhash, sstable
from graphloom.llm.components import connected_components
from graphloom.llm.queries import tokenizer_path

from .conftest import ODD, words


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(n)]
    out = []
    for k, t in enumerate(base):
        out.append(t)
        if k % 3 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        if k % 5 == 0:
            out.append(t)
        if k % 7 == 0:
            out.append(words(rng, 30) + "\n" + base[k // 2] + "\n" + words(rng, 10))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(1), "doc_id long, text string")


# -- 2 ----------------------------------------------------------------------------------------------------------------


def removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                hit[i : i + length] = 1
        out.append((len(r), int(hit.sum()), int((np.diff(np.r_[0, hit]) == 1).sum()), bytes(b for b, h in zip(r, hit) if not h)))
    return out


@pytest.mark.parametrize("group", [1024, 2])
def test_repeats_match_brute_force(spark, docs, monkeypatch, group):
    monkeypatch.setattr(rindex, "GROUP", group)
    rows = [r for r in docs.collect()] + [(900 + k, f"{k} of it: " + "the same line that many texts hold, with a tail of its own that goes on, " * 3 + str(k * k)) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (200, 60):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rindex.remove_repeats(df, length).collect())
        want = sorted((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], length)))
        assert got == want


def hot_phrase(rng):
    """50 bytes of which one 32-byte substring has so small a hash that it anchors nearly all strings around it."""
    while True:
        t = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(50))
        at = np.arange(50 - rindex.ANCHOR + 1)
        if rindex.range_hashes(rindex.prefix_hashes(np.frombuffer(t, np.uint8)), at, at + rindex.ANCHOR).min() < 1 << 50:
            return t.decode()


def check_repeats(spark, texts, length=200):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rindex.remove_repeats(df, length).collect())
    assert got == [(i, *x) for i, x in enumerate(removed(texts, length))]


def test_unique_text_around_a_hot_phrase_stays(spark, monkeypatch):
    monkeypatch.setattr(rindex, "GROUP", 4)
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase, shared = hot_phrase(rng), noise(160)
    texts = [noise(180) + phrase + noise(180) for _ in range(20)]
    texts += [noise(90) + shared + phrase + noise(90) for _ in range(6)] + [noise(90) + phrase + shared + noise(90) for _ in range(6)]
    check_repeats(spark, texts)


def test_copies_of_a_pivot_go(spark, monkeypatch):
    monkeypatch.setattr(rindex, "GROUP", 4)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase = hot_phrase(rng)
    texts = [noise(100) + phrase + noise(100) for _ in range(12)]
    check_repeats(spark, texts + texts)  # whichever text is the pivot, it has a copy
    check_repeats(spark, texts + texts[:6])


def test_repeats_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rindex.remove_repeats(odd).collect()), key=str)
    want = sorted(((i, *x[:3]) for (i, _), x in zip(ODD, removed([t for _, t in ODD], 200))), key=str)
    assert got == want
    assert rindex.remove_repeats(none).count() == 0


def test_matching_statistics_find_long_matches():
    rng = random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12, 40))).encode() for _ in range(6)]
        counts = [len(t) - 7 for t in texts]
        got = rindex.matching_statistics(texts, counts)
        every = [(k, i) for k, n in enumerate(counts) for i in range(n)]
        for (k, i), m in zip(every, got):
            best = max(len(np.flatnonzero(np.cumprod([a == b for a, b in zip(texts[k][i:], texts[j][p:])]))) for j, p in every if (j, p) != (k, i))
            assert (m >= 8) == (best >= 8)


# -- 3 ----------------------------------------------------------------------------------------------------------------


def shingles(text, k=5):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(k, len(w))
    return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_leaks_match_brute_force(spark, docs):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate([1, 3, 5, 6, 9, 15, 40, 70, 130, 300])] + [(99, None), (98, ""), (0, "again w1 w2 w3 w4 w5")]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, t in items[3:10]:
        w = t.split()
        rows.append((1000 + k, words(rng, 900) + " " + t.upper() + ". " + words(rng, 200)))
        rows.append((2000 + k, words(rng, 300) + " " + " ".join(w[: int(len(w) * 0.95)]) + " " + words(rng, 100)))
        rows.append((3000 + k, words(rng, 300) + " " + " ".join(w[: len(w) // 2]) + " " + words(rng, 100)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            k, s = shingles(x)
            w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
            own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
            if s and len(s & own) / len(s) >= 0.8:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in containment.find_leaks(df, bench).collect()}
    assert got == want and len(got) > 10
    blocks = containment.with_matches(df, bench, block_items=4)
    assert {(r.doc_id, m.item_id) for r in blocks.collect() for m in r.leaks} == want
    clean = containment.decontaminate(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one"), (2, None), (None, "some words in a row")], "item_id long, text string")
    got = containment.with_matches(odd.withColumn("leaks", F.lit(1)), bench)
    assert got.count() == len(ODD)
    assert sorted((r.doc_id or 0, len(r.leaks)) for r in got.collect() if r.leaks) == [(0, 1), (4, 1), (4, 1)]
    assert containment.find_leaks(none.select("doc_id", "text"), bench).count() == 0
    assert containment.decontaminate(odd, bench.limit(0)).count() == len(ODD)


# -- 1 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    good = [(k, words(rng, 80, 300)) for k in range(200)]
    bad = [(1000 + k, " ".join(w + "!!" for w in words(rng, 80, 300).upper().split())) for k in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    return df, df.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_resampling_keeps_good_text(labelled):
    df, labels = labelled
    kept = {r.doc_id for r in quality.importance_resample(df, labels.where("doc_id % 2 = 0")).collect()}
    assert len([k for k in kept if k < 1000]) >= 198 and len([k for k in kept if k >= 1000]) <= 2


def test_weights_match_plain_counts(labelled):
    """Log weights from counts of unigrams and bigrams in plain dictionaries."""
    df, labels = labelled
    texts, label = {r.doc_id: r.text for r in df.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    half = {r.label_id for r in labels.select(F.col("doc_id").alias("label_id")).where(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(2)) == 0).collect()}

    def buckets(t):
        own = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", t)
        return [cell(w.encode()) for w in own] + [cell(f"{a} {b}".encode()) for a, b in zip(own, own[1:])]

    def cell(raw):
        return int(quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][-1])

    every, target = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        b = buckets(t)
        every.update(b)
        if i in half and label[i] == 1:
            target.update(b)
    n, m, size = sum(every.values()), sum(target.values()), 1 << quality.BITS
    got = {r.doc_id: r.log_weight for r in quality.importance_resample(df, labels, k=len(texts)).collect()}
    for i, t in texts.items():
        b = buckets(t)
        ratio = sum(np.log((target[x] + 1) / (m + size)) - np.log((every[x] + 1) / (n + size)) for x in b)
        assert abs(got[i] - quality.SCALE * ratio / (len(b) + quality.PRIOR)) < 1e-6


def test_noise_decides_between_close_weights(spark, labelled):
    df, labels = labelled
    kept = [{r.doc_id for r in quality.importance_resample(df, labels, k=100, seed=s).select("doc_id").collect()} for s in (1, 2)]
    assert len(kept[0] & kept[1]) < 95 and all(len(x) == 100 for x in kept)


def test_resampling_takes_the_k_largest_keys(labelled):
    df, labels = labelled
    every = quality.importance_resample(df, labels, k=260).collect()
    top = sorted(every, key=lambda r: -r.sample_key)[:37]
    assert {r.doc_id for r in quality.importance_resample(df, labels, k=37).collect()} == {r.doc_id for r in top}
    assert quality.importance_resample(df, labels, k=0).count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.random(), 0.5, -3.25, rng.random() * 1e6]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 250, 499, 500):
        assert quality.kth_largest(df, "x", k, cells=8) == sorted(values, reverse=True)[k - 1]


def test_resampling_of_odd_rows(spark, odd, none, labelled):
    labels = labelled[1]
    assert quality.importance_resample(odd, labels.limit(0)).count() == len(ODD)
    mixed = labelled[0].unionByName(odd.select("doc_id", "text"))
    out = quality.importance_resample(mixed, labels.unionByName(labels.limit(3)))
    assert out.columns == ["doc_id", "text", "log_weight", "sample_key"]
    assert quality.importance_resample(none, labels).count() == 0


# -- 4 ----------------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_and_mixed_text(spark):
    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi", "nu"], "bb": ["schr", "ein", "ung", "ch"], "cc": ["é", "que", "ou", "eau"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, say(lang, 40), lang) for k, lang in enumerate(list(syllables) * 40)] + [(500, say("aa", 60) + " " + say("cc", 40), "aa"), (501, None, None), (502, "123 !!", "bb"), (503, "“…” 中文字", None), (None, say("bb", 5), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in langid.predict_held_out(df).collect()}
    assert len(got) == len(rows)
    for k, _, lang in rows[:120]:
        assert got[k].lang_pred == lang and 0 < got[k].score <= 1 and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    both = dict(x.split(":") for x in got[500].languages.split(","))
    assert set(both) == {"aa", "cc"} and abs(float(both["aa"]) - 0.6) < 0.15
    assert [got[k].lang_pred for k in (501, 502)] == ["und", "und"] and got[501].score == 0
    assert got[503].lang_pred != "und" and got[None].lang_pred == "bb" and got[None].held_out is False


def plain_mixture(p, count, most, penalty=8.0):
    """The cheapest set of languages, by plain expectation-maximisation run to its end."""

    def em(cols):
        share = np.full(len(cols), 1 / len(cols))
        for _ in range(5000):
            joint = p[:, cols] * share
            share = (joint / joint.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
        return share, (count * np.log((p[:, cols] * share).sum(1))).sum()

    order = np.argsort(-em(list(range(most)))[0], kind="stable")
    tried = []
    for k in range(1, most + 1):
        share, like = em(list(order[:k]))
        tried.append((-2 * like + penalty * k * np.log(count.sum() + 1), dict(zip(order[:k].tolist(), share))))
    return min(tried, key=lambda x: x[0])[1]


def test_mixtures_match_plain_em():
    rng = np.random.default_rng(44)
    p = rng.dirichlet(np.full(60, 0.3), 5).T + 1e-4
    model = langid.LanguageModel(tuple("abcde"), p / p.sum(0), tolerance=1e-7)
    for k in range(1, 6):  # mixtures of one to all five
        count = np.round(model.probability[:, :k].mean(1) * 4000)
        count[count == 0] = 1
        got = model._mixtures(model.probability, count, np.zeros(60, int), np.array([0]))[0]
        want = plain_mixture(model.probability, count, 5)
        assert set(np.flatnonzero(got).tolist()) == set(want) == set(range(k))
        assert all(abs(got[j] - w) < 1e-3 for j, w in want.items())


def test_languages_without_training_rows(odd, none):
    out = langid.predict_held_out(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out} == {"und"}
    assert langid.predict_held_out(none).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, ids):
    part = {i: i for i in ids}
    for a, b in pairs:
        x, y = part[a], part[b]
        if x != y:
            part = {k: min(x, y) if v in (x, y) else v for k, v in part.items()}
    return part


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash_components(spark, docs, odd, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + (i or 0), t) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df, block=block).collect()}
    fp = {i: fingerprint(t) for i, t in rows}
    part = components([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert got == {(i, f"{fp[i]:016x}", part[i]) for i, _ in rows}


def test_near_fingerprints_all_meet(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(6)]
    every = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << bit
            every.add(x)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in every], "fp long")
    for block in (1024, 4):
        links = [(r.a, r.b) for r in simhash.near_links(df, block=block).collect()]
        u = lambda v: int(np.int64(v).astype(np.uint64))
        assert all((u(a) ^ u(b)).bit_count() <= 4 for a, b in links)
        got = components([(u(a), u(b)) for a, b in links], every)
        assert got == components([(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 4], every)


def test_triples_cover_all_fours():
    from itertools import combinations

    chosen = [set(t) for t in simhash.triples()]
    assert len(chosen) == 20 and all(any(t <= set(four) for t in chosen) for four in combinations(range(8), 4))


def test_one_of_each_group_stays(spark, odd, none):
    rows = [(3, "the same text of words"), (1, "the same text of words"), (1, "the same text of words"), (None, "the same text of words"), (9, "another text of other words"), (None, "only without an id here"), (None, "only without an id here")]
    df = spark.createDataFrame([(*r, "en", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, fp int")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, rows[0][1]), (9, rows[4][1]), (None, rows[5][1])]
    assert simhash.drop_near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns
    assert simhash.drop_near_duplicates(odd).count() == len({fingerprint(t) for _, t in ODD})


def test_near_copies_that_fingerprints_miss(spark):
    """Groups by links of either kind, against a plain version."""
    rng = random.Random(55)
    rows, texts = [], [words(rng, 60) for _ in range(12)]
    for t in texts:
        for _ in range(5):
            w = t.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w)))
    five = {i: {" ".join(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    fp = {i: int(simhash.fingerprints(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0]) for i, t in rows}
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4 or len(five[a] & five[b]) >= 0.8 * len(five[a] | five[b])
    part = components([(a, b) for a in five for b in five if a < b and near(a, b)], five)
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert got == set(part.values()) and len(got) < len(rows)


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5), (2000, 1999)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in components(links, {x for p in links for x in p}).items()}


# -- 6 ----------------------------------------------------------------------------------------------------------------


def plain_pack(lengths, caps, overhead, attention):
    best = None
    for most in range(len(caps)):
        if lengths and caps[most] < lengths[0]:
            continue
        bins, used, size, rest = [], [], [], sum(lengths)
        for n in lengths:
            fits = [(size[b] - used[b], b) for b in range(len(used)) if size[b] - used[b] >= n]
            if fits:
                b = min(fits)[1]
            else:
                c = min((c for c in caps[: most + 1] if c >= n), key=lambda c: ((overhead + c * (1 + attention * c)) / min(c, max(rest, 1)), c))
                b = len(used)
                used.append(0)
                size.append(c)
            used[b] += n
            rest -= n
            bins.append(b)
        size = [min(c for c in caps if c >= u) for u in used]
        cost = sum(overhead + c * (1 + attention * c) for c in size)
        if best is None or cost < best[0]:
            best = cost, bins, size
    return best[1:] if best else ([], [])


def test_pack_matches_plain_version():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(0, 60))), reverse=True)
        assert packing.pack(lengths, (16, 32, 64), 4.0, 0.01) == tuple(plain_pack(lengths, (16, 32, 64), 4.0, 0.01))


def test_packing_places_every_token(spark, docs, odd, none):
    df = docs.unionByName(odd.select("doc_id", "text"))
    rows = packing.best_fit_packing(df, capacities=(16, 64, 256), block_rows=20).collect()
    n = collections.Counter()
    for r in rows:
        n[r.doc_id] += r.length
    want = collections.Counter()
    for r in df.collect():
        want[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1
    assert n == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    word = {}  # equal words have equal ids, and the texts come back from them
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.piece)):
        assert len(r.ids) == r.length
        if (r.doc_id or 0) > 10:
            own = [*re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]), None][r.start : r.start + r.length]
            assert all(word.setdefault(w, i) == i and (i == 1) == (w is None) for w, i in zip(own, r.ids, strict=True))
    by_bin = collections.defaultdict(list)
    for r in rows:
        by_bin[r.bin_id].append(r)
    for own in by_bin.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        total = sum(r.length for r in own)
        assert own[0].capacity == min(c for c in (16, 64, 256) if c >= total)
    assert packing.best_fit_packing(none).count() == 0


def test_packing_of_ties_null_and_large_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "a b c"), (big, "a b c"), (3, None)], "doc_id long, text string")
    rows = packing.best_fit_packing(df, capacities=(4, 8)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 4), (3, 1), (big, 4), (big, 4)]
    none = lambda b, c: pa.array([[]] * b.num_rows, pa.list_(pa.int32()))
    assert [r.ids for r in packing.best_fit_packing(df, none, capacities=(4, 8)).collect()] == [[1]] * 4


def test_blocks_cost_little_more_than_one(spark):
    rng = random.Random(66)
    df = spark.createDataFrame([(k, words(rng, int(rng.paretovariate(0.9) * 30) % 5000)) for k in range(1500)], "doc_id long, text string")

    def cost(block_rows):
        bins = packing.best_fit_packing(df, block_rows=block_rows).select("bin_id", "capacity").distinct().collect()
        return sum(packing.bin_cost(r.capacity, 64.0, 1e-5) for r in bins)

    assert cost(300) <= 1.05 * cost(1 << 20)


# -- 7 ----------------------------------------------------------------------------------------------------------------

PATTERNS = (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in PATTERNS[0].finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in PATTERNS[1].finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in PATTERNS[2].finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark, none):
    rng = random.Random(7)
    token = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secret = token(b64, 44)
    texts = [None, "", 'password = "abcdefghijkl"', "token=secret:abcdefghijklmnop token=short", "API_KEY: AKIA" + "Q" * 14 + " é AKIAQ AKIA" + "Z" * 13, "deadbeef" * 4 + "x" + "deadbeef", "AKIAAKIA" + "0" * 12, f"the value {secret} is in here", "a plain sentence of ordinarywordsthatareratherlong but no secret", "a" * 4000, "Secret='x' secret='yyyyyyyyyyyyyy'", "\U0001f600 token=abcdefabcdefabcdef"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(0, None, 1), (None, texts[2], 2)], "doc_id long, text string, row int")
    got = secrets.scan(df).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        s = base_spans(t or "")
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in s)
        assert (by[k].n_assign, by[k].n_access, by[k].n_hex) == tuple(sum(x[1] == j for x in s) for j in range(3)), k
        assert by[k].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(by[k].spans.split(","))
    assert by[7].spans == f"random:10:{10 + len(secret)}" and by[8].spans == ""
    assert secrets.scan(none).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------------


def test_token_shards_round_trip(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    df = docs.unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(-5, "It's 2024's <|endoftext|> x' don't <|startoftext|>"), (77777, "É ç ÷ × é ﬁ Σς İ 　 x")], "doc_id long, text string"))
    ids = lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
    want = collections.Counter((r.doc_id, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in df.collect())
    manifest = sstable.write_shards(df, tokenizer_path(), sstable.new_dir(spark, "test"), shard_bytes=20_000)
    rows = sstable.read_shards(manifest).collect()
    assert manifest.count() > 1 and collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    key = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert key == sorted(key)
    for r in df.where("doc_id in (-5, 0, 4, 6, 77777)").select("doc_id").distinct().collect():
        found = sorted(x.tobytes() for x in sstable.lookup(manifest, r.doc_id))
        assert found == sorted(ids(x.text).tobytes() for x in df.where(F.col("doc_id") == r.doc_id).collect())
    assert sstable.lookup(manifest, 123456789) == []
    assert sstable.encode_to_shards(none, tokenizer_path()).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------


def plain_lines(rows, t=0.8, least=1):
    lines = []
    for i, text in sorted(rows):
        for k, x in enumerate(text.split("\n")):
            s = frozenset(w for w in re.split("[ \n\r\t\x0b\x0c]", x.lower()) if w)
            if len(s) >= least:
                lines.append((i, k, s))
    gone = collections.defaultdict(set)
    for n, (i, k, s) in enumerate(lines):
        if any(len(s & o) >= t * len(s | o) - 1e-12 for _, _, o in lines[:n]):
            gone[i].add(k)
    return {i: (len(text.split("\n")), len(gone[i]), "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])) for i, text in rows}


@pytest.mark.parametrize("least", [1, 5])
def test_lines_match_brute_force(spark, least):
    rng = random.Random(10)
    pool = [words(rng, rng.randrange(3, 30), 90) for _ in range(40)] + [words(rng, rng.randrange(50, 90), 900) for _ in range(10)]
    hub = [f"w{k}" for k in range(30)]  # near copies of one line, by up to eight words apart from each other
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(pool).split() if rng.random() < 0.7 else words(rng, rng.randrange(3, 25), 90).split()
            if rng.random() < 0.3:
                w = list(hub)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
            own.append(" ".join(w) if rng.random() < 0.8 else " ".join(sorted(w)).upper())
        rows.append((i, "\n".join(own)))
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, gone string, n_removed int")
    out = linededup.dedup_lines(df, min_words=least)
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_removed"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == plain_lines(rows, least=least)


def test_query_takes_short_lines(spark, tmp_path):
    from graphloom.llm.queries import QUERIES

    rng = random.Random(13)
    rows = [(i, "\n".join(words(rng, rng.randrange(0, 6), 7) for _ in range(6))) for i in range(30)]
    rows += [(100, "a b c d\n\u4e2d\u6587\u5b57\nhttps://example.org/x"), (101, "a b c d e\n\n\u4e2d\u6587\u5b57"), (102, "https://example.org/x\na b c\nC B A a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in QUERIES["op10_line_set_similarity"](spark, str(tmp_path)).collect()}
    want = {i: (a, b, hashlib.sha256(t.encode()).hexdigest()) for i, (a, b, t) in plain_lines(rows).items()}
    lines = {i: (0 if not t else want[i][0], *want[i][1:]) for i, t in rows}
    assert got == lines and got[101][1] == 2 and got[102][1] == 2


def test_lines_of_odd_rows(spark, odd, none):
    same = "a line of several words that comes again"
    df = odd.select("doc_id", "text", "rk").unionByName(spark.createDataFrame([(20, f"{same}\n\n{same}", 1), (21, same, 1), (21, same, 1), (21, same + "\nother", 2)], "doc_id long, text string, rk int"))
    out = linededup.dedup_lines(df).collect()
    assert len(out) == len(ODD) + 4
    got = sorted((r.text, r.n_removed) for r in out if r.doc_id in (20, 21))
    assert got == sorted([(f"{same}\n", 1), ("", 1), ("", 1), ("other", 1)])
    assert {r.doc_id: (r.text, r.n_lines) for r in out if r.doc_id in (1, 2)} == {1: (None, 0), 2: ("", 0)}
    assert linededup.dedup_lines(none).count() == 0


def test_bitmap_of_tokens_stays_out_of_plans(spark):
    some, all_tokens = spark.range(-900, 900, 3).selectExpr("cast(id as int) token"), spark.range(-900, 9000).selectExpr("cast(id as int) token")
    left = all_tokens.where(linededup.marked(F.col("token"), linededup.bitmap(some)))
    found = {r.token for r in left.collect()}
    assert found >= set(range(-900, 900, 3)) and len(found) < 700
    assert len(left._jdf.queryExecution().toString()) < 20_000  # Spark keeps descriptions of plans in the driver's memory
    assert left.where("false").count() == 0 and not all_tokens.where(linededup.marked(F.col("token"), linededup.bitmap(some.limit(0)))).head(1)


def test_lines_of_large_tables_sort_no_texts(spark):
    rows = [(i, f"a line of several words that comes again\nand number {i} alone") for i in range(20)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.n_removed for r in out.collect()) == [0, *[1] * 19]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_first_lines_come_with_their_words(spark):
    docs = spark.createDataFrame([(i, f"one {i}\ntwo Words words {i}") for i in range(300)], "doc_id long, text string")
    classes = linededup.line_rows(docs).select(F.xxhash64("line").alias("s1"), "doc_id", "rk", "line_no")
    wanted = classes.where("doc_id = 7 and line_no = 1").select("s1")
    found = linededup._first_lines(docs, classes, wanted).collect()
    assert [(r["at"].doc_id, r["at"].line_no, sorted(r.words)) for r in found] == [(7, 1, ["7", "two", "words"])]


def test_lines_hash_a_text_once(spark):
    plan = linededup.line_rows(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")


def test_randomness_threshold_and_p_values(spark):
    from math import erfc, exp, log, log10, sqrt

    rng = random.Random(77)
    for _ in range(200):  # the rule, by trying every number of discoveries
        e = [rng.choice((0, 0, 1, 5, rng.randrange(60))) / 10 for _ in range(rng.randrange(1, 60))]
        m, rate = len(e) + rng.randrange(20), 0.05
        fits = [k for k in range(1, len(e) + 1) if sorted(e, reverse=True)[k - 1] >= log10(m / (k * rate))]
        least = secrets.threshold(collections.Counter(round(x * 10) for x in e), m, rate)
        assert (0 if least is None else sum(round(x * 10) >= least for x in e)) == max(fits, default=0)
    assert secrets.threshold({}, 3, 0.01) is None and secrets.threshold({19: 5}, 5, 0.01) is None and secrets.threshold({20: 5}, 5, 0.01) == 20
    assert secrets.threshold({20: 1}, 1000, 0.01) is None and secrets.threshold({50: 1}, 1000, 0.01) == 50

    rows = spark.createDataFrame([(z,) for z in (0.0, 0.5, -1.0, 2.0, 3.0)], "z double").select("z", secrets.two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - erfc(abs(r.z) / sqrt(2))) < 5e-4 for r in rows)
    p = spark.range(1).select(secrets.combined(F.lit(0.5), F.lit(0.1), F.lit(0.9)).alias("p")).head().p
    x = -log(0.5 * 0.1 * 0.9)
    assert abs(p - exp(-x) * (1 + x + x * x / 2)) < 1e-12


def plain_battery(token):
    """The three tests, Fisher's p-value and the likelihood ratio, one string at a time; normal tails by the operator's formula,
    whose error has a test of its own."""
    from math import exp, log, log10, sqrt

    body = token.rstrip("=")
    sets = [("[0-9]+", 10), ("[0-9a-f]+|[0-9A-F]+", 16), ("[a-z]+|[A-Z]+", 26), ("[A-Z2-7]+", 32), ("[a-z0-9]+|[A-Z0-9]+", 36)]
    k, n = next((k for p, k in sets if re.fullmatch(p, body)), 64), len(body)
    order = lambda c: ord(c) - 48 if c.isdigit() else ord(c) - 87 if c.islower() else ord(c) - 29 if c.isupper() else 62 + ord(c) % 2
    p = [float(order(c)) for c in body]
    chi, df = sum(body.count(c) ** 2 for c in set(body)) * k / n - n, k - 1
    uniform = (max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))
    z = [uniform / sqrt(2 / (9 * df))]
    high = [x > sorted(p)[(n + 1) // 2 - 1] for x in p]
    n1 = sum(high)
    mean = 2 * n1 * (n - n1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z.append((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / sqrt(var) if var > 0 else 99.0)
    mid = sum(p) / n
    spread = sum((x - mid) ** 2 for x in p)
    z.append(sum((a - mid) * (b - mid) for a, b in zip(p, p[1:])) / spread * sqrt(n) if spread > 0 else 99.0)
    tail = [2 / (1 + exp(min(700, 1.5976 * a + 0.07056 * a**3))) for a in (min(abs(x), 30.0) for x in z)]
    half = -sum(log(max(x, 1e-300)) for x in tail)
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]
    word = sum(log10((0.95 if a == b else 0.05 / 3) / (26, 26, 10, 4)[b]) for a, b in zip(kind, kind[1:]))
    return exp(-half) * (1 + half + half * half / 2), max(0.0, -(n - 1) * log10(k) - word)


def test_random_strings_are_told_from_words_as_by_a_plain_battery(spark):
    rng = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["configuration", "Interface", "management", "request", "Handler", "document", "version", "2024", "default", "translation"]
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    planted = [draw(chars, n) for n in (24, 40, 40, 80, 200)] + [draw("0123456789abcdef", n) for n in (40, 64, 64)]
    natural = [draw("a", 30), "ab" * 20, "0123456789" * 3, "x" * 500]
    while len(natural) < 150:
        natural.append(("".join if len(natural) % 2 else "_".join)(rng.sample(words, 4))[: rng.randrange(20, 40)])
    tokens = planted + natural
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(tokens)], "doc_id long, text string")
    tested = {r.i: r for r in secrets.battery(spark.createDataFrame(list(enumerate(tokens)), "i long, kept string")).collect()}
    taken, bands = set(), {}
    for i, t in enumerate(tokens):
        p, bound = plain_battery(t)
        assert tested[i].p_random == pytest.approx(p, abs=1e-9) and tested[i].word_bound == pytest.approx(bound, abs=1e-6), t
        e = bound - math.log10(secrets.ALPHABETS) if tested[i].p_random >= 0.001 else -1
        bands.setdefault(max(b for b in secrets.BANDS if b <= max(len(t.rstrip("=")), 20)), []).append((min(math.floor(e * 10), secrets.CELLS) / 10, i))
    for own in bands.values():
        own.sort(reverse=True)
        fits = [k for k in range(1, len(own) + 1) if own[k - 1][0] >= math.log10(len(own) / (k * 0.01))]
        taken |= {i for _, i in own[: max(fits, default=0)]}
    got = {r.doc_id for r in secrets.scan(df).where("spans like '%random%'").collect()}
    assert got == taken and taken >= set(range(5)) and not {i for i in taken if i >= len(planted)}
