"""Token counts against the tokenizers library, periodic runs against a plain search."""

import hashlib
import random
import unicodedata
import zlib

import pytest
import regex

from graphloom.llm import periodic, queries, tokencount

PATH = queries.tokenizer_path("byte_bpe_50k.json")
STRANGE = [
    "a<|endoftext|>b <|endoftext|><|endoftext|>", "  \n\n x   y\t\tz  ", "don't I'LL we'll  '' 's", "日本語テスト 漢字 ՘x", "‘q’ 😀 　  x​x", "½ ² x² ᠎ ﷺ" * 9, "x" * 5000, " " * 4000, "\r\n \r\n\n a",
]


def library(text):
    return len(tokencount.counter(PATH).tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark, odd, none):
    rng = random.Random(3)
    letters = "ab cdé'sñ \n\t123.,;!()日́Ωж" + "  😀"
    texts = STRANGE + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokencount.token_counts(df, PATH, limit=20).collect():
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 20), texts[r.doc_id]
    out = tokencount.token_counts(odd, PATH).collect()
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text or "")) for r in odd.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in out])) == sorted(map(str, want))
    assert tokencount.token_counts(none, PATH).count() == 0


def test_proved_tokens_are_whole():
    proved = tokencount.whole_tokens(PATH)
    vocabulary = tokencount.counter(PATH).tokenizer.get_vocab_size()
    assert 0.95 * vocabulary < len(proved) < vocabulary and " the" in proved and "<|endoftext|>" not in proved
    assert all(library(x) == 1 for x in random.Random(1).sample(sorted(proved), 3000))


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    text = "don't  stop 123 the \n\n quick " * 50
    monkeypatch.setattr(tokencount, "SCAN", 100)
    assert tokencount.counter(PATH).count(text, True) == library(text)


def test_pattern_agrees_with_the_tokenizer_on_all_characters_it_is_used_for():
    pre = tokencount.counter(PATH).tokenizer.pre_tokenizer
    for c in [*range(0x1000), *range(0x1000, 0x110000, 7)]:
        if 0xD800 <= c < 0xE000 or c >= 0x240 and unicodedata.ucd_3_2_0.category(chr(c)) == "Cn":
            continue
        for s in ("a" + chr(c), "1" + chr(c), "!" + chr(c)):
            assert len(pre.pre_tokenize_str(s)) == len(tokencount.PIECES.findall(s)), hex(c)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokencount.whole_tokens(queries.tokenizer_path())


# -- 13 ---------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc_id, w):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    w = plant(doc_id, words_of(text))
    runs = plain_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def random_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        k = rng.choice([1, 2, 3, 9])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 5, 6, 30, 150]))]
        if w and rng.random() < 0.7:
            a, times = rng.randrange(len(w)), rng.randint(3, 10)
            p = 1 + (len(w) - a) // times
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
        out.append(rng.choice(["", " \n"]) + rng.choice([" ", "\t\n", "\x0b"]).join(w) + rng.choice(["", "  "]))
    return out


def test_runs_equal_a_plain_search(spark, odd, none):
    rows = list(enumerate(random_texts(5, 400)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    for i, text in rows:
        w = words_of(text)
        runs = plain_runs(w)
        assert [tuple(r) for r in found[i].runs] == runs, w
        drop = {x for s, n, q in runs for x in range(s + q, s + n)}
        assert found[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in drop)
    assert periodic.periodic_runs(odd).count() == odd.count() and periodic.periodic_runs(none).count() == 0


def test_words_whose_polynomial_hashes_meet_are_told_apart(spark):
    """Words that agree in any polynomial hash modulo 2**64 are different words."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, " ".join([a, b] * 8)), (2, " ".join([a] * 8))], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(df).collect()} == {1: [(0, 16, 2)], 2: [(0, 8, 1)]}


def test_query_plants_repeats_and_digests(spark, odd, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(random_texts(6, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str(plain_digest(r.doc_id, r.text)) for r in docs.collect())
    counts = queries.op11_whole_token_counts(spark, str(tmp_path)).collect()
    assert len(counts) == docs.count() and all(r.over_limit == (r.n_tokens > 512) for r in counts)


def test_words_whose_polynomial_hashes_meet_keep_their_ids():
    """Thue-Morse words of 1,024 letters agree in every polynomial hash modulo 2**64."""
    import numpy as np

    from graphloom.llm import sstable

    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    encoder = sstable.CachedEncoder(queries.tokenizer_path())
    raw = f"{a} {b} {b.upper()} x".encode()
    ids, n = encoder.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == encoder.tokenizer.encode(raw.decode(), add_special_tokens=False).ids and n.tolist() == [len(ids)]
