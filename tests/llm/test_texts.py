import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import leakage, tokenizer
from tests.conftest import rows

TEXTS = [None, "", "   ", "Hello world, it's 12 o'clock!", "a\n\nb\r\n c\t  d e ", "<|endoftext|> plain", "ſtraße Ünïcode 漢字 emoji 👩‍🚀 ́x", "x" * 3000, "word " * 3000, " line\u0085sep\x1c.", "'S 'll don’t we've", " lead", "trail  \n"]


def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3])], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("words", F.lit(1))


def test_encode_equals_the_tokenizer(spark):
    enc, _ = tokenizer.load(tokenizer.DEFAULT_TOKENIZER)
    got = [(r["doc_id"], r["ids"]) for r in tokenizer.encode_corpus(docs(spark)).collect()]
    want = [(r["doc_id"], enc.encode_ordinary(r["text"] or "")) for r in docs(spark).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tokenizer.encode_corpus(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("stretches", [1, 100_000])
def test_random_texts_round_trip(spark, monkeypatch, stretches):
    monkeypatch.setattr(tokenizer, "STRETCHES", stretches)
    rng = random.Random(4)
    pool = "ab Z9.,'\n\t äß漢👍 　-_"
    data = [(f"d{k}", "".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for k in range(200)]
    enc, _ = tokenizer.load(tokenizer.DEFAULT_TOKENIZER)
    d = spark.createDataFrame(data, "doc_id string, text string")
    coded = tokenizer.encode_corpus(d, chunk_words=50)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {k: enc.encode_ordinary(t) for k, t in data}
    assert {r["doc_id"]: r["text"] for r in tokenizer.decode_corpus(coded, chunk_ids=70).collect()} == dict(data)


def test_decoding_any_ids(spark):
    enc, _ = tokenizer.load(tokenizer.DEFAULT_TOKENIZER)
    ids = enc.encode_ordinary("漢字 and 👍")
    data = [(1, ids), (2, []), (3, None), (None, ids), (1, ids), (4, [None, *ids, 10**9, -1]), (5, ids[:1])]
    got = tokenizer.decode_corpus(spark.createDataFrame(data, "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))).collect()
    want = ["漢字 and 👍"] * 4 + ["", "", bytes(enc.decode_single_token_bytes(ids[0])).decode("utf-8", "replace")]
    assert sorted(r["text"] for r in got) == sorted(want) and len(got) == 7
    assert tokenizer.decode_corpus(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_chunks_end_inside_batches(spark):
    d = spark.createDataFrame([(k, [f"w{x % 50}" for x in range(1 + 37 * k % 400)]) for k in range(3000)] + [(-1, ["long"] * 9000), (-2, [])], "doc long, words array<string>").coalesce(2)
    out = d.mapInArrow(tokenizer._chunked(pa.int64(), pa.string(), 5000), tokenizer._chunk_schema("string")).selectExpr("size(ends) docs", "size(at) n", "size(held) distinct").collect()
    assert sum(r["docs"] for r in out) == 3002 and sorted(r["n"] for r in out)[-2:] < [5001, 9001] and max(r["n"] for r in out) == 9000 and all(r["distinct"] <= 51 for r in out)


def test_pieces_never_exceed_the_limit():
    class Bad:  # a tokenizer whose pieces never come out shorter until they are as short as their bytes
        def encode_ordinary(self, t):
            return list(range(len(t.encode()))) if len(t.encode()) <= 40 else list(range(999))

    text, byte_len = "abc " * 300, np.ones(2000, np.int64)
    enc = Bad()
    enc.encode_ordinary, first = (lambda t, f=enc.encode_ordinary: list(range(1200)) if t == text else f(t)), None  # noqa: F841
    got = tokenizer.split_text(text, enc, byte_len, 40, 4)
    assert got and all(size <= 40 for _, size in got) and got[0][0] == text[: len(got[0][0])] and text.endswith(got[-1][0])


def test_split_pieces(spark):
    enc, _ = tokenizer.load(tokenizer.DEFAULT_TOKENIZER)
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 9))) for _ in range(9)) + rng.choice([". ", ".\n", ".\n\n", ", "])
    long = "".join(sentence() for _ in range(120))
    texts = [(1, long), (2, "kurz"), (3, None), (4, ""), (5, "漢" * 900), (6, "z" * 5000), (7, "👩‍🚀 " * 200)]
    out = tokenizer.split_oversized(spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit(0)), max_tokens=300, overlap=20)
    pieces = {}
    for r in out.orderBy("doc_id", "piece_no").collect():
        pieces.setdefault(r["doc_id"], []).append(r["piece"])
    tokens = {k: len(enc.encode_ordinary(t)) for k, t in texts if t}
    assert set(pieces) == {k for k, n in tokens.items() if n > 300}
    source = dict(texts)
    for k, ps in pieces.items():
        assert all(len(enc.encode_ordinary(p)) <= 300 for p in ps) and "�" not in "".join(ps)
        at = 0
        for a, b in zip(ps, ps[1:]):
            start = source[k].find(a, at)
            nxt = source[k].find(b, start + 1)
            assert start >= 0 and start < nxt <= start + len(a)
            assert len(enc.encode_ordinary(source[k][nxt : start + len(a)])) >= 15
            at = nxt
        assert ps[0] == source[k][: len(ps[0])] and source[k].endswith(ps[-1])
    assert all(p.endswith("\n\n") or p.endswith("\n") for p in pieces[1][:-1])
    with pytest.raises(ValueError):
        tokenizer.split_oversized(spark.createDataFrame(texts, "doc_id long, text string"), max_tokens=100, overlap=90)


def test_boundaries_and_range_maximum():
    raw = b"ab. cd\n\nef\ngh ij\xc3\xa4"
    got = tokenizer.boundary_strengths(raw, np.arange(len(raw)))
    assert got[3] == 3 and got[4] == 3 and got[8] == 5 and got[11] == 4 and got[13] == 2 and got[1] == 1 and got[17] == 0
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, 500)
    index = tokenizer.RangeMax(s)
    for _ in range(300):
        lo = int(rng.integers(0, 490))
        hi = int(rng.integers(lo, 500))
        want = max(range(lo, hi + 1), key=lambda k: (s[k], k))
        assert index.best(lo, hi) == (s[want], want)


WORDS = "der weite lehrer fiel auf die kleine wahl ehe sommer kommt frau verkaufte den kahn wege offen sind vermutlich stockte unerwartete untersuchung muhle strenge gasthaus kostbare anleihe brunnen ernte verein tuchtige neubau richter".split()


def passage(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "", "en", "er", "s"]) for _ in range(n)]


def noisy(rng, words):
    out = []
    for k, w in enumerate(words):
        if rng.random() < 0.12:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "c", w[i] + w[i]]) + w[i + 1 :]
        if rng.random() < 0.08 and len(w) > 4:
            w = w[:3] + "-\n" + w[3:]
        out.append(w.upper() if rng.random() < 0.05 else w)
        if k % 11 == 10:
            out.append("\nkaufe Fahrräder 5 Mark billig\n")
    return " ".join(out)


def test_leaks(spark):
    rng = random.Random(21)
    items = [passage(rng, 60) for _ in range(8)]
    other = lambda n: " ".join(passage(rng, n))
    shuffled = items[2][:40]
    rng.shuffle(shuffled)
    data = [
        (1, other(80) + " " + noisy(rng, items[0]) + " " + other(60)), (2, other(30) + " " + noisy(rng, items[1][10:45]) + other(30)), (3, other(40) + " ".join(shuffled) + other(40)), (4, other(50) + " ".join(items[3][:14]) + other(90)),
        (5, None), (6, ""), (7, other(3000)), (8, " ".join(items[4])), (9, other(20) + noisy(rng, items[5][:30]) + other(2000) + noisy(rng, items[6])),
    ]
    ev = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, passage string")
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("passage", F.lit("clash"))
    found = leakage.find_leaks(d, ev)
    assert rows(found, "item_id", "doc_id") == [(0, 1), (1, 2), (4, 8), (5, 9), (6, 9)]
    assert rows(leakage.without_leaks(d, found), "doc_id") == [(3,), (4,), (5,), (6,), (7,)]
    assert leakage.find_leaks(d.limit(0), ev).count() == 0 and leakage.find_leaks(d, ev.limit(0)).count() == 0


def test_leaks_in_any_script(spark):
    rng = random.Random(17)
    russian = "весной старый мельник продал лодку соседу потому что вода спала после долгого дождя и рынок опустел когда купцы ушли домой через широкий мост у реки".split()
    digits = [str(rng.randrange(10, 10_000)) for _ in range(60)]
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(60)]
    items = [(1, " ".join(russian)), (2, " ".join(digits)), (3, "".join(han)), (4, "kurz und klein " * 3), (5, "Ærlig Øl œuvre " + " ".join(passage(rng, 40)))]
    other = " ".join(passage(rng, 50))
    shifted = " ".join("".join(str((int(c) + 5) % 10) for c in w) for w in digits)
    data = [
        (1, other + " " + " ".join(russian[:14]) + "\nобъявление дня\n" + " ".join(russian[14:]).upper()), (2, other + shifted), (3, other + " " + ", ".join(digits[10:50])), (4, "".join(han[5:38]) + "。" + other),
        (5, "".join(han[5:20]) + other), (6, items[4][1].replace("Æ", "æ") + other), (7, "kurz und klein " * 900), (8, "x " * 60_000), (9, "весной старый мельник " + other),
    ]
    ev = spark.createDataFrame(items, "item_id long, passage string")
    found = leakage.find_leaks(spark.createDataFrame(data, "doc_id long, text string"), ev)
    assert rows(found, "item_id", "doc_id") == [(1, 1), (2, 3), (3, 4), (5, 6)]
    assert rows(found, "doc_id", "longest")[0] == (1, len("".join(russian[:14]))) or rows(found, "doc_id", "longest")[0][1] >= len("".join(russian[14:]))


def test_foreign_lines_of_any_length(spark):
    rng = random.Random(2)
    w = passage(rng, 44)
    d = spark.createDataFrame([(1, " ".join(w[:22]) + "\n" + "verkaufe billig 7 Pferde; " * 150 + "\n" + " ".join(w[22:])), (2, " ".join(w[22:]) + "\n" + " ".join(w[:22]))], "doc_id long, text string")
    found = leakage.find_leaks(d, spark.createDataFrame([(0, " ".join(w))], "item_id long, passage string")).collect()
    assert [(r["doc_id"], r["words"]) for r in found] == [(1, 44)]


def test_twenty_five_words(spark):
    rng = random.Random(3)
    w = passage(rng, 60)
    cut = lambda a, b: " ".join(passage(rng, 20)) + " | " + " ".join(w[a:b]) + " | " + " ".join(passage(rng, 20))
    bad = list(w)
    bad[10] = bad[10][:1] + "qq" + bad[10][2:]  # the first word misread
    d = spark.createDataFrame([(1, cut(10, 35)), (2, cut(10, 33)), (3, "zz " + " ".join(bad[10:35]) + " zz")], "doc_id long, text string")
    assert rows(leakage.find_leaks(d, spark.createDataFrame([(0, " ".join(w))], "item_id long, passage string")), "doc_id") == [(1,), (3,)]


def test_many_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    rng = random.Random(5)
    items = [(k, " ".join(passage(rng, 40))) for k in range(7)]
    d = spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string")
    assert rows(leakage.find_leaks(d, spark.createDataFrame(items, "item_id long, passage string")), "item_id", "doc_id") == [(k, k) for k in range(7)]


def brute_matches(items, texts, seed):
    out = set()
    for i, a in enumerate(items):
        for d, b in enumerate(texts):
            for p in range(len(a)):
                for t in range(len(b)):
                    if p and t and a[p - 1] == b[t - 1]:
                        continue
                    n = 0
                    while p + n < len(a) and t + n < len(b) and a[p + n] == b[t + n]:
                        n += 1
                    if n >= seed:
                        out.add((i, d, p, t, n))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "".join(chr(0x430 + k) for k in range(32)) + "abcdefghij", "".join(chr(0x4E00 + k) for k in range(900))])
def test_matches_against_brute_force(alphabet):
    rng = random.Random(1)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(6)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, texts = [text(14), text(9), ""], [text(40), None, text(25), "", text(3)]
    items, shard = leakage.Items([0, 1, 2], passages), leakage.SuffixArray(leakage.Letters(texts))
    got = leakage.matches(items, shard, shard.rank_of[items.letters.codes])
    begin = shard.letters.begin
    have = {(int(i), int(d), int(p), int(t - begin[d]), int(n)) for i, d, p, t, n in zip(*(got[c] for c in ("item", "text", "place", "pos", "letters")))}
    plain = lambda ts: ["".join(chr(leakage.fold_letter(c)) for c in t or "" if c != " ") for t in ts]
    seeds = [leakage.SEED_DENSE if d else leakage.SEED for d in items.dense]
    assert have == {x for i in range(3) for x in brute_matches([""] * i + [plain(passages)[i]], plain(texts), seeds[i]) if x[0] == i}
    suffixes = ["".join(map(chr, shard.codes[p : shard.letters.ends[shard.letters.text_of(p)]]))[: leakage.SEED] for p in shard.order]
    assert suffixes == sorted(suffixes) and len(suffixes) == len("".join(plain(texts)))


def test_letters_of_any_script():
    fold = lambda t: "".join(chr(c) if c else "|" for c in leakage.Letters([t]).codes)
    assert fold("Ärger, ſo 12½ e\u0301tude ﬁn") == "argerso12½etudefn|".replace("½", fold("½")[0])
    assert fold("Й й") == "ии|" and fold("œ Œ") == "œœ|" and fold("١٢") == "12|" and fold("漢字。") == "漢字|"
    assert len(leakage.Letters(["a\u0308u b"]).starts) == 2 and len(leakage.Letters(["漢字 ab"]).starts) == 3
