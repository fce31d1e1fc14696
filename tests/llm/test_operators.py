"""The operators against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmurate.llm import blocks, decontaminate, language, licenses, neardup, neighbours, packing, pii, quality, scoring, warc
from murmurate.llm.queries import VOCABULARY
from murmurate.session import work_path

ODD = [None, "", " ", "\n\t ", "a", "é", "😀 x", "same", "same", "x" * 70_000, "word " * 20_000, "1" * 50_000]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id long, label string, token string, words string, gone long, found_id long, place long, part long, kept string, n long"


def frame(spark, texts, lang="en"):
    rows = [(k, x, lang, "s", len(x or "")) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(df):
    """The same rows with extra columns under names that the operators use inside."""
    for name in CLASHING.split(", "):
        df = df.withColumn(name.split()[0], F.lit(1).cast(name.split()[1]))
    return df


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))


# --- blocks


def test_words_and_shingles_follow_plain_python():
    rng = random.Random(1)
    texts = [None, "", " a", "A a\x0bb  ", "é É", *("".join(rng.choices("ab \n\té", k=rng.randint(0, 40))) for _ in range(200))]
    import pyarrow as pa

    of = {}
    for _, data, offsets in blocks.blocks(pa.array(texts)):
        hashes, begins = blocks.words(data, offsets)
        for k, text in enumerate(texts):
            plain = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
            own = hashes[begins[k] : begins[k + 1]].tolist()
            assert len(own) == len(plain)
            for word, number in zip(plain, own, strict=True):
                assert of.setdefault(word, number) == number
            pairs = set(zip(plain, plain[1:], strict=False)) if len(plain) > 1 else {tuple(plain)} - {()}
            assert len(blocks.shingles(np.array(own, np.uint64), 2)) == len(pairs)
    assert len(set(of.values())) == len(of)


def test_blocks_are_bounded_and_whole():
    import pyarrow as pa

    texts = ["x" * 700_000, "y" * 700_000, "z" * 3_000_000, "", None, "w"]
    seen = []
    for first, data, offsets in blocks.blocks(pa.array(["cut", *texts]).slice(1)):
        assert len(offsets) == 2 or len(data) <= blocks.BLOCK
        seen += [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert seen == [x or "" for x in texts]


# --- language (1)


def test_language_learns_apart_and_defines_odd_texts(spark):
    rng = random.Random(2)
    alphabets = {"en": "etaoinsh", "de": "enisratdß", "fr": "esaitnruéè", "es": "eaosrniñ", "xx": "qwzkpv"}
    rows = [(k, prose(rng, 60, alphabets[lang]), lang, "s", 0) for k, lang in enumerate(list(alphabets) * 40)]
    rows += [(1000 + k, x, None, None, 0) for k, x in enumerate([None, "", "123 !!", "+"])]
    docs = clashing(spark.createDataFrame(rows, DOCUMENTS).drop("n_chars"))
    model = language.fit(docs, F.col("doc_id") % 4 != 2)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows)
    held = [(r[2], found[r[0]]["lang_pred"]) for r in rows if r[0] < 1000 and r[0] % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 for k in range(1000, 1004))
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_or_with_one_label(spark):
    docs = frame(spark, ["abc def", None], None)
    assert language.fit(docs) is None
    assert [r["lang_pred"] for r in language.identify(docs, None).collect()] == ["und", "und"]
    one = frame(spark, ["abc def", "ghi jkl"], "en")
    assert {r["lang_pred"] for r in language.identify(one, language.fit(one)).collect()} == {"en"}
    assert language.identify(one.limit(0), language.fit(one)).count() == 0


def test_family_precedes_pair():
    assert language.family("de") == language.family("en-GB") == "germanic"
    assert language.family("zz") == "zz"


# --- decontamination (2)


def plain_matches(texts, items):
    """Best similarity of each document and item over windows at common shingles."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    out = {}
    for i, item in items.items():
        words = cut(item)
        n = min(5, len(words))
        if not n:
            continue
        own = Counter(runs(words, n))
        for d, text in texts.items():
            doc = cut(text)
            for start in range(-len(words), len(doc)):
                window = Counter(runs(doc[max(0, start) : max(0, min(len(doc), start + len(words)))], n))
                common = sum((window & own).values())
                if common:
                    s = common / (sum(window.values()) + sum(own.values()) - common)
                    if s >= 0.8:
                        out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    items = {k: prose(rng, rng.randint(12, 40)) for k in range(12)} | {100: "one two three", 101: "", 102: None, 103: items_long(rng)}
    texts = {}
    for d in range(60):
        words = prose(rng, rng.randint(0, 80)).split()
        if d % 3 == 0:
            passage = items[rng.randrange(12)].split()
            if d % 2:
                passage[rng.randrange(len(passage))] = "changed"
            if d % 5 == 0:
                passage = passage[1:]
            at = rng.randint(0, len(words))
            words[at:at] = [w.title() + "," if rng.random() < 0.2 else w for w in passage]
        texts[d] = " ".join(words)
    texts |= {200: "One, two; THREE!", 201: "one two three four", 206: "before one two three after " + "more " * 20, 202: None, 203: "", 204: items[103].upper(), 205: "!!!"}
    docs = clashing(spark.createDataFrame([(d, t, "en") for d, t in texts.items()], "doc_id long, text string, lang string"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, n_words int")
    expected = plain_matches(texts, items)
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(docs, bench).collect()}
    assert {(200, 100), (201, 100), (206, 100)} <= set(expected) and (204, 103) in expected and len(expected) > 10
    assert set(found) == set(expected)
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in found)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == set(texts) - {d for d, _ in expected}


def items_long(rng):
    return prose(rng, 400)


def test_decontamination_of_repeated_and_null_ids_and_empty_tables(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + passage), (1, "x " + passage), (1, "clean text"), (None, passage), (None, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, passage), (None, "clean")], "item_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["item_id"], r["first_word"]) for r in decontaminate.matches(docs, bench).collect()))
    assert found == [(0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 2, 1)]
    assert sorted(r["text"] for r in decontaminate.clean(docs, bench).collect()) == ["clean", "clean text"]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_blocks_cover_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        rows.append((k, signed(a), signed(b)))
    df = spark.createDataFrame(rows, "k int, a long, b long")
    one = df.select("k", decontaminate._blocks(F.col("a"), True).alias("at"))
    two = df.select("k", decontaminate._blocks(F.col("b"), False).alias("at"))
    assert one.join(two, ["k", "at"]).select("k").distinct().count() == 300


# --- personal data (3)

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_pii_base_equals_the_plain_patterns():
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789..@@++- ()ab%é", k=rng.randint(0, 60))) for _ in range(6000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (499) 555-6503", "000255.1.1.1", "1.2.3.4.", "x@-.-", "a@b..c", "++12345678", "@a.b"]
    texts += ["".join(rng.choices("01234567 -", k=24)) for _ in range(3000)] + ["9" * 5000, "a" * 5000 + "@", "+1" + " " * 5000]
    for text in texts:
        found = pii.spans(text)
        assert {k: found[k] for k in pii.BASE} == plain_spans(text), text


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("account no. 12345-678 with 5 items", "account", ["12345-678"]),
        ("Account number: GB29 NWBK 6016 1331 9268 19, then", "account", ["GB29 NWBK 6016 1331 9268 19"]),
        ("account 1234 and myaccount 123456", "account", []),
        ("passport AB1234567 issued", "account", ["AB1234567"]),
        ("password: hunter2hunter2; secret", "secret", ["hunter2hunter2;"]),
        ("the token ring is a token of thanks", "secret", []),
        ("api_key='abcdefgh12'", "secret", ["abcdefgh12"]),
        ("ftp://u:p@h.org x://y", "login", ["u:p"]),
        ("account " + "1" * 100_000, "account", ["1" * 100_000]),
    ],
)
def test_pii_cues(text, kind, found):
    assert [text[a:b] for a, b in pii.spans(text)[kind]] == found


def test_pii_rows_and_masks(spark):
    text = "mail é@x a.b@c.de, IBAN: DE89370400440532013000 token = \"1eb9c654e721b4f8\" http://me:pw@host.org/ 10.0.0.1"
    docs = clashing(frame(spark, [*ODD, text]))
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(rows[k]["base_sha256"] == empty and rows[k]["spans"] == "" for k in range(len(ODD)))
    last = rows[len(ODD)]
    assert (last["n_email"], last["n_ip"], last["n_account"], last["n_secret"], last["n_login"]) == (2, 1, 1, 1, 1)
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in masked.select("doc_id", "text").collect()}
    assert [out[k] for k in range(len(ODD))] == ODD
    assert out[len(ODD)] == 'mail é@x [EMAIL], IBAN: [ACCOUNT] token = "[SECRET]" http://[LOGIN]/ [IP]'
    for secret in ("a.b@c.de", "DE89370400440532013000", "1eb9c654e721b4f8", "me:pw", "10.0.0.1"):
        assert secret not in out[len(ODD)]
    assert pii.find(docs.limit(0)).count() == 0


# --- nearest neighbours (4)


def plain_nearest(vectors, ids, k):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for q in sorted(i for i in ids if i % 20 == 0):
        at = ids.index(q)
        score = x @ x[at]
        rest = [j for j in range(len(ids)) if ids[j] != q]
        rest.sort(key=lambda j: (-score[j], ids[j]))
        out[q] = [(ids[j], score[j]) for j in rest[:k]]
    return out


def test_neighbours_find_all_of_a_small_table_with_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)).round(1)
    x[:120] = x[0]  # a large group of equal vectors
    x[150:170] = 3 * x[150]
    ids = list(range(300))
    odd = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [None] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8)]
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + odd + [(0, [float(c) for c in x[0]])] * 2
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    expected = plain_nearest(x, ids, 20)
    assert set(found) == set(expected)
    for q in expected:
        assert [v for v, _ in found[q]] == [v for v, _ in expected[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in expected[q]], rtol=1e-12)
    doubles = spark.createDataFrame([(k, [1 + k * 1e-12, 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    best = neighbours.nearest(doubles, F.col("vec_id") % 20 == 0, k=3).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in best] == [39, 38, 37] and best[0]["score"] == 2 + 39e-12
    few = df.where("vec_id < 3")
    assert neighbours.nearest(few, F.col("vec_id") % 20 == 0).count() == 2
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall_without_verifying_all():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32)).astype(np.float32) * rng.uniform(0.5, 2, size=(6000, 1)).astype(np.float32)
    ids, queries = np.arange(6000), x[:40]
    hits = 0
    for q, rows, _ in neighbours.search(x, ids, queries, 21, share=0.12):
        hits += len(set(np.argsort(-(x.astype(float) @ queries[q].astype(float)))[:21]) & set(rows))
    assert hits / (40 * 21) >= 0.9


@pytest.mark.parametrize(("dimensions", "norms"), [(64, "lognormal"), (64, "one long"), (128, "uniform"), (256, "equal"), (768, "equal")])
def test_neighbours_recall_of_the_query_on_unequal_norms_and_many_dimensions(dimensions, norms):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(neighbours.BLOCK, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one long":
        x[7] *= 3
    elif norms != "equal":
        x *= rng.lognormal(0, 0.5, (len(x), 1)) if norms == "lognormal" else rng.uniform(0.5, 2, (len(x), 1))
    x = x.astype(np.float32)
    queries, hits = x[100:130], 0
    for q, rows, _ in neighbours.search(x, np.arange(len(x)), queries, 21):
        hits += len(set(np.argsort(-(x.astype(float) @ queries[q].astype(float)))[:21]) & set(rows))
    assert hits / (len(queries) * 21) >= 0.9


@pytest.mark.parametrize(("kind", "n", "most"), [("clustered", 500, 0.4), ("clustered", 2000, 0.25), ("clustered", 50_000, 0.25), ("unstructured", 500, 0.8), ("unstructured", 2000, 0.6), ("unstructured", 50_000, 0.4)])
def test_neighbours_verify_a_part_at_every_size(monkeypatch, kind, n, most):
    """Blocks of any size are searched by collisions; counted are the vectors that are verified."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(n // 125, 64))[rng.integers(0, n // 125, n)] + 0.1 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    counted, verified = [], neighbours._Group.verified

    def counting(self, *args):
        out = verified(self, *args)
        counted.append(len(out[0]))
        return out

    monkeypatch.setattr(neighbours._Group, "verified", counting)
    hits = done = 0
    for first in range(0, n, neighbours.BLOCK):
        block = x[first : first + neighbours.BLOCK]
        for q, rows, _ in neighbours.search(block, np.arange(len(block)), x[:20], 21):
            hits += len(set(np.argsort(-(block.astype(float) @ x[q].astype(float)))[:21]) & set(rows))
            done += 21
    assert hits / done >= 0.9
    share = sum(counted) / (20 * n)
    assert share <= most


@pytest.mark.parametrize("lines", [1, 5, 128])
def test_neighbours_count_collisions_in_bits_as_one_by_one(lines):
    rng = np.random.default_rng(19)
    windows = rng.random((lines, 192)) < 0.6
    for threshold in {1, (lines + 1) // 2, int(np.ceil(0.6 * lines)), lines}:
        found = neighbours._reached(np.packbits(windows, axis=1).view(np.uint64), threshold)
        assert found.tolist() == np.flatnonzero(windows.sum(axis=0) >= threshold).tolist()


def test_neighbours_windows_leave_out_none_within_them():
    rng = np.random.default_rng(23)
    for n in (2, 100, 1000):  # fewer vectors than runs, and vectors that do not fill the last word
        x = rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lines = rng.normal(size=(17, 40)).astype(np.float32)
        asked = np.hstack([x[:2], np.zeros((2, 1))]).astype(np.float32)
        group = neighbours._Group(np.arange(n), x, 1.0, asked, lines, 24)
        numbers = neighbours._padded(x.astype(np.float32), 1.0) @ lines
        for half in (0.1, 0.8, 9.0):
            inside = np.abs(numbers - (asked @ lines)[1]) <= half - 1e-4
            assert set(np.flatnonzero(inside.sum(axis=1) >= 24)) <= set(group._colliding(1, half).tolist()) <= set(range(n))


def test_neighbours_with_a_floor_count_once_and_find_what_reaches_it(monkeypatch):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, first, other = np.arange(4000), x[:2000], x[2000:]
    queries = np.concatenate((first[:20], other[:20]))
    floors = np.array([values[-1] for _, _, values in neighbours.search(first, ids[:2000], queries, 21)])
    floors[5] = -np.inf  # of this one nothing is known
    counted, colliding = [], neighbours._Group._colliding

    def counting(self, q, half):
        counted.append(q)
        return colliding(self, q, half)

    monkeypatch.setattr(neighbours._Group, "_colliding", counting)
    hits = due = 0
    for q, rows, values in neighbours.search(other, ids[2000:], queries, 21, floors=floors):
        score = other.astype(float) @ queries[q].astype(float)
        assert np.allclose(values, score[rows], rtol=1e-12) and list(values) == sorted(values, reverse=True)
        assert (values >= floors[q]).all()
        expected = [r for r in np.argsort(-score)[:21] if score[r] >= floors[q]]
        hits, due = hits + len(set(expected) & set(rows)), due + len(expected)
        assert q != 5 or len(rows) == 21
    assert hits / due >= 0.9
    assert all(counted.count(q) == 1 for q in range(len(queries)) if q != 5)
    # what cannot reach the floor is not searched
    counted.clear()
    assert [len(rows) for _, rows, _ in neighbours.search(0.1 * other, ids[2000:], queries[:5], 21, floors=floors[:5])] == [0] * 5
    assert not counted


def test_neighbours_of_many_blocks_and_two_dimensions(spark):
    rng = np.random.default_rng(37)
    x = {100 + i: v for i, v in enumerate(rng.normal(size=(1500, 16)).astype(np.float32))}
    x |= {5000 + i: v for i, v in enumerate(rng.normal(size=(40, 8)).astype(np.float32))}  # too few in the first block for a floor
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in x.items()], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=300).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        score = {i: float(v.astype(float) @ x[q].astype(float)) for i, v in x.items() if len(v) == len(x[q]) and i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert np.allclose([s for _, s in rows], [score[i] for i, _ in rows], rtol=1e-12)
        hits += len(set(best) & {i for i, _ in rows})
        assert q < 5000 or [i for i, _ in rows] == best
    assert hits / (20 * len(found)) >= 0.9


@pytest.mark.parametrize("dimensions", [3, 64, 768])
def test_neighbours_single_precision_leaves_out_none_that_reach_the_floor(dimensions):
    rng = np.random.default_rng(43)
    x = rng.normal(size=(500, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.hstack([x[:100], np.zeros((100, 1))]).astype(np.float32)
    group = neighbours._Group(np.arange(500), x, 1.0, asked, rng.normal(size=(dimensions + 1, 40)).astype(np.float32), 24)
    for q in (0, 70, 99, 3):  # of more than one batch
        cosine = x @ x[q]
        for least in np.sort(cosine)[[-1, -21, 250]]:
            kept = set(group._reaching(q, np.arange(500), least).tolist())
            assert set(np.flatnonzero(cosine >= least)) <= kept <= set(np.flatnonzero(cosine >= least - 1e-3))


def test_neighbours_make_no_copy_of_a_block_for_each_block_of_queries(spark, monkeypatch):
    """With many blocks of queries the copies of the first block were broadcast, which failed at size; copies of the others were shuffled."""
    monkeypatch.setattr(neighbours, "FIRST", 1)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    x = np.random.default_rng(41).normal(size=(3000, 64)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "48m")
    try:
        found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=1500).collect()
    finally:
        spark.conf.set(limit, before)
    best = plain_nearest(x, list(range(3000)), 20)
    assert len(found) == 20 * len(best)
    assert sum(r["vec_id"] in {v for v, _ in best[r["query_id"]]} for r in found) / len(found) >= 0.9


# --- WARC (5)


def plain_records(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    return first


def test_warc_round_trip(spark):
    rows = [(k, f"http://x/{k}", None if k % 7 == 0 else f"<p>é{k % 5}\r\n\r\nWARC/1.1\r\n</p>" * (k % 11)) for k in range(120)]
    rows += [(500, None, "alone"), (501, "http://a b\r\nX: y", "two"), (None, "n", "two"), (None, "n", "unseen"), (501, "http://a b", "two")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = work_path(spark, "warc")
    manifest = warc.write(pages, folder, shard_bytes=4000, roll=600).collect()
    assert len(manifest) > 8 and len({m["name"] for m in manifest}) == len(manifest) and sum(m["records"] for m in manifest) == len(rows)
    first = plain_records(rows)
    found = warc.read(spark, folder).collect()
    assert len(found) == len(rows)
    seen = Counter()
    by_page = Counter((i, html or "") for i, _, html in rows)
    for r in found:
        if r["record_type"] == "response":
            html = r["payload"].decode()
            assert r["payload_bytes"] == len(r["payload"]) and r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
            assert first.get(html) == r["page_id"]
            assert r["refers_to"] is None
            seen[r["page_id"], html] += 1
        else:
            html = next(x for x in first if base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() == r["payload_digest"])
            assert r["payload_bytes"] == len(html.encode()) and r["refers_to"] == first[html]
            seen[r["page_id"], html] += 1
    assert seen == by_page
    ids = [[r["page_id"] for r in _file(folder, m["name"])] for m in sorted(manifest, key=lambda m: m["name"])]
    flat = [i for part in ids for i in part if i is not None]
    assert flat == sorted(flat)


def _file(folder, name):
    data = open(f"{folder}/{name}", "rb").read()
    return [{"page_id": warc._page(h["warc-record-id"])} for h, _ in warc.parse(gzip.GzipFile(fileobj=io.BytesIO(data)))]


def test_warc_is_deterministic_and_keeps_small_payloads(spark):
    pages = spark.createDataFrame([(k, "u", "x" * (k % 3)) for k in range(40)], "page_id long, url string, html string")
    one, two = work_path(spark, "warc"), work_path(spark, "warc")
    a = sorted(map(tuple, warc.write(pages, one, least=2, shard_bytes=5000).collect()))
    b = sorted(map(tuple, warc.write(pages.repartition(7), two, least=2, shard_bytes=5000).collect()))
    assert a == b
    kinds = Counter((r["payload_bytes"], r["record_type"]) for r in warc.read(spark, one).collect())
    assert kinds == {(0, "response"): 14, (1, "response"): 13, (2, "response"): 1, (2, "revisit"): 12}
    empty = work_path(spark, "warc")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


@pytest.mark.parametrize("kind", ["outlier", "hot id", "negative", "even"])
def test_warc_shards_are_bounded_whatever_the_ids_are(spark, kind):
    rng = random.Random(19)
    ids = {"outlier": [*range(400), 1 << 60, -(1 << 62)], "hot id": [7 if k % 3 == 0 else k for k in range(400)], "negative": [-5 * k for k in range(400)], "even": list(range(400))}[kind]
    rows = [(i, f"u{k}", "".join(rng.choices("ab<>", k=1000))) for k, i in enumerate(ids)]
    folder = work_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shard, n = warc._shards(pages.select("*", F.length("html").cast("long").alias("size"), F.sha1("html").alias("sha1_hex")), 20_000, 64)
    dealt = pages.select("page_id", F.sha1("html").alias("sha1_hex")).select("page_id", "sha1_hex", shard.alias("shard")).orderBy("page_id", "sha1_hex").collect()
    filled = Counter(r["shard"] for r in dealt)
    assert max(filled.values()) * 1512 <= 2 * 20_000 and len(filled) >= 400 * 1512 / 40_000 and max(filled) < n
    assert [r["shard"] for r in dealt] == sorted(r["shard"] for r in dealt)
    warc.write(pages, folder, shard_bytes=20_000)
    found = warc.read(spark, folder).select("page_id", "payload").collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found) == sorted((i, html) for i, _, html in rows)


# --- packing (6)


def test_packing_cuts_the_ids_of_the_tokenizer(spark):
    rng = random.Random(8)
    texts = [*ODD, *(prose(rng, rng.randint(0, 400)) for _ in range(60)), "<|endoftext|> x", "a'll b    c\n\n d"]
    docs = clashing(frame(spark, texts)).repartition(5)
    pieces = packing.pack(docs, VOCABULARY, public_tokenizers.PATTERN, window=256).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*plain.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for k, own in enumerate(ids):
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p["start"]):
            part = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
            assert p["start"] == at and part == own[at : at + p["length"]] and p["doc_tokens"] == len(own)
            at += p["length"]
        assert at == len(own)
    total = sum(map(len, ids))
    assert sorted(by_sequence) == list(range(-(-total // 256)))
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == min(256, total - 256 * s)
    assert packing.pack(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", [" " * 5_000_000 + "x", "a" * 5_000_000, "7" * 5_000_000, "\n" * 5_000_000], ids=["blanks", "letters", "digits", "lines"])
def test_packing_of_very_long_texts(spark, text):
    pieces = packing.pack(frame(spark, [text, "x"]), VOCABULARY, public_tokenizers.PATTERN).where("doc_id = 0").orderBy("start").collect()
    ids = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces), "<u4").tolist() == [*ids, 1]


# --- cross-entropy (7)


def test_scoring_prefers_the_target_and_counts_everything(spark):
    rng = random.Random(9)
    texts = [prose(rng, 80, "abc") if k % 2 else prose(rng, 80, "xyz") for k in range(80)] + [None, ""]
    docs = clashing(frame(spark, texts))
    target = (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 40)
    table = scoring.counts(docs, target)
    sums = {r["gram_order"]: (r["t"], r["a"]) for r in table.groupBy("gram_order").agg(F.sum("in_target").alias("t"), F.sum("in_all").alias("a")).collect()}
    for order in range(1, scoring.ORDER + 1):
        size = lambda k: max(0, len((texts[k] or "").encode()) - order + 1)  # noqa: B023, E731
        assert sums[order] == (sum(size(k) for k in range(40) if k % 2), sum(map(size, range(len(texts)))))
    found = {r["doc_id"]: r for r in scoring.score(docs, scoring.fit(docs, target)).collect()}
    # texts that neither model has as target
    assert min(found[k]["score"] for k in range(41, 80, 2)) > max(found[k]["score"] for k in range(40, 80, 2)) and found[40]["score"] < 0
    assert found[80]["score"] == found[81]["score"] == 0 and found[80]["n_tokens"] == 0


def test_scoring_equals_a_plain_model(spark):
    rng = random.Random(10)
    texts = [prose(rng, 30, "abcde") for _ in range(12)]
    docs = frame(spark, texts)
    found = {r["doc_id"]: r for r in scoring.score(docs, scoring.fit(docs, F.col("doc_id") < 5, bits=22)).collect()}

    def model(members):
        count = Counter()
        for k in members:
            for order in range(1, scoring.ORDER + 1):
                count.update(texts[k][i : i + order] for i in range(len(texts[k]) - order + 1))
        mass = sum(v for g, v in count.items() if len(g) == 1)

        def loss(text):
            total = 0.0
            for i in range(len(text)):
                chance = scoring.WEIGHTS[-1] / 256
                for order in range(1, scoring.ORDER + 1):
                    gram = text[i - order + 1 : i + 1] if i >= order - 1 else None
                    context = mass if order == 1 else count[gram[:-1]] if gram else 0
                    chance += scoring.WEIGHTS[order - 1] * (min(1, count[gram] / context) if gram and context else 1 / 256)
                total -= math.log(chance)
            return total / len(text)

        return loss

    target, background = model(range(5)), model(range(12))
    for k, text in enumerate(texts):
        assert found[k]["target_loss"] == pytest.approx(target(text), rel=1e-4)
        assert found[k]["background_loss"] == pytest.approx(background(text), rel=1e-4)


def test_scoring_counts_every_distinct_gram_apart(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=50_000)) for _ in range(6)]
    docs = frame(spark, texts)
    table = scoring.counts(docs, F.col("doc_id") < 2)
    rows = {r["gram_order"]: r["count"] for r in table.groupBy("gram_order").count().collect()}
    for order in range(1, scoring.ORDER + 1):
        assert rows[order] == len({t[k : k + order] for t in texts for k in range(len(t) - order + 1)})
    # n-grams the model has not seen are scored by their shorter ends
    other = scoring.score(frame(spark, ["~~~~", texts[0][:40] + "é"]), scoring.fit(docs, F.col("doc_id") < 2)).collect()
    assert len(other) == 2 and all(math.isfinite(r["score"]) and r["target_loss"] > 0 for r in other)


def test_scoring_of_empty_tables(spark):
    docs = frame(spark, [])
    assert scoring.score(docs, scoring.fit(docs, F.lit(True))).count() == 0


# --- quality (8)


def test_quality_holds_out(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for k in range(300):
        words = prose(rng, rng.randint(20, 80)).split()
        bad = k % 3 == 0
        if bad:
            words = [w + "***" for w in words] if k % 2 else [words[0]] * len(words)
        texts.append(" ".join(words))
        labels.append((k, int(not bad), 0))
    labels += [(0, 1, 0), (None, 1, 0), (5, None, 0)]
    texts += [None, "", " "]
    docs, known = clashing(frame(spark, texts)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known, F.col("doc_id") % 5 != 1)
    found = {r["doc_id"]: r for r in quality.scores(docs, model).collect()}
    held = [k for k in range(300) if k % 5 == 1]
    assert sum(found[k]["predicted"] == int(k % 3 != 0) for k in held) / len(held) > 0.95
    assert found[300]["score"] == found[301]["score"] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found.values())
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, r in found.items() if r["predicted"]}
    assert quality.scores(docs.limit(0), model).count() == 0


def test_quality_table_is_the_average_of_its_slots():
    rng = np.random.default_rng(12)
    model = quality.Model(rng.normal(size=1 << 16).astype(np.float32), 0.3)
    import pyarrow as pa

    texts = ["one two two", "", "abc", "ab", "é é é", None, "two one"]
    together = np.concatenate([model.score(d, o) for _, d, o in blocks.blocks(pa.array(texts))])
    apart = np.concatenate([model.score(d, o) for x in texts for _, d, o in blocks.blocks(pa.array([x], pa.string()))])
    assert np.allclose(together, apart)


def test_quality_without_labels(spark):
    docs = frame(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.scores(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in quality.scores(docs, quality.fit(docs, one)).collect()] == [1, 1]


def test_quality_learns_from_six_thousand_rows(spark, monkeypatch):
    docs = spark.range(6100).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    known = spark.range(6100).select(F.col("id").alias("doc_id"), (F.col("id") % 7 != 0).cast("int").alias("quality"))

    def counted(batches, bits):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([b""]), pa.array([float(sum(len(b) for b in batches))])], ["numbers", "bias"])

    monkeypatch.setattr(quality, "_trained", counted)
    hot = docs.unionByName(spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("word 1").alias("text")))
    assert quality.fit(docs, known).bias == quality.fit(hot, known).bias == 6000


def test_language_draws_different_texts(spark, monkeypatch):
    """A third of all rows are copies; they are one text of the sample and one row for the driver."""
    rows = [(k, "same words here" if k % 3 == 0 else f"words {k}", "en" if k % 2 else "de") for k in range(600)]
    seen = []
    monkeypatch.setattr(language, "train", lambda x, lang: seen.append(Counter(lang.tolist())))
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=150)
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1000)
    assert seen == [{"en": 150, "de": 150}, {"en": 201, "de": 201}]


# --- near-duplicates (9)


def plain_components(rows, size, percent=80):
    sets = defaultdict(set)
    for k, (i, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(size, len(words))
        sets[k] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                parent[y] = x
    return {rows[k][0]: (len(sets[k]), rows[find(k)][0]) for k in range(len(rows))}


def near_rows(rng):
    rows = [(k, x) for k, x in enumerate(ODD)]
    passage = prose(rng, 15)
    for g in range(25):
        base = prose(rng, rng.randint(3, 60)).split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((len(rows), (" " if g % 2 else "\n").join(words) + (" " + passage if g % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(13)
    rows = near_rows(rng)
    rng.shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size).collect()}
    expected = plain_components(sorted(rows), size)
    assert found == expected
    kept = neardup.kept(docs, size)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(3, a), (3, b), (5, a), (4, b), (None, a), (None, a), (9, None), (9, None), (8, "alone here"), (8, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert found == {(3, 3, True): 2, (5, 3, False): 1, (4, 3, False): 1, (None, None, True): 2, (9, 9, True): 2, (8, 8, True): 2}
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.kept(docs).collect())
    assert kept == {(3, a): 1, (3, b): 1, (None, a): 2, (9, None): 1, (8, "alone here"): 1}
    ordinary = neardup.kept(clashing(docs))
    assert ordinary.columns == clashing(docs).columns and ordinary.count() == sum(kept.values())
    assert sorted(r["doc_id"] for r in neardup.kept(docs.where("doc_id IN (4, 5) OR text LIKE 'one%' AND doc_id = 3")).collect()) == [3, 4]
    assert {(r["doc_id"], r["text"]) for r in neardup.kept(docs.where("doc_id IN (4, 5) OR text LIKE 'seven%'")).collect()} == {(3, b), (5, a)}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.kept(docs.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(14)
    names = rng.sample(range(10_000), 400)
    edges = list(zip(names[:200], names[1:200], strict=False)) + list(zip(names[200:], names[201:], strict=False)) + [(names[0], names[5]), (7, 7)]
    found = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]}


def test_near_duplicates_take_few_tasks(spark):
    """Where shuffle partitions are many and not merged, each stage costs as many tasks, so stages decide the time of a small table."""
    partitions, settings = 29, {"spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows = near_rows(random.Random(13))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    before = {k: spark.conf.get(k) for k in settings}
    context, status = spark.sparkContext, spark.sparkContext.statusTracker()

    def rounds(name, run):
        context.setJobGroup(name, name)
        run()
        stages = {k for job in status.getJobIdsForGroup(name) for k in status.getJobInfo(job).stageIds}
        return sum(info.numCompletedTasks for info in map(status.getStageInfo, stages) if info) / partitions

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert rounds("star", lambda: neardup.components(star).count()) < 8
        assert rounds("near", lambda: neardup.near_duplicates(docs, 2).count()) < 55
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)


# --- licences (10)


def test_licences_equal_plain_phrases(spark):
    rng = random.Random(15)
    vocabulary = "under the mit license apache version 2 cc by nc Apache MIT, BY- x é"
    texts = [" ".join(rng.choices(vocabulary.split(), k=rng.randint(0, 30))) for _ in range(400)]
    texts += [*ODD, "UNDER the mit license", "under the\nMIT-License!", "cc by nc cc by nc", "K apache license, version 2", "(under the mit license)"]
    texts += ["Redistribution and use, in source and binary forms; with or without changes are permitted", "GNU General Public License", "This work is licensed under the GNU General Public License, version 3."]
    docs = clashing(frame(spark, texts))
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = rows[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), text
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[len(texts) - 3]["labels"] == "bsd" and 0.75 <= rows[len(texts) - 3]["score"] < 1
    assert rows[len(texts) - 2]["labels"] == "" and rows[len(texts) - 1]["labels"] == "gpl"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_crc_of_pieces_is_unsigned(spark):
    raw = np.array([1, 2, 3], "<u4").tobytes()
    assert spark.createDataFrame([(raw,)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(raw)
