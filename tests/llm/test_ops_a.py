"""Exact dedup, secrets, packing, language, mixing: brute force, edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weaksift.llm import exact, language, mixing, packing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, h long, level int, size string, _row string, _sha int, taken int"


def docs(spark, rows):
    """(doc_id, text[, lang, source]) with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "x", 7, 1, "s", "r", 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " "), (None, "abc"), (None, "ABC"), (5, "abc"), (5, "abc"), (6, "É"), (7, "é"), (8, "x" * 50_000)]


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_dedup_brute_force(spark, block):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("aAb") for _ in range(rnd.choice([0, 1, 3, 4, 7, 12])))) for i in range(300)] + ODD
    rows += [(1000 + i, "Hot copy of many rows") for i in range(200)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    expected, stays = [], set()
    for i, t in rows:
        own = groups[lower(t)]
        top = max((x for x in own if x is not None), default=None)
        kept = i == top and lower(t) not in stays
        stays |= {lower(t)} if kept else set()
        expected.append((i, top, len(own), kept, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert rows_of(exact.exact_dedup(docs(spark, rows), block)) == sorted(expected, key=repr)


def test_exact_dedup_empty_and_stage(spark):
    assert exact.exact_dedup(docs(spark, [])).count() == 0
    left = exact.exact_stage(docs(spark, ODD))
    assert left.columns == docs(spark, []).columns
    assert Counter(lower(r["text"]) for r in left.collect()) == Counter({lower(t) for _, t in ODD})


def brute_spans(text):
    text = text or ""
    found = []
    for kind, pattern in (("assign", secrets.ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                found.append((m.start(), ["assign", "access", "hex"].index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


def test_secrets_base_spans(spark):
    rnd = random.Random(2)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "abcdefghijklmnop", "short", "AKIA", "ABCD1234EFGH5678",
            "0123456789abcdef", "é", "😀", "\n", "secret=token: abcdefghijklmnop"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(400)] + ODD
    rows.append((9999, "token=abcdefghijklmno " * 3000))
    got = {}
    for r in secrets.scan_secrets(docs(spark, rows)).collect():
        got.setdefault((r["doc_id"], r["base_sha256"]), []).append(r)
    for i, t in rows:
        base = brute_spans(t)
        r = got[(i, hashlib.sha256(",".join(base).encode()).hexdigest())].pop()
        counts = Counter(b.split(":")[0] for b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(counts[k] for k in ("assign", "access", "hex"))
        assert set(base) <= set(r["spans"].split(",")) | {""}
    assert not any(got.values())


def test_secrets_weak_parts_need_company(spark):
    weak = "kJ8sQ2mPz7Lw4Xc9Vb1NtR5yH3"
    texts = [weak, f"user: anna {weak}", "user: anna", f"user: anna {'x ' * 300}{weak}", f"https://db.example.com user=anna pass {weak}", "https://a.example.com"]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs(spark, list(enumerate(texts)))).collect()}
    assert got[0] == got[2] == got[3] == got[5] == ""
    assert [s.split(":")[0] for s in got[1].split(",")] == ["login", "opaque"]
    assert [s.split(":")[0] for s in got[4].split(",")] == ["endpoint", "login", "opaque"]


def test_secrets_grow_with_the_text(spark):
    """Long runs of letters and very many endpoints in one text take time in proportion."""
    def took(text):
        frame = docs(spark, [(1, text)])
        start = time.perf_counter()
        row = secrets.scan_secrets(frame).first()
        return time.perf_counter() - start, row

    took("a")
    for bit, small, large in (("abcdefghij", 50_000, 100_000), ("http://a.example.com ", 25_000, 100_000)):
        a, b = took(bit * small), took(bit * large)
        assert b[0] < 3 * (large / small) / 2 * a[0] + 1, (bit, a[0], b[0])
    text = "ftp://a.b/c" + "http://d.e" + " xhttps://f.g" + " Zab://h" + "z" * 1000 + "://h ://i a:// b://c"
    found = spark.createDataFrame([(1, text)], "_row long, text string").select("_row", *[secrets._matches(k).alias(k) for k in secrets.KINDS])
    spans = secrets.candidate_spans(found).where(F.col("kind") == secrets.PLACE["endpoint"]).collect()
    assert sorted((r["start"], r["end"]) for r in spans) == [m.span() for m in re.finditer(secrets.KINDS["endpoint"][0], text)]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_packing_brute_force(spark):
    rnd = random.Random(3)
    words = ["½a²b", "WOW!!", "x\xa0y", "a\x85.", "_don't_", "ªº", "a1b22c", "e\u0301t", "ﬁn", "The", "the.", "naïve", "été,", "don't", "x1y2", "İstanbul.", "ΣΑΣ", "<|endoftext|>", "é", "中文", "😀", " ", "\x1c", "A.B.", "..", "'S", "\r\n", "\x0b"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 9, 30])))) for i in range(200)] + ODD
    capacity, t = 16, tokenizer()
    got = packing.packing_query(docs(spark, rows), capacity=capacity).toPandas()
    expected = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo : lo + capacity]
            expected.append((i, k, lo, len(part), zlib.crc32(part.tobytes())))
    own = [(None if math.isnan(r[0]) else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(own, key=repr) == sorted(expected, key=repr)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= capacity
    assert got["sequence_id"].nunique() <= 1.02 * math.ceil(got["length"].sum() / capacity) + 1
    assert packing.packing_query(docs(spark, [])).count() == 0


def best_fit_plainly(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_and_reduction_loses_nothing():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([10, 30, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 60))]
        count = dict(Counter(lengths))
        assert sum(t for t, _ in packing.best_fit(dict(count), capacity)) == best_fit_plainly(lengths, capacity)
        left = dict(count)
        fixed = packing.reduce_instance(left, capacity)
        total = sum(t for t, _ in fixed) + sum(t for t, _ in packing.best_fit(left, capacity))
        assert total <= best_fit_plainly(lengths, capacity)
        where = packing.plan(count, capacity)
        assert set(where["length"]) == set(lengths)


def brute_grams(text):
    word = re.sub("[^a-z]+", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    word = re.sub(" +", " ", f" {word} ")
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(word) - n + 1):
            g = word[i : i + n]
            if g != " " and not (n == 3 and g[1] == " ") and g.strip():
                grams[g] += 1
    return grams


def test_grams(monkeypatch):
    text = "The, cat  sat-on the MAT!"
    for piece in (1 << 20, 5):
        monkeypatch.setattr(language, "PIECE", piece)
        codes, counts = language.grams(text)
        own = {}
        for c, n in zip(codes.tolist(), counts.tolist()):
            g = ""
            while c:
                g, c = chr(c & ((1 << 21) - 1)) + g, c >> 21
            own[g] = n
        assert own == dict(brute_grams(text))


def plain_language(rows, top):
    """lang_pred and score by the letter: counts, ranks, ties and distances recomputed."""
    def ranked(texts):
        total = Counter()
        for t in texts:
            total += brute_grams(t)
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return sorted(total, key=lambda g: (-total[g], code(g)))[:top]

    learned = defaultdict(list)
    for i, t, lang, *_ in rows:
        if lang is not None and t is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2:
            learned[lang].append(t)
    profiles = {lang: {g: k for k, g in enumerate(ranked(texts))} for lang, texts in learned.items()}
    out = []
    for i, t, *_ in rows:
        own = ranked([t or ""])
        if not any(c.isalpha() for c in t or "") or not any(profiles.values()):
            out.append((i, "und", 0.0))
            continue
        apart = {lang: sum(abs(p[g] - k) if g in p else top for k, g in enumerate(own)) for lang, p in profiles.items() if p}
        best = min(sorted(apart), key=apart.get)
        out.append((i, best, 1 - apart[best] / (top * len(own))))
    return out


@pytest.mark.parametrize("top", [300, 12])
def test_language_brute_force(spark, top):
    rnd = random.Random(9)
    letters = {"en": "theand os", "de": "ichundere", "fr": "leaquesit", "xx": "ab"}
    rows = []
    for i in range(160):
        lang = rnd.choice(list(letters))
        text = " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 12)))
        rows.append((i, text, rnd.choice([lang, lang, lang, None])))
    rows += [(500, "ab", "aa"), (501, "ab", "bb"), (502, "ab", None), (None, "the end", "en"), (None, None, None), (503, "a", "twin a"), (504, "a", "twin b"), (506, "a", None)]
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in language.language_query(docs(spark, rows), top).collect()]
    assert sorted(got, key=repr) == sorted(((i, lang, round(s, 12)) for i, lang, s in plain_language(rows, top)), key=repr)


def test_language_stage_uses_its_prediction(spark):
    """The text decides, whatever the column says; only the languages asked for stay."""
    rows = [(i, "the cat and the dog went there", "en") for i in range(40)] + [(100 + i, "der hund und die katze gehen dort", "de") for i in range(40)]
    rows += [(500, "die katze und der hund", "en"), (501, "the dog went there", "de"), (502, "the cat", None), (503, "12", "en")]
    frame = docs(spark, rows)
    every = {r["doc_id"]: r["lang"] for r in language.language_stage(frame).collect()}
    assert every == {i: "en" if i < 100 or i in (501, 502) else "de" for i, *_ in rows if i != 503}
    english = language.language_stage(frame, languages=("en",))
    assert english.columns == frame.columns
    assert {r["doc_id"] for r in english.collect()} == {i for i, lang in every.items() if lang == "en"}


def test_language_column_of_something_else(spark, monkeypatch):
    rows = [(i, f"text {i} of it", f"value {i}") for i in range(60)]
    with pytest.raises(ValueError):
        language.learned(language.learn(docs(spark, rows)), most=3)
    assert len(language.learned(language.learn(docs(spark, rows))).langs) > 40


def test_language(spark):
    rows = [(i, "the cat and the dog went there", "en") for i in range(40)] + [(100 + i, "der hund und die katze gehen dort", "de") for i in range(40)]
    rows += [(500, "the dog and the cat", None), (501, None, "en"), (502, "12 !!", "en"), (503, "", "de"), (None, "die katze", "de"), (504, "ß" * 30_000, "de")]
    got = {r["doc_id"]: r for r in language.language_query(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == "en" for i in range(40)) and all(got[100 + i]["lang_pred"] == "de" for i in range(40))
    assert got[500]["lang_pred"] == "en" and [got[i]["lang_pred"] for i in (501, 502, 503)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] == "de"
    assert all(r["held_out"] == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2) for i, r in got.items())
    assert language.language_query(docs(spark, [])).count() == 0
    assert [r["lang_pred"] for r in language.language_query(docs(spark, [(1, "abc", None)])).collect()] == ["und"]
    left = {r["doc_id"] for r in language.language_stage(docs(spark, rows)).collect()}
    assert left == {i for i, *_ in rows} - {501, 502, 503}


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = language.language_query(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(said) > 100 and (said["lang"] == said["lang_pred"]).mean() > 0.95


def plain_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_of_many_sources(spark):
    """Any number of sources, in any order of their caps, against a plain reading; twice as many take about as long."""
    rnd = random.Random(6)
    for n, top in ((1, 9), (7, 40), (300, 3000), (300, 2)):
        sizes = {rnd.choice([f"s{i:05}", f"S{i}", None]): rnd.randint(0, top) ** rnd.choice([1, 2]) for i in range(n)}
        frame = spark.createDataFrame([(s, z) for s, z in sizes.items() for z in (z // 3, z - z // 3)], "source string, size long")
        got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(frame).collect()}
        expected = plain_targets(sizes)
        assert {s: z for s, (z, _) in got.items()} == sizes
        for s, z in sizes.items():
            assert got[s][1] == pytest.approx(expected[s], abs=1e-6)

    def took(n):
        frame = spark.range(n).selectExpr("cast(id as string) as source", "id % 1000 + 1 as size")
        start = time.perf_counter()
        assert mixing.source_targets(frame).count() == n
        return time.perf_counter() - start

    took(1000)
    assert took(100_000) < 2.5 * took(50_000) + 2


def test_mixing_order_of_keys(spark):
    """Which documents the last pass takes: the order of exponential keys scaled by quality, recomputed from the hashes."""
    rows = [(i, ("word " if i % 3 else "w0rd 1 ") * (i % 9), "en", "a" if i % 4 else "b") for i in range(200)]
    frame = docs(spark, rows)
    hashes = {r[0]: r[1] for r in frame.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(mixing.SEED))).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    sources = {s: sum(size[i] for i, _, _, x in rows if x == s) for s in "ab"}
    target = plain_targets(sources)
    expected = {}
    for s in "ab":
        key = {}
        for i, t, _, x in rows:
            if x == s:
                marks = re.sub(r"\s+", "", t)
                quality = sum(c.isalpha() for c in marks) / len(marks) if marks else 0.0
                even = ((hashes[i] % (1 << 64) >> 11) + 0.5) / (1 << 53)
                key[i] = -math.log(even) / (0.05 + quality)
        passes = int(target[s] // sources[s])
        rest = int(target[s] - passes * sources[s])
        for i in sorted(key, key=lambda i: (key[i], i)):
            more = min(size[i], rest)
            expected[i] = passes * size[i] + more
            rest -= more
    assert {r["doc_id"]: r["taken"] for r in mixing.mixing_query(frame).collect()} == expected


def test_mixing(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), "en", rnd.choice(["hot"] * 6 + ["a", "b", "Z", "é", None, ""])) for i in range(800)]
    rows += [(i, t, "en", None) for i, t in ODD] + [(7, "same row", "en", "a")] * 3
    frame = docs(spark, rows)
    got = mixing.mixing_query(frame).toPandas()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(mixing.WORD, t or ""))
    target = plain_targets(size)
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by_target = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert sorted(size.values()) == sorted(by_target.index)
    for s, n in size.items():
        assert by_target.loc[n, "target"] == pytest.approx(target[s])
        assert abs(by_target.loc[n, "taken"] - target[s]) <= 1
    again = mixing.mixing_query(frame.repartition(5)).toPandas()
    assert sorted(got.astype(str).values.tolist()) == sorted(again.astype(str).values.tolist())
    assert mixing.mixing_query(docs(spark, [])).count() == 0
    mixed = mixing.mixing_stage(frame)
    assert mixed.columns == frame.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == got["taken"].sum()
