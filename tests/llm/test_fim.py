"""Fill-in-the-middle against a plain reading of its contract."""

from __future__ import annotations

import hashlib
import random
import re

from weaksift.llm import fim

ROWS = "doc_id long, text string, form int, n string, output long, _text string, _chance int"


def plain(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def cases():
    rnd = random.Random(1)
    bits = ["a", "word", " ", "  ", "\n", "\t", "\x0b", "\x85", " ", "é", "😀", "<", "<P", "<S", "S>", "P>", "M>", "<<", "\\1", "\x00"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(600)]
    rows += [(1000 + i, f"one <{m}> two three") for i, m in enumerate("PSMPSMPSM")]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, "null id"), (None, None), (7, "same"), (7, "same"), (-3, "minus")]
    return rows + [(3000 + i, "long text é " * 60_000) for i in range(6)]


def test_brute_force(spark):
    rows = cases()
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], ROWS)
    out = fim.fill_in_middle(frame)
    assert out.columns == ["doc_id", "text", "_text", "_chance", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(out["output"], out["form"])).collect()
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert sorted(r[6] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_digests_and_parameters(spark):
    rows = cases()[:300]
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], ROWS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.fim_query(frame).collect()), key=repr)
    assert got == sorted(((*(p := plain(*r))[:5], sha(p[5]), sha(r[1] or "")) for r in rows), key=repr)
    every = fim.fill_in_middle(frame, rate=100, spm=0)
    assert sorted((tuple(r) for r in every.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr) == sorted(
        (plain(*r, rate=100, spm=0) for r in rows), key=repr
    )


def test_empty_table(spark):
    frame = spark.createDataFrame([], ROWS)
    assert fim.fim_query(frame).count() == 0 and fim.fill_in_middle(frame).count() == 0
