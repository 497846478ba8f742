"""The filter audit against a plain count, with files that bring smaller ids late."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weaksift.llm import audit
from weaksift.llm.common import stage

DOCS = "doc_id long, text string, lang string, source string, n int, mask string, key int, id string"
LABELS = "doc_id long, quality int, toxic int, part string"


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bits = [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]
    return sum(b << i for i, b in enumerate(bits))


def masks_of(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    return [mask_of(t or "") + 16 * (d is not None and least[t or ""] < d) for d, t, _ in rows]


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    of_part = defaultdict(list)
    for (d, _, lang), m in zip(rows, masks_of(rows)):
        of_part[lang or ""].append((d, m))
    out, shapley = {}, Counter()
    for part, docs in of_part.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[part, letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(bool(m & bit) for _, m in docs) - len(gone), sum(m == bit for _, m in docs),
                    sum(d in good for d, _ in gone if d is not None), sum(d in toxic for d, _ in gone if d is not None)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def result(frame):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def cases():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "Short A", "#"] + [
        " ".join(rnd.choice(words[: rnd.choice([40, 400])]) for _ in range(rnd.choice([20, 99, 100, 101, 130])))
        + rnd.choice(["", " $", " " + "LOUD" * 30, " é\x85 x", "\x0b"])
        for _ in range(40)
    ]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice(["en", "fr", None, ""])) for _ in range(300)]
    rows += [(i, "hot copy " * 60, "en") for i in range(900, 500, -1)] + [(7, "x", "en"), (7, "x", "fr"), (7, "x", "en")]
    labels = [(i % 950, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(1500)] + [(None, 1, 1)]
    return rows, labels


def write_files(spark, folder, parts):
    for i, rows in enumerate(parts):
        frame = spark.createDataFrame([(*r, "s", i, "m", 1, "k") for r in rows], DOCS)
        frame.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("batches,texts", [(1, 512), (4, 8)])
def test_brute_force(spark, tmp_path, batches, texts):
    rows, labels = cases()
    write_files(spark, f"{tmp_path}/documents.parquet", [rows[i::6] for i in range(6)])
    given = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    got = audit.audit(spark, f"{tmp_path}/documents.parquet", given, batches, texts)
    assert result(got) == plain(rows, labels)


def test_smaller_ids_come_later(spark, tmp_path):
    """Every run of the stream takes back what the new files overtake; its counters are right after each."""
    rows, labels = cases()
    rows = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    parts = [rows[:250], rows[250:500], rows[500:]]
    path, target, checkpoint = (f"{tmp_path}/{x}" for x in ("documents.parquet", "changes", "checkpoint"))
    given = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    taken_back = 0
    for i in range(len(parts)):
        write_files(spark, path, parts[i : i + 1])
        audit.run_audit_stream(spark, path, target, checkpoint, texts=8).awaitTermination()
        changes = spark.read.schema(audit.CHANGES).parquet(target)
        so_far = sum(parts[: i + 1], [])
        counted = audit.counters(changes, given)
        assert {(r["part"], r["mask"]): r["n"] for r in counted.collect()} == Counter(
            (lang or "", m) for (_, _, lang), m in zip(so_far, masks_of(so_far))
        )
        back = changes.where("n < 0").count()
        assert i == 0 or back > taken_back
        taken_back = back
    assert result(audit.interaction_table(stage(counted, "counted"))) == plain(rows, labels)
    before = changes.count()
    audit.run_audit_stream(spark, path, target, checkpoint, texts=8).awaitTermination()  # no new file, nothing counted twice
    assert spark.read.schema(audit.CHANGES).parquet(target).count() == before


def test_masks():
    words = " ".join(f"w{i}" for i in range(100))
    texts = ["", "a", words, words + "\n\t ", " " + words, "w " * 100, "A" + "b" * 9, "A" + "b" * 8, "É" * 30, "x\x85y " * 120, "50%", "\x1c|", "w1 " * 20 + words]
    assert audit._masks(pa.array(["skip", *texts]).slice(1)).tolist() == [mask_of(t) for t in texts]


def test_copies_of_one_batch_meet_their_state_once(spark):
    rows = [(i, "copy", "en") for i in range(5000)]
    frame = spark.createDataFrame([(*r, "s", 1, "m", 1, "k") for r in rows], DOCS).coalesce(1)
    judged = frame.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), "text").mapInArrow(audit._judge(9), audit.JUDGED)
    state = judged.where("not settled").collect()
    assert [(r["id"], r["n"], r["mask"]) for r in state] == [(0, 1, 1)]
    assert judged.where("settled").select("bucket").distinct().count() == 9


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    empty = spark.createDataFrame([], LABELS)
    assert audit.audit(spark, f"{tmp_path}/documents.parquet", empty).count() == 0
    write_files(spark, f"{tmp_path}/other.parquet", [[(1, "a", "en")]])
    assert result(audit.audit(spark, f"{tmp_path}/other.parquet", empty)) == plain([(1, "a", "en")], [])
