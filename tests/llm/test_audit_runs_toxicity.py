"""Toxicity, the filter audit and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatorium.llm import filter_audit, periodic_runs, queries, toxicity
from tests.compare import duck_rows, rows_of
from tests.llm.tables import no_docs, odd_docs, words

WORD = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"


# Periodic runs.


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every stretch that each period allows, with the smallest period of each."""
    least, ids = {}, np.unique(np.array([hash(x) for x in w], dtype=np.int64), return_inverse=True)[1]
    for q in range(1, len(w) // 4 + 1):
        same = np.diff(np.concatenate(([0], ids[q:] == ids[:-q], [0])))
        for start, stop in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
            if stop - start >= q:
                least.setdefault((start, stop + q), q)
    return sorted(((s, e - s, q) for (s, e), q in least.items() if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


def planted(doc_id, text) -> list[str]:
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text) -> tuple:
    w = planted(doc_id, text)
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_equal_brute_force():
    r = random.Random(13)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 5, 30])) for _ in range(r.randint(0, 80))]
        if w and r.random() < 0.6:
            a = r.randrange(len(w))
            p = r.randint(1, max(1, (len(w) - a) // 3))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = periodic_runs.runs(w)
        assert found == plain_runs(w)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert list(periodic_runs.kept(w, found)) == [x for i, x in enumerate(w) if i not in gone]


def test_ordered_sets_of_many_positions():
    r = random.Random(5)
    at = r.sample(range(100_000), 6000)
    held = periodic_runs.Ends(at[0])
    for x in at[1:]:
        held.add(x)
    assert [x for part in held.parts for x in part] == sorted(at) and len(held.parts) > 3
    inside = set(at)
    for x in r.sample([x for x in range(100_000) if x not in inside], 500):
        assert held.near(x) == (max((a for a in at if a < x), default=None), min((a for a in at if a > x), default=None))


def test_long_periodic_text():
    base = words(7, 700).split()
    assert periodic_runs.runs([base[i % 700] for i in range(60_000)]) == [(0, 60_000, 700)]
    assert periodic_runs.runs(["x"] * 60_000) == [(0, 60_000, 1)]


def test_run_query_equals_brute_force(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 4000").select("doc_id", "text").collect()}
    got = queries.op13_periodic_runs(spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    kept = [tuple(r) for r in got if r["doc_id"] in docs]
    assert kept == [plain_digest(r[0], docs[r[0]]) for r in kept] and sum(r[1] > 0 for r in kept) > 40


def test_odd_rows_have_runs(spark, tmp_path):
    docs = odd_docs(spark, extra=True)
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.repeat(F.lit("ab cd "), 12_000)).withColumn("doc_id", F.lit(77).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op13_periodic_runs(spark, str(tmp_path)).collect(), key=str)
    assert got == sorted((plain_digest(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert periodic_runs.collapsed(no_docs(spark)).count() == 0


# The filter audit.


def plain_audit(docs: list, labels: list) -> set[tuple]:
    """Each order applied filter by filter to every document."""
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    parts = defaultdict(list)
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = any((o[1] or "") == t and None not in (o[0], doc_id) and o[0] < doc_id for o in docs)
        parts[lang or ""].append((doc_id, {f for f, x in fails.items() if x}))
    out = set()
    for part, rows in parts.items():
        found, share = [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here, now = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                share[f] += len(here)
                found.append((part, order, step, len(now), len(here), sum(f in r[1] for r in rows) - len(here), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)))
                left = now
        out |= {(*x, share[x[1][x[2] - 1]]) for x in found}
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_audit_equals_brute_force(spark, partitions):
    """Groups of copies longer than a range of rows, repeated doc_ids, and texts that share a fingerprint's range."""
    r = random.Random(partitions)
    pool = [words(k, n) for k, n in ((1, 120), (2, 30), (3, 101))] + ["A B C # " * 30, "", None, "x " * 150]
    rows = [(r.choice([None, *range(400)]), r.choice([pool[0]] * 6 + pool), r.choice(["en", "de", "", None])) for _ in range(600)]
    labels = [(r.choice([None, *range(400)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).repartition(5)
        got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).select(*COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 600 * 3 and {tuple(x) for x in got} == plain_audit(rows, labels)


def test_equal_fingerprints_of_other_texts(spark):
    """Sorted by fingerprint and text, rows of one fingerprint are told apart by their texts, over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i % 11, f"text {i % 4}", "en", 5, i) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string, part string, fingerprint long, mask int").coalesce(1).sortWithinPartitions("fingerprint", "text", "doc_id")
        got = df.mapInArrow(filter_audit._later, "doc_id long, part string, mask int, fingerprint long, later boolean, least long, text string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = {f"text {k}": min(i % 11 for i in range(60) if i % 4 == k) for k in range(4)}
    assert {r["mask"]: r["later"] for r in got} == {i: i % 11 > least[f"text {i % 4}"] for i in range(60)}
    assert all((r["text"] is not None) == (not r["later"]) for r in got)


def test_audit_of_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (99, 1, 1), (4, 1, None)], LABELS)
    docs = odd_docs(spark, extra=True)
    assert {tuple(x) for x in filter_audit.audit(docs, labels).select(*COLUMNS).collect()} == plain_audit(docs.collect(), labels.collect())
    assert filter_audit.audit(no_docs(spark), labels).count() == 0


def test_audit_same_as_sql(spark, data):
    df = queries.op12_filter_audit(spark, data)
    assert rows_of(df.columns, df.collect()) == rows_of(*duck_rows(data, queries.ORACLES["op12_filter_audit"]))


# Toxicity.


def test_nearest_equals_all_cosines():
    r = np.random.default_rng(3)
    size, many = 60, 700
    word = [np.sort(r.choice(size, r.integers(1, 6), replace=False)) for _ in range(many)]
    weight = [(lambda w: w / np.linalg.norm(w))(r.choice([1.0, 1.0, 2.5], len(w)) + 0.1 * (w % 7)) for w in word]
    ids, toxic = (7 * np.arange(many)[::-1]).tolist(), (np.arange(many) % 2).tolist()
    index = toxicity.Index.of(size, ids, toxic, word, weight)
    dense = np.zeros((many, size))
    for i, (w, x) in enumerate(zip(word, weight, strict=True)):
        dense[i, w] = x
    place = {d: i for i, d in enumerate(ids)}
    for q in range(0, many, 3):
        without = None if q % 2 else int(np.flatnonzero(index.doc_id == ids[q])[0])
        found, cosine = index.nearest(word[q], weight[q], 9, without)
        all_scores = dense @ dense[q]
        if without is not None:
            all_scores[q] = 0
        want = sorted((-round(s, 9), d) for d, s in zip(ids, all_scores, strict=True) if s > 0)[:9]
        assert [int(index.doc_id[i]) for i in found] == [d for _, d in want]
        assert np.allclose(cosine, [-s for s, _ in want]) and all(index.toxic[i] == toxic[place[int(index.doc_id[i])]] for i in found)


def test_isotonic_never_falls():
    r = np.random.default_rng(4)
    votes = np.round(r.random(500), 2)
    labels = (r.random(500) < votes).astype(int)
    at, chance = toxicity.isotonic(votes, labels)
    assert (np.diff(chance) >= 0).all() and (np.diff(at) > 0).all() and abs(chance[-1] - 1) < 0.2 and chance[0] < 0.2
    # Pools of a least-squares fit: no other step function that never falls is nearer.
    assert toxicity.isotonic(np.array([1.0, 2.0, 3.0]), np.array([1, 0, 1]))[0].tolist() == [1.0, 3.0]


def test_scores_are_votes_of_all_neighbours(spark, data):
    """Scores, from vectors made word by word and cosines with every example."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    index = model.index
    dense = np.zeros((len(index.doc_id), len(model.vocabulary.hashes)))
    for w in range(dense.shape[1]):
        part = slice(index.start[w, 0], index.start[w, -1])
        dense[index.example[part], w] = index.weight[part]
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    voted = 0
    for r in toxicity.score(docs, model).limit(300).collect():
        count = defaultdict(int)
        for w in re.findall(rb"[a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "").encode()):
            h, _ = toxicity.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
            at = np.searchsorted(model.vocabulary.hashes, h[0])
            if at < dense.shape[1] and model.vocabulary.hashes[at] == h[0]:
                count[at] += 1
        if not count:
            assert r["score"] == model.plain and r["evidence"] == []
            continue
        x = np.zeros(dense.shape[1])
        for w, n in count.items():
            x[w] = (1 + np.log(n)) * model.vocabulary.idf[w]
        cosine = dense @ (x / np.linalg.norm(x))
        near = sorted(np.flatnonzero(cosine > 0), key=lambda i: (-round(cosine[i], 9), index.doc_id[i]))[: toxicity.NEAREST]
        assert [e["doc_id"] for e in r["evidence"]] == [index.doc_id[i] for i in near]
        assert abs(r["score"] - model.chance(model.vote(np.array(near), cosine[near]))) < 1e-9
        voted += 1
    assert voted > 20


def test_held_out_accuracy(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries.op11_toxicity(spark, large).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.7 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def test_toxicity_of_odd_and_empty_tables(spark):
    texts = [(100 + i, words(i, 30) + (" idiot moron" if i % 4 == 0 else ""), "en", "a", 1) for i in range(200)]
    docs = odd_docs(spark, extra=True)
    docs = docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    labels = spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(200)] + [(104, 1, 0), (None, 1, 1), (3, 1, 0), (5, 0, None), (4, 0, 0)], LABELS)
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"] % 4 == 0 for r in got if r["predicted"] == 1 and r["doc_id"]} == {True} and sum(r["predicted"] for r in got) == 50
    plain = {r["score"] for r in got if r["doc_id"] in (4, 5, 6)}
    assert len(plain) == 1 and plain.pop() < 0.1
    assert toxicity.judged(no_docs(spark), labels).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {(r["score"], r["predicted"]) for r in toxicity.judged(docs, none).collect()} == {(0.0, 0)}
