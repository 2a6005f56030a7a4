"""Records of unknown shape, crawls within budgets, statistics and logs, against plain Python."""

from __future__ import annotations

import json
import os
import random
import re
from collections import Counter, deque

from pyspark.sql import functions as F

from curatorium.operators import crawl, payloads, statistics
from curatorium.operators.graph import written
from curatorium.sources import logs


def test_bounded_payloads(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}, "file_data": "AAAA", "Base64Body": [1], "text": "x" * 4000, "list": list(range(50)), "n": None, "t": True, "num": 1.5}
    rows = [json.dumps(deep), "not json", None, "[" * 500 + "]" * 500, '"plain"']
    got = [r[0] for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw string").select(payloads.bounded("raw")).collect()]
    cut = json.loads(got[0])
    assert cut["a"]["b"]["c"]["d"]["e"] == {"f": "[omitted: depth limit]"} or cut["a"]["b"]["c"]["d"]["e"] == "[omitted: depth limit]"
    assert cut["file_data"] == cut["Base64Body"] == "[omitted: binary/base64]" and len(cut["text"]) == 3000 + len("...[omitted]") and cut["list"] == list(range(30)) and (cut["n"], cut["t"], cut["num"]) == (None, True, 1.5)
    assert got[1:3] == [None, None] and got[3] == '[[[[[["[omitted: depth limit]"]]]]]]' and got[4] == '"plain"'


def test_records_and_their_side_table(spark):
    rows = [(1, '{"data":{"id":7,"max_amount":"5万円"}}', "x"), (2, "```JSON\n{\"items\":[{\"id\":\"a\"},{}]}\n```", "y"), (3, "{", "z"), (4, "  ", "z"), (5, "[1]", "z"), (6, '{"result":[{"name":1}]}', "z"), (7, 'text {"a":{"b":1}} {', "z")]
    good, bad = payloads.records(spark.createDataFrame(rows, "k int, raw string, id0 string"))
    assert sorted((r["k"], r["place"], r["id"], r["amount_text"], r["id0"]) for r in good.collect()) == [(1, 0, "7", "5万円", "x"), (2, 0, "a", None, "y")]
    assert {r["k"]: r["reason"] for r in bad.where("reason <> ''").collect()} == {3: "not JSON", 4: "empty", 5: "no record", 6: "no id", 7: "no record"}


def queue(links, seeds, refused, max_urls, most):
    """A plain first-in, first-out queue."""
    waiting, met, out, visits = deque(), {}, [], 0
    for url, place, depth in seeds:
        if url not in met:
            met[url] = (0, (place,), refused(url))
            waiting.append((url, 0, (place,), depth))
    while waiting:
        url, d, path, depth = waiting.popleft()
        if met[url][2]:
            continue
        if max_urls is not None and visits >= max_urls:
            met[url] = (*met[url][:2], crawl.OVER_RUN)
            continue
        visits += 1
        met[url] = (*met[url][:2], crawl.VISITED)
        out.append(url)
        if d < depth:
            for pos, target in sorted(links.get(url, [])):
                if target not in met:
                    met[target] = (d + 1, (*path, pos), refused(target))
                    waiting.append((target, d + 1, (*path, pos), depth))
    return out, met


def test_crawl_in_the_order_of_a_queue(spark):
    r = random.Random(8)
    links = {f"u{k}": [(pos, f"u{r.randrange(120)}") for pos in range(r.randint(0, 6))] for k in range(120)}
    rows = [(s, pos, t) for s, out in links.items() for pos, t in out]
    seeds = [("u3", 0, 3), ("u5", 1, 1), ("u3", 2, 3), ("u9", 3, 2)]
    refused = lambda u: "ends with 4" if u.endswith("4") else None
    df = spark.createDataFrame(rows, "source string, pos int, target string")
    start = spark.createDataFrame(seeds, "url string, place int, max_depth int")
    for most in (None, 1, 17, 40):
        got = crawl.crawl(df, start, F.when(F.col("url").endswith("4"), "ends with 4"), max_urls=most).orderBy("depth", "path").collect()
        order, met = queue(links, seeds, refused, most, None)
        assert [x["url"] for x in got if x["outcome"] == crawl.VISITED] == order
        assert {x["url"]: (x["depth"], tuple(x["path"]), x["outcome"]) for x in got} == met and len(got) == len(met)


def test_crawl_with_a_budget_for_each_seed(spark):
    links = spark.createDataFrame([("a", k, f"a{k}") for k in range(9)] + [("b", k, f"b{k}") for k in range(2)], "source string, pos int, target string")
    got = crawl.crawl(links, spark.createDataFrame([("a", 0), ("b", 1)], "url string, place int"), max_per_seed=4, depth=1).collect()
    assert Counter((x["seed"], x["outcome"]) for x in got) == {("a", crawl.VISITED): 4, ("a", crawl.OVER_SEED): 6, ("b", crawl.VISITED): 3}
    assert {x["url"] for x in got if x["seed"] == "a" and x["outcome"] == crawl.VISITED} == {"a", "a0", "a1", "a2"}


def test_statistics_in_one_scan(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(1000).select(F.element_at(F.array(*map(F.lit, ("skip", "insert", "error", "publish"))), (F.col("id") % 4 + 1).cast("int")).alias("action"), (F.col("id") % 3).alias("extracted_links")).mapInPandas(counted, "action string, extracted_links long")
    kept, found = statistics.observed(rows, statistics.crawl_counters(rows.columns), "one")
    log = written(kept)
    assert seen.value == 1000
    plain = Counter(r["action"] for r in log.collect())
    assert (found.get["attempted_urls"], found.get["skipped_urls"], found.get["error_urls"], found.get["inserted"], found.get["publish"]) == (750, plain["skip"], plain["error"], plain["insert"], plain["publish"]) and found.get["extracted_links"] == 999


def test_logs_of_a_folder(spark, tmp_path):
    r = random.Random(3)
    texts = {}
    for k, name in enumerate(("manual-1.log", "manual-2.log", "weekly-9.log", "weekly-7.log", "other.log", "manual-3.txt")):
        body = [r.choice(("✅ 追加: 3", "inserted: 12", "⏭ スキップ：4", "❌ エラー: 1", "更新: 5 errors：2", "line", "")) for _ in range(3000)] + ["end"]
        texts[name] = body
        (tmp_path / name).write_text("\r\n".join(body) if k % 2 else "\n".join(body))
        os.utime(tmp_path / name, (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # files in several parts
    try:
        rows = logs.lines(spark, str(tmp_path))
        assert {x["file"] for x in logs.newest(rows).select("file").distinct().collect()} == {"manual-2.log", "weekly-7.log"}
        last = {}
        for x in sorted(logs.tail(rows, 7).collect(), key=lambda x: -x["from_end"]):
            last.setdefault(x["file"], []).append(x["line"])
        assert set(last) == set(list(texts)[:4]) and all(last[n] == texts[n][-7:] for n in last)
        got = {x["file"]: x for x in logs.summary(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, x in got.items():
        whole = "\n".join(texts[name])
        for field, patterns in logs.COUNTERS.items():
            found = [int(m[1]) for p in patterns if (m := re.search(p, whole))]
            assert x[field] == (found[0] if found else None)
    kinds = {x["line"]: x["c"] for x in rows.select("line", logs.line_class(F.col("line")).alias("c")).distinct().collect()}
    assert kinds["✅ 追加: 3"] == "success" and kinds["⏭ スキップ：4"] == "warning" and kinds["❌ エラー: 1"] == "error" and kinds["line"] == "info"


def test_written_tables_are_discarded(spark):
    from curatorium.operators.graph import discard, shared_dir

    written(spark.range(3))
    folder = shared_dir(spark).removeprefix("file://") + "/curatorium/" + spark.sparkContext.applicationId
    assert os.listdir(folder)
    discard(spark)
    assert not os.path.exists(folder) and written(spark.range(3)).count() == 3
