"""Stored structures: lexical blocks, vector cells, the versioned store."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.operators import evaluate, frontier, ivf, lexical, usage, vector
from corvina.shared import numbered
from corvina.sources import batches
from corvina.sources import store as stores
from corvina.streaming import stateful


def corpus(spark, n=300):
    rng = random.Random(4)
    vocabulary = [f"palabra{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 90))), f"s{i % 3}") for i in range(n)]
    rows += [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, "palabra0 " * 400, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def queries(spark):
    texts = ["palabra0 palabra1 palabra50", "palabra3", "palabra59 palabra58 palabra57 palabra0", "nada", "palabra0 palabra40"]
    return lexical.query_table(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), "query_id", "text")


@pytest.mark.parametrize("prune_from, top", [(0, 1), (0, 10), (10**9, None)])
def test_pruned_search_gives_the_same_rows(spark, tmp_path, monkeypatch, prune_from, top):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    docs, path = corpus(spark), str(tmp_path / "i")
    lexical.write_index(docs.filter("doc_id % 2 = 0"), path, keep=["source"], buckets=5)
    lexical.write_index(docs.filter("doc_id % 2 = 1"), path, keep=["source"])
    want = sorted(map(tuple, lexical.bm25(docs, queries(spark), top, keep=["source"]).collect()), key=str)
    got = lexical.bm25_index(spark, path, queries(spark), top, keep=["source"], prune_from=prune_from)
    assert sorted(map(tuple, got.collect()), key=str) == want
    lexical.optimize_index(spark, path, str(tmp_path / "o"))
    got = lexical.bm25_index(spark, str(tmp_path / "o"), queries(spark), top, keep=["source"], prune_from=prune_from)
    assert sorted(map(tuple, got.collect()), key=str) == want
    some = lexical.bm25_index(spark, path, queries(spark), top, keep=["source"], sources=["s1"], prune_from=prune_from).collect()
    every = lexical.bm25_index(spark, path, queries(spark), None, keep=["source"]).filter("source = 's1'")
    assert sorted(map(tuple, some), key=str) == sorted(map(tuple, lexical._ranked(every, top).collect()), key=str)


def test_blocks_are_skipped_and_buckets_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    path = str(tmp_path / "i")
    docs = spark.createDataFrame([(i, "comun " * (i % 9 + 1) + ("raro" if i % 50 == 0 else "")) for i in range(400)], "doc_id long, text string")
    lexical.write_index(docs, path, buckets=7)
    q = lexical.query_table(spark.createDataFrame([(1, "comun")], "query_id int, text string"), "query_id", "text")
    plan = lexical.bm25_index(spark, path, q, 5)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#", plan) and "EqualTo(term,comun)" in plan
    blocks = spark.read.parquet(f"{path}/postings").filter("term = 'comun'")
    df = spark.read.parquet(f"{path}/terms").filter("term = 'comun'").select("term", "df")
    needed = lexical._needed(blocks, lexical._weighted(q, df, 1000), 5, 6.0, [])
    assert needed.count() < blocks.count() / 2
    assert spark.read.parquet(f"{path}/postings").filter("n > 4").count() == 0
    assert len(lexical.bm25_index(spark, path, q, None).collect()) == 400


def test_a_term_of_all_documents_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("comun "), F.repeat(F.lit("x "), (F.col("id") % 40).cast("int"))).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task's
    try:
        lexical.write_index(docs, path, buckets=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = spark.read.parquet(f"{path}/postings").filter("term = 'comun'").select(F.input_file_name()).distinct().count()
    assert names > 1


def vectors(spark, n=1500, width=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, width))[rng.integers(20, size=n)] + 0.3 * rng.normal(size=(n, width))
    x[7] = x[8]
    rows = [(i, x[i].astype(np.float32).tolist(), i % 4) for i in range(n)] + [(n, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    return df, df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf"))
    df, q = vectors(spark)
    ivf.write_vectors(df, path, cells=40, keep=["label"])
    return path, df, q


def same(a, b):
    rows = lambda x: {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in x.collect()}
    a, b = rows(a), rows(b)
    return a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 2e-6 for k in a)


@pytest.mark.parametrize("block", [2048, 20])
def test_probing_all_or_exactly_equals_the_scan(spark, indexed, block):
    path, df, q = indexed
    want = vector.knn(df, q, 10)
    assert same(ivf.search_vectors(spark, path, q, 10, probe=40, block=block), want)
    assert same(ivf.search_vectors(spark, path, q, 10, probe=2, exact=True, block=block), want)
    some = ivf.search_vectors(spark, path, q, 10, probe=2, exact=True, where=F.col("label") == 1, block=block)
    assert same(some, vector.knn(df.filter("label = 1"), q, 10))


def test_recall_of_probed_cells(spark, indexed):
    path, df, q = indexed
    want = {(r["query_id"], r["vec_id"]) for r in vector.knn(df, q, 10).collect()}
    probe = ivf.probe_for(spark, path)
    got = {(r["query_id"], r["vec_id"]) for r in ivf.search_vectors(spark, path, q, 10, probe=probe).collect()}
    assert probe < 20 and len(want & got) >= 0.9 * len(want)


def test_only_probed_cells_are_read(spark, indexed):
    path, _, q = indexed
    one = q.filter("query_id = 40")
    plan = ivf.search_vectors(spark, path, one, 10, probe=3)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(\d+,\d+,\d+\)", plan)


def test_vector_index_edges(spark, tmp_path):
    df, q = vectors(spark, 30)
    ivf.write_vectors(df.limit(0), str(tmp_path / "none"))
    assert ivf.search_vectors(spark, str(tmp_path / "none"), q, 5).collect() == []
    ivf.write_vectors(df, str(tmp_path / "few"), cells=1)
    assert same(ivf.search_vectors(spark, str(tmp_path / "few"), q, 50), vector.knn(df, q, 50))
    assert ivf.search_vectors(spark, str(tmp_path / "few"), q.limit(0), 5).collect() == []
    with pytest.raises(ValueError):
        ivf.write_vectors(df.unionByName(spark.createDataFrame([(99, [1.0], 0)], df.schema)), str(tmp_path / "odd"))


def test_distances_in_slices_and_blocks(spark, monkeypatch):
    df, q = vectors(spark, 500)
    want = vector.knn(df, q, 7).collect()
    monkeypatch.setattr(vector, "SLICE", (3, 11))
    assert sorted(vector.knn(df, q, 7).collect()) == sorted(want)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 8 * 16 * 100)
    assert sorted(vector.knn(df, q, 7, block=5).collect()) == sorted(want)


def rows_of(store, **more):
    return sorted(map(tuple, store.read(**more).collect()), key=str)


def test_upserts_keep_the_last_row_of_a_key(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id", buckets=8)
    first = spark.createDataFrame([(i, f"a{i}", 1) for i in range(50)] + [(None, "none", 1)], "id long, v string, t int")
    assert store.upsert(first) == 1
    more = spark.createDataFrame([(i, f"b{i}", t) for i in range(40, 60) for t in (3, 2)] + [(None, "other", 1)], "id long, v string, t int")
    assert store.upsert(more.filter("t = 3"), "t") == 2 and store.upsert(more, "t") == 3
    want = [(i, f"a{i}", 1) for i in range(40)] + [(i, f"b{i}", 3) for i in range(40, 60)] + [(None, "other", 1)]
    assert rows_of(store) == sorted(want, key=str)
    assert rows_of(store, version=1) == sorted(map(tuple, first.collect()), key=str)
    store.insert(spark.createDataFrame([(1, "no", 9), (77, "new", 9)], "id long, v string, t int"))
    store.delete(spark.createDataFrame([(2,), (500,)], "id long"))
    want = [r for r in want if r[0] != 2] + [(77, "new", 9)]
    assert rows_of(store) == sorted(want, key=str)
    assert sorted(store.lookup(spark.createDataFrame([(1,), (77,), (2,)], "id long")).collect()) == [(1, "a1", 1), (77, "new", 9)]
    with pytest.raises(ValueError):
        stores.Store(spark, store.path, "v")


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id", buckets=16, files_per_bucket=2)
    store.upsert(spark.range(200).withColumn("v", F.lit("a")))
    store.upsert(spark.createDataFrame([(7, "b")], "id long, v string"))
    assert len([n for n in stores.listed(spark, f"{store.path}/data/v=2") if n.startswith("bucket=")]) == 1
    assert store.read().count() == 200 and store.read().filter("v = 'b'").count() == 1


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = stores.Store(spark, str(tmp_path / "s"), "id", buckets=4)
    store.upsert(spark.range(20).withColumn("v", F.lit("a")))
    before, new = rows_of(store), spark.range(10, 30).withColumn("v", F.lit("b"))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(stores, "put_once", killed)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(new)
    monkeypatch.undo()
    assert store.version() == 1 and rows_of(store) == before
    assert store.upsert(new) == 2 and len(rows_of(store)) == 30
    with pytest.raises(FileExistsError):  # a second writer that started from version 1
        stores.put_once(spark, f"{store.path}/manifest/{2:08d}.json", {})
    store.upsert(new)
    assert store.vacuum(keep=1) and len(rows_of(store)) == 30
    with pytest.raises(Exception):
        store.read(version=1).count()


# --- batches, streams into stores, the crawl ------------------------------------------


def fragments(spark, n=60):
    return spark.createDataFrame([(f"f{i}", f"palabra{i % 7} texto comun") for i in range(n)], "fragment_id string, text string")


def encoder(calls):
    def encode(x):
        calls.append(1)
        return x.select("fragment_id", F.array(F.length("text").cast("double")).alias("v"))

    return encode


def test_batches_commit_one_by_one(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "i"), []
    index = batches.Reindex(spark, path, batches=4, settings={"mode": "a"})
    with pytest.raises(batches.Incomplete):
        index.run(fragments(spark), encoder(calls), most=2)
    assert len(calls) == 2 and len(index.committed()) == 2 and index.current() is None
    fragments(spark, 5).write.parquet(f"{path}/vectors/batch=3/half-written")  # what a killed run leaves

    def killed(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(batches.lexical, "write_index", killed)
    with pytest.raises(KeyboardInterrupt):
        index.run(fragments(spark), encoder(calls))
    monkeypatch.undo()
    assert len(calls) == 4 and index.current() is None  # all vectors, but no lexical index: not finished
    assert "half-written" not in stores.listed(spark, f"{path}/vectors/batch=3")
    now = index.run(fragments(spark), encoder(calls))
    assert len(calls) == 4 and now["n"] == 60 and index.vectors().count() == 60
    assert index.run(fragments(spark), encoder(calls)) == now and len(calls) == 4
    hits = lexical.bm25_index(spark, index.lexical_path(), lexical.query_table(spark.createDataFrame([(1, "palabra3")], "query_id int, text string"), "query_id", "text"), None)
    assert hits.count() == 9


def test_reindexing_extends_and_refuses(spark, tmp_path):
    path, calls = str(tmp_path / "i"), []
    index = batches.Reindex(spark, path, batches=2, settings={"mode": "a"})
    first = index.run(fragments(spark, 20), encoder(calls))
    seen = []

    def counting(x):
        seen.append(x.count())
        return encoder(calls)(x)

    now = index.run(fragments(spark, 26), counting)
    assert sum(seen) == 6 and now["n"] == 26 and now["number"] == first["number"] + 1 and index.vectors().count() == 26
    with pytest.raises(ValueError):
        index.run(fragments(spark, 10), encoder(calls))  # rows that the corpus no longer has
    with pytest.raises(ValueError):
        batches.Reindex(spark, path, batches=2, settings={"mode": "b"})
    with pytest.raises(ValueError):
        index.run(fragments(spark, 30), encoder(calls), extend=False)
    assert index.vectors().count() == 26
    short = batches.Reindex(spark, str(tmp_path / "j"), batches=2)
    with pytest.raises(batches.Incomplete):
        short.run(fragments(spark), lambda x: encoder(calls)(x).limit(3))
    assert short.current() is None and short.committed() == {}


def test_a_replayed_batch_of_a_stream_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}") for i in range(30)], "id long, v string")
    store = stores.Store(spark, str(tmp_path / "s"), "id", buckets=4)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    batches.ingest(stream(), store, str(tmp_path / "c"))
    version = store.version()
    batches.ingest(stream(), store, str(tmp_path / "other"))  # a lost checkpoint: the batch comes again under its number
    assert store.version() == version and store.read().count() == 30
    spark.createDataFrame([(5, "b"), (99, "b")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    batches.ingest(stream(), store, str(tmp_path / "c"))
    assert store.read().count() == 31 and store.read().filter("v = 'b'").count() == 1


def queue(links, seeds, known, most):
    """The model: one queue."""
    todo, seen, out, found, levels = list(seeds), set(), [], 0, {s: 0 for s in seeds}
    while todo and found < most:
        x = todo.pop(0)
        if x in seen:
            continue
        seen.add(x)
        out.append((x, levels[x], len(out), x in known))
        found += x in known
        if x in known:
            for y in links.get(x, []):
                levels.setdefault(y, levels[x] + 1)
                todo.append(y)
    return out


@pytest.mark.parametrize("most, every", [(10**6, 1), (10**6, 3), (25, 2), (1, 1)])
def test_the_crawl_is_a_queue(spark, tmp_path, most, every):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(80)]
    links = {a: rng.sample(names, rng.randint(0, 4)) for a in names}
    known = set(rng.sample(names, 65)) | {"n0"}
    seeds = ["n0", "n7", "n0", "n33"]
    df = spark.createDataFrame([(a, b, k) for a, bs in links.items() for k, b in enumerate(bs)], "src string, dst string, pos int")
    first = spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "id string, pos int")
    nodes = spark.createDataFrame([(x,) for x in known], "id string")
    want = queue(links, seeds, known, most)
    frontier.crawl(df, first, str(tmp_path / "c"), nodes, most, every, max_levels=2)
    (tmp_path / "c" / "levels" / "level=99").mkdir()  # a level that a killed run has left
    got = frontier.crawl(df, first, str(tmp_path / "c"), nodes, most, every)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
    assert frontier.crawl(df, first, str(tmp_path / "c"), nodes, most, every).count() == len(want)


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("s")).repartition(7)
    got = {r["k"]: r["n"] for r in numbered(df, ["k"], "n", 5).collect()}
    assert got == {k: k + 5 for k in range(1000)}
    assert numbered(df.limit(0), ["k"], "n").count() == 0
    pairs = {r["id"]: r["other"] for r in evaluate.circular_pairs(df, "k").collect()}
    assert pairs == {k: (k + 3) % 1000 for k in range(1000)}


def requests(spark, path, keys, days, each=5):
    """Requests (event_id, user_id, ts) of many keys, a file for each run of days; the keys and days in any order."""
    rows = [((d * len(keys) + i) * each + n, k, f"2026-01-{d + 1:02d} {8 + n:02d}:00:00") for d in range(days) for i, k in enumerate(keys) for n in range(each)]
    random.Random(2).shuffle(rows)
    out = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    return out, [(out.filter(F.dayofmonth("ts") == d + 1), path) for d in range(days)]


def test_keys_of_a_stream_share_slots(spark, tmp_path):
    rows, parts = requests(spark, str(tmp_path / "in"), [*range(300), None], 3)
    plans = spark.createDataFrame([(k, [None, 0, 2, 4][k % 4], "dia" if k % 8 < 4 else "mes", None) for k in range(200)], "user_id long, tope long, periodo string, vence date")
    stream = None
    for name, plan in (("daily", None), ("plans", plans)):
        for k, (part, path) in enumerate(parts):
            part.repartition(3).write.mode("append").parquet(f"{path}-{name}")
            stream = stateful.counted(spark.readStream.schema(rows.schema).parquet(f"{path}-{name}"), plans=plan, address=None if plan is None else "user_id", hard=3, soft=2, slots=4)
            out = stateful.drained(stream, str(tmp_path / name), f"{tmp_path}/checkpoint-{name}") if k == 0 else out.unionByName(stateful.drained(stream, f"{tmp_path}/{name}{k}", f"{tmp_path}/checkpoint-{name}"))
        want = usage.daily_verdicts(rows, hard=3, soft=2) if plan is None else usage.plan_verdicts(rows, plans, "user_id", "ts", "event_id", address="user_id", hard=3)
        of = ["event_id", "period", "used", "allowed", *(["suggest"] if plan is None else ["verdict"])]
        key = lambda x: sorted(map(tuple, x.select(*of).collect()))
        assert key(out) == key(want)
    found = {(r["who"], r["period"]): r["n"] for r in stateful.counts_in_state(spark, f"{tmp_path}/checkpoint-daily").collect()}
    assert {k: n for k, n in found.items() if k[1] == "2026-01-03"} == {(None if u is None else f"a{u}", "2026-01-03"): 3 for u in [*range(300), None]}
    with stateful.rocks(spark):
        assert spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint-daily").option("stateVarName", "used").load().count() <= 4 * 3  # a row for each key and day before


def test_periods_of_a_slot_end(spark, tmp_path):
    rows, parts = requests(spark, str(tmp_path / "in"), list(range(20)), 9, 1)
    for k, (part, path) in enumerate(parts):
        part.write.mode("append").parquet(path)
        stateful.drained(stateful.counted(spark.readStream.schema(rows.schema).parquet(path), hard=3, soft=2, slots=2), f"{tmp_path}/out{k}", str(tmp_path / "checkpoint"))
    left = {r["period"] for r in stateful.counts_in_state(spark, str(tmp_path / "checkpoint")).select("period").distinct().collect()}
    assert left == {f"2026-01-{d:02d}" for d in range(6, 10)}  # the watermark is a day behind January 9, 8:00; a period stays two days after its end


def test_quota_stream_of_many_keys_in_a_folder(spark, tmp_path):
    from corvina.plans import register

    rows, _ = requests(spark, "", list(range(150)), 2)
    rows.repartition(2).write.parquet(f"{tmp_path}/events.parquet")  # files of other names than the table's
    got = register.QUERIES["streaming_quota_equals_batch"](spark, str(tmp_path))
    of = ["event_id", "user_id", "used", "allowed", "suggest"]
    key = lambda x: sorted(map(tuple, x.select(*of).collect()))
    assert key(got) == key(usage.daily_verdicts(rows, hard=3, soft=2))
