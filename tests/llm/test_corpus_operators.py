"""Operators over many texts, against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm import bpe, common, decontaminate, sharding, simhash, substrings
from chronotext.llm import components as components_module
from chronotext.llm.components import components
from chronotext.llm.queries import tokenizer_file

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    """A number for each row's component."""
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute_components(rows):
    groups, least = brute_groups(rows), defaultdict(list)
    for (d, _), g in zip(rows, groups, strict=True):
        least[g] += [d] if d is not None else []
    return sorted(((d, f"{brute_fingerprint(t):016x}", min(least[g], default=None)) for (d, t), g in zip(rows, groups, strict=True)), key=str)


@pytest.mark.parametrize("table", ["corpus", "odd", "none"])
def test_simhash_equals_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(rows_of(docs))


def test_simhash_shingle_hash_is_sparks(spark):
    text = "ÄB c  D"
    want = spark.range(1).select(F.xxhash64(F.lit("Äb c d"))).first()[0]
    assert simhash.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fp"] == want


def test_simhash_links_at_all_distances(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(2**63), 2**63, 60)
    values = set(base.tolist())
    for x in base[:40]:
        for n in (1, 2, 3, 4):
            y = int(x)
            for b in r.choice(64, n, replace=False):
                y ^= 1 << int(b)
            values.add(int(np.uint64(y & (2**64 - 1)).astype(np.int64)))
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("many", [0, 500_000])
def test_components_of_a_long_chain(spark, monkeypatch, many):
    monkeypatch.setattr("chronotext.llm.components.MANY_LINKS", many)
    links = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (7, 7)], "u long, v long"))
    got = {r["u"]: r["v"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1001: 1000}
    assert components(links.limit(0)).count() == 0


def brute_first(rows):
    """(doc_id, text) of the row that stays, a component each."""
    named = list(zip(rows, brute_groups(rows), strict=True))
    out = []
    for g in set(brute_groups(rows)):
        mine = [r for r, own in named if own == g]
        ids = [d for d, _ in mine if d is not None]
        out.append((min(ids, default=None), {t for d, t in mine if d == min(ids, default=None)}))
    return out


@pytest.mark.parametrize("table", ["corpus", "odd", "none"])
def test_keep_first_keeps_one_of_each_group(request, table):
    docs = request.getfixturevalue(table)
    kept, rows = simhash.keep_first(docs), rows_of(docs)
    assert kept.columns == docs.columns
    got, want = rows_of(kept), brute_first(rows)
    assert len(got) == len(want)
    for d, texts in want:
        assert sum(d == x and t in texts for x, t in got) >= 1
    assert all(any(d == x and t in texts for x, texts in want) for d, t in got)


def test_keep_first_of_shared_and_missing_ids(spark):
    rows = [(5, "alpha"), (5, "beta"), (None, "alpha"), (7, "alpha"), (None, "gamma"), (None, "gamma"), (None, None), (3, ""), (9, "delta"), (9, "delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id_", F.lit(None).cast("string"))
    assert sorted(rows_of(simhash.keep_first(docs)), key=str) == sorted([(5, "alpha"), (5, "beta"), (None, "gamma"), (3, ""), (9, "delta")], key=str)


@pytest.fixture
def joined(monkeypatch):
    """Plans with a join of what SimHash and components write, before adaptive execution."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    written = common.table
    for module in (common, components_module, simhash):
        monkeypatch.setattr(module, "table", noted)

    def all_with(df):
        noted(df)
        return [p for p in plans if "Join" in p]

    return all_with


def test_keep_first_broadcasts_nothing_that_grows(corpus, joined):
    plans = joined(simhash.keep_first(corpus))
    assert len(plans) >= 4 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_near_duplicates_broadcasts_nothing_that_grows(corpus, joined):
    plans = joined(simhash.near_duplicates(corpus))
    assert len(plans) >= 5 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def brute_removed(rows, window):
    """Spans by rows; rows without an id take no part."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [50, 20])
@pytest.mark.parametrize("table", ["corpus", "odd", "none"])
def test_substrings_equal_brute_force(request, table, window):
    docs = request.getfixturevalue(table)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs, window).collect()), key=str)
    assert got == brute_removed(rows_of(docs), window)


def test_substrings_of_few_words(spark):
    """Runs of one word, where minimizers tie, and documents that contain one another."""
    texts = ["a " * 200, "b " + "a " * 90 + "c", "a " * 49, "a b " * 60, "x " + "a b " * 40 + "y " + "a " * 70, "a " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert got == brute_removed(list(enumerate(texts)), 50)


def test_substrings_with_colliding_hashes(spark, corpus):
    """Words of two-bit hashes collide all over; what they promise is compared at the source and thrown away."""
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = rows_of(corpus)[:60] + [(1000 + i, " ".join(r.choice(words, 90))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, verified = substrings._attempt(docs, 20, 7, 2)
    assert not verified
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs, 20, bits=(2, 64)).collect()), key=str)
    assert got == brute_removed(rows, 20)


def test_substrings_without_broadcasts(monkeypatch, corpus):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", -1)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(corpus, 20).collect()), key=str)
    assert got == brute_removed(rows_of(corpus), 20)


def test_tables_go_when_their_consumer_is_written(spark):
    from chronotext.llm import common

    before = set(common._left)
    made = []

    def make():
        made.append(common.table(spark.range(3)))
        made.append(common.table(made[0].withColumn("x", F.lit(1))))
        return made[1].where("id > 0")

    out = common.settled(lambda: common.settled(make).where("x = 1"))
    assert out.count() == 2 and len(set(common._left) - before) == 1
    common.free(out, out, spark.range(1))
    assert set(common._left) == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from chronotext.llm import common

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        sc.master = master
        with pytest.raises(RuntimeError, match="checkpoint"):
            common.checkpoint_ready(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_substrings_under_shared_ids(spark):
    """Many texts under one id, next to smaller and larger ids: each row is judged on its own."""
    r = np.random.default_rng(8)
    part = [" ".join(f"w{i}" for i in r.integers(0, 900, 70)) for _ in range(6)]
    rows = [(5, f"{part[i % 6]} x{i} {part[(i + 1) % 6]}") for i in range(30)] + [(2, part[0]), (9, part[1]), (9, part[1]), (None, part[2]), (9, f"{part[0]} y {part[5]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in substrings.remove_repeats(docs).collect()), key=str)
    assert got == brute_removed(rows, 50)


def test_chains_are_contracted(spark):
    """A passage of very many paths in two copies becomes one span with its source's coordinate."""
    r = np.random.default_rng(4)
    long_ = " ".join(f"w{i}" for i in r.integers(0, 5000, 3000))
    docs = spark.createDataFrame([(3, f"a b {long_} c"), (9, f"{long_} x y"), (12, f"p q r {long_}")], "doc_id long, text string")
    spans = substrings.repeated_spans(substrings.named(docs, substrings.tag_of(docs))).collect()
    assert sorted((s["doc_id"], s["first"], s["size"], s["s_doc"], s["s_first"]) for s in spans) == [(9, 0, 3000, 3, 2), (12, 3, 3000, 3, 2)]
    named = [("k" + d, t) for d, t in (("1", long_), ("2", f"z {long_}"), ("0", "short"))]
    got = substrings.remove_repeats(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == {"k0": 0, "k1": 0, "k2": 3000}


def test_super_windows_cut_long_documents(monkeypatch, spark):
    from chronotext.llm import superwindows

    monkeypatch.setattr(superwindows, "_SLOTS", 256)
    r = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in r.integers(0, 50, 3000)]
    p = superwindows.Pieces([words, words[:60], [], words[100:900]], superwindows.WordHashes(), 50, 16)
    assert p.count.sum() == (3000 - 49) + 11 + (800 - 49)
    of = [np.flatnonzero(p.doc == d) for d in range(4)]
    doc, first, w = superwindows.window_hashes([words, words[:60], [], words[100:900]], superwindows.WordHashes(), 50, [p.first[x] for x in of], [p.count[x] for x in of])
    at = {(int(d), int(f)): tuple(x) for d, f, x in zip(doc, first, w.tolist(), strict=True)}
    assert all(at[(3, i)] == at[(0, i + 100)] for i in range(751)) and len(set(at.values())) == 2951


def brute_overlaps(docs, items, window=15):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    found = {}
    for d, t in docs:
        a = cut(t)
        for i, u in items:
            b = cut(u)
            w = min(window, len(b))
            if w < decontaminate.SPAN:
                continue
            for shift in range(-len(b), len(a)):
                for s in range(len(b) - w + 1):
                    same = [0 <= shift + s + j < len(a) and a[shift + s + j] == b[s + j] for j in range(w)]
                    if 5 * sum(same) >= 4 * w:
                        best, lo, hi = found.get((d, i), (0, 10**9, -1))
                        found[d, i] = (max(best, sum(same) / w), min(lo, shift + s), max(hi, shift + s + w - 1))
    return sorted(((d, i, *x) for (d, i), x in found.items()), key=str)


def test_overlaps_equal_brute_force(spark):
    import random

    r = random.Random(6)
    words = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 6, 8, 15, 30])))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        own = [r.choice(words) for _ in range(30)]
        if d % 2 == 0:
            leak = r.choice(items[:12])[1].split()
            for _ in range(r.randrange(len(leak) // 4 + 1)):
                leak[r.randrange(len(leak))] = "other"
            own[10:10] = leak
        docs.append((d, " ".join(own).upper() + "!"))
    docs += [(100, None), (101, ""), (102, "t1 t2")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["last_word"]) for r in decontaminate.overlaps(a, b).collect()), key=str)
    assert got == brute_overlaps(docs, items) and len(got) > 10
    assert {r["doc_id"] for r in decontaminate.clean(a, b).collect()} == {d for d, _ in docs} - {x[0] for x in got}
    # One id for all rows, or none: each row is still judged by its own text.
    leaked = {x[0] for x in got}
    for own in (F.lit(1).cast("long"), F.lit(None).cast("long")):
        left = decontaminate.clean(a.withColumn("doc_id", own), b)
        assert sorted(str(r["text"]) for r in left.collect()) == sorted(str(t) for d, t in docs if d not in leaked)


def test_overlaps_by_shuffled_joins(spark, monkeypatch, corpus, odd, none):
    items = corpus.where("doc_id % 40 = 7").select(F.col("doc_id").alias("item_id"), "text")
    whole = sorted(map(tuple, decontaminate.overlaps(corpus, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, decontaminate.overlaps(corpus, items).collect())) == whole and whole
    assert decontaminate.overlaps(odd, items).count() == 0
    assert decontaminate.overlaps(none, items).count() == 0 and decontaminate.overlaps(corpus, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, items).columns == odd.columns and decontaminate.clean(odd, items).count() == odd.count()


def test_masks_catch_every_placement():
    """Any 15 tokens with three substitutions keep one mask intact."""
    from itertools import combinations

    masks = [[i for i, b in enumerate(m) if b == "1"] for m in decontaminate.MASKS]
    for lost in combinations(range(15), 3):
        assert any(not any(s + i in lost for i in on) for m, on in zip(decontaminate.MASKS, masks, strict=True) for s in range(15 - len(m) + 1))


def test_short_items_with_every_placement(spark, monkeypatch):
    from itertools import combinations

    items = [(w, " ".join(f"i{w}t{j}" for j in range(w))) for w in range(6, 15)]
    docs = []
    for w, t in items:
        for lost in combinations(range(w), w - -(-w * 4 // 5)):
            docs.append((len(docs), " ".join(["a", "b", "c", *("other" if j in lost else x for j, x in enumerate(t.split())), "d"])))
    docs.append((len(docs), "i7t1 i7t2 i7t3 i7t4 i7t5 i7t6"))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.BROADCAST_SEEDS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
        got = sorted(((r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["last_word"]) for r in decontaminate.overlaps(a, b).collect()), key=str)
        assert got == brute_overlaps(docs, items) and {x[0] for x in got} == {d for d, _ in docs}


def test_no_python_on_the_decontamination_path(corpus):
    items = corpus.limit(5).select(F.col("doc_id").alias("item_id"), "text")
    plan = decontaminate.overlaps(corpus, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_shards(rows, limit):
    import hashlib

    bits = lambda d: f"{int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16):060b}"
    sized = [(d, len((t or "").encode()), bits(d)) for d, t in rows]
    out = []
    for d, n, b in sized:
        for depth in range(61):
            mine = [m for _, m, c in sized if c[:depth] == b[:depth]]
            if sum(mine) <= limit or len(mine) == 1:
                out.append((d, n, f"s{b[:depth]}", depth, sum(mine), len(mine)))
                break
    return sorted(out)


def test_shards_equal_brute_force(corpus):
    for limit in (100, 3000, 10**9):
        assert sorted(map(tuple, sharding.assign_shards(corpus, limit=limit).collect())) == brute_shards(rows_of(corpus), limit)


def test_shards_split_a_hot_key(spark, odd, none):
    hot = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("0123456789").alias("text"))
    out = sharding.assign_shards(hot, limit=500)
    per = out.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("said"), F.max("shard_rows").alias("rows")).collect()
    assert sum(r["n"] for r in per) == 4000 and max(r["b"] for r in per) <= 500
    assert all((r["b"], r["n"]) == (r["said"], r["rows"]) for r in per)
    few = sharding.assign_shards(odd, limit=100)
    assert few.count() == odd.count() and few.where("bytes > 100 and shard_rows > 1").count() == 0
    assert sharding.assign_shards(none).count() == 0


def test_rows_that_share_a_key_are_written_once(spark, tmp_path, odd):
    rows = [(1, "a" * 40), (1, "a" * 40), (1, "b" * 90), (None, "c" * 30), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, f"{tmp_path}/few", limit=50)
    assert sorted(rows_of(spark.read.parquet(f"{tmp_path}/few")), key=str) == sorted(rows, key=str)
    sharding.write_shards(odd, f"{tmp_path}/odd", limit=1000)
    assert sorted(rows_of(spark.read.parquet(f"{tmp_path}/odd")), key=str) == sorted(rows_of(odd), key=str)


def test_shards_are_written(spark, tmp_path, corpus):
    sharding.write_shards(corpus, f"{tmp_path}/shards", limit=20_000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == corpus.count()
    assert back.groupBy("_shard").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 20000").count() == 0


@pytest.mark.parametrize("table", ["odd", "none"])
def test_pipeline_stages_on_odd_rows(request, spark, tmp_path, table):
    docs = request.getfixturevalue(table)
    spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or out.columns == docs.columns
        rows = out.collect()
        assert (len(rows) > 0) == (count > 0)
        if name == "decontamination":
            assert len(rows) == count
        assert all(r[c] == "clash" for r in rows for c in docs.columns if c in r and isinstance(r[c], str) and c in ("row", "own", "fold", "kept_text", "_leaked", "spans"))


def test_pipeline_stages(spark, tmp_path, corpus):
    items = corpus.where("doc_id = 17 or doc_id = 27").select(F.col("doc_id").alias("item_id"), "text")
    blank = spark.createDataFrame([(900, None, None, None, None), (901, "12 !!", None, "s", 5)], corpus.schema)
    corpus.unionByName(blank).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in one.collect()} == {d for d, t in rows_of(corpus)}
    two = stages["near_duplicates"](spark, one, str(tmp_path))
    assert {r["doc_id"] for r in two.collect()} == {c for _, _, c in brute_components(rows_of(one))}
    three = stages["repeats"](spark, two, str(tmp_path))
    want = {d: (t, n, gone) for d, n, gone, t in brute_removed(rows_of(two), 50)}
    original = dict(rows_of(two))
    assert dict(rows_of(three)) == {d: t if gone else original[d] for d, (t, n, gone) in want.items() if not (n and gone == n)}
    four = stages["decontamination"](spark, three, str(tmp_path))
    assert all(x.columns == docs.columns for x in (one, two, three, four))
    leaked = {x[0] for x in brute_overlaps([r for r in rows_of(three) if len(r[1]) < 3000], rows_of(items.withColumnRenamed("item_id", "doc_id")))}
    assert leaked and not leaked & {r["doc_id"] for r in four.collect()}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = bpe.codec(tokenizer_file())
    assert {r["doc_id"]: bytes(r["ids"]) for r in final} == {d: np.array(codec.encode(t), "<u4").tobytes() for d, t in rows_of(four)}
