from collections import defaultdict

from pyspark.sql import functions as F

from scriptorium.llm import extendible_sharding as es


def brute(rows, limit, bits):
    """Split buckets one bit at a time; rows are (hash, bytes)."""
    out, todo = {}, [(0, rows)]
    while todo:
        depth, own = todo.pop()
        if sum(n for _, n in own) <= limit or depth == bits:
            for h, _ in own:
                out[h] = depth
            continue
        for bit in (0, 1):
            todo.append((depth + 1, [(h, n) for h, n in own if (h >> (63 - depth)) & 1 == bit]))
    return out


def test_depths_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("depth", F.lit("x"))
    got = es.shard(docs, keys=["doc_id"], size=F.octet_length("text"), limit=60_000).withColumn("h", F.xxhash64("doc_id")).collect()
    want = brute([(r.h % 2**64, r.n_bytes) for r in got], 60_000, 14)
    assert len(got) == 1000 and all(r.depth == want[r.h % 2**64] for r in got)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard_id] += r.n_bytes
    assert max(sums.values()) <= 60_000 and len(sums) > 40


def test_overflow_chains(spark):
    rows = [(1, "a" * 10)] * 100 + [(2, "b" * 500), (None, None), (3, ""), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = es.shard(docs, keys=["doc_id"], size=F.octet_length("text"), limit=100).collect()
    sums, kinds = defaultdict(int), defaultdict(set)
    for r in got:
        sums[r.shard_id] += r.n_bytes
        kinds[r.shard_id].add(r.doc_id)
    assert len(got) == len(rows) and all(n <= 100 or (n == 500 and kinds[s] == {2}) for s, n in sums.items())
    assert es.shard(docs.limit(0), keys=["doc_id"], size=F.octet_length("text"), limit=100).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["bucket", "cell", "_part", "_row", "_h", "_n", "h", "n", "part", "row", "start", "own", "caller"]
    docs = spark.createDataFrame([(*range(len(names)), i % 3, "x" * 50) for i in range(60)], [*names, "key", "text"])
    for limit in (10_000, 200):  # without and with overflow chains
        got = es.shard(docs, keys=["key"], size=F.octet_length("text"), limit=limit).collect()
        assert len(got) == 60 and all([r[c] for c in names] == [*range(len(names))] for r in got)
