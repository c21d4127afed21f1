import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from corpuslens.llm import common, mixing, quality, sharding
from tests.llm import force
from tests.llm.cases import awkward, frame

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_function", "n_distinct")


def test_counts_against_brute_force(spark):
    texts = [t for _, t, _ in awkward()] + ["a b c d e f a b c d e", "x x x x x x", "x x x x x", "a\n\na\n a\na", "w " * 9 + "| ## <>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", quality.features(F.col("text")).alias("f")).collect()
    for r in rows:
        want = force.counts(texts[r.i])
        assert {c: r.f[c] for c in COUNTS} == want, texts[r.i]


def test_judgement_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in contract.queries()["op3_quality"](spark, data).collect()}
    for r, (f, failed, kept, p) in zip(rows, force.judged([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (g.base_failed, g.kept) == (failed, kept) and g.posterior == pytest.approx(p, abs=1e-6)
        assert all(g[c] == f[c] for c in COUNTS[:5])


def test_rejects_what_people_reject(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = contract.queries()["op3_quality"](spark, data).join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_keep_good_keeps_columns(spark):
    docs = frame(spark, awkward())
    out = quality.keep_good(docs)
    want = [r[0] for r, j in zip(awkward(), force.judged([t for _, t, _ in awkward()]), strict=True) if j[2]]
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_a_period_is_within_one_block():
    rng = random.Random(2)
    for _ in range(100):
        w = [rng.randint(1, 50) for _ in range(rng.randint(1, 10))]
        order, ran = mixing.period(w), [0] * len(w)
        for slot, k in enumerate(order, 1):
            ran[k] += 1
            assert all(abs(ran[i] - slot * w[i] / sum(w)) < 1 for i in range(len(w)))
        assert ran == w


@pytest.mark.parametrize(("weights", "part"), [(None, 7), ({"a": 5, "hot": 1, None: 2}, 2000)])
def test_mix_is_whole_and_follows_the_weights(spark, weights, part):
    rows = awkward()
    got = mixing.positions(frame(spark, rows), weights=weights, block_rows=2, part_rows=part).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert Counter((r.id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    # in the first phase each source is within one block of its share
    share, ran = {r.source: r.weight for r in got}, Counter()
    total = sum(share.values())
    for slot in range(min(len(slots), max(r.slot for r in got if r.phase == 0) + 1)):
        ran[slots[slot][0]] += 1
        assert all(abs(ran[s] - (slot + 1) * w / total) < 1 for s, w in share.items())


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 7, "c": 2, "d": 90}, {"a": 3, "b": 3, "c": 3}])
def test_mix_against_brute_force(spark, weights):
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaaaaabbbccd")) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = {r.id: r.position for r in mixing.positions(docs.repartition(3), weights=weights, block_rows=4, part_rows=50).collect()}
    own = {}
    for r in docs.select("doc_id", "source", F.xxhash64(F.lit(20), "doc_id", F.lit(None).cast("long")).alias("h")).collect():
        parts = -(-sum(s == r.source for _, s in rows) // 50)
        own.setdefault(r.source, []).append((r.h % parts, r.h, r.doc_id))
    whole = mixing.whole_weights({"+" + k: len(v) ** 0.5 if weights is None else weights.get(k, 0) for k, v in own.items()})
    queues = {"+" + k: [i for _, _, i in sorted(v)] for k, v in own.items()}
    want = []
    for k in force.mixed_blocks({k: -(-len(v) // 4) for k, v in queues.items()}, whole):
        want, queues[k] = want + queues[k][:4], queues[k][4:]
    assert got == {i: p for p, i in enumerate(want)}


def test_plans_of_many_sources_are_quick():
    rng = random.Random(1)
    sizes = {f"s{k}": int(10 ** rng.uniform(2, 6)) for k in range(300)}
    plan = mixing.plan({k: -(-n // 32) for k, n in sizes.items()}, mixing.whole_weights({k: n**0.5 for k, n in sizes.items()}))
    assert sum(p["length"] for p in plan) == sum(-(-n // 32) for n in sizes.values())


def test_mixed_rows_come_in_order(spark):
    docs = frame(spark, awkward())
    out = mixing.mixed(docs, block_rows=2)
    place = {(r.id, r.source): r.position for r in mixing.positions(docs, block_rows=2).filter("id IS NOT NULL AND id <> 61").collect()}
    path = common.new_path(spark, "mixed")
    out.coalesce(1).write.parquet(path)
    seen = [place[r.doc_id, r.source] for r in spark.read.parquet(path).collect() if (r.doc_id, r.source) in place]
    assert out.columns == docs.columns and len(seen) == len(place) and seen == sorted(seen)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_whole_weights():
    assert sum(mixing.whole_weights({"a": 1.0, "b": 2.0, "c": 0}).values()) == 1000
    assert mixing.whole_weights({k: 1 for k in range(500)}) == {k: 4 for k in range(500)}


def test_shards_hold_every_row_once(spark):
    rows = awkward()
    docs = frame(spark, rows).repartition(3)
    got = sharding.shard_records(docs, common.new_path(spark, "shards"), shards=7, bucket_bytes=2000).collect()
    # the table has columns named shard, slot and size of its own
    new = [c for c in got[0].asDict() if c.startswith(("shard_", "slot_", "size_"))]
    assert sorted(new) == ["shard_1", "size_1", "slot_1"]
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    per = Counter(r.shard_1 for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) <= set(range(7))
    assert all(sorted(r.slot_1 for r in got if r.shard_1 == s) == list(range(n)) for s, n in per.items())
    assert all(r.size_1 == len((r.text or "").encode()) + 16 for r in got)
    again = sharding.shard_records(docs.repartition(5), common.new_path(spark, "shards"), shards=7, bucket_bytes=2000).collect()
    place = lambda rows_: sorted((r.doc_id or -1, r.text or "", r.shard_1, r.slot_1) for r in rows_ if r.doc_id != 61)
    assert place(got) == place(again)
    assert sharding.shard_records(docs.limit(0), common.new_path(spark, "shards")).count() == 0


def test_shards_against_brute_force(spark):
    rows = [(i, "w" * (7 * i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_records(docs, common.new_path(spark, "shards"), shards=7, seed=3, bucket_bytes=900).collect()}
    n = max(7, -(-sum(len(t) + 16 for _, t in rows) // 900))
    buckets = {}
    for r in docs.select("doc_id", F.xxhash64(F.lit(3), "doc_id", F.lit(0).cast("long")).alias("h")).collect():
        buckets.setdefault(r.h % n, []).append((r.h, r.doc_id))
    line = []
    for b in sorted(buckets):
        own = [i for _, i in sorted(buckets[b])]
        rng = random.Random(3 * 1_000_003 + b)
        for i in reversed(range(1, len(own))):  # Fisher-Yates
            j = rng._randbelow(i + 1)
            own[i], own[j] = own[j], own[i]
        line += own
    starts = [s * len(line) // 7 for s in range(8)]
    want = {i: (s, k - starts[s]) for s in range(7) for k, i in enumerate(line) if starts[s] <= k < starts[s + 1]}
    assert got == want


def test_sharding_query(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = contract.queries()["op4_sharding"](spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1


def test_pipeline_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    kept = [d for d, j in zip(docs, force.judged([d.text for d in docs]), strict=True) if j[2]]
    last = {d.text.translate(force.LOWER): d for d in kept}  # the largest doc_id of each text
    kept = sorted(last.values(), key=lambda d: d.doc_id)
    roots = force.near_groups([d.text for d in kept])
    kept = [d for k, d in enumerate(kept) if roots[k] == k]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d in kept:
        ids = library.encode(d.text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[d.doc_id] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
    got = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_pipeline_on_awkward_rows_and_on_none(spark, tmp_path):
    docs = frame(spark, awkward() + [(200 + k, "The quick words of a clean text go here and there, as it is told, number %d." % k + " More of them follow in the same way." * (k % 2), None) for k in range(12)])
    docs.write.parquet(f"file://{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/some").collect()
    rows = [(i, t or "") for i, t, _ in [(r.doc_id, r.text, r.source) for r in docs.collect()]]
    kept = [r for r, j in zip(rows, force.judged([t for _, t in rows]), strict=True) if j[2]]
    last = {}
    for i, t in kept:
        last[t.translate(force.LOWER)] = max((i, t), last.get(t.translate(force.LOWER), (i, t)))
    kept = sorted(last.values())
    roots = force.near_groups([t for _, t in kept])
    kept = {i: t for k, (i, t) in enumerate(kept) if roots[k] == k}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}
    assert sorted(r.position for r in got) == list(range(len(kept))) and len(kept) > 5
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_pipeline_positions_follow_the_mix(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source")
    want = {r.id: r.position for r in mixing.positions(docs).collect()}
    stages = corpus_pipeline.STAGES[-2:]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "100k"}  # many files, read out of order
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        assert {r.doc_id: r.position for r in corpus_pipeline.run(spark, data).collect()} == want
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("no mix", lambda spark, docs, sf_dir: docs), stages[1]])
        other = {r.doc_id: r.position for r in corpus_pipeline.run(spark, data).collect()}
        assert other != want and sorted(other.values()) == sorted(want.values())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
