import datetime as dt
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpuslens.operators import chunking, ingest, texts, trees
from corpuslens.operators import relational as R
from corpuslens.operators import search as S


def test_chunks_tile_the_text_within_budget():
    text = "".join(f"Phrase numéro {k}, avec des mots; et une fin. " + ("\n\n" if k % 9 == 0 else "") for k in range(900))
    chunks = chunking.chunk(text, chunk_tokens=1024, overlap_min=20, overlap_max=60)
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))
    budget = int(1024 * chunking.SAFE_CHARS)
    assert all(e - c <= budget for _, e, c in chunks)
    assert all(int(20 * chunking.MEDIAN_CHARS) <= s - c <= int(60 * chunking.MEDIAN_CHARS) for s, _, c in chunks[1:])
    assert chunking.chunk("court") == [(0, 5, 0)]


def plans_by_force(places, penalty, n, budget, first, rest, low, high):
    """Least cost over all cuts and contexts."""
    size, best = places[-1], float("inf")
    even = (size + first + (n - 1) * (rest + low)) / n
    for inner in itertools.combinations(range(1, len(places) - 1), n - 1):
        cuts = [0, *inner, len(places) - 1]
        total = 0.0
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            if k == 0:
                options = [((first + places[b] - even) / budget) ** 2] if first + places[b] <= budget else []
            else:
                reach = [c for c in range(a + 1) if low <= places[a] - places[c] <= high]
                options = [((rest + places[b] - places[c] - even) / budget) ** 2 + penalty[c] for c in reach if rest + places[b] - places[c] <= budget]
            total += min(options, default=float("inf")) + penalty[b]
        best = min(best, total)
    return best


def test_chunk_plans_against_brute_force():
    rng = random.Random(3)
    feasible = 0
    for _ in range(300):
        places = [0, *sorted(rng.sample(range(1, 60), rng.randint(2, 8))), 60]
        penalty = [0.0, *[rng.choice([0.0, 1.0, 3.0, 9.0]) for _ in places[1:-1]], 0.0]
        n, budget, first, rest, low, high = rng.randint(2, 4), rng.randint(20, 45), rng.randint(0, 4), rng.randint(0, 6), rng.randint(0, 6), rng.randint(6, 20)
        plan = chunking.cheapest(np.array(places), np.array(penalty), n, budget, first, rest, low, high, 1.0, 1.0)
        want = plans_by_force(places, penalty, n, budget, first, rest, low, high)
        assert (plan is None) == (want == float("inf"))
        if plan:
            feasible += 1
            even, at = (60 + first + (n - 1) * (rest + low)) / n, dict(zip(places, penalty, strict=True))
            cost = sum(((first + b - even) / budget) ** 2 + at[b] if k == 0 else ((rest + b - c - even) / budget) ** 2 + at[b] + at[c] for k, (_, b, c) in enumerate(plan))
            assert abs(cost - want) < 1e-9
    assert feasible > 50


def test_chunks_of_odd_texts(spark):
    assert chunking.chunk("") == []
    with pytest.raises(chunking.Infeasible):
        chunking.chunk("x" * 9000, chunk_tokens=512, overlap_min=20, overlap_max=60)
    places, penalty = chunking.candidates("a\n\nbb. c")
    assert places.tolist() == [0, 2, 3, 6, 7, 8] and penalty.tolist() == [0.0, 1.0, 0.0, 5.0, 3.0, 0.0]
    assert chunking.embedding_text("BODY", 0, 4, 0, 0, "HDR", "VISA") == "HDR\n\nBODY"
    assert chunking.embedding_text("--CTXBODY", 5, 9, 2, 1, "HDR", "VISA") == f"HDR\n\nVISA{chunking.MARK}CTXBODY"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "x" * 9000), (5, "One sentence of it. " * 400)], "doc_id long, text string")
    got = chunking.chunk_documents(docs, chunk_tokens=512, overlap_min=20, overlap_max=60).collect()
    by = {i: sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_index) for i in range(1, 6)}
    assert not by[1] and not by[2] and [tuple(r) for r in by[3]] == [(3, 0, 0, 5, 0, "short")] and [tuple(r) for r in by[4]] == [(4, -1, None, None, None, None)]
    assert "".join(r.body for r in by[5]) == "One sentence of it. " * 400 and len(by[5]) > 1


def test_highlight_marks_the_best_fragment():
    out = texts.highlight([(1, "rien ici. le congé payé est dû"), (2, "vide")], "congé")
    assert out == {1: "rien ici. le <mark>congé</mark> payé est dû"}


def test_diff():
    assert texts.diff("a\nb\n", "a\nAlinéa nouveau.\nb\n") == [("equal", "a\n"), ("insert", "Alinéa nouveau.\n"), ("equal", "b\n")]
    assert texts.diff("le chat noir", "le chien noir") == [("equal", "le "), ("delete", "chat"), ("insert", "chien"), ("equal", " noir")]


def test_collocations():
    lexicon = {("a", "b"), ("a", "b", "c"), ("c", "d")}
    assert texts.collocations(["a", "b", "c", "d"], lexicon) == [(0, 3)]
    assert texts.truecase("X" * 300 + ". FIN") == "X" + "x" * 299 + ". Fin"


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9), (None, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 10, "c"), (1, 4, "d")], "k long, at long, v string")
    got = {(r.k, r.t): r.v for r in R.asof_join(left, right, "k", "t", "at", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 0): None, (2, 9): None, (None, 3): None}


def test_intervals_and_their_ends(spark):
    d = dt.date
    rows = spark.createDataFrame([("a", d(2020, 1, 1), d(2021, 1, 1)), ("b", d(2021, 1, 1), None)], "v string, s date, e date")
    from pyspark.sql import functions as F

    at = F.lit(d(2021, 1, 1))
    assert {r.v for r in R.valid_at(rows, "s", "e", at, True).collect()} == {"a", "b"}
    assert {r.v for r in R.valid_at(rows, "s", "e", at, False).collect()} == {"b"}


def test_unique_match_abstains(spark):
    cand = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "k string, t long")
    got = {r.k: r.t for r in R.unique_match(spark.createDataFrame([("x",), ("y",), ("z",)], "k string"), cand, "k", "t").collect()}
    assert got == {"x": 1, "y": None, "z": None}


def test_percentile_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, v) for v in range(1, 101)], "g long, v long")
    r = R.rank_percentile(rows, ["g"], "v", [0.5, 0.9, 0.99]).first()
    assert (r.p50, r.p90, r.p99) == (51, 90, 99)


def test_authority_and_reconcile(spark):
    p = spark.createDataFrame([(1, 7, "en", 60, True), (2, 7, "fr", 60, False), (3, 8, "fr", 50, True)], "pid long, doc long, lang string, rank int, gone boolean")
    best = ingest.authority(p, "doc", "rank", "lang", "pid")
    assert {r.doc: r.pid for r in best.collect()} == {7: 2, 8: 3}
    docs = spark.createDataFrame([(7,), (8,), (9,)], "doc long")
    assert {r.doc: r.action for r in ingest.reconcile(docs, best, "doc", "gone").collect()} == {7: "live", 8: "blank", 9: "delete"}


def test_triage_modes(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "uid long, sum string")
    state = spark.createDataFrame([(1, "a", True), (2, "x", True)], "uid long, sum string, vec boolean")
    act = lambda **k: {r.uid: r.action for r in ingest.triage(batch, state, "uid", "sum", "vec", **k).collect()}
    assert act() == {1: "skip", 2: "update", 3: "write"} and act(force=True) == {1: "update", 2: "update", 3: "write"}


def test_chunks_by_tokens():
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    words.pre_tokenizer = pre_tokenizers.Whitespace()
    text = "Une phrase de mots. " * 200
    chunks = chunking.chunk_by_tokens(text, words, chunk_tokens=128, overlap_min=4, overlap_max=24)
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))
    assert all(len(words.encode(text[c:e]).ids) <= 128 for _, e, c in chunks)


def test_spellings():
    assert texts.without_prefix_variants(["DUPONT", "Dupont", "Dupont Jean", "Martin"]) == ["Dupont Jean", "Martin"]
    assert texts.better_cased("DUPONT", "Dupont") == "Dupont"


def test_toc_merges_divisions_and_keeps_order(spark):
    rows = [("t", 1, "a1", "I > A"), ("t", 2, "a2", None), ("t", 3, "a3", "II"), ("t", 4, "a4", "I > B"), ("t", 5, "a5", "I > A"), ("flat", 1, "b1", None)]
    got = sorted((r.owner, r.seq, r.kind, r.label) for r in trees.corpus_toc(spark.createDataFrame(rows, "text_uid string, idx long, uid string, title_path string")).collect())
    assert got == [("", 1, "division", "I"), ("", 2, "article", "a2"), ("", 3, "division", "II"), ("I", 1, "division", "A"), ("I", 2, "division", "B"), ("I > A", 1, "article", "a1"), ("I > A", 2, "article", "a5"), ("I > B", 1, "article", "a4"), ("II", 1, "article", "a3")]


def test_cascade_takes_the_first_unique_rule(spark):
    cands = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "q"), (5, "c", "q")], "t long, k string, m string")
    pending = spark.createDataFrame([(10, "a", "y"), (11, "b", "none"), (12, "c", "q"), (13, None, None)], "i long, k string, m string")
    assert {r.i: (r.t, r.rule) for r in R.cascade(pending, cands, [["k"], ["k", "m"]], "t").collect()} == {10: (2, 2), 11: (3, 1), 12: (None, None), 13: (None, None)}


def test_numbered_is_the_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id").repartition(7)
    got = R.numbered(rows, [F.col("x"), F.col("id")]).collect()
    assert sorted(got, key=lambda r: r.pos) == sorted(got, key=lambda r: (r.x, r.id)) and sorted(r.pos for r in got) == list(range(1, 1001))
    assert R.numbered(rows.limit(0), [F.col("x")]).count() == 0


def test_knn_in_blocks_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8))
    vectors[50:55] = vectors[7]  # ties
    rows = spark.createDataFrame([(i, i // 4, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label long, embedding array<double>")
    got = {}
    for r in S.knn(rows, rows.filter("vec_id % 10 = 7"), 3, block=4).collect():
        got.setdefault(r.src, {})[r.rk] = r.vec
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i in range(7, 200, 10):
        best = sorted((j for j in range(200) if j // 4 != i // 4), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == best


@pytest.fixture
def few_recursive_rows(spark):
    """A recursive query may give twenty rows here, as it may give a million by default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    yield
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_trees_down_have_no_row_limit(spark, few_recursive_rows):
    edges = spark.createDataFrame([("top", f"a{i}", i) for i in range(5)] + [(f"a{i}", f"b{i}-{j}", j) for i in range(5) for j in range(9)], "parent string, child string, seq long")
    got = trees.descend_all(spark, edges, spark.createDataFrame([("top",), ("a1",)], "root string")).collect()
    want = [("top", f"a{i}", 1, [i]) for i in range(5)] + [("top", f"b{i}-{j}", 2, [i, j]) for i in range(5) for j in range(9)] + [("a1", f"b1-{j}", 1, [j]) for j in range(9)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.node: r.path for r in trees.descend(spark, edges.replace(3, 1234567, "seq"), "top").collect()}["b2-3"] == "000002/1234567"
    assert trees.descend_all(spark, edges, spark.createDataFrame([("none",)], "root string")).count() == 0


def test_trees_up_have_no_row_limit(spark, few_recursive_rows):
    edges = spark.createDataFrame([("top", "mid"), *[("mid", f"c{i}") for i in range(30)], ("x", "y"), ("y", "x")], "parent string, child string")
    leaves = spark.createDataFrame([(f"c{i}",) for i in range(30)], "leaf string")
    want = [(f"c{i}", node, level) for i in range(30) for level, node in ((1, "mid"), (2, "top"))]
    assert sorted(map(tuple, trees.ascend(spark, edges, leaves).collect())) == sorted(want)
    ring = trees.ascend(spark, edges, spark.createDataFrame([("x",)], "leaf string")).collect()
    assert sorted((r.level, r.node) for r in ring) == [(n, "y" if n % 2 else "x") for n in range(1, 13)]


def test_numbered_ranges_rows_once(spark):
    rows = spark.range(300_000, numPartitions=5).select((F.col("id") * 7919 % 300_007).alias("x"), F.repeat(F.lit("y"), F.lit(20)).alias("y"))
    got = R.numbered(rows, [F.col("x")])
    place = got.select("x", "pos").toPandas().sort_values("x")
    assert place["pos"].tolist() == list(range(1, 300_001)) and place["x"].is_unique


def test_date_resort_against_sql(spark, tmp_path):
    import __spark_entry__ as contract
    import duckdb

    key = F.when(F.col("id") != 5, F.col("id") * 7919 % 200_003)
    day = F.when(F.col("id") % 11 != 0, F.expr("timestamp_ntz'1992-01-01' + make_dt_interval(CAST(id % 2400 AS INT))"))
    spark.range(200_000, numPartitions=5).select(key.alias("o_orderkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = {r.o_orderkey: r.pos for r in contract.queries()["f13_date_resort"](spark, str(tmp_path)).collect()}
    assert got == dict(db.execute(contract.oracle_sql()["f13_date_resort"]).fetchall())


def test_islands_with_equal_spans(spark):
    """Of equal spans one opens an island, and its twins stay in it."""
    rng = random.Random(5)
    spans = [(k, a := rng.randrange(60), a + rng.randrange(4)) for k in range(40) for _ in range(30)]
    spans += spans[::3]
    want = []
    for k in range(40):
        found = []
        for _, a, b in sorted(s for s in spans if s[0] == k):
            if found and a < found[-1][2]:
                found[-1][2:] = [max(b, found[-1][2]), found[-1][3] + 1]
            else:
                found.append([k, a, b, 1])
        want += map(tuple, found)
    rows = spark.createDataFrame(spans, "k long, a long, b long").repartition(7)
    assert sorted(map(tuple, R.islands(rows, ["k"], "a", "b").select("k", "a", "b", "n_spans").collect())) == sorted(want)
