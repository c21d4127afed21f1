import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import exact_dedup, line_dedup, near_dup
from tests.llm.cases import awkward, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


def order(i):
    return (i is not None, i if i is not None else 0)


def test_exact_against_brute_force(spark):
    rows = awkward()
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(3)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        mine = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.digest)
        assert r.group_size == len(mine) and r.keep_id == max(mine, key=order)
    kept = Counter(r.digest for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.keep_id == r.id for r in got if r.kept)


def test_exact_drop_keeps_columns_and_one_of_repeats(spark):
    docs = frame(spark, awkward())
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({norm(t) for _, t, _ in awkward()})
    assert out.filter("doc_id = 61").count() == 1
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_index_persists_between_batches(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_test", buckets=4)
    exact_dedup.dedup_rows(frame(spark, [(1, "alpha", "a"), (2, "beta", "a")]), index).count()
    second = exact_dedup.dedup_rows(frame(spark, [(9, "ALPHA", "a"), (8, "gamma", "a")]), index).collect()
    assert {r.id: r.keep.id for r in second} == {9: 1, 8: 8}
    assert index.frame().count() == 3


def test_three_batches_against_brute_force(spark):
    batches = [awkward()[:40], [(11, "Alpha", "a"), (12, "new", "b"), (12, "new", "b"), (3, "ALPHA", "a")] + awkward()[30:60], [(2, "alpha", "x"), (99, "NEW", "x"), (5, "own", "x")]]
    index, seen = exact_dedup.DigestIndex(spark, "digest_index_batches"), {}
    for rows in batches:
        own = defaultdict(list)
        for i, t, _ in rows:
            own[norm(t)].append(i)
        want = Counter()
        for text, ids in own.items():
            new = text not in seen
            seen.setdefault(text, max(ids, key=order))
            digest = hashlib.sha256(text.encode()).hexdigest()
            for k, i in enumerate(sorted(ids, key=order, reverse=True)):
                want[i, seen[text], len(ids), new and k == 0, digest] += 1
        got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in exact_dedup.exact_dedup(frame(spark, rows), index=index).collect())
        assert got == want
    assert index.frame().count() == len(seen) and index.buckets == exact_dedup.LEAST_BUCKETS
    again = frame(spark, batches[0])
    assert exact_dedup.drop_exact_copies(again, index=exact_dedup.DigestIndex(spark, "digest_index_batches")).count() == 0
    index.drop()


def test_an_index_of_its_own_is_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(frame(spark, awkward())).count() == len(awkward())
    assert {t.name for t in spark.catalog.listTables()} == before


def lines_by_force(rows, min_docs, min_chars, mode):
    def keys(t):
        return [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (t or "").split("\n")]

    docs, first, lines = Counter(), {}, Counter()
    for i, t, _ in rows:
        for n, k in enumerate(keys(t)):
            lines[k] += 1
            if k not in first or (order(i), n) < first[k]:
                first[k] = (order(i), n)
        docs.update(set(keys(t)))
    out = []
    for i, t, _ in rows:
        kept = [
            line
            for n, (line, k) in enumerate(zip((t or "").split("\n"), keys(t), strict=True))
            if len(k) < min_chars or docs[k] < min_docs or lines[k] < 2 or (mode == "first" and first[k] == (order(i), n))
        ]
        out.append((order(i), len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "min_chars", "mode", "most"), [(10, 1, "all", 1000), (2, 1, "all", 1), (1, 4, "first", 1000), (2, 1, "first", 2)])
def test_lines_against_brute_force(spark, min_docs, min_chars, mode, most):
    rows = awkward()
    docs = frame(spark, rows).repartition(5)
    got = line_dedup.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, mode=mode, bits=1 << 19, broadcast_lines=most).collect()
    assert sorted((order(r.id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == lines_by_force(rows, min_docs, min_chars, mode)


def test_lines_of_no_rows(spark):
    assert line_dedup.dedup_lines(frame(spark, awkward()).limit(0), bits=1 << 19).count() == 0


def shingle_set(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def links_by_force(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                top[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_against_brute_force(spark, block):
    rows = awkward()
    got = near_dup.near_duplicates(frame(spark, rows).coalesce(1), block=block).orderBy("row").collect()
    links, roots = links_by_force(rows)
    assert [r.id for r in got] == [i for i, _, _ in rows]
    assert [r.n_links for r in got] == links
    groups = defaultdict(set)
    for r, g in zip(got, roots, strict=True):
        groups[g].add(r.class_id)
    assert all(len(g) == 1 for g in groups.values())
    for g, ids in groups.items():
        members = [rows[k][0] for k in range(len(rows)) if roots[k] == g and rows[k][0] is not None]
        assert ids == {min(members)} if members else ids == {None}


def test_one_representative_of_each_group_stays(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = near_dup.keep_representatives(docs)
    _, roots = links_by_force(rows)
    assert out.columns == docs.columns and out.count() == len(set(roots))
    assert near_dup.keep_representatives(docs.limit(0)).count() == 0


def test_posterior_bounds_keep_true_pairs():
    least = near_dup.least_matches()
    assert all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.8 * near_dup.VALUES


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in near_dup.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_hot_copies_take_the_broadcast_path(spark):
    rows = [(k, "same text for all of these rows here", "a") for k in range(50)] + [(100 + k, f"another text number {k} with words {k}", "a") for k in range(10)]
    got = {r.id: r for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got[7].n_links == 49 and got[7].class_id == 0 and got[101].n_links == 0
    assert exact_dedup.exact_dedup(frame(spark, rows)).filter(F.col("kept")).count() == 11
