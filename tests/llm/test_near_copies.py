"""The near-copy stage against all pairs in plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parchment.llm import common, exact_dedup, near_copies, simhash


def edited(rng, words, n):
    words = words.copy()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("dense", [32, 2])
def test_no_near_copy_is_left(spark, dense):
    rng = random.Random(8)
    rows = []
    for b in range(6):
        base = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(120)]
        rows += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, rng.randint(1, 3)) for _ in range(12))]
    rng.shuffle(rows)
    rows = [*enumerate(rows), (500, None), (501, ""), (502, "one two"), (503, "one  TWO"), (None, rows[0])]
    sets = {i: {tuple((t or "").lower().split()[a : a + 5]) for a in range(max(len((t or "").split()) - 4, 1))} for i, t in rows if i is not None}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.near_copies(df, dense=dense, pivots=1).where("id is not null").collect()
    least = {}
    for r in found:
        least[r.g] = min(least.get(r.g, r.id), r.id)
    got = {r.id: least[r.g] for r in found}
    left = {i for i in sets if got.get(i, i) == i}
    assert not [p for p in alike if left.issuperset(p)]
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert all(root[i] == root[c] for i, c in got.items())
    assert len({*root.values()}) < len(sets) / 2
    if dense == 32:
        assert {i: got.get(i, i) for i in sets} == root
        kept = [r.doc_id for r in simhash.drop_near_copies(df).collect()]
        assert {*kept} == {*root.values()} and len(kept) == len({*kept})


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_copies])
def test_rows_decide_and_not_ids(spark, drop):
    """Another text of an id that goes stays, null ids are the greatest, of rows alike in all one stays."""
    rows = [(6, "A b c"), (7, "A b c"), (7, "quite another text"), (None, "A b c"), (None, "A b c"), (None, "of none"), (None, "of none"), (9, "twice"), (9, "twice"), (9, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_hot", "_cold", "_salt", "_one_id", "key", "n", "g", "node")})
    out = drop(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(6, "A b c"), (7, "quite another text"), (None, "of none"), (9, "twice"), (9, "once")]))
    assert drop(df.limit(0)).count() == 0


def test_many_keys_meet_in_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (sorted(map(tuple, exact_dedup.exact_dedup(docs, few=n).collect())) for n in (0, 1 << 20))
    assert a == b


@pytest.mark.parametrize("turns", [1, 0])
def test_crowds_lose_no_link(spark, monkeypatch, turns):
    """Chains of edits, in which only neighbours are near: a band value of many texts gives the components of all pairs."""
    monkeypatch.setattr(near_copies, "TURNS", turns, raising=False)
    monkeypatch.setattr(near_copies, "ROUND", 1, raising=False)  # how many texts of a crowd the earlier code held at a time
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        chain = [[f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(120)]]
        for _ in range(25):
            chain.append(edited(rng, chain[-1], 2).split())
        rows += [" ".join(c) for c in chain]
    rng.shuffle(rows)
    sets = [{tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for t in rows]
    root = [*range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    found = near_copies.near_copies(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string"), dense=2, pivots=1).collect()
    least = {}
    for r in found:
        least[r.g] = min(least.get(r.g, r.id), r.id)
    got = {r.id: least[r.g] for r in found}
    assert [got.get(i, i) for i in range(len(rows))] == root
    assert len({*root}) < len(rows) / 5


@pytest.mark.parametrize("tile", [7, 2048])
def test_tiles_hold_all_pairs(spark, tile):
    rng = random.Random(4)
    # Sketches that differ in few places of four bits; sizes over several classes; two texts of a component now and then.
    texts = [(k, k * 1000 + i, rng.randrange(60, 200), [rng.getrandbits(2) << 4 * rng.randrange(15) for _ in range(7)], rng.randrange(30)) for k in (1, 2) for i in range(90)]
    df = spark.createDataFrame(texts, "key long, node long, size int, sketch array<long>, label long")
    a, b = (F.struct(*[F.col(f"{x}.{c}") for c in ("size", "sketch")]) for x in "ab")
    want = df.alias("a").join(df.alias("b"), F.expr("a.key = b.key and a.node < b.node and a.label != b.label")).where(near_copies.may_be_near(a, b, 0.8)).selectExpr("a.node a", "b.node b")
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, near_copies.tiles(df, 0.8, tile).collect())) == want and len(want) > 1000


@pytest.mark.parametrize("links", [1 << 18, 0])
def test_shuffle_files_do_not_pile_up(spark, monkeypatch, links):
    """Dozens of shuffles are over when the last begins; their files stayed until the driver collected its garbage."""
    monkeypatch.setattr(near_copies, "FEW_LINKS", links, raising=False)

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName().split("_") for i in range(files.size())]
        return {n[1] for n in names if n[0] == "shuffle"}

    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    rows = [*enumerate(edited(rng, b, 1) for b in base for _ in range(3))]
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    earlier = shuffles()
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), dense=2, pivots=1)
    until = time.time() + 20
    while len(left := shuffles() - earlier) > 3 and time.time() < until:
        time.sleep(0.5)
    assert len(left) <= 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert found.count() == 60 and found.select("g").distinct().count() == 20


def test_components_on_the_driver_are_the_same(spark):
    rng = random.Random(6)
    path = [*range(0, 400, 2), *range(399, 0, -2)]
    edges = [*zip(path, path[1:]), *((rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)), (-5, 2000), (2000, -(1 << 63)), (7, 7), (3000, 3000)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, common.components(df).collect()))
    for few in (len(edges), len(edges) - 1):
        assert sorted(map(tuple, common.components(df, few).collect())) == want
    assert len({r for _, r in want}) > 10 and (2000, -(1 << 63)) in want and (399, 0) in want
    assert common.components(df.limit(0), 9).collect() == [] == common.components(df.where("a = b"), 9).collect()
