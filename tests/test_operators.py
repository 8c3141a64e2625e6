"""Operators on literal evidence, with the edge cases that the generated tables lack."""

from pyspark.sql import functions as F

from moltide.functions import geometry as G
from moltide.operators import ingest
from moltide.operators import queries as Q
from moltide.operators import replay as R

SCHEMA = "umi_class long, cell long, chrom string, strand_rev boolean, anchor long, weight long, reps array<array<struct<start:bigint,end:bigint>>>, mms array<array<struct<start:bigint,end:bigint>>>"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_cassette_boundary(spark):
    c = spark.createDataFrame([("c", 10, 20, 5), ("c", 20, 30, 5), ("c", 10, 30, 5)], "chrom string, donor long, acceptor long, supporting_children long")
    kinds = lambda strict: {r.kind for r in Q.discover_events(c, strict=strict).select("kind").distinct().collect()}
    assert "cassette" in kinds(False)
    assert "cassette" not in kinds(True)


def test_support_bounds(spark):
    blocks = lambda *b: [dict(start=s, end=e) for s, e in b]
    two = [blocks((0, 10), (20, 30)), blocks((5, 10), (25, 30))]
    got = Q.support_reads(records(spark, (1, 1, "c", False, 0, 9, two, []), (2, 1, "c", False, 0, 4, two[:1], []), (3, 1, "c", False, 0, 3, [], two[:1])), lambda b: G.has_junction(b, 10, 20)).orderBy("umi_class").collect()
    assert [(r.lower, r.upper, r.status) for r in got] == [(1, 8, "bounded"), (4, 4, "exact"), (3, 3, "exact")]


def test_kleene_fold(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False)], "k int, p boolean")
    got = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(G.kleene_any(F.col("p")).alias("a"), G.kleene_all(F.col("p")).alias("b")).collect()}
    assert got == {1: (True, None), 2: (None, False), 3: (False, False)}


def test_islands_and_intervals(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 24, 48, 73, 200)], "g string, x long")
    assert [r.island for r in Q.islands(df, ["g"], "x", 24).orderBy("x").collect()] == [0, 0, 0, 1, 2]
    a = spark.createDataFrame([(1, "c", 0, 20_000), (2, "c", 5_000, 5_001), (3, "d", 0, 9)], "i int, chrom string, start long, end long")
    b = spark.createDataFrame([(7, "c", 4_000, 9_000), (8, "c", 20_000, 20_001)], "j int, chrom string, bstart long, bend long")
    assert sorted((r.i, r.j) for r in R.interval_join(a, b, ["chrom"]).collect()) == [(1, 7), (2, 7)]


def test_collapse_ties(spark):
    best = spark.createDataFrame([(1, 0, "g", 5), (1, 1, "g", 5), (1, 5, "g", 1), (1, 21, "h", 9)], "cell long, umi_class long, gene_id string, w long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 5), (1, 5, 21)], "cell long, a long, b long")
    assert {r.gene_id: r.umis for r in R.collapse(best, edges).collect()} == {"g": 1, "h": 1}


def test_scalars(spark):
    row = spark.range(1).select(G.parse_locus(F.lit("chr1:1,000-2,000")).alias("l"), G.parse_locus(F.lit("chr1:9-9")).alias("n"), G.pack(F.lit("ACGT")).alias("p"), G.pack(F.lit("ACN")).alias("q"), G.hamming_one(F.lit(1), F.lit(3)).alias("h"), G.hamming_one(F.lit(0), F.lit(5)).alias("k"), G.unversion(F.lit("G.1.23")).alias("u")).first()
    assert (tuple(row.l), row.n, row.p, row.q, row.h, row.k, row.u) == (("chr1", 1000, 2000), None, 27, None, True, False, "G.1")


def test_paths(spark):
    b = "array(struct(0L as start, 1L as end), struct(5L as start, 6L as end), struct(9L as start, 10L as end), struct(20L as start, 21L as end))"
    df = spark.sql(f"select {b} as b")
    b = F.col("b")
    row = df.select(G.has_path(b, [(1, 5), (6, 9)]).alias("x"), G.has_path(b, [(1, 5), (10, 20)]).alias("y"), G.has_subpath(b, [(1, 5), (10, 20)]).alias("z"), G.has_subpath(b, [(10, 20), (1, 5)]).alias("w")).first()
    assert tuple(row) == (True, False, True, False)


def test_cells_are_renumbered_beyond_the_first_forty(spark):
    cells = [(100 - c, k) for c in range(60) for k in range(1 + c % 7)]
    rows = spark.createDataFrame(cells, "cell long, molecule long")
    count = {c: sum(x == c for x, _ in cells) for c, _ in cells}
    want = {c: i for i, c in enumerate(sorted(count, key=lambda c: (-count[c], c)))}
    assert {r.cell: (r.n, r.new_id) for r in ingest.cell_numbers(rows).collect()} == {c: (count[c], i) for c, i in want.items()}
    assert sorted(map(tuple, ingest.renumber_cells(rows).collect())) == sorted((want[c], k) for c, k in cells)


def test_barcodes_meet_their_neighbours_without_a_broadcast(spark):
    listed = [0, 5, 0x40000000, 0xC0000000, 0xFFFFFFFF]
    quals = [[30] * 16, [30] * 15 + [2], None, [0] * 16, [None] * 16]
    reads = [(i, code, q) for i, (code, q) in enumerate((c ^ x, q) for c in listed for x in (0, 1, 2 << 30, 3 << 14) for q in quals)]
    df = spark.createDataFrame(reads, "read long, code long, quals array<int>")
    exact = {c: sum(r[1] == c for r in reads) for c in listed}
    want = {}
    for i, code, q in reads:
        if code in exact:
            want[i] = code
            continue
        at = {c: next(k for k in range(16) if (code ^ c) >> (2 * (15 - k)) & 3) for c in listed if sum((code ^ c) >> (2 * k) & 3 > 0 for k in range(16)) == 1}
        w = {c: (exact[c] + 1) * (0.01 if q is None or q[k] is None else 10 ** (-min(max(q[k], 0), 33) / 10)) for c, k in at.items()}
        if w and max(w.values()) / sum(w.values()) > ingest.POSTERIOR:
            want[i] = max(w, key=w.get)
    found = ingest.correct_barcodes(df, spark.createDataFrame([(c,) for c in listed], "code long"))
    assert {r.read: r.cell for r in found.collect()} == want
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_records_of_one_geometry_are_decided_once(spark):
    kind = "array<struct<start:bigint,end:bigint>>"
    tx = spark.createDataFrame([("c", "g1", "t1", False, [(0, 100), (200, 300)]), ("c", "g1", "t2", False, [(0, 100), (250, 300)]), ("c", "g2", "t3", False, [(40, 90)]), ("d", "g3", "t4", True, [(5000, 9000)])], f"chrom string, gene_id string, transcript_id string, strand_rev boolean, exons {kind}")
    wide = [dict(start=10, end=20)], [dict(start=50, end=60)], [dict(start=80, end=100), dict(start=200, end=210)], [dict(start=400, end=410)], [dict(start=8000, end=8001)]
    rows = spark.createDataFrame([("s", 1, 1, "c", False, 2, [wide[0], wide[2]], []), ("s", 1, 1, "c", False, 3, [], [wide[0]]), ("s", 1, 2, "c", False, 5, [wide[1]], []), ("s", 2, 3, "c", False, 1, [wide[3]], []), ("s", 2, 4, None, None, 1, [wide[0]], []), ("s", 2, 5, "d", True, 7, [wide[4], wide[4]], []), ("s", 2, 6, "c", False, 9, [], [])], f"sample string, cell long, umi_class long, chrom string, strand_rev boolean, weight long, reps array<{kind}>, mms array<{kind}>")
    some = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    plan = R.audit(rows, tx)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("umi_class" in line for line in plan.splitlines() if "Aggregate" in line or "Join" in line)
    assert some(R.audit(rows, tx), "bucket", "rows_", "reads") == [("multi", 1, 5), ("none", 2, 2), ("single", 5, 21)]
    assert some(R.fates(rows, tx), "fate", "classes", "cells") == [("multi_only", 1, 1), ("no_gene", 2, 1), ("single", 2, 2)]
    assert some(R.equivalence_classes(rows, tx), "status", "transcripts", "classes", "cells") == [("assigned", 1, 1, 1), ("assigned", 1, 1, 1), ("assigned", 3, 1, 1), ("no_compatible", 0, 2, 1)]
    want = [(1, 1, 2, "g1", 2), (1, 1, 3, "g1", 1), (2, 5, 7, "g3", 2)]
    for most in (R.MOST_SHAPES, 0):  # sent to all tasks, or met in a shuffle
        assert some(R.assigned(rows, tx, most=most), "cell", "umi_class", "weight", "gene_id", "copies") == want


def test_edges_and_collapse_within_cell_and_gene(spark):
    import random

    draw = random.Random(5)
    classes = sorted({draw.randrange(64) << draw.choice((0, 6, 18)) for _ in range(60)} | {(3 << 24) + 1, (9 << 24) + 2, 1 << 40})
    best = [(c, u, f"g{draw.randrange(2)}", draw.randrange(3)) for c in (1, 2) for u in classes]
    df = spark.createDataFrame(best, "cell long, umi_class long, gene_id string, w long")
    near = lambda a, b: sum((a ^ b) >> (2 * i) & 3 > 0 for i in range(12)) == 1
    assert sorted(map(tuple, R.umi_edges(df).select("cell", "a", "b").collect())) == sorted((c, a, b) for c in (1, 2) for a in classes for b in classes if a < b and near(a, b))
    first, kept, want = lambda r: (-r[3], r[1]), {}, {}
    for c, u, g, w in sorted(best, key=first):
        before = [r for r in best if r[0] == c and r[2] == g and near(u, r[1]) and first(r) < (-w, u)]
        want[c, u] = want[c, min(before, key=first)[1]] if before else u
        kept[c, g] = kept.get((c, g), 0) + (not before)
    assert {(r.cell, r.gene_id): r.umis for r in R.collapse(df).collect()} == kept
    spark.sparkContext.setCheckpointDir("/tmp/moltide-test-checkpoints")
    assert {(r.cell, r.umi_class): r.survivor for r in R.survivors(df).collect()} == want


def test_events_are_counted_where_classes_lie(spark):
    kind = "array<array<struct<start:bigint,end:bigint>>>"
    blocks = lambda *x: [dict(start=a, end=b) for a, b in zip((0, *x[1::2]), (*x[0::2], 99))]
    short, long, far = blocks(10, 20), blocks(10, 30), blocks(10, 20, 25, 30)
    made = [("s", 1, 1, [short], []), ("s", 1, 1, [long], []), ("s", 1, 2, [short, short], []), ("t", None, 3, [], [long]), ("t", 2, 4, [far], []), (None, 2, 4, [long], []), ("t", 3, 5, [far], []), ("t", 3, None, [], [])]
    rows = spark.createDataFrame([(*r[:3], "c", *r[3:]) for r in made], f"sample string, cell long, umi_class long, chrom string, reps {kind}, mms {kind}")
    old = Q.sides(Q.junction_rows(rows).select("sample", "chrom", "donor", "acceptor", "umi_class", "cell").join(Q.discover_events(Q.junction_catalogue(rows)), ["chrom", "donor", "acceptor"]), ["sample", "event_id", "kind"]).where("informative_umis >= 1")
    got = Q.events(rows, ["sample"])
    assert sorted(map(str, got.select(*old.columns).collect())) == sorted(map(str, old.collect())) != []
    assert not any("umi_class" in x and "event_id" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_a_full_tile_is_not_gathered(spark):
    rows = spark.createDataFrame([("c", 5, k, k % 3, [[dict(start=0, end=10), dict(start=20, end=30)]], []) for k in range(9)], "chrom string, anchor long, umi_class long, cell long, reps array<array<struct<start:bigint,end:bigint>>>, mms array<array<struct<start:bigint,end:bigint>>>")
    plan = spark.createDataFrame([("r", "region", "c", 0, 9), ("j", "junction", "c", 10, 20), ("n", "region", "d", 0, 9)], "id string, kind string, chrom string, start long, end long")
    found = Q.batch(rows, plan)
    assert not any("Exchange" in x and "tile" in x for x in found._jdf.queryExecution().executedPlan().toString().splitlines())
    assert sorted((r.id, r.present, r.umis, r.cells) for r in found.collect()) == [("j", True, 9, 3), ("n", False, 0, 0), ("r", True, 9, 3)]


def test_distinct_counts_hold_a_row_once(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, None), (None, None, 5), (None, 7, 5)], "k string, umi_class long, cell long")
    got = Q.distinct_counts(rows, ["k"])
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.umis, r.cells) for r in got.collect()} == {"a": (2, 2), None: (1, 1)}
