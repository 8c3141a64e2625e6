"""Stored evidence, text inputs and their errors, masks and expressions, keyed draws."""

import pytest
from pyspark.sql import functions as F

from moltide.operators import cooccurrence as C
from moltide.operators import replay as R
from moltide.operators import statistics as S
from moltide.sources import archive as A
from moltide.sources import evidence as E
from moltide.sources import files as T

DATA = "/root/testdata/sf0.001"


def put(tmp_path, text):
    p = tmp_path / "x.txt"
    p.write_text(text)
    return str(p)


def test_regions_open_their_bins_only(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = E.records(spark, DATA)
    A.write_archive(rows, path)
    assert A.read_archive(spark, path).count() == rows.count()
    found = A.stored_region(spark, path, "chr2", 100, 900)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert "chrom" in filters and "bin" in filters and "anchor" in plan.split("PushedFilters:")[1]
    assert found.count() == rows.where("chrom = 'chr2' and anchor >= 100 and anchor < 900").count() > 0
    with pytest.raises(FileExistsError):
        A.write_archive(rows, path)


def test_files_of_an_archive_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(A, "FILE_ROWS", 50)
    A.write_archive(E.base(spark, DATA), str(tmp_path / "archive"), E.shaped)
    sizes = [pq.ParquetFile(p).metadata.num_rows for p in (tmp_path / "archive" / "records").rglob("*.parquet")]
    want = E.records(spark, DATA)
    assert max(sizes) <= 50 and sum(sizes) == want.count()
    kept = A.read_archive(spark, str(tmp_path / "archive")).select(*want.columns)
    assert kept.exceptAll(want).isEmpty() and want.exceptAll(kept).isEmpty()


def test_exons_become_half_open_and_touching_ones_merge(spark, tmp_path):
    line = lambda a, b, s="+", x='gene_id "g1"; transcript_id "t1";': f"c\tm\texon\t{a}\t{b}\t.\t{s}\t.\t{x}\n"
    got = T.gtf(spark, put(tmp_path, "#c\n" + line(21, 30) + line(1, 10) + line(11, 14) + "c\tm\tgene\t0\t0\t.\t+\t.\t\n")).collect()
    assert [(r.gene_id, r.strand_rev, [tuple(e) for e in r.exons]) for r in got] == [("g1", False, [(0, 14), (20, 30)])]
    for bad in (line(0, 5), line(9, 3), line(1, 5, "?"), line(1, 5, "+", 'gene_id "g";')):
        with pytest.raises(T.InputError):
            T.gtf(spark, put(tmp_path, bad)).collect()


def test_broken_side_files_are_refused(spark, tmp_path):
    for read, text in ((T.cells, "A\nB\nA\n"), (T.groups, "A\tx\nB\n"), (T.groups, "A\tx\nA\ty\n"), (T.batch_plan, "id\tkind\n1\tregion\n"), (T.batch_plan, "id\tkind\tlocus\n1\tregion\tc:9-3\n"), (T.batch_plan, "id\tkind\tlocus\n1\tgene\tc:1-3\n"), (T.federation, '{"schema_version":1,"archives":[{"sample":"s","path":"p"},{"sample":"s","path":"q"}]}'), (T.metadata, '{"columns":{"n":{"type":"int","optional":false}},"cells":{"s":{"b":{"n":"x"}}}}')):
        with pytest.raises(T.InputError):
            read(spark, put(tmp_path, text))
    with pytest.raises(T.InputError):
        T.cells(spark, put(tmp_path, "A\nZ\n"), spark.createDataFrame([("A",)], "barcode string"))


def test_names_are_resolved_in_turn(spark):
    tx = spark.createDataFrame([("E1.2", "AB"), ("E2.1", "AB"), ("E3.7", "E1.2"), ("E4", "CD")], "gene_id string, gene_name string")
    names = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    assert {(r.name, r.how, r.gene_id) for r in T.resolve(tx, names("E1.2", "E3", "CD")).collect()} == {("E1.2", "id", "E1.2"), ("E3", "unversioned", "E3.7"), ("CD", "symbol", "E4")}
    for bad in ("AB", "none"):
        with pytest.raises(T.InputError):
            T.resolve(tx, names(bad))


def test_expressions_are_three_valued(spark):
    df = spark.createDataFrame([(True, None), (False, None), (None, None), (True, False)], "a boolean, b boolean")
    got = df.select(*[C.parse(t, ["a", "b"])({"a": F.col("a"), "b": F.col("b")}).alias(f"x{i}") for i, t in enumerate(("a | b", "!(a & b)", "!a | !b & a"))]).collect()
    assert [tuple(r) for r in got] == [(True, None, None), (None, True, True), (None, None, None), (True, True, True)]
    for bad in ("a &", "(a", "c", "a b"):
        with pytest.raises(ValueError):
            C.parse(bad, ["a", "b"])


def test_states_of_a_placement(spark):
    exons = [(100, 200), (300, 400)]
    cases = {"Concordant": [(150, 200), (300, 350)], "ExonIntron": [(120, 180), (300, 320)], "Intron": [(220, 260)], "ExonIntronSpan": [(180, 220)], "Incompatible": [(90, 150)]}
    kind = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame([(k, v, exons) for k, v in cases.items() if k != "ExonIntron"], f"want string, blocks {kind}, exons {kind}")
    assert all(r.want == r.got for r in df.withColumn("got", R.versus(F.col("blocks"), F.col("exons"))).collect())


def test_survivors_follow_the_chain(spark):
    spark.sparkContext.setCheckpointDir("/tmp/moltide-test-checkpoints")
    best = spark.createDataFrame([(1, 0, "g", 9), (1, 1, "g", 5), (1, 5, "g", 3), (1, 9, "g", 1)], "cell long, umi_class long, gene_id string, w long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 5)], "cell long, a long, b long")
    assert {r.umi_class: r.survivor for r in R.survivors(best, edges).collect()} == {0: 0, 1: 0, 5: 0, 9: 9}


def test_draws_against_whole_numbers(spark):
    def mixed(z):
        z = z + S.STEP & S.MASK
        for shift, m in zip((30, 27), S.MULTIPLIERS):
            z = (z ^ z >> shift) * m & S.MASK
        return z ^ z >> 31

    values = [0, 1, 7, 2**31, 2**40 + 5, -1, -(2**63)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.split_mix(F.col("v")).alias("z")).collect()
    assert [r.z & S.MASK for r in got] == [mixed(v & S.MASK) for v in values]
