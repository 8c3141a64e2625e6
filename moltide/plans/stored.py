"""Registered queries over files: stored evidence, text inputs, sinks; and over masks, placements' states and keyed draws."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cooccurrence as C
from ..operators import ends as N
from ..operators import queries as Q
from ..operators import replay as R
from ..operators import statistics as S
from ..sources import archive as A
from ..sources import evidence as E
from ..sources import files as T
from . import sinks
from .catalogue import COUNTS, FORWARD, ORACLES, PLAN, QUERIES, cand, register, tx_of
from .more import SQL, THREE, WHOLE

ORACLES["src_region_route"] = ORACLES["q_region_grp"]
QUERIES["src_region_route"] = lambda spark, sf_dir: Q.region(A.stored_region(spark, A.evidence_path(spark, sf_dir), "chr1", 280, 1080), "chr1", 280, 1080, ["grp"])
ORACLES["src_lazy"] = ORACLES["q_junction"]
QUERIES["src_lazy"] = lambda spark, sf_dir: A.stored_junction(spark, A.evidence_path(spark, sf_dir), "chr1", 300, 480).groupBy("grp").agg(Q.umis(), Q.cells())


@register("src_chunk_index", SQL + "select chrom, cast(floor(pos / 4000000) * 4000000 as bigint) as bin_start, count(*) as n_mols, cast(max(pos) as bigint) as max_anchor from rec group by all")
def src_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_archive(spark, A.evidence_path(spark, sf_dir), "chunks").groupBy("chrom", "bin_start").agg(F.sum("n_mols").alias("n_mols"), F.max("max_anchor").alias("max_anchor"))


@register("src_junc_catalogue", SQL + "select chrom, cast(donor as bigint) as donor, cast(acceptor as bigint) as acceptor, n as supporting_children from cat")
def src_junc_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_archive(spark, A.evidence_path(spark, sf_dir), "junctions").groupBy("chrom", "donor", "acceptor").agg(F.sum("supporting_children").alias("supporting_children"))


@register("src_tail_route", ORACLES["src_tail_route"], common=False)
def src_tail_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_archive(spark, A.evidence_path(spark, sf_dir), "tails").groupBy("chrom", "strand_rev", "tail").agg(Q.umis(), Q.cells())


def written(spark: SparkSession, name: str, text: str) -> str:
    return T.put_text(spark, f"{A.scratch(spark)}/{uuid.uuid4().hex}-{name}", text)


def gtf_text(spark: SparkSession) -> str:
    """The generated annotation as GTF, each transcript's second exon in two that touch."""
    lines = ["#!made for a test"]
    for t in E.annotation(spark).collect():  # 180 rows
        strand, made = "-" if t.strand_rev else "+", f'gene_id "{t.gene_id}"; gene_name "n{t.gene_id}"; transcript_id "{t.transcript_id}";'
        (a, b), (c, d), (e, f) = t.exons
        lines.append(f"{t.chrom}\tmade\ttranscript\t{a + 1}\t{f}\t.\t{strand}\t.\t{made}")
        lines += [f"{t.chrom}\tmade\texon\t{s + 1}\t{x}\t.\t{strand}\t.\t{made}" for s, x in ((e, f), (a, b), (c + 5, d), (c, c + 5))]
    return "\n".join(lines) + "\n"


@register("src_gtf", SQL + "select chrom, gene_id, 'n' || gene_id as gene_name, transcript_id, strand_rev, x1s || '-' || x1e || ',' || x2s || '-' || x2e || ',' || x3s || '-' || x3e as exons from tx")
def src_gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = T.gtf(spark, written(spark, "a.gtf", gtf_text(spark)))
    return tx.withColumn("exons", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


@register("ann_resolve", SQL + "select gene_id as name, 'id' as how, gene_id from tx where chrom = 'chr1' group by all union all select 'n' || gene_id, 'symbol', gene_id from tx where chrom = 'chr2' group by all")
def ann_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = T.gtf(spark, written(spark, "a.gtf", gtf_text(spark)))
    names = tx.where("chrom = 'chr1'").select(F.col("gene_id").alias("name")).union(tx.where("chrom = 'chr2'").select("gene_name")).distinct()
    return T.resolve(tx, names)


CODE = "lpad(cast(c_custkey as varchar), 16, 'A')"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 16, "A").alias("barcode"))


@register("src_barcodes", f"select {CODE} as barcode from customer", common=False)
def src_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{A.scratch(spark)}/{uuid.uuid4().hex}"
    codes(spark, sf_dir).select(F.explode(F.array(F.concat("barcode", F.lit(" ")), F.lit("SHORT"))).alias("value")).write.text(path)
    return T.barcodes(spark, path)


@register("src_cells", f"select {CODE} as barcode from customer where c_custkey between 1 and 40", common=False)
def src_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = codes(spark, sf_dir).select("barcode")
    return T.cells(spark, written(spark, "cells.tsv", "# chosen\n" + "".join(f"{str(k).rjust(16, 'A')}\n" for k in range(1, 41))), known)


@register("src_groups", f"select {CODE} as barcode, 'g' || c_custkey % 3 as grp, cast((c_custkey + 2) % 3 as int) as rank from customer where c_custkey between 1 and 60", common=False)
def src_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.groups(spark, written(spark, "groups.tsv", "".join(f"{str(k).rjust(16, 'A')}\tg{k % 3}\n" for k in range(1, 61))), codes(spark, sf_dir).select("barcode"))


@register("src_batch_plan", ORACLES["q_batch"], common=False)
def src_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "id\tkind\tlocus\n" + "".join(f"{i}\t{kind}\t{chrom}:{start:,}-{end:,}\n" for i, kind, chrom, start, end in PLAN)
    return Q.batch(A.evidence(spark, sf_dir), T.batch_plan(spark, written(spark, "plan.tsv", text)))


@register("src_design", "select 's' || x as sample, 'c' || x % 2 as condition, 'a' || x as archive, 'l' || x as cells from range(1, 9) t(x)", common=False)
def src_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["sample", "condition", "archive", "cells"]
    return T.design(spark, written(spark, "design.tsv", "\t".join(columns) + "\n" + "".join(f"s{x}\tc{x % 2}\ta{x}\tl{x}\n" for x in range(1, 9))), columns, ("sample", "archive"))


@register("src_polyasite", SQL + "select distinct chrom, strand_rev, cast(x3e - 1 as bigint) as start, cast(x3e as bigint) as \"end\", transcript_id as name, 1.5::double as score from tx")
def src_polyasite(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "".join(f"{t.chrom}\t{t.exons[2].end - 1}\t{t.exons[2].end}\t{t.transcript_id}\t1.5\t{'-' if t.strand_rev else '+'}\n" for t in E.annotation(spark).collect())
    return T.sites(spark, written(spark, "sites.bed", text))


@register("src_fasta", "select 'c' || x as contig, length(s) as bases, sha256(s) as sha256 from (select x, repeat('ACGT', x * 30) as s from range(1, 6) t(x))", common=False)
def src_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wrap(x: int) -> str:
        s = "acgt" * (30 * x)
        return "\n".join(s[k : k + 50] for k in range(0, len(s), 50))

    found = T.fasta(spark, written(spark, "g.fa", "".join(f">c{x} made\n{wrap(x)}\n" for x in range(1, 6))))
    return found.select("contig", F.length("sequence").cast("long").alias("bases"), "sha256")


@register("src_federation", "select 'asm' as assembly, 's' || x as sample, 'p' || x as path from range(3) t(x)", common=False)
def src_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = ",".join(f'{{"sample":"s{x}","path":"p{x}","metadata":"m{x}"}}' for x in range(3))
    return T.federation(spark, written(spark, "f.json", f'{{"schema_version":1,"assembly":"asm","archives":[{members}]}}')).select("assembly", "sample", "path")


@register("src_metadata", "select 's' || x % 2 as sample, 'b' || x as barcode, cast(x as varchar) as age, case when x % 3 = 0 then 'k' end as kind from range(12) t(x)", common=False)
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda x: f'"b{x}":{{"age":{x}' + (',"kind":"k"' if x % 3 == 0 else "") + "}"
    by = ",".join(f'"s{s}":{{{",".join(cell(x) for x in range(12) if x % 2 == s)}}}' for s in (0, 1))
    text = f'{{"columns":{{"age":{{"type":"int","optional":false}},"kind":{{"type":"string","optional":true}}}},"cells":{{{by}}}}}'
    return T.metadata(spark, written(spark, "m.json", text)).select("sample", "barcode", F.element_at("values", "age").alias("age"), F.element_at("values", "kind").alias("kind"))


# --- masks and expressions over chr1

PREDICATES = [C.junction("ro", 300, 480), C.overlap("ra", 300, 420, 12), C.ends("en", 300, 420)]
BITS = f"""b as (select record_id, bool_or(n_junc >= 1 and e1 = 300 and s2 = 480 or n_junc = 2 and e2 = 300 and s3 = 480) as ro, bool_or({WHOLE} >= 12) as ra, bool_or(pend >= 300 and pend < 420) as en from pl where not is_mm and chrom = 'chr1' group by record_id),
m as (select rec.*, (case when coalesce(ro, false) then 1 else 0 end + case when coalesce(ra, false) then 2 else 0 end + case when coalesce(en, false) then 4 else 0 end)::bigint as mask,
 (1 + case when coalesce(ra, false) or is_mm or weight <= 2 then 2 else 0 end + case when coalesce(en, false) or is_mm or weight <= 2 then 4 else 0 end)::bigint as known from rec left join b using (record_id) where chrom = 'chr1'),
"""
PATTERNS = "select mask, known, count(*) as units, count(distinct umi_class) as umis, count(distinct cell) as cells from {} group by all"


def on_chr1(rows: DataFrame) -> DataFrame:
    return rows.where("chrom = 'chr1'")


@register("co_mask", BITS + SQL + PATTERNS.format("m"))
def co_mask(rows: DataFrame) -> DataFrame:
    return C.patterns(C.masked(on_chr1(rows), PREDICATES))


@register("co_patterns", BITS + "k as (select cell, umi_class, bit_or(mask) as mask, bit_and(known) as known from m group by all) " + PATTERNS.format("k"))
def co_patterns(rows: DataFrame) -> DataFrame:
    return C.patterns(C.by_class(C.masked(on_chr1(rows), PREDICATES)))


@register("co_membership", BITS + "z as (select 1) select cast(cell as bigint) as cell, cast(umi_class as bigint) as umi_class, bit_or(mask) as mask, bit_and(known) as known from m group by cell, umi_class having bit_or(mask) & 2 > 0")
def co_membership(rows: DataFrame) -> DataFrame:
    """Classes of the universe of the second predicate, a row each."""
    return C.by_class(C.masked(on_chr1(rows), PREDICATES)).where(F.col("mask").bitwiseAND(F.lit(2)) > 0)


STATES = "t as (select *, mask & 1 > 0 as ro, case when mask & 2 > 0 then true when known & 2 > 0 then false end as ra, case when mask & 4 > 0 then true when known & 4 > 0 then false end as en from m), "


@register("co_expr", BITS + STATES + SQL + "select sample, (not ro and (ra or en)) as state, count(*) as units, count(distinct cell) as cells from t group by all")
def co_expr(rows: DataFrame) -> DataFrame:
    found = C.select(C.masked(on_chr1(rows), PREDICATES), PREDICATES, "!ro & (ra | en)")
    return found.groupBy("sample", "state").agg(F.count("*").alias("units"), Q.cells())


@register("co_match_within", f"""p as (select record_id, ({WHOLE} >= 12 and not (pend >= 300 and pend < 420)) as h from pl where not is_mm and chrom = 'chr1'),
h as (select record_id, bool_or(h) as a, bool_and(h) as b from p group by record_id),
s as (select sample, case when is_mm then false when a then true when weight > 2 then null else false end as any_state, case when is_mm then false when not b then false when weight > 2 then null else true end as all_state from rec left join h using (record_id) where chrom = 'chr1')
select sample, any_state, all_state, count(*) as units from s group by all""")
def co_match_within(rows: DataFrame) -> DataFrame:
    found = C.match_within(on_chr1(rows), PREDICATES, "ra & !en", "any").withColumnRenamed("state", "any_state")
    found = C.match_within(found, PREDICATES, "ra & !en", "all").withColumnRenamed("state", "all_state")
    return found.groupBy("sample", "any_state", "all_state").agg(F.count("*").alias("units"))


def touched(a: int, b: int) -> str:
    return f"(s1 < {b} and e1 > {a} or n_junc >= 1 and s2 < {b} and e2 > {a} or n_junc = 2 and s3 < {b} and e3 > {a})"


@register("co_region_match", f"r as (select record_id, bool_or(s1 >= 280 and s1 < 480) as an, bool_or({touched(280, 480)}) as al from pl where chrom = 'chr1' group by record_id), z as (select 1) select sample, count(*) filter (an) as anchored, count(*) filter (al) as aligned, count(*) filter (al and not is_mm) as aligned_unique from rec join r using (record_id) group by sample")
def co_region_match(rows: DataFrame) -> DataFrame:
    """Records whose placements begin in a region, or align to it, among all placements and among those of unique reads."""
    both = [C.region("an", 280, 480), C.region("al", 280, 480, "aligned")]
    found = C.masked(on_chr1(rows), both, "direct").withColumnRenamed("mask", "every")
    found = C.masked(found, both).withColumn("one", F.col("mask"))
    bit = lambda c, k: F.count_if(F.col(c).bitwiseAND(F.lit(k)) > 0)
    return found.groupBy("sample").agg(bit("every", 1).alias("anchored"), bit("every", 2).alias("aligned"), bit("one", 2).alias("aligned_unique"))


# --- replay

JUNCTION = "({0} = x1e and {1} = x2s or {0} = x2e and {1} = x3s)"
IN = "({0} >= x1s and {1} <= x1e or {0} >= x2s and {1} <= x2e or {0} >= x3s and {1} <= x3e)"
OFF = "(({1} <= x1s or {0} >= x1e) and ({1} <= x2s or {0} >= x2e) and ({1} <= x3s or {0} >= x3e))"
EACH = [("s1", "e1", 0), ("s2", "e2", 1), ("s3", "e3", 2)]
ANY_CROSSES = " or ".join(f"(n_junc >= {k} and not {IN.format(s, e)} and not {OFF.format(s, e)})" for s, e, k in EACH)
ALL_IN = " and ".join(f"(n_junc < {k} or {IN.format(s, e)})" for s, e, k in EACH)
ANY_IN = " or ".join(f"(n_junc >= {k} and {IN.format(s, e)})" for s, e, k in EACH)


@register("rp_vs_tx", f"""v as (select transcript_id, case when s1 < x1s or pend > x3e or n_junc >= 1 and not {JUNCTION.format('e1', 's2')} or n_junc = 2 and not {JUNCTION.format('e2', 's3')} then 'Incompatible'
 when {ANY_CROSSES} then 'ExonIntronSpan' when {ALL_IN} then 'Concordant' when {ANY_IN} then 'ExonIntron' else 'Intron' end as state from pl join tx on pl.chrom = tx.chrom and s1 < x3e and pend > x1s)
select transcript_id, state, count(*) as placements from v group by all""")
def rp_vs_tx(rows: DataFrame) -> DataFrame:
    return R.states(rows, tx_of(rows)).groupBy("transcript_id", "state").agg(F.sum("copies").alias("placements"))


@register("rp_canon", cand(FORWARD) + COUNTS.replace("ab as (", "nb as (select x.cell, x.gene_id, x.umi_class as a, arg_max(y.umi_class, y.w * 100000000 - y.umi_class) as b from bg x join ed on ed.cell = x.cell and ed.a = x.umi_class join bg y on y.cell = x.cell and y.gene_id = x.gene_id and y.umi_class = ed.b where y.w > x.w or y.w = x.w and y.umi_class < x.umi_class group by all),\nab as (") + """
w as (select cell, gene_id, umi_class as a, umi_class as to_ from bg union all select w.cell, w.gene_id, w.a, nb.b from w join nb on nb.cell = w.cell and nb.gene_id = w.gene_id and nb.a = w.to_)
select cast(w.cell as bigint) as cell, w.gene_id, cast(w.a as bigint) as umi_class, cast(to_ as bigint) as survivor from w where not exists (select 1 from nb where nb.cell = w.cell and nb.gene_id = w.gene_id and nb.a = w.to_)""")
def rp_canon(rows: DataFrame) -> DataFrame:
    if not rows.sparkSession.sparkContext.getCheckpointDir():
        rows.sparkSession.sparkContext.setCheckpointDir(f"{A.scratch(rows.sparkSession)}/rounds")
    return R.survivors(R.best_of(rows, tx_of(rows)))


ORACLES["rp_canon"] = ORACLES["rp_canon"].replace("with base", "with recursive base", 1)


@register("ing_class_assign", "o as (select cell, umi_class, min((case chrom when 'chr1' then 1 when 'chr2' then 2 else 3 end) * 10000000 + pos) as first from rec group by all) select cast(cell as bigint) as cell, cast(umi_class as bigint) as umi_class, row_number() over (order by first, cell, umi_class) - 1 as class_id from o")
def ing_class_assign(rows: DataFrame) -> DataFrame:
    """Classes numbered by where they first stand in genome order: sorted by range and numbered from the partitions' sizes."""
    first = rows.groupBy("cell", "umi_class").agg(F.min(F.struct("chrom", "anchor")).alias("first")).orderBy("first", "cell", "umi_class").select("cell", "umi_class")
    return rows.sparkSession.createDataFrame(first.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "cell long, umi_class long, class_id long")


# --- statistics and scalars

HALF = "case when {0} < 0 then {0} + 18446744073709551616::hugeint else {0}::hugeint end"


@register("fn_splitmix", """k as (select c_custkey, ((c_custkey::hugeint << 32) + c_nationkey) as x from customer),
a as (select c_custkey, (xor(x, 7::hugeint) + 11400714819323198485::hugeint) % 18446744073709551616::hugeint as z from k),
b as (select c_custkey, xor(z, z >> 30) as z from a),
b2 as (select c_custkey, ((z % 4294967296::hugeint) * 13787848793156543929::hugeint + ((z >> 32) * 13787848793156543929::hugeint % 4294967296::hugeint) * 4294967296::hugeint) % 18446744073709551616::hugeint as z from b),
c as (select c_custkey, xor(z, z >> 27) as z from b2),
c2 as (select c_custkey, ((z % 4294967296::hugeint) * 10723151780598845931::hugeint + ((z >> 32) * 10723151780598845931::hugeint % 4294967296::hugeint) * 4294967296::hugeint) % 18446744073709551616::hugeint as z from c)
select c_custkey, cast(xor(z, z >> 31) >> 11 as double) / 9007199254740992.0 < 0.3 as held_out from c2""".replace("k as", "with k as", 1), common=False)
def fn_splitmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.held_out(7, F.col("c_custkey"), F.col("c_nationkey"), 0.3).alias("held_out"))


@register("fn_depth_gate", "k as (select cell, count(*) as n from rec group by cell) select cast(cell as bigint) as cell, round(pow(n, 1.5) / (pow(n, 1.5) + pow(20, 1.5)), 9) as gate from k")
def fn_depth_gate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.round(S.depth_gate(F.col("n"), 20.0, 1.5), 9).alias("gate"))


@register("fn_paired", """k as (select grp, sample, count(*) filter (strand_rev) - count(*) filter (not strand_rev) as d from rec group by all),
f as (select grp, m, abs(sum(case when (m >> i) & 1 = 1 then -d else d end)) as t from (select grp, d, row_number() over (partition by grp order by sample) - 1 as i from k) cross join range(32) r(m) group by grp, m),
o as (select grp, count(*) as n, avg(d) as mean, abs(sum(d)) as t, avg(d) / (stddev_samp(d) / sqrt(count(*))) as tt from k group by grp)
select o.grp, n, round(mean, 9) as mean, round(tt, 9) as t, count(*) filter (f.t >= o.t) / 32.0::double as p from o join f on f.grp = o.grp group by all""")
def fn_paired(rows: DataFrame) -> DataFrame:
    """Differences between strands, paired by sample (5 of them), in each group."""
    d = rows.groupBy("grp", "sample").agg((F.count_if("strand_rev") - F.count_if(~F.col("strand_rev"))).cast("double").alias("d"))
    return S.paired(d, ["grp"], "d").select("grp", "n", F.round("mean", 9).alias("mean"), F.round("t", 9).alias("t"), "p")


@register("fn_pack", "select o_orderkey, o_orderkey % 65536 as packed from orders", common=False)
def fn_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as eight bases, and back."""
    n = F.col("o_orderkey").cast("long") % 65536
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", G.pack(G.unpack(n, 8)).alias("packed"))


# --- sinks: written, and read again


@register("snk_mex", ORACLES["snk_mex"], common=False)
def snk_mex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.evidence(spark, sf_dir)
    path = f"{A.scratch(spark)}/{uuid.uuid4().hex}"
    sinks.write_mex(R.gene_counts(rows, tx_of(rows)), path, "gene_id", "cell", "umis")
    return sinks.read_mex(spark, path)


@register("snk_tsv", ORACLES["q_region_grp"], common=False)
def snk_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = f"{A.scratch(spark)}/{uuid.uuid4().hex}", QUERIES["q_region_grp"](spark, sf_dir)
    sinks.write_text(out, path, "tsv")
    return spark.read.csv(path, sep="\t", header=True, schema=out.schema)


@register("snk_json", ORACLES["q_junction"], common=False)
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = f"{A.scratch(spark)}/{uuid.uuid4().hex}", QUERIES["q_junction"](spark, sf_dir)
    sinks.write_text(out, path, "json")
    return spark.read.schema(out.schema).json(path)
