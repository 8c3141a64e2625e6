"""The pipeline language on made-up evidence: malformed programs, types, bounds of read support, states of predicates; statistics of ends."""

import pytest

from moltide.operators.ends import chi2_sf
from moltide.operators.ingest import cigar_blocks
from moltide.plans.pipeline_language import Compiler, QueryError, query
from moltide.sources import evidence

BEGIN = "header {gq = 1} from @lib.records |> within g[c7:2000..9000] "

#: sample, cell, umi_class, strand_rev, weight, reps, mms, tail; by weight: an unspliced pair, a spliced pair, a lone read, a multimapper
MADE = [
    ("a", 11, 40, True, 6, [[(2400, 2460)], [(2430, 2475)]], [], 2400),
    ("a", 12, 41, False, 9, [[(3000, 3040), (3300, 3350)], [(3010, 3040), (3300, 3390)]], [], None),
    ("b", 13, 42, False, 1, [[(5000, 5090)]], [], 5090),
    ("b", 13, 43, True, 4, [], [[(7000, 7030), (7200, 7260)]], None),
]


@pytest.fixture(scope="module")
def made(spark):
    block = "array<array<struct<start:bigint,end:bigint>>>"
    kinds = f"sample string, cell long, umi_class long, chrom string, strand_rev boolean, weight long, reps {block}, mms {block}, tail long"
    return spark.createDataFrame([(*r[:3], "c7", *r[3:]) for r in MADE], kinds)


def states(made, predicate):
    """Of each record, by weight, whether the predicate holds."""
    out = query(BEGIN + f"|> derive {{p = {predicate}}} |> select {{reads.total, p}}", made).collect()
    return [s for _, s in sorted(map(tuple, out))]


MALFORMED = {
    "a pipeline without a region": "header {gq = 1} from @lib.records |> derive {p = true}",
    "a version to come": "header {gq = 7} from @lib.records |> within all",
    "a region that ends before it begins": "header {gq = 1} from @lib.records |> within g[c7:900..400]",
    "an unknown stage": BEGIN + "|> shuffle {sample}",
    "rows cut without an order": BEGIN + "|> take 12",
    "a bracket that stays open": BEGIN + "|> where (true",
    "a text that stays open": BEGIN + '|> where sample == "a',
}


@pytest.mark.parametrize("why", MALFORMED)
def test_malformed_programs_are_refused(why):
    with pytest.raises(QueryError):
        Compiler(MALFORMED[why])


@pytest.mark.parametrize("expression", ['reads.total == "six"', "reads.total", "unheard_of(g[c7:2000..2100])"])
def test_conditions_of_the_wrong_type_are_refused(made, expression):
    with pytest.raises(QueryError):
        query(BEGIN + "|> where " + expression, made)


def test_support_of_an_overlap_is_bounded_by_what_is_stored(made):
    out = query(BEGIN + "|> derive {s = support_reads(overlaps(g[c7:2440..2455], min: 10bp))} |> select {reads.total, s.lower, s.upper, s.status}", made).collect()
    # both stored reads of the pair overlap by 15; of the four between them, which start from 2400 to 2430, the end is not stored
    assert sorted(map(tuple, out))[2] == (6, 2, 6, "bounded")
    assert [tuple(r)[1:] for r in sorted(map(tuple, out)) if r[0] != 6] == [(0, 0, "exact")] * 3


def test_support_of_a_junction_is_exact(made):
    out = query(BEGIN + "|> derive {s = support_reads(j[c7:3040..3300])} |> select {reads.total, s.lower, s.upper, s.status}", made).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 0, "exact"), (4, 0, 0, "exact"), (6, 0, 0, "exact"), (9, 9, 9, "exact")]


def test_placements_by_their_kind(made):
    # weights 1, 4, 6, 9
    assert states(made, "nonempty(unique)") == [True, False, True, True]
    assert states(made, "any unique {start_in(g[c7:3000..3001])}") == [False, False, False, True]
    assert states(made, "all stored {end_in(g[c7:5080..5100])}") == [True, True, False, False]
    assert states(made, "any multimap {all alternative {overlaps(g[c7:7210..7220])}}") == [False, True, False, False]
    assert states(made, "any unique {j[c7:3040..3300]}") == [False, False, False, True]
    assert states(made, "terminal(g[c7:2300..2500])") == [False, False, True, False]


def test_junction_only_support_is_one_number_for_both_implementations(made):
    from moltide.functions import geometry as G
    from moltide.operators import queries as Q

    bounds = {r.weight: (r.lower, r.upper) for r in Q.support_reads(made, lambda b: G.has_junction(b, 3040, 3300)).collect()}
    assert bounds == {1: (0, 0), 4: (0, 0), 6: (0, 0), 9: (9, 9)}


def test_arithmetic_signs_and_lists(made):
    assert states(made, "reads.total in [4u64, 9u64]") == [False, True, False, True]
    assert states(made, "reads.total + 2u64 > 7u64") == [False, False, True, True]


def test_cigar(spark):
    one = lambda c: [tuple(b) for b in spark.sql(f"select 40 as p, '{c}' as c").select(cigar_blocks(*map(evidence.F.col, "pc"))).first()[0]]
    assert one("7S9M3D6M25N2=1X4I3M1S") == [(40, 58), (83, 89)]
    assert one("11N8M") == [(51, 59)] and one("6S") == []


@pytest.mark.parametrize(("x", "k"), [(3.841, 1), (5.991, 2), (7.815, 3), (11.070, 5)])
def test_chi2(x, k):
    assert abs(chi2_sf(x, k) - 0.05) < 1e-4
