import random

import pytest

from strandlake.functions import dna
from strandlake.operators import checks, counting, search
from strandlake.operators.index import KmerIndex
from strandlake.sources import sequences
from tests import naive
from pyspark.sql import functions as F

DOC = ["TGTTTG", "TTGCTAT", "ACGTAGTATAT", "TGTAAA"]
PAPER = ["AGGTAAA", "ACAGGTAGGAAAGGAAAGT"]


def build(spark, seqs, k, **options):
    return KmerIndex.build(sequences.from_values(spark, seqs), k, **options)


def rows(index, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in index.orderBy("colex").select(*cols).collect()]


def test_label_sets_of_the_documented_example(spark):
    # fixed values: the 25 sets of the published example
    expected = "AT,C,,A,T,T,AGT,,,G,T,T,T,T,C,G,A,,,A,A,A,AT,T,G".split(",")
    assert rows(build(spark, DOC, 4).labels(), "labels") == expected


def test_spectrum_and_lcs_of_the_paper(spark):
    # fixed values: the spectrum and common suffixes of the published example
    nodes = "$$$$,$$$A,GAAA,TAAA,GGAA,GTAA,$ACA,AGGA,GGTA,$$AC,AAAG,ACAG,GTAG,AAGG,CAGG,TAGG,AAGT,AGGT".split(",")
    lcs = [0, 0, 1, 3, 2, 2, 1, 1, 1, 0, 0, 2, 2, 1, 3, 3, 0, 2]
    index = build(spark, PAPER, 4)
    assert rows(index.labels(), "node") == nodes
    assert rows(index.labels(), "lcs") == lcs


@pytest.mark.parametrize("k", [1, 2, 3, 5, 12])
@pytest.mark.parametrize("dummies", [False, True])
def test_against_the_definitions(spark, k, dummies):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(50 + 7 * i)) for i in range(4)] + ["AC", "", "NNN"]
    index = build(spark, seqs, k, all_dummy_paths=dummies)
    nodes = naive.padded(naive.kmers(seqs, k), k, seqs if dummies else None)
    assert rows(index.labels(), "node", "labels", "lcs") == list(zip(nodes, naive.labels(nodes, k), naive.lcs(nodes)))
    assert checks.invariant(index).first().ok
    assert checks.against_sequences(index, sequences.from_values(spark, seqs)).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    seqs = sequences.from_values(spark, PAPER)
    one, many = (KmerIndex.build(seqs.repartition(n), 5) for n in (1, 7))
    assert checks.differs(one.nodes, many.nodes).count() == 0


def test_reverse_complements_and_lower_case(spark):
    index = build(spark, ["aaccß", "GGT"], 3, add_rev_comp=True)
    assert {r.kmer for r in index.kmers().collect()} == naive.kmers(["AACC", "GGTT", "GGT", "ACC"], 3)


def test_empty_and_short_input(spark):
    index = build(spark, ["", "NN", "A"], 4)
    assert rows(index.labels(), "node", "labels") == [("$$$$", "")]
    assert index.stats().first().n_kmers == 0


def test_labels_ranks_and_steps(spark):
    index = build(spark, PAPER, 4)
    sets = rows(index.labels(), "labels")
    ranks = {r.colex: r for r in index.subset_rank().collect()}
    c = {r.label: r.c for r in index.c_array().collect()}
    for x in "ACGT":
        assert [ranks[i][f"rank_{x.lower()}"] for i in range(len(sets))] == [sum(x in s for s in sets[:i]) for i in range(len(sets))]
        assert [r.colex for r in index.subset_select(x).orderBy("nth").collect()] == [i for i, s in enumerate(sets) if x in s]
        assert c[x] == 1 + sum(y < x for s in sets for y in s)
    # an edge leads to the node that the step says, and back
    edges = index.edges_all()
    steps = {(r.colex, r.label): r.target for r in index.lf_step(edges.select(F.col("src").alias("colex"), "label")).collect()}
    assert {(r.src, r.label): r.dst for r in edges.collect()} == steps
    back = {r.colex: r.source for r in index.inverse_lf_step().collect()}
    assert all(back[t] == s for (s, _), t in steps.items()) and back[0] is None
    assert [r.bits for r in index.matrix_rows().orderBy("label").collect()] == ["".join(str(int(x in s)) for s in sets) for x in "ACGT"]


def test_pushed_labels_are_those_of_the_source(spark):
    index = build(spark, PAPER, 4)
    nodes = rows(index.nodes, "node")
    pushed = rows(index.push_labels_forward(index.last_column().withColumnRenamed("last", "label")), "label")
    assert pushed == ["$" if x == "$$$$" else x[-2] for x in nodes]


def test_search_access_and_prefix_table(spark):
    index = build(spark, PAPER, 4)
    asked = spark.createDataFrame([(p,) for p in ("AGG", "AAGT", "", "CCC", "agg", "AAAAAA", "NN")], "pattern string")
    found = {r.pattern: (r.lo, r.hi) for r in search.search(index, asked).collect()}
    assert found == {"AGG": (13, 16), "AAGT": (16, 17), "": (0, 18), "CCC": (None, None), "agg": (13, 16), "AAAAAA": (None, None), "NN": (None, None)}
    nodes = rows(index.nodes, "node")
    table = {r.pmer: (r.lo, r.hi) for r in search.prefix_table(index, 2).collect()}
    assert table == {a + b: naive.interval(nodes, a + b) or (0, 0) for a in "ACGT" for b in "ACGT"}
    on = spark.createDataFrame([("A", "GG"), ("CC", "A"), ("", "AAGT")], "start string, pattern string")
    assert {r.start: r.lo for r in search.search_from(index, on).collect()} == {"A": 13, "CC": None, "": 16}
    assert search.kmer_at_colex(index, 13) == "AAGG"
    with pytest.raises(IndexError):
        search.kmer_at_colex(index, 18)


def test_lookup(spark):
    index = build(spark, PAPER, 4)
    queries = spark.createDataFrame([(1, "AGGTNAAAG"), (2, "A"), (3, "aggt")], "query_id long, seq string")
    assert {r.query_id: r.line for r in search.lookup_lines(index, queries).collect()} == {1: "17 -1 -1 -1 -1 10", 2: "", 3: "17"}
    assert {r.query_id: r.line for r in search.lookup_lines(index, queries, True).collect()} == {1: "100001", 2: "", 3: "1"}
    assert tuple(search.lookup_stats(index, queries).first())[:2] == (7, 3)


def test_counts_of_all_orders(spark):
    seqs = ["ACACTGANNNNNGATANNNNTGNNNAN", "NNNNNNNNNN", "ACCCCCCCNNNNTACNNN", "A" * 300]
    index = build(spark, seqs, 3, all_dummy_paths=True, count=True)
    for d in (1, 2, 3):
        expected = {}
        for s in seqs:
            for i in range(len(s) - d + 1):
                if set(s[i : i + d]) <= set("ACGT"):
                    expected[s[i : i + d]] = expected.get(s[i : i + d], 0) + 1
        assert {r.str: r.n for r in counting.order_counts(index, d).collect() if r.n} == expected
        assert {r.str: r.n for r in counting.string_counts(sequences.from_values(spark, seqs), d).collect()} == expected
    n = [r.n for r in counting.node_counts(index).orderBy("colex").collect()]
    asked = spark.createDataFrame([(0, 4), (2, 2), (1, len(n))], "lo long, hi long")
    assert {(r.lo, r.hi): r.n for r in counting.range_sums(index, asked).collect()} == {(0, 4): sum(n[:4]), (2, 2): 0, (1, len(n)): sum(n[1:])}
    with pytest.raises(ValueError):
        counting.node_counts(build(spark, seqs, 3))


def test_functions(spark):
    df = spark.createDataFrame([("ACGTT", "ACGAA")], "a string, b string")
    got = df.select(
        dna.reverse_complement(F.col("a")), dna.packed(F.col("a"), 5), dna.unpacked(dna.packed(F.col("a"), 5), 5), dna.common_prefix(F.col("a"), F.col("b"), 5), dna.common_suffix(F.col("a"), F.col("b"), 5),
        dna.successor(F.col("a"), F.lit("G")), dna.right_shifted(F.col("a"), 2), dna.left_shifted(F.col("a"), 2), dna.with_char(F.col("a"), 1, "T"), dna.char_idx(F.lit("g")), dna.char_idx(F.lit("N")), dna.bit_width(F.lit(5)), dna.is_dna(F.lit("acgT")), dna.is_dna(F.lit("ACGT\n")), dna.reversed_sanitised(F.lit("ANC")),
    ).first()
    assert tuple(got) == ("AACGT", 0b0001101111, "ACGTT", 3, 0, "CGTTG", "AAACG", "GTTAA", "ATGTT", 2, None, 3, True, False, "C$A")
    dna.register(spark)
    assert spark.sql("SELECT revcomp('AAC'), kmers('ACGNAC', 2), lcs_len('AACG', 'TTCG'), is_dna('N')").first()[:] == ("GTT", ["AC", "CG", "AC"], 2, False)
