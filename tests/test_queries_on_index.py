import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import checks, dbg, matching, setops, vodbg
from strandlake.operators.index import KmerIndex, kmers_of
from strandlake.plans import rank
from strandlake.sources import sequences
from tests import naive

FINIMIZER = ["GTAAGTCT", "AGGAAA", "ACAGG", "GTAGG", "AGGTA"]


def build(spark, seqs, k, **options):
    return KmerIndex.build(sequences.from_values(spark, seqs), k, **options)


def ask(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "query_id long, seq string")


def by_query(df, n):
    return [[tuple(r)[2:] for r in df.where(f"query_id = {i}").orderBy("pos").collect()] for i in range(n)]


def test_matching_statistics_of_the_published_example(spark):
    index = build(spark, FINIMIZER, 4)
    got = by_query(matching.matching_statistics(index, ask(spark, "AAGTAA")), 1)[0]
    # fixed values: lengths, sizes of ranges and their 1-based starts
    assert [x[0] for x in got] == [1, 2, 3, 4, 3, 4]
    assert [x[2] - x[1] for x in got] == [7, 3, 1, 1, 1, 1]
    assert [x[1] + 1 for x in got] == [2, 3, 11, 17, 8, 5]
    short = by_query(matching.frequency_bounded_suffixes(index, ask(spark, "AAGTAA", "AANAAGTAA"), 1), 2)
    none = (None, None, None)
    assert short[0] == [none, none, (3, 10, 11), (3, 16, 17), (2, 7, 8), (3, 4, 5)]
    assert short[1] == [none] * 3 + short[0]


@pytest.mark.parametrize("k", [3, 6, 11])
def test_matching_statistics_against_the_definitions(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3)]
    queries = [s[10:40] + "N" + "".join(rng.choice("ACGT") for _ in range(40)) for s in seqs] + ["", "N", "acgt"]
    index = build(spark, seqs, k)
    nodes = naive.padded(naive.kmers(seqs, k), k)
    asked = ask(spark, *queries)
    expected = [naive.matching(nodes, k, q.upper()) for q in queries]
    assert by_query(matching.matching_statistics(index, asked), len(queries)) == expected
    assert by_query(matching.matching_statistics_by_join(index, asked), len(queries)) == expected
    assert by_query(matching.matching_statistics(index, asked, 2), len(queries)) == [naive.matching(nodes, k, q.upper(), 2) for q in queries]
    for t in (1, 4):
        got = by_query(matching.frequency_bounded_suffixes(index, asked, t), len(queries))
        assert got == [[x or (None, None, None) for x in naive.shortest(nodes, k, q.upper(), t)] for q in queries]


@pytest.mark.parametrize("k, cells", [(3, 99), (9, 999), (9, 5), (31, 999), (32, 999)])
def test_lines_are_those_of_the_positions(spark, monkeypatch, k, cells):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(2)]
    queries = [seqs[0][3:60] + "N" + seqs[1][:40], "", "N", "acgt\U0001f9ecé" + seqs[1], seqs[0], "G"]
    rows = [(i, q) for i, q in enumerate(queries)] + [(7, None), (4, "TTNA"), (4, ""), (None, "CAT")]
    index = build(spark, seqs, k)
    monkeypatch.setattr(matching, "FEW_CELLS", cells)
    monkeypatch.setattr(matching, "AT_ONCE", 50)
    asked = spark.createDataFrame(rows, "query_id long, seq string")
    key = lambda r: (r.query_id is not None, r.query_id)
    expected = sorted(matching.ms_lines(matching.matching_statistics(index, asked)).collect(), key=key)
    assert len(expected) == 6 and expected[1].line.startswith("(")
    assert sorted(matching.lines(index, asked).collect(), key=key) == expected
    once = matching.lines(index, asked.where("query_id < 4"))
    assert sorted(once.collect(), key=key) == [r for r in expected if r.query_id is not None and r.query_id < 4]
    if k <= matching.WIDEST and cells > 5:  # no row a position that is shuffled
        assert "Exchange" not in once._jdf.queryExecution().toString() and "Generate" not in once._jdf.queryExecution().toString()


def test_contraction_and_extension(spark):
    index = build(spark, ["AGGTAAA", "ACAGGTAGGAAAGGAAAGT"], 4)
    cut = spark.createDataFrame([("AGG", n) for n in (3, 2, 1, 0)], "str string, len int")
    assert {r.len: (r.lo, r.hi) for r in matching.contract_left(index, cut).collect()} == {3: (13, 16), 2: (13, 16), 1: (10, 16), 0: (0, 18)}
    more = spark.createDataFrame([("AGG", "A"), ("AGGT", "A"), ("AGG", "C")], "str string, label string")
    assert {(r.str, r.label): r.lo for r in matching.extend_right(index, more).collect()} == {("AGG", "A"): 7, ("AGGT", "A"): 8, ("AGG", "C"): None}


CASES = {
    "merge drops a redundant dummy": (["ACTGA"], ["CTGAC"], 5),
    "no repair": (["AAGTACGAAAAAAAAAAACCCC"], ["AAGTACGAAAAAAAAAAATTTT"], 5),
    "repair": (["AGTACGAAAAAAAAAAAAAAA"], ["CGTACGAAAAAAAAAAAAAAA"], 5),
    "dead end": (["ACCTTGGGTACGTTTTTTTTTTTT"], ["ACCTGAGGTACGTTTTTTTTTTTT"], 5),
    "orphan": (["ACAA", "ACGT"], ["ACAC", "ACGT"], 4),
    "dead chain": (["ACCTT"], ["CACCTT"], 5),
    "phantom": (["ACCTT", "AGGGG"], ["AGGGG", "TAGGG"], 5),
    "cycles": (["A" * 12, "ACGACGACG"], ["ACGACGACGT"], 3),
    "empty": ([""], ["ACGT"], 3),
}


@pytest.mark.parametrize("case", CASES)
def test_set_operations_are_builds_from_scratch(spark, case):
    a, b, k = CASES[case]
    x, y = naive.kmers(a, k), naive.kmers(b, k)
    ia, ib = build(spark, a, k, all_dummy_paths=True), build(spark, b, k)
    for op, expected, name in ((setops.union, x | y, "merge"), (setops.intersection, x & y, "intersect"), (setops.difference, x - y, "difference")):
        result = op(ia, ib)
        nodes = naive.padded(expected, k)
        got = result.labels().orderBy("colex").collect()
        assert [(r.node, r.labels, r.lcs) for r in got] == list(zip(nodes, naive.labels(nodes, k), naive.lcs(nodes)))
        sets = [kmers_of(sequences.from_values(spark, s), k) for s in (a, b)]
        assert checks.against_set_operation(result, name, *sets).count() == 0
    s = setops.sizes(ia, ib).first()
    assert (s.n_union, s.n_intersection, s.n_difference) == (len(x | y), len(x & y), len(x - y))
    assert s.jaccard == len(x & y) / len(x | y)


def test_jaccard_of_empty_sets_and_unequal_k(spark):
    a = build(spark, [""], 3)
    assert setops.sizes(a, a).first().jaccard != setops.sizes(a, a).first().jaccard
    with pytest.raises(ValueError):
        setops.union(a, build(spark, ["ACGT"], 4))


def test_graph_of_the_published_example(spark):
    g = dbg.Dbg(build(spark, FINIMIZER, 4))
    assert sorted(r.seq for r in g.unitigs().collect()) == sorted(FINIMIZER)
    d = {r.kmer: (r.outdegree, r.indegree) for r in g.degrees().collect()}
    assert d["ACAG"][1] == 0 and d["AGGA"][1] == d["AGGT"][1] == 2
    assert [r.neighbor for r in g.predecessors().where("kmer = 'AGGT'").orderBy("nth").collect()] == ["CAGG", "TAGG"]
    assert [r.neighbor for r in g.follow_in(1).where("kmer = 'AGGT'").collect()] == ["TAGG"]
    steps = spark.createDataFrame([("ACAG", "G"), ("ACAG", "T")], "kmer string, label string")
    assert {r.label: r.target for r in g.follow_out(steps).collect()} == {"G": "CAGG", "T": None}


@pytest.mark.parametrize("k", [5, 6, 10])
def test_graph_against_the_definitions(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(10)]
    seqs = [s + s[: k - 1] if i < 3 else s for i, s in enumerate(seqs)] + ["A" * 20]
    ks = naive.kmers(seqs, k)
    g = dbg.Dbg(build(spark, seqs, k))
    edges = {(x, x[1:] + c, c) for x in ks for c in "ACGT" if x[1:] + c in ks}
    assert {(r.src, r.dst, r.label) for r in g.edges().collect()} == edges
    assert {(r.kmer, r.labels) for r in g.out_labels().collect()} == {(x, "".join(c for c in "ACGT" if x[1:] + c in ks)) for x in ks}
    got = g.unitigs().collect()
    assert sorted((r.seq, r.is_cycle) for r in got) == naive.unitigs(ks, k)
    assert sum(r.n_kmers for r in got) == len(ks) and sorted(r.unitig_id for r in got) == list(range(len(got)))


@pytest.mark.parametrize("k", [4, 7])
def test_variable_order_graph(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(25)) for _ in range(4)]
    index = build(spark, seqs, k)
    nodes = naive.padded(naive.kmers(seqs, k), k)
    g = vodbg.VoDbg(index)
    held = {d: {x[k - d :] for x in nodes if "$" not in x[k - d :]} for d in range(1, k + 1)}
    for d in range(1, k + 1):
        assert {(r.str, r.lo, r.hi) for r in g.nodes(d).collect()} == {(s, *naive.interval(nodes, s)) for s in held[d]}
        pairs = {(s, s[1:] + c) for s in held[d] for c in "ACGT" if s[1:] + c in held[d] and (d == k or s + c in held[d + 1])}
        assert {(r.str, r.target) for r in g.edges(d).collect()} == pairs
        degree = {(r.str): (r.outdegree, r.indegree) for r in g.degrees(d).collect()}
        assert degree == {s: (sum(a == s for a, _ in pairs), sum(b == s for _, b in pairs)) for s in held[d]}
    assert {(r.str, r.target) for r in g.contract_right(k, 2).collect()} == {(s, s[:2]) for s in held[k]}
    assert {(r.str, r.nth, r.target) for r in g.extend_left(2).collect()} == {(s, n, t) for s in held[2] for n, t in enumerate(sorted((c + s for c in "ACGT" if c + s in held[3]), key=lambda x: x[::-1]))}
    lcs = naive.lcs(nodes)
    for r in vodbg.previous_smaller(index, 2).collect():
        i = r.colex
        assert r.previous == next((j for j in range(i, -1, -1) if lcs[j] < 2), 0)
        assert r.next == next((j for j in range(i, len(nodes)) if lcs[j] < 2), len(nodes))
    whole = spark.createDataFrame([("",), ("AC",), ("N",), ("A" * 20,)], "str string")
    got = {r.str: (r.lo, r.hi) for r in g.get_node(whole).collect()}
    assert got == {"": (0, len(nodes)), "AC": naive.interval(nodes, "AC") or (None, None), "N": (None, None), "A" * 20: (None, None)}


def test_orientation_never_adds_sources(spark):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(120))
    parts = [genome[i : i + 14] for i in range(0, 100, 10)]
    turn = str.maketrans("ACGT", "TGCA")
    mixed = [p[::-1].translate(turn) if rng.random() < 0.5 else p for p in parts]
    k = 5
    df = spark.createDataFrame(list(enumerate(mixed)), "unitig_id long, seq string")
    chosen = {r.unitig_id: r.orientation for r in dbg.orientations(df, k).collect()}

    def sources(seqs):
        return sum(s[: k - 1] not in {t[-(k - 1) :] for t in seqs} for s in seqs)

    turned = [s[::-1].translate(turn) if chosen[i] == "Reverse" else s for i, s in enumerate(mixed)]
    assert set(chosen) == set(range(len(mixed))) and sources(turned) <= sources(mixed)
    assert sources(turned) < sources(mixed) or sources(mixed) <= 2


def test_running_sums_over_many_blocks(spark):
    df = spark.range(500).select(F.col("id").alias("at"), (F.col("id") % 7).alias("v"))
    got = {r.at: r.before_v for r in rank.running_sums(df, "at", ["v"], blocks=4).collect()}
    assert got == {i: sum(j % 7 for j in range(i)) for i in range(500)}
