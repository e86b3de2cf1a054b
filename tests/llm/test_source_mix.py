import hashlib
import random

from strandlake.llm import source_mix
from tests.llm.help import awkward, words


def plain(rows, cycle=3, passes=3):
    """The mix of (id, text, source) with distinct ids, by plain queues."""
    size = {i: len(words(t)) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: n % cycle + 1 for n, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    budget, capped = sum(total.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        left = budget - sum(passes * total[s] for s in capped)
        target = {s: float(passes * total[s]) if s in capped else left / sum(weight[x] for x in free) * weight[s] for s in sources}
        over = [s for s in free if target[s] >= passes * total[s]]
        if not over:
            break
        capped |= set(over)
    queue = []
    for s in sources:
        run = 0
        for key, n, i in sorted((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), size[i], i) for i, _, x in rows if x == s):
            run += n
            queue += [((p * total[s] + run) / target[s], s is None, s or "", key, n, i, p) for p in range(passes) if n]
    taken, run = dict.fromkeys(size, 0), 0
    for f in sorted(queue):
        run += f[4]
        if run > budget:
            break
        if f[0] <= 1:
            taken[f[5]] += f[4]
    for s in sources:  # up to four of the largest size that fits what is left, four times, each smaller than the one before
        mine = [(q[5], q[4], q[0]) for q in queue if q[6] == 0 and (q[1], q[2]) == (s is None, s or "")]
        left, last = target[s] - sum(taken[i] for i, *_ in mine), float("inf")
        room = [(taken[i] // n, place, i, n) for i, n, place in mine if taken[i] < passes * n and n <= left]
        for _ in range(4):
            last = max((n for *_, n in room if n < last and n <= left), default=0)
            for _, _, i, n in sorted(r for r in room if r[3] == last)[:4]:
                if n <= left:
                    left -= n
                    taken[i] += n
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in rows}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in source_mix.mix(df).collect()}
    expected = plain(rows)
    assert set(got) == set(expected)
    for i, (size, total, target, taken) in expected.items():
        assert got[i][:2] == (size, total) and abs(got[i][2] - target) < 1e-6 * max(1, target) and got[i][3] == taken
    return got


def corpus(seed, n=400):
    rng = random.Random(seed)
    return [(i, "w " * rng.randint(0, 40), rng.choice(["hot"] * 6 + ["é", "a", "Z", None, "b"])) for i in range(n)]


def test_against_plain_queues(spark):
    for seed in (1, 2):
        got = check(spark, corpus(seed))
        assert all(t <= 3 * s for s, _, _, t in got.values())


def test_targets_are_met(spark):
    rows = corpus(3, 3000)
    got = check(spark, rows)
    for s in {x for _, _, x in rows}:
        ids = [i for i, _, x in rows if x == s]
        assert abs(sum(got[i][3] for i in ids) - got[ids[0]][2]) < 120


def test_few_documents_a_source_still_meet_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * int(10 ** rng.uniform(0, 3)), f"s{i % 12}") for i in range(240)]
    got = check(spark, rows)
    for s in {x for _, _, x in rows}:
        ids = [i for i, _, x in rows if x == s]
        assert 0.95 <= sum(got[i][3] for i in ids) / got[ids[0]][2] <= 1 + 1e-9
    assert sum(t for *_, t in got.values()) <= sum(n for n, *_ in got.values())


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "FEW_SOURCES", 3)
    check(spark, corpus(6))


def test_awkward_rows(spark):
    check(spark, [(1, None, "x"), (2, "", "x"), (3, "a", None)])
    check(spark, [(1, None, "x"), (2, " ", None)])
    check(spark, [(1, "a b c d e f g", "x"), (2, "a", "y")])
    df = awkward(spark)
    assert source_mix.mix(df).count() == df.count() and source_mix.mix(df.limit(0)).count() == 0
    out = source_mix.mixed(df)
    assert out.columns == df.columns and out.where("text IS NULL").count() == 0


def test_reruns_agree(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, source string")
    a, b = ({(r.doc_id, r.taken) for r in source_mix.mix(df.repartition(n)).collect()} for n in (1, 6))
    assert a == b
