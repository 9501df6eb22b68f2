import random
import re

from gridloom.llm import neardup
from gridloom.llm.common import among, id_filter
from tests.llm import cases


def brute(rows, width, percent):
    sets, node = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
        node[i] = i

    def find(x):
        while node[x] != x:
            x = node[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                    node[y] = x
    return sorted([(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)], key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def corpus(seed, groups=12, most=90):
    """Groups of copies and near copies, chains, a passage that many share, unrelated texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(25)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 4, 9, 40, 120]))]
        for _ in range(r.choice([1, 2, 5, most if g < 2 else 8])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.1:
                base = t  # a chain
            if r.random() < 0.2:
                t = t[: len(t) * 9 // 10]
            texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(12)] + passage) for _ in range(80)]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for seed, width in ((1, 4), (2, 5)):
        rows = corpus(seed)
        assert got(neardup.near_duplicates(cases.docs(spark, rows), width, 80)) == brute(rows, width, 80)


def test_hard_rows(spark):
    df = cases.hard(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = neardup.near_duplicates(df, 4, 80)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute(rows, 4, 80)
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0


def test_truncated_copies_at_the_threshold(spark):
    """Pairs of a text and its first 80 % of shingles: the sketch of the union must be cut in the sketches' own order."""
    r = random.Random(5)
    rows = []
    for i in range(700):
        n = r.choice(range(50, 111, 5))
        words = [f"w{i}x{j}" for j in range(n + 3)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: n * 4 // 5 + 3]))]
    out = neardup.near_duplicates(cases.docs(spark, rows), 4, 80).collect()
    assert [r.doc_id for r in out if r.component_id != r.doc_id // 2 * 2] == []


def test_short_templates_with_many_variants(spark):
    """Four shingles against the same with one more, with all lists long: they need not have three consecutive names in common."""
    rows = []
    for g in range(12):
        base = [f"t{g}w{j}" for j in range(7)]
        for extra in [[], *[[f"v{g}x{v}"] for v in range(80)]]:
            rows.append((len(rows), " ".join(base + extra)))
        for v in range(40):  # ahead of the text
            rows.append((len(rows), " ".join([f"u{g}x{v}", *base])))
    assert got(neardup.near_duplicates(cases.docs(spark, rows), 4, 80)) == brute(rows, 4, 80)


def test_the_bitmap_goes_before_the_exact_filter(spark):
    """Semi and anti joins would be moved below it and shuffle every text."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = cases.docs(spark, [(i, f"text {i}") for i in range(50)] + [(None, "no id"), (7, "again")]).selectExpr("*", "1 as _in", "2 as _b", "3 as _w")
        ids = spark.range(0, 50, 7).selectExpr("id as doc_id")
        maybe, surely = id_filter(ids, "doc_id")(df, "doc_id")
        inside, outside = among(maybe, ids, ["doc_id"]), among(maybe, ids, ["doc_id"], present=False)
        assert sorted(r.doc_id for r in inside.collect()) == [0, 7, 7, 14, 21, 28, 35, 42, 49]
        assert inside.count() + outside.count() + surely.count() == 52 and inside.columns == df.columns
        for out in (inside, outside):
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("doc_id#") < plan.index("getbit") and "LeftSemi" not in plan and "LeftAnti" not in plan
            joins = [line for line in plan.splitlines() if "Join" in line]
            assert "getbit" in joins[1] and "getbit" not in joins[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
