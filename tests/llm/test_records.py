"""Splits and cross-split overlap against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gatewarden.llm import bitwise, overlap, splits
from gatewarden.llm.bitwise import lcs_length
from gatewarden.llm.fold import is_solid, tokens


def _components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for a, b in pairs:
        if a and b:
            by[b].append(a)
    for group in by.values():
        for x in group[1:]:
            a, b = find(group[0]), find(x)
            parent[max(a, b)] = min(a, b)
    return find


def test_components_against_union_find(spark):
    r = random.Random(1)
    pairs = [(f"p{r.randrange(60):02d}", f"s{r.randrange(70)}") for _ in range(90)] + [(f"q{i:03d}", f"c{i // 2 * 2 if k else (i + 1) // 2 * 2 + 1}") for i in range(40) for k in (0, 1)]
    pairs += [(None, "s1"), ("lone", None), ("p01", "s1")] * 30
    df = spark.createDataFrame(pairs, "left string, right string")
    find = _components(pairs)
    got = {r.node: r.root for r in splits.components(splits.ties(df)).collect()}
    assert all(find(k) == v for k, v in got.items())
    nodes = {a for a, b in pairs if a}
    assert {x for x in nodes if any(find(x) == find(y) and x != y for y in nodes)} == set(got)
    want = {(x, y) for x in nodes for y in nodes if x < y and find(x) == find(y)}
    assert {tuple(x) for x in splits.linked_pairs(splits.components(splits.ties(df))).collect()} == want


def test_no_links(spark):
    df = spark.createDataFrame([("a", "s"), ("b", "t"), (None, None)], "left string, right string")
    assert splits.components(splits.ties(df)).count() == 0


def test_session_keys(spark):
    ok = "f82b0bb8f216fd0a57f76ec2199ce707"
    values = [ok, ok.upper() + "\n", "0" * 32, "null", "", None, ok[:-1], ok[:-1] + "g"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(splits.session_key(F.col("s"))).collect()] == [ok, ok] + [None] * 6


def test_sums_beyond_the_bitset_are_exact_where_small_sizes_allow():
    for sizes, target in (([(1, 30), (7, 2_000_000), (999_983, 9)], 5_000_010), ([(3, 4_000_000), (5, 900_000), (1_000_003, 12)], 17_994_000), ([(2, 10_000_000)], 4_000_001)):
        got = splits.closest_sum(sizes, target)
        assert all(0 <= got[s] <= dict(sizes)[s] for s in got)
        assert abs(sum(s * n for s, n in got.items()) - target) == (1 if sizes[0][0] == 2 else 0)


def test_closest_sums():
    r = random.Random(2)
    for _ in range(100):
        sizes = [(s, r.randint(1, 4)) for s in r.sample(range(1, 30), r.randint(1, 4))]
        target = r.uniform(0, sum(s * m for s, m in sizes))
        sums = {0}
        for s, m in sizes:
            sums = {x + s * k for x in sums for k in range(m + 1)}
        got = splits.closest_sum(sizes, target)
        assert all(0 <= got[s] <= dict(sizes)[s] for s in got)
        assert abs(sum(s * k for s, k in got.items()) - target) <= min(abs(x - target) for x in sums) + 0.5 + 1e-9
    assert splits.closest_sum([], 5) == {}
    big = splits.closest_sum([(1, 10_000_000), (999_983, 3)], 1_500_000, max_bits=1 << 12)
    assert abs(sum(s * k for s, k in big.items()) - 1_500_000) < 50_000


def test_splits_keep_links_together(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "hot"] + [f"p{r.randrange(80)}"] * 6), r.choice([None, f"s{r.randrange(400)}"]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, pub string, ses string, split string")
    out = {x.id: (x.component, x.split) for x in splits.assign_splits(df, "id", F.col("pub"), F.col("ses")).collect()}
    assert len(out) == len(rows)
    for col in (1, 2):
        seen = defaultdict(set)
        for row in rows:
            if row[col]:
                seen[row[col]].add(out[row[0]][1])
        assert all(len(v) == 1 for v in seen.values())
    empty = spark.createDataFrame([], df.schema)
    assert splits.assign_splits(empty, "id", F.col("pub"), F.col("ses")).count() == 0


def test_split_shares(spark):
    rows = [(i, f"p{i // 7}", f"s{i // 7}", "x") for i in range(7000)]
    df = spark.createDataFrame(rows, "id bigint, pub string, ses string, split string")
    n = {r.split: r["count"] for r in splits.assign_splits(df, "id", F.col("pub"), F.col("ses")).groupBy("split").count().collect()}
    assert n == {"train": 5600, "validation": 700, "test": 700}


def test_overlap_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    texts = []
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.randint(6, 40))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            near = [w for w in base if r.random() > r.choice((0.02, 0.1, 0.25))]
            for _ in range(r.randrange(4)):
                near.insert(r.randrange(len(near) + 1), r.choice(words))
            texts.append(" ".join(near).upper() + "!")
    texts += ["字" * 5 + "日本語の文章をここに書いて三十文字以上にするための例です" + str(i) for i in range(3)] + [None, "", "a a a a a a a a a a a a", "a a a a a a a a a a a"]
    rows = [(f"id{i:03d}", t, r.choice(["train", "train", "test", "validation", None])) for i, t in enumerate(texts)]
    rows += [(f"hot{i:02d}", texts[0], r.choice(["train", "test"])) for i in range(30)]
    both = overlap.Overlap(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s")
    pairs = both.pairs()
    got = {(x.train_key, x.eval_key): x.coverage for x in pairs.collect()}
    assert len(got) == pairs.count()
    use = [(k, tokens(t), s) for k, t, s in rows if t and s and len(tokens(t)) >= (overlap.LEAST_CHARS if is_solid(t) else overlap.LEAST_WORDS)]
    want = {}
    for k, a, s in use:
        for k2, b, s2 in use:
            if s == "train" and s2 != "train":
                c = lcs_length(a, b) / max(len(a), len(b))
                if c >= 0.8 - 1e-9:
                    want[k, k2] = c
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    rates = {r.k: (r.n, r.coverage) for r in both.coverage().collect()}
    assert {k: n for k, (n, _) in rates.items()} == Counter(e for _, e in want)
    best = defaultdict(float)
    for (k, e), c in want.items():
        sizes = {x: len(w) for x, w, _ in use}
        best[e] = max(best[e], c * max(sizes[k], sizes[e]) / sizes[e])
    assert all(best[e] - 1e-9 <= c <= 1 for e, (_, c) in rates.items())


def test_hot_classes_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COPIES", 7)
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(f"a{i:02d}", text, "train" if i % 3 else "test") for i in range(60)]
    assert overlap.cross_split(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").distinct().count() == 20 * 40


def test_halves_in_two_training_texts_cover_the_whole(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [("e", " ".join(words), "test"), ("a", " ".join(words[:45]), "train"), ("b", " ".join(words[6:]), "train"), ("c", " ".join(words[:30]), "train")]
    got = overlap.Overlap(spark.createDataFrame(rows, "k string, t string, s string"), "k", "t", "s").coverage().collect()
    assert [tuple(r) for r in got] == [("e", 2, 1.0)]


def test_places_of_the_common_subsequence():
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(2))
        rows = bitwise.lcs_rows(bitwise.masks(a), len(a), b)
        places = bitwise.lcs_places(rows, len(a))
        it = iter(b)
        assert len(places) == lcs_length(a, b) == len(set(places)) and all(a[p] in it for p in places)


def test_overlap_of_nothing(spark):
    df = spark.createDataFrame([("a", "one two three four five six seven eight nine ten", "train")], "k string, t string, s string")
    assert overlap.cross_split(df, "k", "t", "s").count() == 0
    assert overlap.cross_split(df.where("k = 'z'"), "k", "t", "s").count() == 0
