import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from chronopix.llm import simhash
from chronopix.llm.common import Scratch
from chronopix.llm.components import connected_components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    keys = list(prints)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_fingerprint_equals_brute_force(odd_rows):
    for text in [r[1] for r in odd_rows] + ["A b C d", "É é", "x" * 5000, "a\x0bb\x0cc d e f"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.createDataFrame([("héllo wörld x",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("héllo wörld x".encode(), 42)


def test_components_of_near_fingerprints_equal_brute_force(spark):
    r = random.Random(3)
    prints = [0, 1, 3, (1 << 64) - 1, 1 << 63]
    for _ in range(25):
        p = r.getrandbits(64)
        prints.append(p)
        for _ in range(r.choice([0, 1, 8, 30])):  # crowded buckets take the other way
            p ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                p ^= 1 << r.randrange(64)
            prints.append(p)
    prints = dict(enumerate(dict.fromkeys(prints)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints.values()]
    scratch = Scratch(spark, "test")
    links = simhash.links(spark.createDataFrame(signed, "fp long"), scratch)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).isEmpty()
    found = {x["node"]: x["root"] for x in connected_components(links, scratch).collect()}
    groups = defaultdict(set)
    for (p,) in signed:
        groups[found.get(p, p)].add(p)
    expected = defaultdict(set)
    for k, root in brute_components(prints).items():
        expected[root].add(signed[k][0])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_candidates_are_what_meets_in_a_segment(spark):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:25]:
        prints |= {p ^ 1 << r.randrange(64), p ^ 3 << r.randrange(60), p ^ r.getrandbits(32), p ^ r.getrandbits(32) << 32}
    near = lambda a, b: any(((a ^ b) >> s & 0xFFFFFFFF).bit_count() <= 1 for s in (0, 32))
    expected = {a for a in prints if any(a != b and near(a, b) for b in prints)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    assert {x["fp"] % (1 << 64) for x in simhash.candidates(df, Scratch(spark, "test")).collect()} == expected


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    plans = []

    class Seen(Scratch):
        def keep(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().keep(df, name)

    monkeypatch.setattr(simhash, "Scratch", Seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        r = random.Random(5)
        rows = [(k, " ".join(f"w{r.randrange(50)}" for _ in range(20))) for k in range(100)]
        simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [line for plan in plans for line in [*plan.split("\n"), ""]]
    depth = [re.match(r"[\s:+\-*()\d]*", line).end() for line in lines]
    assert sum("Generate" in line for line in lines) >= 4
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next(j for j in range(i + 1, len(lines)) if depth[j] <= depth[i])
            assert not [x for x in lines[i:end] if "Generate" in x]


def test_components_of_chains_stars_and_nothing(spark):
    scratch = Scratch(spark, "test")
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and len(got) == 101
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).isEmpty()


def test_query_equals_brute_force(spark, sf):
    from chronopix.llm.queries import op1_simhash

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: brute_fingerprint(t) for k, t in sorted(texts.items())}
    expected = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, sf).collect()}
    assert got == {k: (f"{p:016x}", expected[k]) for k, p in prints.items()}


def test_odd_rows_and_empty_table(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 13
    by = {r["id"]: r["component"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[None] == 4 and by[6] == 6
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_class_stays(odd, empty):
    kept = simhash.keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7, 8, 9, 10, 11]
    assert simhash.keep_one_each(empty).count() == 0


def test_rows_of_one_id_go_by_their_own_text(spark):
    a, b, c = ("alpha beta gamma delta " * 3, "one two three four five six", "seven eight nine ten eleven")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (2, b, "x"), (2, c, "x"), (3, a, "x"), (None, c, "x"), (4, "all on its own here", "x"), (4, "all on its own here", "x")]
    kept = simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(tuple, kept)) == [(1, a, "x"), (1, b, "w"), (2, c, "x"), (4, "all on its own here", "x")]


def test_ids_of_any_kind_maps_and_a_key_column(spark):
    text, other = "alpha beta gamma delta " * 3, "one two three four five six"
    rows = [("b", text, {"k": 1}, 7), ("a", text, {"k": 2}, 8), ("a", other, {"k": 3}, 9), (None, other, {"k": 4}, 1), ("c", "", {}, 2), ("c", "", {}, 2), ("d", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, m map<string,int>, _key int").repartition(3)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["m"], r["_key"]) for r in kept.collect()), key=str) == [("a", {"k": 2}, 8), ("a", {"k": 3}, 9), ("c", {}, 2)]
    assert {r["id"]: r["component"] for r in simhash.near_duplicates(docs.where("text like 'alpha%'")).collect()} == {"a": "a", "b": "a"}


def test_keys_beyond_the_broadcast_are_joined_alike(spark, odd, monkeypatch):
    from chronopix.llm import common

    few = sorted(str(tuple(r)) for r in simhash.keep_one_each(odd).collect())
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert sorted(str(tuple(r)) for r in simhash.keep_one_each(odd).collect()) == few


def test_tables_have_fingerprints_of_their_own(odd_rows):
    def mixed(h, table):
        z, top = (h + 0x9E3779B97F4A7C15 * table) % (1 << 64), 1 << 64
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % top
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % top
        return z ^ (z >> 31)

    for text in {r[1] for r in odd_rows} | {"a b c d e f g", "one", None}:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        slow = lambda hs: sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in hs) > len(hs)) if len(hs) < 2000 else None
        got = simhash.table_fingerprints(text, tables=3)
        assert got[0] == simhash.fingerprint(text)
        for t in (1, 2):
            expected = slow([mixed(v, t) for v in h])
            assert expected is None or got[t] == expected


def test_links_of_any_table_equal_brute_force(spark):
    r, top = random.Random(11), 1 << 64
    base = [[r.getrandbits(64) for _ in range(3)] for _ in range(60)]
    rows = set()
    for k, b in enumerate(base):
        rows.add(tuple(b))
        for _ in range(r.randrange(6)):  # near ones, by few bits or many in each table
            near = [v ^ sum(1 << i for i in r.sample(range(64), r.choice((0, 1, 2, 3, 6)))) for v in b]
            rows.add(tuple(near))
        if k % 7 == 0:  # the same in one table only, and the same first fingerprint with others
            rows.add((r.getrandbits(64), b[1], r.getrandbits(64)))
            rows.add((b[0], r.getrandbits(64), r.getrandbits(64)))
    signed = [tuple(v - top if v >> 63 else v for v in x) for x in rows]
    nodes = sorted({x[0] for x in signed})
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x in signed:
        for y in signed:
            if any(((u ^ v) % top).bit_count() <= 2 for u, v in zip(x, y, strict=True)):
                a, b = sorted((find(x[0]), find(y[0])))
                root[b] = a
    scratch = Scratch(spark, "test")
    prints = spark.createDataFrame(signed, "fp long, f1 long, f2 long")
    got = simhash.roots(prints.select("fp").distinct(), scratch, simhash.table_links(prints, scratch, 3)).collect()
    assert {x["fp"]: x["root"] for x in got} == {n: find(n) for n in nodes}


def test_more_tables_find_more_near_copies(spark):
    r = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(150)]
        rows.append((2 * k, " ".join(words)))
        words[r.randrange(150)] = "changed"
        words[r.randrange(150)] = "again"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [{x["doc_id"] for x in simhash.keep_one_each(docs, tables=t).collect()} for t in (1, 3)]
    assert kept[1] < kept[0] and {2 * k for k in range(40)} <= kept[1]
