"""SimHash groups against all pairs, whatever the buckets."""

import random
import re

import duckdb
import pytest
import xxhash
from kinetrail.llm import simhash, texts

from .fixtures import SCHEMA, awkward


def brute_print(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_groups(pairs, radius):
    """{(node, comp)} of nodes (id, fp), linked within radius or by equal ids."""
    root = {n: n for n in pairs}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for x in pairs:
        for y in pairs:
            if (x[1] ^ y[1]).bit_count() <= radius or x[0] == y[0]:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {(*n, find(n)[0]) for n in pairs}


def near(rng, fp, most):
    for k in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << k
    return fp


def prints(seed, n=300):
    """Chains at distances about the radius, a dense ball, edges of the word, strangers."""
    rng, out = random.Random(seed), {0, 1, (1 << 64) - 1, 1 << 63, 15 << 60, 31}
    while len(out) < n // 3:
        fp = rng.getrandbits(64)
        for _ in range(6):
            out.add(fp)
            fp = near(rng, fp, 5)
    centre = rng.getrandbits(64)
    while len(out) < n * 2 // 3:
        out.add(near(rng, centre, 3))
    while len(out) < n:
        out.add(rng.getrandbits(64))
    out = sorted(out)
    rng.shuffle(out)
    return list(enumerate(out))


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("options", [{}, {"radius": 2, "prefix": 3}, {"bound": 3000, "prefix": 4}, {"bound": 100, "prefix": 4, "deeper": 25}, {"radius": 0}])
def test_links_join_what_all_pairs_join(spark, options):
    rows, radius = prints(len(options)), options.get("radius", 4)
    df = spark.createDataFrame([(signed(fp), k) for k, fp in rows], "fp long, rep long")
    by, found = dict(rows), {}
    for a, b in ((r["a"], r["b"]) for r in simhash.ball_links(df, **options).collect()):
        found.setdefault(a, set()).add(b)
        found.setdefault(b, set()).add(a)
    reach = {}
    for k, _ in rows:
        if k not in reach:
            stack, reach[k] = [k], k
            while stack:
                for other in found.get(stack.pop(), ()):
                    if other not in reach:
                        reach[other] = k
                        stack.append(other)
    assert {(k, by[k], c) for k, c in reach.items()} == brute_groups(rows, radius)


def test_a_dense_ball_is_split_and_linked_once(spark):
    """3,000 fingerprints in one ball: as many links at most a bucket as it has fingerprints, one component."""
    rng = random.Random(9)
    centre, out = rng.getrandbits(64), set()
    while len(out) < 3000:
        out.add(near(rng, centre, 4))
    df = spark.createDataFrame([(signed(fp), k) for k, fp in enumerate(sorted(out))], "fp long, rep long")
    links = simhash.ball_links(df, bound=200_000)
    assert links.count() < 3000 * 2081 // 20
    assert simhash.components(links).select("comp").distinct().count() == 1


def test_awkward_documents(spark):
    rows = awkward() + [(400, " ".join("abcdefgh"[k % 8] * 3 + str(k % 3) for k in range(500))), (401, "a B\tc"), (402, "A b C"), (403, "a b")]
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    words = rows[3][1].split()
    for k in range(20):  # near copies
        words[k * 3 % len(words)] = f"w{k}"
        rows.append((500 + k, " ".join(words), *[None] * 6))
    rows += [(9, "another text of number nine " * 4, *[None] * 6)]
    df = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    nodes = {(r[0], brute_print(r[1])) for r in rows if r[0] is not None}
    comp = {(i, fp): c for i, fp, c in brute_groups(sorted(nodes), 4)}
    want = sorted(((r[0], f"{brute_print(r[1]):016x}", comp.get((r[0], brute_print(r[1])))) for r in rows), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_small_documents(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    comp = {i: (f"{fp:016x}", c) for i, fp, c in brute_groups(rows, 4)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op12_simhash(spark, small_dir).collect()}
    assert got == comp


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slices_do_not_show(monkeypatch):
    samples = ["", " \t", "a", "a b c", "a b c d", "x" * 300, " ".join(f"w{k % 7}" for k in range(200))]
    for size in (1, 3, 40):
        cut = lambda t, word, gap, size=size: texts.word_slices(t, word, gap, size)
        monkeypatch.setattr(simhash, "word_slices", cut)
        assert [simhash.fingerprint(s.encode()) for s in samples] == [brute_print(s) for s in samples]


def test_sql_hashes_are_xxh64():
    rng, con = random.Random(1), duckdb.connect()
    strings = {"".join(rng.choices("abcdé ß😀xyz", k=k)) for k in range(80)}
    con.execute("CREATE TABLE t (s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(s,) for s in strings])
    found = con.execute(f"WITH x0 AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM t), {simhash._xxh64_sql()} SELECT s, h FROM xh").fetchall()
    assert dict(found) == {s: xxhash.xxh64_intdigest(s.encode(), 42) for s in strings}


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.simhash_groups(spark.createDataFrame([], SCHEMA), radius=3)
